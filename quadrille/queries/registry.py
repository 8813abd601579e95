"""The queries of the core by name."""

from __future__ import annotations

from quadrille.queries import admin, data, published, reference
from quadrille.queries.data_sql import SQL as DATA_SQL
from quadrille.queries.reference_sql import SQL as REFERENCE_SQL

FLAGSHIP = reference.QUERIES["valid_nanopubs"]

_DATA = {k: v for k, v in vars(data).items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def queries() -> dict:
    return _DATA | reference.QUERIES | published.QUERIES | admin.QUERIES


def oracle_sql() -> dict[str, str]:
    return DATA_SQL | REFERENCE_SQL | published.SQL | admin.SQL
