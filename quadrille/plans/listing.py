"""Listings of shards and spaces, and where to ask."""

from __future__ import annotations

import hashlib
import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repos(shard_rows: DataFrame) -> DataFrame:
    return shard_rows.select("repo").distinct().orderBy("repo")


def repo_for(type_iri: str | None = None, pubkey: str | None = None) -> str:
    """The shard of a type or key."""
    kind, v = ("type", type_iri) if type_iri is not None else ("pubkey", pubkey)
    return f"{kind}_{hashlib.sha256((v or '').encode()).hexdigest()}"


def spaces(refs: DataFrame) -> DataFrame:
    return refs.select("space", "ref", "root_np").distinct().orderBy("space", "ref")


def spaces_json(refs: DataFrame) -> DataFrame:
    return spaces(refs).select(F.to_json(F.struct(F.col("space").alias("space_iri"), F.col("ref").alias("space_ref"), F.col("root_np").alias("root_nanopub"))).alias("value"))


def spaces_html(refs: DataFrame) -> DataFrame:
    """A table row per space, escaped."""

    def esc(c):
        for a in "&<>\"'":
            c = F.replace(c, F.lit(a), F.lit(html.escape(a)))
        return c

    cell = lambda c: F.concat(F.lit("<td>"), esc(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    return spaces(refs).select(F.concat(F.lit("<tr>"), cell("space"), cell("ref"), F.lit("</tr>")).alias("value"))
