"""Quads as a table, terms as columns, and the sources that patterns are matched against."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.sparql.parser import XSD

QUAD_COLUMNS = ["repo", "g", "s", "p", "o", "o_kind", "o_dt", "o_lang"]
QUADS = T.StructType([T.StructField(c, T.StringType()) for c in QUAD_COLUMNS])

# Namespaces of the data model.
NS = {
    "npa": "http://purl.org/nanopub/admin/",
    "npx": "http://purl.org/nanopub/x/",
    "np": "http://www.nanopub.org/nschema#",
    "dct": "http://purl.org/dc/terms/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": XSD,
    "foaf": "http://xmlns.com/foaf/0.1/",
    "pav": "http://purl.org/pav/",
    "gen": "https://w3id.org/kpxl/gen/terms/",
}


def ns(name: str) -> str:
    """The IRI of a prefixed name of NS."""
    p, _, local = name.partition(":")
    return NS[p] + local


def term(kind: Column | str, v: Column, dt: Column | str = "", lang: Column | str = "") -> Column:
    """A term as a struct without nulls inside; null if the value is null."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit(""))
    return F.when(v.isNotNull(), F.struct(lit(kind).alias("k"), F.coalesce(v, F.lit("")).alias("v"), lit(dt).alias("dt"), lit(lang).alias("lang")))


def node_term(v: Column) -> Column:
    """The term of an IRI or blank node given as a string."""
    return term(F.when(v.startswith("_:"), "bnode").otherwise("iri"), v)


def quads_of(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Quads from (repo, g, s, p, o, o_kind[, o_dt[, o_lang]]) tuples."""
    return spark.createDataFrame([tuple(r) + ("",) * (8 - len(r)) for r in rows], QUADS)


class QuadSource:
    """What patterns are matched against. scan() gives QUAD_COLUMNS for the bound positions; an object is bound as
    (kind, value, datatype, language)."""

    def scan(self, repo: str | None, g: str | None, s: str | None, p: str | None, o: tuple | None) -> DataFrame:
        raise NotImplementedError

    def star(self, repo: str | None, g: str | None, preds: list[str]) -> tuple[DataFrame, dict[str, tuple]] | None:
        """One scan for several predicates of a subject, if the source can: the table with g, s and a column per
        predicate, and for each predicate (column, kind, datatype)."""
        return None


class FlatQuads(QuadSource):
    """A table of quads. Bound positions become filters that reach the Parquet scan."""

    def __init__(self, quads: DataFrame):
        missing = [c for c in QUAD_COLUMNS if c not in quads.columns]
        self.quads = quads.select(*(F.coalesce(c, F.lit("")).alias(c) if c in ("o_dt", "o_lang") and c not in missing else F.lit("").alias(c) if c in missing else F.col(c) for c in QUAD_COLUMNS))

    def scan(self, repo, g, s, p, o):
        df = self.quads
        for c, v in (("repo", repo), ("g", g), ("s", s), ("p", p)):
            if v is not None:
                df = df.where(F.col(c) == v)
        if o is not None:
            df = df.where((F.col("o") == o[1]) & (F.col("o_kind") == o[0]))
            if o[0] == "lit":
                df = df.where((F.col("o_dt") == o[2]) & (F.col("o_lang") == o[3]))
        return df


@dataclass(frozen=True)
class Mapping:
    """One predicate of the rows of a table: subject and object as columns of ``df``. Null subjects or objects give
    no quad. ``single``: each subject has one row at most."""

    df: DataFrame
    g: str
    s: Column
    p: str
    o: Column
    kind: str = "lit"
    dt: str = XSD + "string"
    repo: str = "full"
    table: str = ""
    single: bool = True


class MappedQuads(QuadSource):
    """Tables seen as quads. A pattern with a predicate reads only the tables and columns mapped to it, and several
    predicates of one subject that come from one table are read by one scan instead of self-joins."""

    def __init__(self, spark: SparkSession, mappings: list[Mapping]):
        self.spark, self.mappings = spark, mappings

    def _fitting(self, repo, g, p):
        return [m for m in self.mappings if (repo is None or m.repo == repo) and (g is None or m.g == g) and (p is None or m.p == p)]

    def scan(self, repo, g, s, p, o):
        out = None
        for m in self._fitting(repo, g, p):
            if o is not None and (o[0] != m.kind or m.kind == "lit" and o[2] != m.dt):
                continue
            cols = [F.lit(m.repo).alias("repo"), F.lit(m.g).alias("g"), m.s.alias("s"), F.lit(m.p).alias("p"), m.o.cast("string").alias("o"), F.lit(m.kind).alias("o_kind"), F.lit(m.dt if m.kind == "lit" else "").alias("o_dt"), F.lit("").alias("o_lang")]
            df = m.df.select(*cols).where("s is not null and o is not null")
            if s is not None:
                df = df.where(F.col("s") == s)
            if o is not None:
                df = df.where(F.col("o") == o[1])
            out = df if out is None else out.unionAll(df)
        return out if out is not None else self.spark.createDataFrame([], QUADS)

    def star(self, repo, g, preds):
        found = [self._fitting(repo, g, p) for p in preds]
        if len(set(preds)) < len(preds) or any(len(f) != 1 for f in found):
            return None
        ms = [f[0] for f in found]
        if len({(m.table, m.g, m.repo) for m in ms}) > 1 or not ms[0].table or not all(m.single for m in ms):
            return None
        df = ms[0].df.select(F.lit(ms[0].repo).alias("repo"), F.lit(ms[0].g).alias("g"), ms[0].s.alias("s"), *(m.o.cast("string").alias(f"o{k}") for k, m in enumerate(ms))).where("s is not null")
        for k in range(len(ms)):
            df = df.where(F.col(f"o{k}").isNotNull())
        return df, {m.p: (f"o{k}", m.kind, m.dt if m.kind == "lit" else "") for k, m in enumerate(ms)}
