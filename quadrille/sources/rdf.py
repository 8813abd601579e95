"""Quads from N-Quads and TriG text, and nanopubs from quads."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.text import artifact_code
from quadrille.model import ns
from quadrille.sparql.parser import XSD, Parser, SparqlError

TYPE = ns("rdf:type")
QUAD_POS = "source string, pos long, g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Quads files (compressed or not) by regular expressions alone; lines that are none are left out."""
    node = r"(?:<([^>]*)>|(_:\S+))"
    line = rf'^\s*{node}\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([\w-]+))?)\s*(?:{node})?\s*\.\s*(?:#.*)?$'
    get = lambda k: F.nullif(F.regexp_extract("value", line, k), F.lit(""))
    t = spark.read.text(path).where(F.col("value").rlike(line))
    lit = F.col("value").rlike(r'^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+"')
    text = F.regexp_extract("value", line, 6)
    for a, b in ((r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", r"\\")):
        text = F.regexp_replace(text, a, b)
    dt = F.when(get(8).isNotNull(), ns("rdf:langString")).otherwise(F.coalesce(get(7), F.lit(XSD + "string")))
    return t.select(
        F.coalesce(get(9), get(10), F.lit("")).alias("g"), F.coalesce(get(1), get(2)).alias("s"), get(3).alias("p"), F.when(lit, text).otherwise(F.coalesce(get(4), get(5))).alias("o"),
        F.when(lit, "lit").when(get(5).isNotNull(), "bnode").otherwise("iri").alias("o_kind"), F.when(lit, dt).otherwise("").alias("o_dt"), F.when(lit, F.lower(F.coalesce(get(8), F.lit("")))).otherwise("").alias("o_lang"),
    )


def parse_trig(text: str) -> list[tuple]:
    """(g, s, p, o, o_kind, o_dt, o_lang) of a TriG document in the order of its statements."""
    p, out = Parser(""), []
    from quadrille.sparql.parser import tokens

    p.toks = tokens(text)

    def emit(triples: list, g: str) -> None:
        for s, pred, o in triples:
            name = lambda t: t[1] if t[0] == "iri" else "_:" + t[1]
            if s[0] == "lit":
                raise SparqlError("literal as subject")
            obj = (o[1], "lit", o[2], o[3]) if o[0] == "lit" else (name(o), "iri" if o[0] == "iri" else "bnode", "", "")
            out.append((g, name(s), pred[1], *obj))

    def block(g: str) -> None:
        p.need("{")
        while not p.take("}"):
            if not p.take("."):
                triples: list = []
                p.triples(triples, False)
                emit(triples, g)

    while p.at < len(p.toks):
        kind, v = p.toks[p.at]
        if kind == "lang" and v in ("@prefix", "@base") or p.peek("PREFIX", "BASE"):
            p.at += 1
            if v.lstrip("@").upper() == "PREFIX":
                prefix = p.next().rstrip(":")
                p.prefixes[prefix] = p.next()[1:-1]
            else:
                p.base = p.next()[1:-1]
            p.take(".")
        elif p.peek("{"):
            block("")
        else:
            p.take("GRAPH")
            start, before = p.at, len(p.toks)
            t = p.term() if p.kind() in ("iri", "name", "bnode") else None
            if t and p.peek("{"):
                block(t[1] if t[0] == "iri" else "_:" + t[1])
            else:
                assert before
                p.at = start
                triples = []
                p.triples(triples, False)
                emit(triples, "")
    return out


def read_trig(spark: SparkSession, path: str) -> DataFrame:
    """Quads of TriG files, plain or gzipped; one that cannot be parsed raises an error that names it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, content in zip(b["path"], b["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                try:
                    out += [(source, k, *q) for k, q in enumerate(parse_trig(data.decode()))]
                except SparqlError as e:
                    raise SparqlError(f"{source}: {e}") from e
            yield pd.DataFrame(out, columns=["source", "pos", "g", "s", "p", "o", "o_kind", "o_dt", "o_lang"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, QUAD_POS)


def nanopubs(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nanopubs and their content from quads (g, s, p, o, o_kind, pos).

    A nanopub is named by its head graph, which also names the other three. Its types are those it states itself, the
    predicate of all its assertion's statements if it is one, and the classes of the assertion's subject if it is one."""
    q = quads
    head = q.where(F.col("p").isin(ns("np:hasAssertion"), ns("np:hasProvenance"), ns("np:hasPublicationInfo")))
    part = lambda p: F.max(F.when(F.col("p") == ns(p), F.col("o")))
    n = head.groupBy(F.col("s").alias("np"), F.col("g").alias("head_g")).agg(part("np:hasAssertion").alias("assertion_g"), part("np:hasProvenance").alias("provenance_g"), part("np:hasPublicationInfo").alias("pubinfo_g")).dropna()
    n = n.withColumn("code", artifact_code("np"))
    graphs = n.select("np", F.explode(F.array(*(F.struct(F.col(f"{x}_g").alias("g"), F.lit(x).alias("part")) for x in ("head", "assertion", "provenance", "pubinfo")))).alias("x")).select("np", "x.g", "x.part")
    content = q.join(graphs, "g").select("np", "part", "pos", "g", "s", "p", "o", "o_kind", "o_dt", "o_lang")
    info = content.where("part = 'pubinfo'")
    own = info.where("s = np")
    sig = info.where(F.col("p") == ns("npx:hasPublicKey")).join(info.where(F.col("p") == ns("npx:hasSignatureTarget")).where("o = np").select("np", "s"), ["np", "s"], "left_semi").groupBy("np").agg(F.min("o").alias("pubkey"))
    signer = info.where(F.col("p") == ns("npx:signedBy")).groupBy("np").agg(F.when(F.countDistinct("o") == 1, F.min("o")).alias("signer"))
    one = lambda p, c, f=F.col("o"): own.where(F.col("p") == ns(p)).groupBy("np").agg(F.min(f).alias(c))
    many = lambda p, c: own.where((F.col("p") == ns(p)) & (F.col("o_kind") == "iri")).groupBy("np").agg(F.sort_array(F.collect_set("o")).alias(c))
    a = content.where("part = 'assertion'")
    stated = own.where(F.col("p").isin(TYPE, ns("npx:hasNanopubType")) & (F.col("o_kind") == "iri") & (F.col("o") != ns("np:Nanopublication"))).select("np", F.col("o").alias("t"))
    shape = a.groupBy("np").agg(F.countDistinct("p").alias("np_"), F.min("p").alias("p1"), F.countDistinct("s").alias("ns_"))
    single = shape.where("np_ = 1").select("np", F.col("p1").alias("t"))
    classes = a.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).join(shape.where("ns_ = 1").select("np"), "np", "left_semi").select("np", F.col("o").alias("t"))
    types = stated.unionByName(single).unionByName(classes).groupBy("np").agg(F.sort_array(F.collect_set("t")).alias("types"))
    parts = [sig, signer, one("dct:created", "created", F.col("o").try_cast("timestamp")), one("rdfs:label", "label"), one("dct:description", "description"), many("dct:creator", "creators"), many("pav:authoredBy", "authors"), types]
    for x in parts:
        n = n.join(x, "np", "left")
    none = F.array().cast("array<string>")
    n = n.withColumns({c: F.coalesce(c, none) for c in ("creators", "authors", "types")}).withColumn("pk", F.sha2("pubkey", 256))
    return n, content


def inline_nanopub(spark: SparkSession, encoded: str) -> DataFrame:
    """Quads of a nanopub given as base64url of its TriG text."""
    data = base64.urlsafe_b64decode(encoded + "=" * (-len(encoded) % 4))
    rows = [("inline", k, *q) for k, q in enumerate(parse_trig(data.decode()))]
    return spark.createDataFrame(rows, QUAD_POS)


def pending_uris(spark: SparkSession, path: str, loaded: DataFrame) -> DataFrame:
    """The IRIs of a list file (one a line, # for comments) whose nanopub is not loaded yet: uri, code."""
    uris = spark.read.text(path).select(F.trim("value").alias("uri")).where("uri <> '' and not startswith(uri, '#')").distinct()
    return uris.withColumn("code", artifact_code("uri")).where("code is not null").join(loaded.select(artifact_code("np").alias("code")).distinct(), "code", "left_anti").select("uri", "code")


def objects_for(quads: DataFrame, g: str, s: str, p: str) -> DataFrame:
    """All objects of a subject and predicate in a graph."""
    return quads.where((F.col("g") == g) & (F.col("s") == s) & (F.col("p") == p)).select("o", "o_kind", "o_dt", "o_lang")


def object_for(quads: DataFrame, g: str, s: str, p: str) -> str | None:
    """The first of them in code point order, or None."""
    r = objects_for(quads, g, s, p).orderBy("o").limit(1).collect()
    return r[0].o if r else None


# What a shard notes about its own loading.
BOOKKEEPING = [ns("npa:" + x) for x in ("hasLoadNumber", "hasLoadChecksum", "hasLoadTimestamp")]


def fetch_back(quads: DataFrame, np: str) -> DataFrame:
    """All that is stored on a nanopub: its four graphs, its admin quads but for the shard's bookkeeping, and the
    invalidations of it with the keys of the invalidating nanopubs."""
    cols = ["g", "s", "p", "o", "o_kind", "o_dt", "o_lang"]
    admin = quads.where((F.col("s") == np) & F.col("g").isin(ns("npa:graph"), ns("npa:networkGraph")) & ~F.col("p").isin(BOOKKEEPING))
    inv = quads.where((F.col("g") == ns("npa:graph")) & (F.col("p") == ns("npx:invalidates")) & (F.col("o") == np))
    keys = quads.where((F.col("g") == ns("npa:graph")) & F.col("p").startswith(ns("npa:hasValidSignatureForPublicKey"))).join(inv.select("s").distinct(), "s", "left_semi")
    return content_of(quads, np).select(*cols).unionByName(admin.select(*cols)).unionByName(inv.select(*cols)).unionByName(keys.select(*cols)).distinct()


def prune_before(quads: DataFrame, cutoff) -> DataFrame:
    """The quads without nanopubs created before a time: neither their graphs nor what the admin graphs say of them."""
    old = quads.where(F.col("p") == ns("dct:created")).where(F.col("o").try_cast("timestamp") < cutoff).select(F.col("s").alias("np")).distinct()
    graphs = quads.where(F.col("p") == ns("npa:hasGraph")).join(old.withColumnRenamed("np", "s"), "s", "left_semi").select(F.col("o").alias("g")).distinct()
    return quads.join(graphs, "g", "left_anti").join(old.withColumnRenamed("np", "s"), "s", "left_anti").select(*quads.columns)


def content_of(quads: DataFrame, np: str) -> DataFrame:
    """The statements of a nanopub's four graphs, found by the graphs it is said to have."""
    graphs = quads.where((F.col("s") == np) & (F.col("p") == ns("npa:hasGraph"))).select(F.col("o").alias("g")).distinct()
    return quads.join(graphs, "g", "left_semi")
