"""Nanopubs into the store: derived admin quads, the shards they belong to, load numbers, checksums, invalidations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.iri import shard_name, trusty_base
from quadrille.functions.text import artifact_code
from quadrille.model import QUAD_COLUMNS, ns
from quadrille.plans.extract import relevant
from quadrille.sparql.parser import XSD

GRAPH, NETWORK = ns("npa:graph"), ns("npa:networkGraph")
TYPE = ns("rdf:type")


def code_words(code: Column) -> list[Column]:
    """The 256 bits of an artifact code's hash as four longs; XOR over them does not depend on the order."""
    hexed = F.hex(F.unbase64(F.concat(F.translate(F.substring(code, 3, 43), "-_", "+/"), F.lit("="))))
    return [F.conv(F.substring(hexed, 1 + 16 * k, 16), 16, -10).cast("long") for k in range(4)]


def checksum_text(words: list[Column]) -> Column:
    """32 bytes in base64 from four longs."""
    return F.base64(F.unhex(F.concat(*(F.lpad(F.hex(w), 16, "0") for w in words))))


def checksums(rows: DataFrame, by: list[str], code: str = "code") -> DataFrame:
    """Number of rows and order-independent checksum per group."""
    w = code_words(F.col(code))
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("np_count"), *(F.bit_xor(x).alias(f"w{k}") for k, x in enumerate(w)))
    return agg.select(*by, "np_count", checksum_text([F.col(f"w{k}") for k in range(4)]).alias("checksum"))


def shards(nanopubs: DataFrame, last30d_from: Column | None = None) -> DataFrame:
    """repo, np and the other columns, a row per shard a nanopub belongs to: meta, full, text, one per key and per
    type that is a web address and not minted in the nanopub, spaces for the types it looks at, and last30d for those
    created at or after a given time."""
    types = F.transform(F.filter("types", lambda t: t.rlike("^https?://.*") & ~F.startswith(t, F.col("np"))), lambda t: shard_name("type", t))
    repos = F.concat(
        F.array(F.lit("meta"), F.lit("full"), F.lit("text")),
        F.when(F.col("pubkey").isNotNull(), F.array(shard_name("pubkey", F.col("pubkey")))).otherwise(F.array().cast("array<string>")),
        F.coalesce(types, F.array().cast("array<string>")),
        F.when(relevant(F.col("types")), F.array(F.lit("spaces"))).otherwise(F.array().cast("array<string>")),
    )
    if last30d_from is not None:
        repos = F.concat(repos, F.when(F.col("created") >= last30d_from, F.array(F.lit("last30d"))).otherwise(F.array().cast("array<string>")))
    return nanopubs.withColumn("repo", F.explode(F.array_distinct(repos)))


def fresh(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows whose (repo, np) is not loaded; repeats within the batch count once, the first by counter."""
    w = Window.partitionBy("repo", "np").orderBy("counter")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(loaded.select("repo", "np").distinct(), ["repo", "np"], "left_anti")


#: Counters that are numbered by one task.
SPAN = 1 << 16


def number(rows: DataFrame, heads: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """Load numbers (from 0; from 1 in spaces) and running checksums per shard in the order of the counter. ``heads``:
    repo, np_count and w0..w3 of the rows loaded before.

    A shard may hold every row. Numbers and checksums run within spans of the counter, and the totals of the spans
    before are added to them."""
    n4 = range(4)
    x = rows.withColumn("_b", F.floor(F.col("counter") / span).cast("long")).withColumns({f"_c{k}": c for k, c in enumerate(code_words(F.col("code")))})
    totals = x.groupBy("repo", "_b").agg(F.count(F.lit(1)).alias("_n"), *(F.bit_xor(f"_c{k}").alias(f"_t{k}") for k in n4))
    before = Window.partitionBy("repo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    base = totals.select("repo", "_b", F.coalesce(F.sum("_n").over(before), zero).alias("_base"), *(F.coalesce(F.bit_xor(f"_t{k}").over(before), zero).alias(f"_h{k}") for k in n4))
    if heads is not None:
        base = base.join(heads.select("repo", F.col("np_count").alias("_m"), *(F.col(f"w{k}").alias(f"_g{k}") for k in n4)), "repo", "left")
        base = base.withColumns({"_base": F.col("_base") + F.coalesce("_m", zero), **{f"_h{k}": F.col(f"_h{k}").bitwiseXOR(F.coalesce(f"_g{k}", zero)) for k in n4}}).drop("_m", *(f"_g{k}" for k in n4))
    w = Window.partitionBy("repo", "_b").orderBy("counter")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_r": F.row_number().over(w), **{f"_s{k}": F.bit_xor(f"_c{k}").over(upto) for k in n4}}).join(base, ["repo", "_b"])
    n = F.col("_base") + F.col("_r") - F.when(F.col("repo") == "spaces", 0).otherwise(1)
    x = x.withColumns({"load_number": n.cast("long"), "load_checksum": checksum_text([F.col(f"_h{k}").bitwiseXOR(F.col(f"_s{k}")) for k in n4])})
    return x.drop("_b", "_r", "_base", *(f"_{p}{k}" for p in "csh" for k in n4))


def invalidations(content: DataFrame) -> DataFrame:
    """np, target, kind: what a nanopub invalidates, retracts or supersedes; the last only if it says so of itself."""
    p = F.col("p")
    own = (p == ns("npx:supersedes")) & (F.col("s") == F.col("np"))
    rows = content.where((p.isin(ns("npx:invalidates"), ns("npx:retracts")) | own) & (F.col("o_kind") == "iri"))
    kind = F.when(p == ns("npx:retracts"), "retracts").when(p == ns("npx:supersedes"), "supersedes").otherwise("invalidates")
    return rows.select("np", F.col("o").alias("target"), kind.alias("kind")).distinct()


def propagate(inv: DataFrame, nanopubs: DataFrame) -> DataFrame:
    """repo, np: shards of its targets that an invalidating nanopub must also reach, whichever was loaded first: the
    key's shard if it is another key, the types' shards it is not in, and spaces if the target is looked at there."""
    by = nanopubs.select("np", F.col("pubkey").alias("by_pubkey"), F.col("types").alias("by_types"))
    to = nanopubs.select(F.col("np").alias("target"), "pubkey", "types")
    x = inv.select("np", "target").distinct().join(by, "np").join(to, "target")
    none = F.array().cast("array<string>")
    types = F.transform(F.filter(F.array_except(F.coalesce("types", none), F.coalesce("by_types", none)), lambda t: t.rlike("^https?://.*") & ~F.startswith(t, F.col("target"))), lambda t: shard_name("type", t))
    repos = F.concat(F.when(~F.col("pubkey").eqNullSafe(F.col("by_pubkey")) & F.col("pubkey").isNotNull(), F.array(shard_name("pubkey", F.col("pubkey")))).otherwise(none), types, F.when(relevant(F.col("types")), F.array(F.lit("spaces"))).otherwise(none))
    return x.select("np", F.explode(repos).alias("repo")).distinct()


def admin_quads(nanopubs: DataFrame, content: DataFrame) -> DataFrame:
    """The quads derived from each nanopub (repo is empty; see shards()).

    ``nanopubs``: np, code, pubkey, pk, signer, created, label, description, types, creators, authors, head_g,
    assertion_g, provenance_g, pubinfo_g; nulls give no quad. ``content``: np, part, s, p, o, o_kind."""
    rows = []

    def put(df: DataFrame, p: Column | str, o: Column, kind: str = "iri", dt: str = "", g: str = GRAPH, s: str = "np") -> None:
        pred = F.lit(ns(p)) if isinstance(p, str) else p
        rows.append(df.select(F.lit("").alias("repo"), F.lit(g).alias("g"), F.col(s).alias("s"), pred.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit("").alias("o_lang")).where("o is not null"))

    n, string = nanopubs, XSD + "string"
    put(n, "npa:hasValidSignatureForPublicKey", F.col("pubkey"), "lit", string)
    put(n, "npa:hasValidSignatureForPublicKeyHash", F.col("pk"), "lit", string)
    put(n, "npx:signedBy", F.col("signer"))
    for c, p in (("head_g", "npa:hasHeadGraph"), ("assertion_g", "np:hasAssertion"), ("provenance_g", "np:hasProvenance"), ("pubinfo_g", "np:hasPublicationInfo")):
        put(n, p, F.col(c))
        put(n, "npa:hasGraph", F.col(c))
    put(n, "npa:artifactCode", F.col("code"), "lit", string)
    put(n, "dct:created", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "lit", XSD + "dateTime")
    put(n.select("np", F.explode("types").alias("t")), "npx:hasNanopubType", F.col("t"))
    put(n, "rdfs:label", F.col("label"), "lit", string)
    put(n, "dct:description", F.col("description"), "lit", string)
    put(n.select("np", F.explode("creators").alias("t")), "dct:creator", F.col("t"))
    put(n.select("np", F.explode("authors").alias("t")), "pav:authoredBy", F.col("t"))
    iri = content.where("o_kind = 'iri'")
    own = iri.where("s = np and part = 'pubinfo'")
    for p in ("npx:introduces", "npx:describes", "npx:embeds"):
        put(own.where(F.col("p") == ns(p)), p, F.col("o"))
    put(iri.where("s = np").where(F.endswith("o", artifact_code("o"))), F.col("p"), F.col("o"), g=NETWORK)
    inv = invalidations(content)
    put(inv, "npx:invalidates", F.col("target"))
    for k in ("retracts", "supersedes"):
        put(inv.where(F.col("kind") == k), f"npx:{k}", F.col("target"))
    named = iri.select("np", F.explode(F.array("s", "p", "o")).alias("i")).distinct()
    graphs = n.select("np", F.explode(F.array("np", "assertion_g", "provenance_g", "pubinfo_g")).alias("i"))
    sub = named.where(F.contains("i", artifact_code("np"))).join(graphs, ["np", "i"], "left_anti")
    put(sub, "npa:hasSubIri", F.col("i"))
    other = named.where(~F.contains("i", artifact_code("np"))).select("np", trusty_base(F.col("i")).alias("b")).where("b is not null")
    put(other, "npa:refersToNanopub", F.col("b"), g=NETWORK)
    intro = content.where(F.col("p") == ns("npx:declaredBy")).where("part = 'assertion'").select("np", F.col("s").alias("d"), F.col("o").alias("agent"))
    put(intro, "npa:isIntroductionOf", F.col("agent"))
    keys = content.where((F.col("p") == ns("npx:hasPublicKey")) & (F.col("part") == "assertion")).join(intro.select("np", F.col("d").alias("s")), ["np", "s"], "left_semi")
    put(keys, "npa:declaresPubkey", F.col("o"), "lit", string)
    return reduce(DataFrame.unionByName, rows).distinct().select(*QUAD_COLUMNS)


def filter_literals(nanopubs: DataFrame, content: DataFrame) -> DataFrame:
    """The searchable text of a nanopub: its key and types as words, then its literals, white space collapsed."""
    lits = content.where("o_kind = 'lit'").select("np", F.regexp_replace("o", r"\s+", " ").alias("t")).groupBy("np").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("lits"))
    tags = F.concat(F.lit("_pubkey_"), F.sha2("pubkey", 256), F.array_join(F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.concat(F.lit(" _type_"), F.sha2(t, 256))), ""))
    return nanopubs.join(lits, "np", "left").select("np", F.concat(tags, F.lit("\n"), F.coalesce("lits", F.lit(""))).alias("text"))


def accepted(nanopubs: DataFrame, public: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nanopubs to load, and notes on the others: np, note. Needs a valid key; protected ones stay off a public
    instance; every graph's IRI must hold the code."""
    graphs = F.array("head_g", "assertion_g", "provenance_g", "pubinfo_g")
    odd = ~F.forall(graphs, lambda g: F.contains(F.coalesce(g, F.lit("")), F.col("code")))
    protected = F.lit(public) & F.coalesce(F.array_contains("types", ns("npx:ProtectedNanopub")), F.lit(False))
    note = F.when(F.col("pubkey").isNull(), "missing or invalid signature").when(protected, "protected nanopub").when(odd, "graph without artifact code")
    x = nanopubs.withColumn("note", note)
    return x.where("note is null").drop("note"), x.where("note is not null").select("np", "note")


def hash_dictionary(values: DataFrame, col: str, kind: str) -> DataFrame:
    return values.select(F.sha2(col, 256).alias("hash"), F.col(col).alias("value"), F.lit(kind).alias("kind")).dropna().distinct()
