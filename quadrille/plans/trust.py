"""Trust states: reading envelopes, keeping a number of them, and what they say about accounts and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.model import NS, QUAD_COLUMNS, ns
from quadrille.sparql.parser import XSD

RAW = "trustStateHash string, trustStateCounter string, createdAt string, accounts string, edges string"
ACCOUNTS = "array<struct<pubkey:string,agent:string,status:string,depth:string,pathCount:string,ratio:string,quota:string,name:string,nameCreatedAt:string,introNanopub:string>>"
EDGES = "array<struct<fromAgent:string,fromPubkey:string,toAgent:string,toPubkey:string,viaNanopub:string>>"


def unwrap_long(c: Column) -> Column:
    """A number given plain, as text, or as {"$numberLong": "..."}."""
    return F.coalesce(c.try_cast("long"), F.get_json_object(c, "$.$numberLong").try_cast("long"), F.get_json_object(c, "$['$numberLong']").try_cast("long"))


def unwrap_time(c: Column) -> Column:
    """A time given as ISO text, with a zone name or not, as milliseconds, or as {"$date": ...} of these."""
    inner = F.coalesce(F.get_json_object(c, "$['$date']['$numberLong']"), F.get_json_object(c, "$['$date']"), c)
    millis = F.timestamp_millis(inner.try_cast("long"))
    return F.coalesce(millis, F.regexp_replace(inner, r"\[.*\]$", "").try_cast("timestamp"))


def parse_envelopes(texts: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots, accounts and edges from JSON texts, one envelope each. An envelope is refused as a whole (valid =
    false, no accounts, no edges) if it lacks hash, counter, time or accounts, or an account lacks key, agent or status."""
    e = texts.select(F.from_json(col, RAW, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    e = e.select(
        F.col("trustStateHash").alias("trust_state_hash"), unwrap_long(F.col("trustStateCounter")).alias("trust_state_counter"), unwrap_time(F.col("createdAt")).alias("created_at"),
        F.from_json("accounts", ACCOUNTS).alias("acc"), F.when(F.col("edges").isNull(), F.from_json(F.lit("[]"), EDGES)).otherwise(F.from_json("edges", EDGES)).alias("edg"),
    )
    whole = F.forall("acc", lambda a: a["pubkey"].isNotNull() & a["agent"].isNotNull() & a["status"].isNotNull())
    valid = F.col("trust_state_hash").isNotNull() & F.col("trust_state_counter").isNotNull() & F.col("created_at").isNotNull() & F.col("edg").isNotNull() & F.coalesce(whole, F.lit(False))
    e = e.withColumn("valid", valid)
    snaps = e.select("trust_state_hash", "trust_state_counter", "created_at", "valid", F.when(F.col("valid"), F.size("acc")).alias("n_accounts"))
    a = e.where("valid").select("trust_state_hash", F.explode("acc").alias("a"))
    accounts = a.select(
        "trust_state_hash", F.col("a.pubkey").alias("pubkey"), F.col("a.agent").alias("agent"), F.col("a.status").alias("status"), unwrap_long(F.col("a.depth")).cast("int").alias("depth"), unwrap_long(F.col("a.pathCount")).cast("int").alias("path_count"),
        F.col("a.ratio").try_cast("double").alias("ratio"), unwrap_long(F.col("a.quota")).alias("quota"), F.col("a.name").alias("name"), unwrap_time(F.col("a.nameCreatedAt")).alias("name_created_at"), F.col("a.introNanopub").alias("intro_nanopub"),
    )
    edges = e.where("valid").select("trust_state_hash", F.explode("edg").alias("x")).select("trust_state_hash", F.col("x.fromAgent").alias("from_agent"), F.col("x.fromPubkey").alias("from_pubkey"), F.col("x.toAgent").alias("to_agent"), F.col("x.toPubkey").alias("to_pubkey"), F.col("x.viaNanopub").alias("via_nanopub"))
    return snaps, accounts, distinct_edges(edges)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges once per snapshot (from, to, via); their link is named by a hash of these."""
    key = ["trust_state_hash", "from_pubkey", "to_pubkey"]
    link = F.sha2(F.concat_ws("|", *key, F.coalesce("via_nanopub", F.lit(""))), 256)
    return edges.withColumn("link", F.concat(F.lit(NS["npa"] + "endorsementlink/"), link)).dropDuplicates(["link"])


def account_iri(hash_: Column, pubkey: Column, agent: Column) -> Column:
    return F.concat(F.lit(NS["npa"] + "accountstate/"), F.sha2(F.concat_ws("|", hash_, pubkey, agent), 256))


def canonical_names(accounts: DataFrame, by: list[str]) -> DataFrame:
    """For each agent the name of its account with the greatest ratio, on ties the first in code point order; accounts
    without a name do not count, one without a ratio counts least."""
    named = accounts.where("name is not null")
    return named.groupBy(*by, "agent").agg(F.min_by("name", F.struct((-F.coalesce("ratio", F.lit(-1.0))).alias("r"), "name")).alias("name"))


def retained(snapshots: DataFrame, keep: int = 100) -> DataFrame:
    """The newest snapshots by counter; fewer than one is read as one."""
    return snapshots.orderBy(F.col("trust_state_counter").desc(), "trust_state_hash").limit(max(1, keep))


def trust_quads(snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts and canonical names in one graph per snapshot, and the pointers in the admin graph."""
    g = F.concat(F.lit(NS["npa"] + "truststate/"), F.col("trust_state_hash"))
    a = accounts.join(snapshots.select("trust_state_hash"), "trust_state_hash", "left_semi").withColumn("s", account_iri(F.col("trust_state_hash"), F.col("pubkey"), F.col("agent")))
    put = lambda df, s, p, o, kind="lit", dt=XSD + "string": df.select(F.lit("trust"), g, s, F.lit(ns(p)), o.cast("string"), F.lit(kind), F.lit(dt if kind == "lit" else ""), F.lit("")).toDF(*QUAD_COLUMNS).where("o is not null")
    rows = put(a, F.col("s"), "npa:agent", F.col("agent"), "iri")
    for p, c, kind, dt in (("npa:pubkey", "pubkey", "lit", "string"), ("npa:trustStatus", "status", "lit", "string"), ("npa:depth", "depth", "lit", "integer"), ("npa:pathCount", "path_count", "lit", "integer"), ("npa:ratio", "ratio", "lit", "double"), ("npa:quota", "quota", "lit", "long"), ("npa:declaredBy", "intro_nanopub", "iri", "")):
        rows = rows.unionByName(put(a, F.col("s"), p, F.col(c), kind, XSD + dt))
    rows = rows.unionByName(put(canonical_names(a, ["trust_state_hash"]), F.col("agent"), "foaf:name", F.col("name")))
    current = snapshots.orderBy(F.col("trust_state_counter").desc()).limit(1)
    pointer = current.select(F.lit("trust"), F.lit(ns("npa:graph")), F.lit(ns("npa:thisRepo")), F.lit(ns("npa:hasCurrentTrustState")), g, F.lit("iri"), F.lit(""), F.lit("")).toDF(*QUAD_COLUMNS)
    return rows.unionByName(pointer)


def read_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Envelopes from JSON files, one each; a path that does not exist gives empty tables."""
    from quadrille.session import hadoop_path

    fs, p = hadoop_path(spark, path)
    found = fs.globStatus(p)
    texts = spark.read.text(path, wholetext=True) if found and len(found) else spark.createDataFrame([], "value string")
    return parse_envelopes(texts)
