"""Ingest, trust states, reconciliation, updates and streams over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.model import FlatQuads, NS, ns
from quadrille.operators.history import LedgerStore
from quadrille.plans import ingest, listing, reconcile, trust
from quadrille.plans.state import LoaderStatus
from quadrille.queries.reference_sql import _EV, _SHARDS
from quadrille.session import materialize, scratch
from quadrille.sources import bridge, rdf
from quadrille.sources.bridge import EX, np_iri
from quadrille.sources.tables import table
from quadrille.sparql.engine import Engine
from quadrille.streaming.feed import append_once, latest_wins
from quadrille.streaming.loader import Loader, probe_files

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def event_content(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as whole nanopubs: their heads with the IRIs of four graphs, and their statements. A purchase introduces a
    thing of its own, a view cites a sub-IRI of the nanopub before, and all carry the number in their properties as
    text; nanopubs of type error are protected, those of user 0 have no key, and clicks of user 1 an odd head."""
    n = bridge.event_nanopubs(spark, sf_dir)
    for part in ("assertion", "provenance", "pubinfo"):
        n = n.withColumn(f"{part}_g", F.concat("np", F.lit(f"/{part}")))
    odd = (F.col("user_id") == 1) & (F.col("event_type") == "click")
    types = F.when(F.col("event_type") == "error", F.array_append("types", ns("npx:ProtectedNanopub"))).otherwise(F.col("types"))
    heads = n.withColumns({
        "head_g": F.when(odd, F.lit(EX + "head")).otherwise(F.concat("np", F.lit("/Head"))), "types": types, "pubkey": F.when(F.col("user_id") != 0, F.col("pubkey")), "signer": F.concat(F.lit(EX + "user/"), "user_id"),
        "description": F.lit(None).cast("string"), "creators": F.array(F.concat(F.lit(EX + "user/"), "user_id")), "authors": F.lit(None).cast("array<string>"),
    })
    say = lambda part, s, p, o, kind="iri": F.struct(F.lit(part).alias("part"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    user, thing = F.concat(F.lit(EX + "user/"), "user_id"), F.concat("np", F.lit("#thing"))
    body = F.array_compact(F.array(
        say("assertion", user, EX + "does", F.concat(F.lit(EX + "type/"), "event_type")), say("assertion", user, EX + "says", F.concat(F.lit("number  "), F.col("event_id").cast("string")), "lit"),
        F.when(F.col("event_type") == "purchase", say("pubinfo", F.col("np"), ns("npx:introduces"), thing)), F.when((F.col("event_type") == "view") & (F.col("event_id") > 0), say("assertion", user, EX + "cites", F.concat(np_iri(F.col("event_id") - 1), F.lit("#x")))),
    ))
    return heads, n.select("np", F.explode(body).alias("x")).select("np", "x.*")


@query
def admin_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is derived from every nanopub for the admin graphs."""
    return ingest.admin_quads(*event_content(spark, sf_dir)).select("g", "s", "p", "o", "o_kind")


@query
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanopubs that a public instance does not load, and why."""
    return ingest.accepted(event_content(spark, sf_dir)[0])[1]


@query
def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each nanopub for the text shard."""
    heads, content = event_content(spark, sf_dir)
    return ingest.filter_literals(heads, content)


@query
def repo_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.repos(ingest.shards(bridge.event_nanopubs(spark, sf_dir)))


@query
def spaces_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of spaces as escaped rows of HTML."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit(EX + "a&b/<"), "n_name", F.lit(">")).alias("space"), F.col("n_nationkey").cast("string").alias("ref"), F.lit("").alias("root_np"))
    return listing.spaces_html(n)


@query
def prune_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the shard last30d when all that is older than the ten days before the newest was removed."""
    n = bridge.event_nanopubs(spark, sf_dir)
    heads, _ = event_content(spark, sf_dir)
    none = heads.limit(0).select("np", F.lit("").alias("part"), F.lit("").alias("s"), F.lit("").alias("p"), F.lit("").alias("o"), F.lit("").alias("o_kind"))
    cutoff = n.agg(F.max("created")).first()[0]
    quads, _ = materialize(ingest.admin_quads(heads, none), "quads")
    return rdf.prune_before(quads, F.lit(cutoff) - F.make_interval(days=F.lit(10))).groupBy("p").agg(F.countDistinct("s").alias("n"))


@query
def trust_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts read back from envelopes in extended JSON, one for each delivery."""
    long_ = lambda c: F.struct(F.col(c).cast("string").alias("$numberLong"))
    account = F.struct("pubkey", "agent", "status", F.col("depth").alias("depth"), long_("path_count").alias("pathCount"), "ratio", long_("quota").alias("quota"), "name", F.concat(F.date_format("name_created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("[UTC]")).alias("nameCreatedAt"), F.col("intro_nanopub").alias("introNanopub"))
    a = table(spark, sf_dir, "trust_accounts").where("pubkey is not null and agent is not null and status is not null").groupBy("delivery_id").agg(F.collect_list(account).alias("accounts"))
    s = table(spark, sf_dir, "trust_snapshots").join(a, "delivery_id")
    when = F.struct(F.struct(F.unix_millis(F.col("created_at").cast("timestamp")).cast("string").alias("$numberLong")).alias("$date"))
    texts = s.select(F.to_json(F.struct(F.concat(F.col("delivery_id").cast("string"), F.lit(":"), "trust_state_hash").alias("trustStateHash"), F.struct(F.col("trust_state_counter").cast("string").alias("$numberLong")).alias("trustStateCounter"), when.alias("createdAt"), "accounts")).alias("value"))
    return trust.parse_envelopes(texts)[1].select("trust_state_hash", "pubkey", "agent", "status", *(F.col(c).cast("string").alias(c) for c in ("depth", "path_count", "quota")), "ratio", "name", "name_created_at", "intro_nanopub")


@query
def trust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each kind in the graphs of the trust states."""
    s = table(spark, sf_dir, "trust_snapshots").select("trust_state_hash", "trust_state_counter").distinct()
    a = table(spark, sf_dir, "trust_accounts").select("trust_state_hash", "pubkey", "agent", "status", "depth", "path_count", "ratio", "quota", "name", "intro_nanopub")
    return trust.trust_quads(s, a).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query
def ledger_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the order status of customers from a ledger to which snapshots were applied one by one, out of order:
    all that was ever believed, with when it was recorded."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderkey")
    states = o.groupBy("k", "y").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status")).select("k", F.lit(1).cast("long").alias("chain_id"), F.col("y").cast("long").alias("pos"), "status")
    states, _ = materialize(states, "states")
    years = sorted(r[0] for r in states.select("pos").distinct().collect())
    store = LedgerStore(spark, scratch(spark, "ledger"), ["k"], "k bigint", "struct<status: string>")
    late = years[::2] + years[1::2]  # every second year arrives after all the others
    for i, y in enumerate(late):
        snap = spark.createDataFrame([(1, y, i)], "chain_id long, pos long, i int").select("chain_id", "pos", F.timestamp_seconds(F.col("i") * 3600).alias("recorded"))
        store.apply(snap, states.where(F.col("pos") == y), ["status"])
    rows = store.read()
    hour = lambda c: (F.unix_seconds(c) / 3600).cast("long")
    return rows.select("k", F.col("state.status").alias("status"), "from_pos", F.coalesce("to_pos", F.lit(-1)).alias("to_pos"), hour("recorded_from").alias("recorded_from"), F.coalesce(hour("recorded_to"), F.lit(-1)).alias("recorded_to"))


@query
def retro_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nanopubs of the last day lack if those of type error never reached the shards of their types, page by
    page until there is none left."""
    n = bridge.event_nanopubs(spark, sf_dir).withColumns({"load_number": F.col("counter"), "loaded_at": F.col("created")})
    top = n.agg(F.max("load_number"), F.max("loaded_at")).first()
    actual = ingest.shards(n).where(~((F.col("event_type") == "error") & F.col("repo").startswith("type_"))).select("repo", "np")
    now, out, below = F.lit(top[1]), None, None
    size = max(1, n.where(F.col("loaded_at") >= now - F.make_interval(hours=F.lit(24))).count() // 3)
    while (end := reconcile.page_end(n, top[0], now, limit=size, below=below)) is not None:
        page, _ = materialize(reconcile.retro_sweep(n, actual, top[0], now, limit=size, below=below), "page")
        out, below = page if out is None else out.unionByName(page), end
    return out


@query
def sweep_and_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships that a forward sweep finds lacking and a repair brings, below the first nanopub still on its way."""
    n = bridge.event_nanopubs(spark, sf_dir).withColumns({"load_number": F.col("counter"), "loaded_at": F.col("created")})
    now = F.lit(n.agg(F.max("created")).first()[0])
    flying = (F.col("event_type") == "view") & (F.col("created") > now - F.make_interval(mins=F.lit(reconcile.IN_FLIGHT)))
    actual = ingest.shards(n).where(~((F.col("event_type") == "error") & F.col("repo").startswith("type_")) & ~(flying & (F.col("repo") == "meta"))).select("repo", "np")
    lack, _ = reconcile.forward_sweep(n, actual, -1, None, now)
    lack, _ = materialize(lack, "lack")
    path = scratch(spark, "repaired")
    reconcile.repair(lack, n, append_once(path, ["repo", "np"]))
    mended = spark.read.parquet(path).select("repo", "np")
    left, _ = reconcile.forward_sweep(n, actual.unionByName(mended), -1, None, now)
    return mended.withColumn("still", F.lit(False)).unionByName(left.select("repo", "np", F.lit(True).alias("still")))


@query
def latest_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type."""
    e = bridge.event_nanopubs(spark, sf_dir).select("user_id", "event_type", "created", "event_id", "value")
    return latest_wins(e, ["user_id", "event_type"], ["created", "event_id"])


@query
def loader_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards after a loader drained a counter feed in batches of which one failed after it was written and was
    repeated, went on after a restart, and began anew as the registry was set up again."""
    base = scratch(spark, "loader")
    rows = bridge.event_nanopubs(spark, sf_dir).select("np", "code", "pubkey", "types", "created", "counter")
    rows.repartition(4).write.parquet(f"{base}/feed")
    n, fail, folder = rows.count(), [True], ["out"]
    feed = lambda low, high: spark.read.parquet(f"{base}/feed").where((F.col("counter") > low) & (F.col("counter") <= high))

    def sink(batch: DataFrame, epoch: int) -> None:
        append_once(f"{base}/{folder[0]}", ["repo", "np"])(ingest.shards(batch), epoch)
        if fail:
            fail.clear()
            raise OSError("lost after the write")

    def loader(setup: int) -> Loader:
        return Loader(LoaderStatus(spark, f"{base}/status"), lambda: probe_files(spark, f"{base}/feed", setup), feed, sink, lambda: folder.__setitem__(0, "anew"), -(-n // 2), sleep=lambda _: None)

    steps = [loader(7).tick(), loader(7).tick(), loader(8).tick()]
    assert steps == ["load", "idle", "resync"], steps
    parts = [spark.read.parquet(f"{base}/{f}").groupBy("repo").agg(F.count(F.lit(1)).alias("n")) for f in ("out", "anew")]
    return parts[0].withColumn("setup", F.lit(7)).unionByName(parts[1].withColumn("setup", F.lit(8)))


@query
def update_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of each graph and predicate after a sequence of updates."""
    source = bridge.quad_source(spark, sf_dir)
    e = Engine(spark, FlatQuads(source.scan("full", EX + "nation", None, None, None).unionByName(source.scan("full", EX + "region", None, None, None))), prefixes=bridge.PREFIXES)
    quads = e.update("""INSERT { GRAPH ex:derived { ?r ex:has ?n } } WHERE { ?n col:n_regionkey ?r } ;
      DELETE { GRAPH ex:nation { ?n col:n_name ?x } } INSERT { GRAPH ex:nation { ?n ex:label ?x } } WHERE { GRAPH ex:nation { ?n col:n_name ?x } } ;
      DELETE { GRAPH ex:derived { ?r ex:has ?n } } WHERE { ?r col:r_name ?x . ?r ex:has ?n FILTER(STRENDS(?x, "A")) }""")
    return quads.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


_TOP = "(SELECT max(ts) FROM ev)"
_LACK = "repo LIKE 'type_%' AND event_type = 'error'"
_NPA, _NPX, _NP = NS["npa"], NS["npx"], NS["np"]
_GRAPHS = f"['{_NPA}hasHeadGraph', '{_NP}hasAssertion', '{_NP}hasProvenance', '{_NP}hasPublicationInfo']"
_HEADS = f"""{_EV},
head AS (
  SELECT *, CASE WHEN user_id <> 0 THEN pubkey END AS key, CASE WHEN user_id = 1 AND event_type = 'click' THEN '{EX}head' ELSE np || '/Head' END AS head_g,
         CASE WHEN event_type = 'error' THEN [type, '{_NPX}ProtectedNanopub'] ELSE [type] END AS types FROM ev),
gr AS (SELECT np, unnest([head_g, np || '/assertion', np || '/provenance', np || '/pubinfo']) AS gi, unnest({_GRAPHS}) AS gp FROM head)"""

SQL = {
    "admin_quads": f"""WITH {_HEADS}, admin AS (
  SELECT np AS s, '{_NPA}hasValidSignatureForPublicKey' AS p, key AS o, 'lit' AS k FROM head UNION ALL SELECT np, '{_NPA}hasValidSignatureForPublicKeyHash', pk, 'lit' FROM head
  UNION ALL SELECT np, '{_NPX}signedBy', '{EX}user/' || user_id, 'iri' FROM head UNION ALL SELECT np, gp, gi, 'iri' FROM gr UNION ALL SELECT np, '{_NPA}hasGraph', gi, 'iri' FROM gr
  UNION ALL SELECT np, '{_NPA}artifactCode', code, 'lit' FROM head UNION ALL SELECT np, '{NS["dct"]}created', strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), 'lit' FROM head
  UNION ALL SELECT np, '{_NPX}hasNanopubType', unnest(types), 'iri' FROM head UNION ALL SELECT np, '{NS["rdfs"]}label', label, 'lit' FROM head UNION ALL SELECT np, '{NS["dct"]}creator', '{EX}user/' || user_id, 'iri' FROM head
  UNION ALL SELECT np, '{_NPX}introduces', np || '#thing', 'iri' FROM head WHERE event_type = 'purchase' UNION ALL SELECT np, '{_NPA}hasSubIri', np || '#thing', 'iri' FROM head WHERE event_type = 'purchase')
SELECT '{_NPA}graph' AS g, s, p, o, k AS o_kind FROM admin WHERE o IS NOT NULL
UNION ALL SELECT '{_NPA}networkGraph', a.np, '{_NPA}refersToNanopub', b.np, 'iri' FROM ev a JOIN ev b ON b.event_id = a.event_id - 1 WHERE a.event_type = 'view'""",
    "rejections": f"""WITH {_HEADS} SELECT np, CASE WHEN key IS NULL THEN 'missing or invalid signature' WHEN event_type = 'error' THEN 'protected nanopub' ELSE 'graph without artifact code' END AS note
FROM head WHERE key IS NULL OR event_type = 'error' OR head_g NOT LIKE '%RA%'""",
    "searchable_text": f"""WITH {_HEADS} SELECT np, CASE WHEN key IS NULL THEN NULL ELSE '_pubkey_' || sha256(key) || array_to_string([' _type_' || sha256(t) FOR t IN types], '') || chr(10) || 'number ' || event_id END AS text FROM head""",
    "repo_catalogue": f"WITH {_SHARDS} SELECT DISTINCT repo FROM shard",
    "spaces_table": f"SELECT '<tr><td>{EX}a&amp;b/&lt;' || n_name || '&gt;</td><td>' || n_nationkey || '</td></tr>' AS value FROM nation",
    "prune_old": f"""WITH {_HEADS}, kept AS (SELECT * FROM head WHERE ts >= {_TOP} - INTERVAL 10 DAYS)
SELECT '{_NPA}hasValidSignatureForPublicKey' AS p, count(key) AS n FROM kept UNION ALL SELECT '{NS["rdfs"]}label', count(label) FROM kept
UNION ALL SELECT unnest(['{_NPA}hasValidSignatureForPublicKeyHash', '{_NPX}signedBy', '{_NPA}hasGraph', '{_NPA}artifactCode', '{NS["dct"]}created', '{_NPX}hasNanopubType', '{NS["dct"]}creator'] || {_GRAPHS}), count(*) FROM kept""",
    "trust_envelopes": """SELECT delivery_id || ':' || s.trust_state_hash AS trust_state_hash, pubkey, agent, status, CAST(depth AS VARCHAR) AS depth, CAST(path_count AS VARCHAR) AS path_count, ratio, CAST(quota AS VARCHAR) AS quota, name, name_created_at, intro_nanopub
FROM trust_accounts JOIN trust_snapshots s USING (delivery_id) WHERE pubkey IS NOT NULL AND agent IS NOT NULL AND status IS NOT NULL""",
    "trust_graph": f"""WITH s AS (SELECT DISTINCT trust_state_hash FROM trust_snapshots), a AS (SELECT * FROM trust_accounts WHERE trust_state_hash IN (SELECT trust_state_hash FROM s)), n AS (SELECT DISTINCT trust_state_hash, agent FROM a WHERE name IS NOT NULL)
SELECT unnest([{", ".join(f"'{_NPA}{p}'" for p in ("agent", "pubkey", "trustStatus", "depth", "pathCount", "ratio", "quota", "declaredBy"))}]) AS p,
  unnest([count(agent), count(pubkey), count(status), count(depth), count(path_count), count(ratio), count(quota), count(intro_nanopub)]) AS n FROM a
UNION ALL SELECT '{NS["foaf"]}name', count(*) FROM n UNION ALL SELECT '{_NPA}hasCurrentTrustState', 1""",
    "ledger_applied": """WITH st AS (SELECT o_custkey AS k, year(o_orderdate) AS y, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2),
ys AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT y FROM st)),
arr AS (SELECT y, CASE WHEN r % 2 = 0 THEN r // 2 ELSE (c + 1) // 2 + r // 2 END AS t FROM ys),
known AS (SELECT a.t AS tm, b.y, lag(b.y) OVER w AS before, lead(b.y) OVER w AS after FROM arr a JOIN arr b ON b.t <= a.t WINDOW w AS (PARTITION BY a.t ORDER BY b.y)),
s AS (SELECT k.tm, k.before, k.after, st.* FROM known k JOIN st ON st.y = k.y),
f AS (SELECT *, CASE WHEN lag(y) OVER w = before AND lag(status) OVER w = status THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY tm, k ORDER BY y)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY tm, k ORDER BY y) AS run FROM f),
v AS (SELECT tm, k, status, min(y) AS from_pos, arg_max(coalesce(after, -1), y) AS to_pos FROM g GROUP BY tm, k, run, status),
w AS (SELECT *, tm - row_number() OVER (PARTITION BY k, status, from_pos, to_pos ORDER BY tm) AS spell FROM v)
SELECT k, status, from_pos, to_pos, min(tm) AS recorded_from, CASE WHEN max(tm) + 1 < (SELECT count(*) FROM ys) THEN max(tm) + 1 ELSE -1 END AS recorded_to FROM w GROUP BY k, status, from_pos, to_pos, spell""",
    "retro_missing": f"WITH {_SHARDS} SELECT repo, s.np FROM shard s JOIN ev USING (event_id) WHERE repo LIKE 'type_%' AND s.event_type = 'error' AND ts >= {_TOP} - INTERVAL 24 HOURS",
    "sweep_and_repair": f"""WITH {_SHARDS} SELECT repo, np, false AS still FROM shard WHERE {_LACK}
AND event_id < coalesce((SELECT min(event_id) FROM ev WHERE event_type = 'view' AND ts > {_TOP} - INTERVAL 30 MINUTES), 9223372036854775807)""",
    "latest_of_key": "SELECT user_id, event_type, ts AS created, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "loader_cycle": f"WITH {_SHARDS} SELECT repo, count(*) AS n, unnest([7, 8]) AS setup FROM shard GROUP BY repo",
    "update_sequence": f"""SELECT '{EX}nation' AS g, '{EX}label' AS p, count(*) AS n FROM nation UNION ALL SELECT '{EX}nation', '{EX}col/n_regionkey', count(*) FROM nation UNION ALL SELECT '{EX}region', '{EX}col/r_name', count(*) FROM region
UNION ALL SELECT '{EX}derived', '{EX}has', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE '%A'""",
}
