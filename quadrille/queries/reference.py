"""Queries for the operators of graph patterns, ingest, trust and resolution, over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.iri import encode_for_uri, parent_prefix, shard_name, short_key, trusty_base
from quadrille.functions.text import artifact_code, base64_key, clean, clean_lower
from quadrille.operators.closure import best_below, closure
from quadrille.plans import ingest, listing, reconcile, resolve, textsearch, trust
from quadrille.plans.templates import Template
from quadrille.session import materialize
from quadrille.sources import bridge
from quadrille.sources.tables import table
from quadrille.sparql.engine import Engine
from quadrille.streaming.feed import within

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, bridge.quad_source(spark, sf_dir), prefixes=bridge.PREFIXES)


def sparql(name: str, text: str, repo: str | None = None) -> None:
    """Register a query given as SPARQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).query(text, repo)

    run.__name__ = name
    QUERIES[name] = run


# -- graph patterns

sparql("valid_nanopubs", """SELECT ?np ?key ?date ?label WHERE { GRAPH npa:graph {
  ?np npa:hasValidSignatureForPublicKeyHash ?key ; dct:created ?date .
  FILTER NOT EXISTS { ?npx npx:invalidates ?np ; npa:hasValidSignatureForPublicKeyHash ?key . }
  OPTIONAL { ?np rdfs:label ?label } } }""", "meta")  # fmt: skip
sparql("scan_pattern", "SELECT ?np WHERE { ?np npx:hasNanopubType <http://ex.org/type/purchase> }")
sparql("graph_var", "SELECT ?g ?p (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g ?p")
sparql("star_pattern", "SELECT ?c ?name ?seg ?nation WHERE { ?c col:c_name ?name ; col:c_mktsegment ?seg ; col:c_nationkey ?n . ?n col:n_name ?nation }")
sparql("cross_graph", "SELECT ?r (COUNT(?o) AS ?n) WHERE { GRAPH ex:orders { ?o col:o_custkey ?c } GRAPH ex:customer { ?c col:c_nationkey ?k } GRAPH ex:nation { ?k col:n_regionkey ?g } GRAPH ex:region { ?g col:r_name ?r } } GROUP BY ?r")
sparql("optional_label", "SELECT ?np ?label WHERE { ?np npx:hasNanopubType <http://ex.org/type/signup> OPTIONAL { ?np rdfs:label ?label } }")
sparql("optional_filter", """SELECT ?c ?o WHERE { ?c col:c_mktsegment "BUILDING" OPTIONAL { ?o col:o_custkey ?c ; col:o_orderstatus ?st . FILTER(?st = "P") } }""")
sparql("exists_semi", """SELECT ?c WHERE { ?c col:c_name ?n FILTER EXISTS { ?o col:o_custkey ?c ; col:o_orderpriority "1-URGENT" } }""")
sparql("not_exists_anti", """SELECT ?c WHERE { ?c col:c_name ?n FILTER NOT EXISTS { ?o col:o_custkey ?c ; col:o_orderpriority "1-URGENT" } }""")
sparql("subset_nested", """SELECT ?n WHERE { ?n col:n_name ?name FILTER NOT EXISTS { ?s col:s_nationkey ?n
  FILTER NOT EXISTS { ?c col:c_nationkey ?n ; col:c_acctbal ?cb . ?s col:s_acctbal ?sb FILTER(?cb > ?sb) } } }""")  # fmt: skip
sparql("exists_flag", """SELECT ?c ?has WHERE { ?c col:c_name ?n BIND(EXISTS { ?o col:o_custkey ?c ; col:o_orderstatus "F" } AS ?has) }""")
sparql("minus_set", """SELECT ?c WHERE { ?c col:c_name ?n MINUS { ?o col:o_custkey ?c ; col:o_orderstatus "P" } }""")
sparql("union_arms", """SELECT ?x ?name WHERE { { ?x col:c_name ?name } UNION { ?x col:s_name ?name } }""")
sparql("values_in", """SELECT ?c ?seg WHERE { VALUES ?seg { "BUILDING" "MACHINERY" } ?c col:c_mktsegment ?seg }""")
sparql("bind_mint", """SELECT ?c ?iri WHERE { ?c col:c_name ?n BIND(IRI(CONCAT(STR(?c), "__", ENCODE_FOR_URI(CONCAT(?n, " *~/+")))) AS ?iri) }""")
sparql("numeric_filter", "SELECT ?c ?b WHERE { ?c col:c_acctbal ?b FILTER(?b >= 1000 && ?b < 2000.5) }")
sparql("time_filter", """SELECT ?o ?d WHERE { ?o col:o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00Z"^^xsd:dateTime && ?d < "1997-07-01T00:00:00Z"^^xsd:dateTime) }""")
sparql("lexical_filter", """SELECT ?o WHERE { ?o col:o_orderdate ?d FILTER(STR(?d) > "1998") }""")
sparql("regex_filter", """SELECT ?p WHERE { ?p col:c_name ?n FILTER(REGEX(?n, "00[0-4]$")) }""")
sparql("count_distinct", "SELECT ?st (COUNT(DISTINCT ?c) AS ?n) (COUNT(?o) AS ?m) WHERE { ?o col:o_custkey ?c ; col:o_orderstatus ?st } GROUP BY ?st")
sparql("group_concat", """SELECT ?r (GROUP_CONCAT(DISTINCT ?name; separator=" ") AS ?names) WHERE { ?n col:n_regionkey ?g ; col:n_name ?name . ?g col:r_name ?r } GROUP BY ?r""")
sparql("group_max", "SELECT ?c (MAX(?d) AS ?last) WHERE { ?o col:o_custkey ?c ; col:o_orderdate ?d } GROUP BY ?c")
sparql("having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o col:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)")
sparql("sub_select", "SELECT ?c ?name ?n WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o col:o_custkey ?c } GROUP BY ?c } ?c col:c_name ?name }")
sparql("topk", "SELECT ?c ?b WHERE { ?c col:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 20")
sparql("keyset_page", "SELECT ?np ?ln WHERE { ?np npa:hasLoadNumber ?ln FILTER(?ln > 500) } ORDER BY ?ln LIMIT 100")
sparql("offset_slice", "SELECT ?c ?b WHERE { ?c col:c_acctbal ?b } ORDER BY DESC(?b) ?c OFFSET 5 LIMIT 10")
sparql("distinct_types", "SELECT DISTINCT ?t WHERE { ?np npx:hasNanopubType ?t }")
sparql("ask_any", "ASK { ?np npx:invalidates ?other }")
sparql("construct_edges", "CONSTRUCT { ?k <http://ex.org/hasCustomer> ?c } WHERE { ?c col:c_nationkey ?k }")
sparql("path_sequence", "SELECT ?c ?r WHERE { ?c col:c_nationkey/col:n_regionkey/col:r_name ?r }")
sparql("path_alternative", "SELECT ?x ?n WHERE { ?x (col:c_nationkey|col:s_nationkey) ?n }")
sparql("path_inverse", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?n ^col:c_nationkey ?c } GROUP BY ?n")
sparql("path_both_ways", "SELECT ?a ?b WHERE { ?a (npx:supersedes|^npx:supersedes) ?b }")
sparql("service_hop", """SELECT ?c ?name WHERE { SERVICE <https://query.example.org/repo/full> { ?c col:c_name ?name ; col:c_mktsegment "BUILDING" } }""")
sparql("service_var", "SELECT ?r (COUNT(*) AS ?n) WHERE { SERVICE ?r { ?s rdfs:label|col:n_name ?l } } GROUP BY ?r")
sparql("from_graph", "SELECT ?p (COUNT(*) AS ?n) FROM ex:nation FROM ex:region WHERE { ?s ?p ?o } GROUP BY ?p")
sparql("from_named", "SELECT ?g (COUNT(*) AS ?n) FROM ex:region FROM NAMED ex:nation FROM NAMED ex:supplier WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")
sparql("optional_shared", """SELECT ?s ?k ?r WHERE { ?s col:s_name ?n OPTIONAL { ?s col:s_nationkey ?k . ?k col:n_name "NATION_3" } OPTIONAL { ?k col:n_regionkey ?r } }""")
sparql("minus_loose", """SELECT ?s ?k WHERE { ?s col:s_name ?n OPTIONAL { ?s col:s_nationkey ?k . ?k col:n_regionkey ?r . ?r col:r_name ?rn FILTER(STRENDS(?rn, "A")) } MINUS { ?k col:n_name "NATION_1" } }""")
sparql("type_alternatives", "SELECT ?np ?t WHERE { ?np npx:hasNanopubType ?t FILTER(?t != <http://ex.org/type/view> && (?t = <http://ex.org/type/error> || ?t = <http://ex.org/type/signup>)) }")
sparql("path_star", "SELECT ?v (COUNT(?old) AS ?n) WHERE { ?v npx:hasNanopubType <http://ex.org/type/purchase> . ?v npx:supersedes* ?old } GROUP BY ?v", "meta")
sparql("coalesce_value", """SELECT ?np ?l WHERE { ?np npx:hasNanopubType <http://ex.org/type/signup> OPTIONAL { ?np rdfs:label ?x } BIND(COALESCE(?x, "none") AS ?l) }""")
sparql("text_matches", """PREFIX search: <http://www.openrdf.org/contrib/lucenesail#> SELECT ?np ?prop ?k ?snippet WHERE { ?np npx:hasNanopubType <http://ex.org/type/purchase> .
  ?np search:matches [ search:query "7 12" ; search:property ?prop ; search:score ?score ; search:snippet ?snippet ] FILTER(?prop = rdfs:label) BIND(FLOOR(?score * 1000) AS ?k) }""", "meta")  # fmt: skip
sparql("functions_text", """SELECT ?c ?u ?l ?s ?b ?a ?m WHERE { ?c col:c_name ?n BIND(UCASE(?n) AS ?u) BIND(STRLEN(?n) AS ?l) BIND(SUBSTR(?n, 3, 4) AS ?s)
  BIND(STRBEFORE(?n, "#") AS ?b) BIND(STRAFTER(?n, "#") AS ?a) BIND(MD5(?n) AS ?m) }""")  # fmt: skip
sparql("functions_number", """SELECT ?c ?f ?k WHERE { ?c col:c_acctbal ?b BIND(FLOOR(?b) AS ?f) BIND(IF(?b > 5000, "high", "low") AS ?k) }""")
sparql("functions_time", """SELECT (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (COUNT(*) AS ?n) WHERE { ?o col:o_orderdate ?d } GROUP BY (YEAR(?d)) (MONTH(?d))""".replace("(YEAR(?d) AS ?y) (MONTH(?d) AS ?m)", "?y ?m").replace("GROUP BY (YEAR(?d)) (MONTH(?d))", "GROUP BY (YEAR(?d) AS ?y) (MONTH(?d) AS ?m)"))


@query
def path_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nanopubs each one supersedes over any number of steps."""
    q = "SELECT ?v (COUNT(?old) AS ?n) WHERE { ?v npx:supersedes+ ?old } GROUP BY ?v"
    return engine(spark, sf_dir).query(q, "meta")


@query
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every superseded nanopub the newest that supersedes it over any number of steps and is not invalidated under
    its key; all at once instead of a query per nanopub."""
    rel = bridge.event_relations(spark, sf_dir)
    n = bridge.event_nanopubs(spark, sf_dir).select("np", "pk", "created")
    edges = rel.where("pred = 'supersedes'").select(F.col("np").alias("src"), F.col("target").alias("dst"))
    edges, _ = materialize(edges, "supersedes")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()  # others neither ask nor answer
    dead = resolve.same_key_invalidations(n, rel.where("pred = 'invalidates'").select(F.col("np").alias("inv"), "target")).select(F.col("target").alias("np")).distinct()
    alive = n.join(dead, "np", "left_anti").select(F.col("np").alias("node"), "pk", F.struct("created", "np").alias("val")).join(nodes, "node", "left_semi")
    best = best_below(edges, alive, ["pk"])
    if best is None:  # several edges of a nanopub, or cycles: all pairs are needed
        up = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        pairs = up.unionByName(up.select("src").distinct().select("src", F.col("src").alias("dst")))
        best = pairs.join(alive.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "pk").agg(F.max("val").alias("val"))
    asked = edges.select(F.col("dst").alias("np")).distinct().join(n.select("np", "pk"), "np")
    return asked.join(best.withColumnRenamed("node", "np"), ["np", "pk"]).select("np", F.col("val.np").alias("latest"))


@query
def template_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published query with parameters."""
    t = Template("RA" + "x" * 43, "orders-of", "SELECT ?o ?p WHERE { VALUES ?__prio_multi {} ?o col:o_orderpriority ?p ; col:o_orderstatus ?_status FILTER(?p = ?__prio_multi) }")
    return t.run(engine(spark, sf_dir), {"status": "P", "prio": ["1-URGENT", "2-HIGH"]})


# -- ingest


#: Days for which a nanopub stays in the shard last30d.
RECENT_DAYS = 30


def with_newest(nanopubs: DataFrame) -> DataFrame:
    """Nanopubs with the time of the newest of them, which stands for now."""
    return nanopubs.crossJoin(F.broadcast(nanopubs.agg(F.max("created").alias("newest"))))


@query
def shard_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and how many nanopubs each holds."""
    since = F.col("newest") - F.make_interval(days=F.lit(RECENT_DAYS))
    return ingest.shards(with_newest(bridge.event_nanopubs(spark, sf_dir)), since).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query
def running_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load number and running checksum of every nanopub in each of its shards."""
    return ingest.number(ingest.shards(bridge.event_nanopubs(spark, sf_dir))).select("repo", "np", "load_number", "load_checksum")


@query
def xor_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.checksums(ingest.shards(bridge.event_nanopubs(spark, sf_dir)), ["repo"])


@query
def last30d(spark: SparkSession, sf_dir: str, days: int = RECENT_DAYS) -> DataFrame:
    """Nanopubs of the thirty days before the newest."""
    return within(with_newest(bridge.event_nanopubs(spark, sf_dir)), "created", F.col("newest"), days).select("np", "created")


@query
def propagate_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = bridge.event_relations(spark, sf_dir).where("pred = 'invalidates'")
    return ingest.propagate(inv, bridge.event_nanopubs(spark, sf_dir))


@query
def valid_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = bridge.event_relations(spark, sf_dir).where("pred = 'invalidates'").select(F.col("np").alias("inv"), "target")
    return resolve.same_key_invalidations(bridge.event_nanopubs(spark, sf_dir).select("np", "pk"), inv)


@query
def shard_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is lacking if the nanopubs of type error never reached the shards of their types."""
    n = bridge.event_nanopubs(spark, sf_dir)
    actual = ingest.shards(n).where(~((F.col("event_type") == "error") & F.col("repo").startswith("type_"))).select("repo", "np")
    return reconcile.missing(n, actual)


@query
def fleet_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories on which the latest reports of the instances do not agree in count or checksum; null equals null only."""
    rows = table(spark, sf_dir, "repo_status").select(clean("instance").alias("instance"), F.regexp_replace(clean("repo"), "^(pubkey|type)/", "$1_").alias("repo"), "np_count", base64_key("checksum").alias("checksum"), "reported_at", "status_row")
    w = Window.partitionBy("instance", "repo").orderBy(F.col("reported_at").desc(), F.col("status_row").desc())
    last = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    return reconcile.consistent(last.select("instance", "repo", F.coalesce("np_count", F.lit(-1)).alias("np_count"), "checksum"))


@query
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.shard_counts(ingest.shards(bridge.event_nanopubs(spark, sf_dir)))


@query
def hash_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.hash_dictionary(bridge.event_nanopubs(spark, sf_dir), "pubkey", "pubkey")


@query
def iri_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, base, code and shard of the spaces' IRIs and roots."""
    s = table(spark, sf_dir, "space_rows")
    return s.select("space_row", parent_prefix(clean("space_iri")).alias("parent"), trusty_base(clean("root_nanopub")).alias("base"), artifact_code("root_nanopub").alias("code"), shard_name("type", F.col("space_iri")).alias("shard"), short_key(F.col("space_ref")).alias("short"), encode_for_uri(F.col("space_iri")).alias("encoded"))


# -- trust


@query
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "trust_accounts").select("delivery_id", clean("agent").alias("agent"), clean("name").alias("name"), "ratio")
    return trust.canonical_names(a, ["delivery_id"])


@query
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "trust_edges")
    return trust.distinct_edges(e).select("trust_state_hash", "from_pubkey", "to_pubkey", "link")


@query
def retained_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "trust_snapshots").select("trust_state_hash", "trust_state_counter").distinct()
    return trust.retained(s, 10)


@query
def trust_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts by status in each delivery, in the order of the registry's counter."""
    s = table(spark, sf_dir, "trust_snapshots").select("delivery_id", "registry", "trust_state_counter")
    a = table(spark, sf_dir, "trust_accounts").groupBy("delivery_id", clean_lower("status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(s, "delivery_id").select("registry", "trust_state_counter", "delivery_id", "status", "n")


@query
def space_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "space_rows").select(clean("space_iri").alias("space"), clean("space_ref").alias("ref"), artifact_code("root_nanopub").alias("root_np"))
    return listing.spaces(s)


# -- spaces and roles


def extraction(ext: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k: v for k, v in ext.items() if k in resolve.EXT} | {"acct": resolve.approved(ext["accounts"])}


def resolver(spark: SparkSession, sf_dir: str) -> resolve.Resolver:
    return resolve.Resolver(spark, extraction(bridge.spaces(spark, sf_dir)))


@query
def mirror_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.approved(bridge.spaces(spark, sf_dir)["accounts"])


@query
def admin_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admins by chains of grants that were not revoked."""
    return resolver(spark, sf_dir).admins().select("ref", "agent")


@query
def role_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolver(spark, sf_dir)
    a = r.admins()
    return r.attachments(a, r.aliases(a)).select("ref", "role")


@query
def space_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all tiers."""
    return resolver(spark, sf_dir).build()["role"].select("ref", "agent", "role", "role_type", "np")


@query
def space_state_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per tier."""
    return resolve.totals(resolver(spark, sf_dir).build())


@query
def prefix_subspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolver(spark, sf_dir)
    return r.prefix_subspaces(spark.createDataFrame([], "child string")).select(resolve.link_iri("derived", F.col("child_ref"), F.col("parent_ref")).alias("link"), "child_ref", "parent_ref")


@query
def newest_revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest revocation of each agent and role per space."""
    rev = bridge.spaces(spark, sf_dir)["revocation"]
    return resolve.latest(rev, ["space", "agent", "role"], ["created", "rev"]).select("space", "agent", "role", "rev")


def authority_rows(r: resolve.Resolver, state: dict[str, DataFrame]) -> DataFrame:
    """The rows of every tier of a state, and of the rules within tiers, as tier and three texts."""
    none = F.lit("")
    admins, same = state["admin"], state["alias"]
    tiers = [
        (admins, "admin", "ref", "agent", none),
        (same, "alias", "ref", "alias", "np"),
        (state["subspace"], "subspace", "child_ref", "parent_ref", "np"),
        (state["prefix"], "prefix", "child_ref", "parent_ref", none),
        (state["maintained"], "maintained", "ref", "resource", "np"),
        (state["governing"], "governing", "ref", "resource", none),
        (state["stamp"], "stamp", "ref", "pa", F.col("active").cast("string")),
        (state["attachment"], "attachment", "ref", "role", "np"),
        (state["role"], "role", "ref", F.concat("agent", F.lit(" "), "role", F.lit(" "), "role_type"), "np"),
        (r.latest_declarations(), "declaration", "kind", F.coalesce("role", none), "pd"),
        (r.latest_assignments(admins, same), "assignment", "ref", "preset", "pa"),
        (r.detached(admins, same), "detached", "ref", "role", F.date_format("detached_at", "yyyy-MM-dd HH:mm:ss")),
    ]
    cols = lambda *cs: [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip("abc", cs)]
    rows = [df.select(F.lit(t).alias("tier"), *cols(*cs)).distinct() for df, t, *cs in tiers]
    rows.append(resolve.edges(state).groupBy("predicate").agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.lit("edges").alias("tier"), *cols("predicate", "n", none)))
    return reduce(DataFrame.unionByName, rows)


@query
def auth_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiers over rows of all kinds: aliases, sub-spaces, maintained resources, presets, detachments, revocations,
    invalidations."""
    r = resolve.Resolver(spark, extraction(bridge.authority(spark, sf_dir)))
    return authority_rows(r, r.build())


@query
def auth_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a build without the younger half of the parts and an incremental cycle that brings them, and with
    them invalidations, deactivations and detachments of what was built."""
    ext = extraction(bridge.authority(spark, sf_dir))
    ext["acct"], _ = materialize(ext["acct"], "acct")
    middle = ext["loads"].where("ln >= 1000000000").agg(F.percentile_approx("ln", 0.5)).first()[0] or 0
    late, _ = materialize(ext["loads"].where(F.col("ln") > middle).select("np").distinct(), "late")
    half = {k: v.join(late, "np", "left_anti") if k in bridge.OF_PARTS else v for k, v in ext.items()}
    half["loads"] = ext["loads"].where(F.col("ln") <= middle)
    half["invalidates"] = ext["invalidates"].join(late.withColumnRenamed("np", "inv"), "inv", "left_anti")
    state = resolve.Resolver(spark, half).build()
    r = resolve.Resolver(spark, ext, since=middle)
    return authority_rows(r.anew(since=None), r.build(state))


# -- text


@query
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all of three words, and their scores."""
    index = textsearch.build_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return textsearch.search(index, "cache memory worker", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


# -- streams and cycles, which SQL cannot express


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanopubs read as a stream in micro-batches and appended once per shard and nanopub, in two runs of which the
    second begins where the first ended."""
    from quadrille.session import scratch
    from quadrille.streaming.feed import append_once

    base = scratch(spark, "stream")
    rows = bridge.event_nanopubs(spark, sf_dir).select("np", "code", "pubkey", "types", "created", "counter")
    rows.repartition(4).write.parquet(f"{base}/feed")
    sink = append_once(f"{base}/out", ["repo", "np"])
    for _ in range(2):
        s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/feed")
        q = s.writeStream.foreachBatch(lambda b, e: sink(ingest.shards(b), e)).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query
def incremental_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles after a build over the older half of the orders and an incremental cycle over all of them; the same as
    those of space_state."""
    ext = extraction(bridge.spaces(spark, sf_dir))
    middle = ext["loads"].agg(F.percentile_approx("ln", 0.5)).first()[0]
    early = ext["loads"].where(F.col("ln") <= middle).select("np").distinct()
    half = {k: v.join(early, "np", "left_semi") if k in ("grant", "attachment", "revocation", "loads") else v for k, v in ext.items()}
    state = resolve.Resolver(spark, half).build()
    return resolve.Resolver(spark, ext, since=middle).build(state)["role"].select("ref", "agent", "role", "role_type", "np")
