"""The driver's tables as objects of the domain: events as nanopubs, customers and orders as agents and grants, rows
as quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.model import Mapping, MappedQuads, ns
from quadrille.plans.ingest import GRAPH
from quadrille.operators.ranks import row_numbers
from quadrille.plans.resolve import ADMIN, ADMIN_PRED, GEN, GEN_SPACE, MAINTAINER, MEMBER, OBSERVER
from quadrille.session import materialize
from quadrille.sources.tables import table
from quadrille.sparql.parser import XSD

EX = "http://ex.org/"
#: PREFIX table of the queries over these tables.
PREFIXES = {"ex": EX, "col": EX + "col/"} | {p: ns(p + ":") for p in ("npa", "npx", "np", "dct", "rdfs", "xsd", "foaf")}


def code(c: Column) -> Column:
    """An artifact code for a number."""
    return F.concat(F.lit("RA"), F.substring(F.sha2(c.cast("string"), 256), 1, 43))


def np_iri(c: Column) -> Column:
    return F.concat(F.lit("https://np.example.org/"), code(c))


def event_nanopubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a nanopub: its user signs, its type is its type, and a number in its properties its label."""
    e = table(spark, sf_dir, "events")
    pubkey = F.concat(F.lit("pk"), F.col("user_id").cast("string"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        np_iri(F.col("event_id")).alias("np"), code(F.col("event_id")).alias("code"), pubkey.alias("pubkey"), F.sha2(pubkey, 256).alias("pk"), F.col("ts").cast("timestamp").alias("created"), F.array(F.concat(F.lit(EX + "type/"), "event_type")).alias("types"),
        F.when(k < 50, F.concat(F.lit("label "), k.cast("string"))).alias("label"), F.col("event_id").alias("counter"), "user_id", "event_type", "value", "event_id",
    )


def event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """np, pred, target: purchases supersede the user's purchase before, errors invalidate the user's event before, and
    views invalidate the event with the number before, which mostly is another user's and then void."""
    e = table(spark, sf_dir, "events")
    user, kind = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    x = e.select("event_id", "event_type", F.lag("event_id").over(user).alias("before"), F.lag("event_id").over(kind).alias("same"))
    target = F.when(F.col("event_type") == "purchase", F.col("same")).when(F.col("event_type") == "error", F.col("before")).when(F.col("event_type") == "view", F.when(F.col("event_id") > 0, F.col("event_id") - 1))
    pred = F.when(F.col("event_type") == "purchase", "supersedes").otherwise("invalidates")
    return x.withColumns({"t": target, "pred": pred}).where("t is not null").select(np_iri(F.col("event_id")).alias("np"), "pred", np_iri(F.col("t")).alias("target"))


def quad_source(spark: SparkSession, sf_dir: str) -> MappedQuads:
    """Nanopubs in the admin graph of the repository meta; customers, orders, nations, regions and suppliers in a graph
    each of the repository full."""
    n, rel = event_nanopubs(spark, sf_dir), event_relations(spark, sf_dir)
    ms = []
    for p, o, kind, dt in (
        ("npa:hasValidSignatureForPublicKeyHash", F.col("pk"), "lit", XSD + "string"), ("dct:created", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "lit", XSD + "dateTime"), ("npx:hasNanopubType", F.col("types")[0], "iri", ""),
        ("rdfs:label", F.col("label"), "lit", XSD + "string"), ("npa:hasLoadNumber", F.col("counter"), "lit", XSD + "long"),
    ):
        ms.append(Mapping(n, GRAPH, F.col("np"), ns(p), o, kind, dt, "meta", "events"))
    for p in ("invalidates", "supersedes"):
        ms.append(Mapping(rel.where(F.col("pred") == p), GRAPH, F.col("np"), ns("npx:" + p), F.col("target"), "iri", "", "meta"))
    iri = lambda kind, c: F.concat(F.lit(f"{EX}{kind}/"), F.col(c).cast("string"))
    links = {"c_nationkey": "nation", "n_regionkey": "region", "s_nationkey": "nation", "o_custkey": "customer"}
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")):
        df = table(spark, sf_dir, name)
        for c, t in df.dtypes:
            if c == key:
                continue
            if c in links:
                o, kind, dt = iri(links[c], c), "iri", ""
            elif t.startswith("timestamp"):
                o, kind, dt = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "lit", XSD + "dateTime"
            else:
                o, kind, dt = F.col(c), "lit", XSD + {"double": "double", "string": "string"}.get(t, "integer")
            ms.append(Mapping(df, EX + name, iri(name, key), EX + "col/" + c, o, kind, dt, "full", name))
    return MappedQuads(spark, ms)


ROLE_OF = {"1-URGENT": MAINTAINER, "2-HIGH": MEMBER}


def spaces(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Extraction rows: nations are spaces under their regions; customers are agents, approved in two segments; an order
    is a nanopub of its customer that names the customer of the nation's next order. Its status and priority say what
    it is: a grant (status O: admin for the two highest priorities, else a role), an attachment of the priority's role
    (P), or a revocation (F)."""
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    cust = lambda c: F.concat(F.lit(EX + "agent/"), c.cast("string"))
    key = lambda c: F.sha2(F.concat(F.lit("ck"), c.cast("string")), 256)
    status = F.create_map(*(F.lit(x) for kv in (("BUILDING", "loaded"), ("MACHINERY", "toLoad"), ("HOUSEHOLD", "contested"), ("FURNITURE", "skipped"), ("AUTOMOBILE", "seen")) for x in kv))[F.col("c_mktsegment")]
    accounts = customer.select(cust(F.col("c_custkey")).alias("agent"), key(F.col("c_custkey")).alias("pubkey"), status.alias("status"))
    space = F.concat(F.lit(EX), "r_name", F.lit("/"), "n_name")
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", space.alias("space"), F.concat(F.lit(EX), "r_name").alias("prefix"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("ref"))
    r = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ref"), F.concat(F.lit(EX), "r_name").alias("space"), F.lit(None).cast("string").alias("prefix"))
    root = customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("k"))
    definition = n.join(root, "n_nationkey").select("ref", F.concat(F.lit("https://np.example.org/def/"), "ref").alias("np"), cust(F.col("k")).alias("root_admin"))
    o = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o, _ = materialize(row_numbers(o, ["c_nationkey"], ["o_orderdate", "o_orderkey"], F.floor(F.unix_date(F.to_date("o_orderdate")) / 30), "rn"), "orders")
    o = o.join(o.select("c_nationkey", (F.col("rn") - 1).alias("rn"), F.col("o_custkey").alias("next")), ["c_nationkey", "rn"])
    o, _ = materialize(o.select("o_orderkey", "o_custkey", "next", "c_nationkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "order-nanopubs")  # numbers; their texts are many times as long
    o = o.join(F.broadcast(n.select("n_nationkey", "space")), F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.select("o_orderstatus", "o_orderpriority", "space", np_iri(F.col("o_orderkey")).alias("np"), key(F.col("o_custkey")).alias("pk"), cust(F.col("next")).alias("agent"), F.col("o_orderdate").cast("timestamp").alias("created"), F.col("o_orderkey").alias("ln"), F.concat(F.lit(EX + "role/"), "o_orderpriority").alias("role"), F.concat(F.lit(EX + "pred/"), "o_orderpriority").alias("pred"))
    admin = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    grant = o.where("o_orderstatus = 'O'")
    inverse = grant.where(admin).select(F.col("np").alias("ri"), "space", "agent", F.lit("inverse").alias("dir"), F.lit(ADMIN_PRED).alias("pred"), "pk", "np", "created")
    regular = grant.select(F.concat("np", F.lit("#r")).alias("ri"), "space", "agent", F.lit("regular").alias("dir"), "pred", "pk", "np", "created")
    prio = orders.select("o_orderpriority").distinct()
    tier = F.when(F.col("o_orderpriority") == "1-URGENT", MAINTAINER).when(F.col("o_orderpriority") == "2-HIGH", MEMBER).otherwise(OBSERVER)
    return {
        "accounts": accounts,
        "ref_iri": n.select("ref", "space", "prefix").unionByName(r),
        "definition": definition,
        "grant": inverse.unionByName(regular),
        "attachment": o.where("o_orderstatus = 'P'").select(F.col("np").alias("ra"), "space", "role", "pk", "np", "created"),
        "declaration": prio.select(F.concat(F.lit(EX + "role/"), "o_orderpriority").alias("role"), tier.alias("role_type"), F.lit("regular").alias("dir"), F.concat(F.lit(EX + "pred/"), "o_orderpriority").alias("pred"), F.lit("https://np.example.org/decl").alias("np")),
        "revocation": o.where("o_orderstatus = 'F'").select(F.col("np").alias("rev"), "space", "agent", F.when(admin, ADMIN).otherwise(F.col("role")).alias("role"), "pk", "np", "created"),
        "loads": o.select("np", "ln", "pk"),
        "gen": spark.createDataFrame([(GEN,)], "iri string"),
    }


#: The tables of authority() all of whose nanopubs are parts; of the others only loads names any.
OF_PARTS = ("subspace", "maintained", "alias", "preset_decl", "preset_assign", "detachment")
#: The roles by number, as the priorities of orders name them.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def authority(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The rows of spaces() and those of all other kinds. Suppliers are spaces of their own under their nation's space,
    each with an approved customer of the nation as its root and only admin; the roots of nations name themselves
    admins, too. A part is a nanopub of the nation that its brand's number names, published by one of the first three
    approved customers of the nation, or of the next one for some sub-spaces; its type says whether it declares a
    sub-space, a maintained resource, an alias or a preset, assigns a preset, or detaches a role.
    Hot parts invalidate the part before of the same publisher, red ones that with the number before, whose publisher
    mostly is another."""
    ext = spaces(spark, sf_dir)
    customer, supplier, part = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit(EX), "r_name", F.lit("/"), "n_name").alias("space"))
    cust = lambda c: F.concat(F.lit(EX + "agent/"), c.cast("string"))
    key = lambda c: F.sha2(F.concat(F.lit("ck"), c.cast("string")), 256)
    good = customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.col("c_nationkey").alias("nk"))
    good = row_numbers(good, ["nk"], ["c_custkey"], F.floor(F.col("c_custkey") / 100_000), "rk").select("nk", "rk", cust(F.col("c_custkey")).alias("agent"), key(F.col("c_custkey")).alias("pk"))
    sup = row_numbers(supplier.select("s_suppkey", F.col("s_nationkey").alias("nk")), ["nk"], ["s_suppkey"], F.floor(F.col("s_suppkey") / 100_000), "rk")
    sup = sup.join(good, ["nk", "rk"]).join(nation.withColumnRenamed("n_nationkey", "nk"), "nk")
    sup = sup.select("nk", "rk", "agent", "pk", F.col("space").alias("above"), F.concat(F.lit("s"), "s_suppkey").alias("ref"), F.concat("space", F.lit("/s"), "s_suppkey").alias("space"), F.concat(F.lit("https://np.example.org/def/s"), "s_suppkey").alias("np"))
    sup, _ = materialize(sup, "suppliers")
    epoch = F.lit("2024-01-01").cast("timestamp")
    nk = F.substring_index("p_brand", "#", -1).cast("long") - 1
    p = part.select("p_partkey", "p_type", F.col("p_size").cast("long").alias("size"), F.split("p_name", " ")[0].alias("colour"), (F.col("p_name") < "m").alias("first"), nk.alias("nk"), np_iri(F.concat(F.lit("p"), "p_partkey")).alias("np"))
    rank = F.floor(((F.col("size") - 1) % 25) / 10) + 1
    of = F.when((F.col("p_type") == "ECONOMY") & ~F.col("first") & (F.col("size") > 25), (F.col("nk") + 1) % 25).otherwise(F.col("nk"))
    p = p.withColumns({"rk": rank, "of": of}).join(good.withColumnRenamed("nk", "of"), ["of", "rk"])
    p = p.join(nation.select(F.col("n_nationkey").alias("nk"), "space"), "nk").withColumns({"created": F.timestamp_micros(F.unix_micros(epoch) + F.col("p_partkey") * 60_000_000), "role": F.concat(F.lit(EX + "role/"), F.element_at(F.array(*map(F.lit, PRIORITIES)), F.least(F.floor((F.col("size") - 1) / 10) + 1, F.lit(5)).cast("int")))})
    p, _ = materialize(p, "parts")  # every rule reads some of them
    kind = lambda t: p.where(F.col("p_type") == t)
    near = kind("ECONOMY").where("first").join(sup.select("nk", "rk", F.col("space").alias("child")), ["nk", "rk"]).select("child", F.col("space").alias("parent"), "pk", "np")
    far = kind("ECONOMY").where("not first").join(nation.select(((F.col("n_nationkey") + 24) % 25).alias("nk"), F.col("space").alias("parent")), "nk").select(F.col("space").alias("child"), "parent", "pk", "np")
    owned = kind("MEDIUM").join(sup.select("nk", "rk", F.col("space").alias("own")), ["nk", "rk"], "left")
    own = ext["definition"].join(ext["ref_iri"].select("ref", "space"), "ref").withColumn("k", F.substring_index("root_admin", "/", -1))
    number, brand = F.col("size").cast("string"), F.col("nk").cast("string")
    w = Window.partitionBy("pk").orderBy("p_partkey")
    before = p.withColumn("target", F.lag("np").over(w)).where("colour = 'hot' and target is not null").select(F.col("np").alias("inv"), "target")
    other = part.where(F.col("p_name").startswith("red ") & (F.col("p_partkey") > 0)).select(np_iri(F.concat(F.lit("p"), "p_partkey")).alias("inv"), np_iri(F.concat(F.lit("p"), F.col("p_partkey") - 1)).alias("target"))
    more = {
        "ref_iri": sup.select("ref", "space", F.col("above").alias("prefix")),
        "definition": sup.select("ref", "np", F.col("agent").alias("root_admin")),
        "grant": sup.select(F.concat("np", F.lit("#a")).alias("ri"), "space", "agent", F.lit("inverse").alias("dir"), F.lit(ADMIN_PRED).alias("pred"), "pk", "np", epoch.alias("created")).unionByName(own.select(F.concat("np", F.lit("#a")).alias("ri"), "space", F.col("root_admin").alias("agent"), F.lit("inverse").alias("dir"), F.lit(ADMIN_PRED).alias("pred"), key(F.col("k")).alias("pk"), "np", epoch.alias("created"))),
        "subspace": near.unionByName(far).withColumn("d", F.concat("np", F.lit("#d"))),
        "maintained": kind("LARGE").select(F.col("np").alias("d"), F.concat(F.lit(EX + "res/"), brand, F.lit("-"), number).alias("resource"), "space", "pk", "np"),
        "alias": owned.select(F.col("np").alias("d"), F.col("space").alias("canonical"), F.coalesce("own", F.concat(F.lit(EX + "alias/"), brand, F.lit("-"), number)).alias("alias"), "pk", "np"),
        "preset_decl": kind("PROMO").select(F.col("np").alias("pd"), F.concat(F.lit(EX + "kind/"), brand).alias("kind"), F.concat(F.lit(EX + "preset/"), brand).alias("preset"), "role", F.when(F.col("size") <= 40, GEN_SPACE).otherwise(EX + "Other").alias("applies_to"), "np", "created"),
        "preset_assign": kind("SMALL").select(F.col("np").alias("pa"), F.concat(F.lit(EX + "preset/"), brand).alias("preset"), F.col("space").alias("resource"), (F.col("size") <= 30).alias("active"), "pk", "np", "created"),
        "detachment": kind("STANDARD").select(F.col("np").alias("det"), "space", "role", "pk", "np", "created"),
        "loads": p.select("np", (F.col("p_partkey") + 1_000_000_000).alias("ln"), "pk").unionByName(sup.select("np", F.lit(-1).cast("long").alias("ln"), "pk")),
        "invalidates": before.unionByName(other),
    }
    return {k: ext[k].unionByName(more[k]) if k in ext and k in more else more.get(k, ext.get(k)) for k in ext.keys() | more.keys()}
