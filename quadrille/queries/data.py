"""The p-queries of the core."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.text import artifact_code, base64_key, clean, clean_lower, unpack_key
from quadrille.operators.cells import snapshot_changes
from quadrille.operators.chunkdiff import differences
from quadrille.operators.firstmatch import first_reading
from quadrille.operators.history import believed, build_ledger
from quadrille.operators.incremental import VersionedState, classify, content_hash, process
from quadrille.operators.references import orphans, report
from quadrille.operators.sequences import STATE_RUNS, STATE_SEEN, accept, advance_runs
from quadrille.plans.snapshots import Snapshots, read_snapshots
from quadrille.session import broadcast_if_small, materialize, scratch
from quadrille.sources.tables import table

ACCOUNT = ["pk", "agent", "chain_id"]


def account_ledger(snaps: Snapshots) -> DataFrame:
    attrs = ["status", "name", "name_created_at"]
    return build_ledger(snaps.states(*attrs), snaps.chain.select("chain_id", "ord", "recorded"), attrs, small=lambda df: broadcast_if_small(df, snaps.n_bytes))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of accounts as believed now."""
    snaps = read_snapshots(spark, sf_dir)
    now = believed(account_ledger(snaps))
    start = snaps.small("chain_id", "ord", "registry", "counter").withColumnRenamed("ord", "from_ord")
    end = snaps.small("chain_id", "ord", "counter").select("chain_id", F.col("ord").alias("to_ord"), F.col("counter").alias("valid_to"))
    rows = now.join(start, ["chain_id", "from_ord"]).join(end, ["chain_id", "to_ord"], "left")
    return rows.select("registry", unpack_key(F.col("pk")).alias("pubkey"), "agent", F.col("counter").alias("valid_from"), F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts added, removed or changed in status between consecutive snapshots."""
    snaps = read_snapshots(spark, sf_dir)
    last = snaps.chain.groupBy("chain_id").agg(F.max("ord").alias("last_ord"))
    rows = snapshot_changes(snaps.states("status"), broadcast_if_small(last, snaps.n_bytes), ACCOUNT, ["status"])
    return rows.join(snaps.small("chain_id", "ord", "trust_state_hash"), ["chain_id", "ord"]).select("trust_state_hash", unpack_key(F.col("pk")).alias("pubkey"), "agent", "change_kind")


def nanopub_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference that is not blank: src_table, row_id, key (artifact code or null), at."""
    received = table(spark, sf_dir, "trust_snapshots").select("delivery_id", F.col("received_at").alias("at"))
    parts = []
    for name, row, ref in (("trust_accounts", "acc_row", "intro_nanopub"), ("trust_edges", "edge_row", "via_nanopub")):
        rows = table(spark, sf_dir, name).select("delivery_id", F.col(row).alias("row_id"), clean(ref).alias("ref")).where("ref is not null")
        parts.append(rows.join(received, "delivery_id", "left").withColumn("src_table", F.lit(name)))
    rows = table(spark, sf_dir, "space_rows").select(F.col("space_row").alias("row_id"), clean("root_nanopub").alias("ref"), F.col("extracted_at").alias("at"), F.lit("space_rows").alias("src_table")).where("ref is not null")
    cols = ["src_table", "row_id", artifact_code("ref").alias("key"), "at"]
    return parts[0].select(*cols).unionByName(parts[1].select(*cols)).unionByName(rows.select(*cols))


def nanopub_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, since (first load), until (first load of the first nanopub that invalidates it under a key of its own)."""
    loads = table(spark, sf_dir, "np_load").select(artifact_code("np").alias("key"), clean_lower("pubkey_hash").alias("pk"), F.col("load_timestamp").alias("t"), artifact_code("invalidates_np").alias("target")).where("key is not null")
    since = loads.groupBy("key").agg(F.min("t").alias("since"))
    named = loads.where("target is not null and pk is not null").select(F.col("key").alias("by"), "pk", F.col("target").alias("key")).distinct()
    valid = named.join(loads.where("pk is not null").select("key", "pk").distinct(), ["key", "pk"])
    until = valid.join(since.select(F.col("key").alias("by"), F.col("since").alias("until")), "by").groupBy("key").agg(F.min("until").alias("until"))
    return since.join(until, "key", "left")


def nanopub_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(nanopub_references(spark, sf_dir), nanopub_lifetimes(spark, sf_dir)).withColumn("ref_month", F.date_format("at", "yyyy-MM"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nanopubs that were not loaded or not valid at the time."""
    return nanopub_orphans(spark, sf_dir).select("src_table", "row_id", "ref_month", "reason")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    return report(nanopub_orphans(spark, sf_dir), ["src_table", "ref_month"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the latest reports of the two instances."""
    rows = table(spark, sf_dir, "repo_status").select(
        clean("instance").alias("instance"), F.regexp_replace(clean("repo"), "^(pubkey|type)/", "$1_").alias("repo"), "np_count", base64_key("checksum").alias("checksum"), "reported_at", "status_row"
    ).where("repo is not null and instance in ('inst-a', 'inst-b')")
    order = F.struct("reported_at", "status_row")
    latest = rows.groupBy("instance", "repo").agg(F.max(F.struct(order.alias("o"), "np_count", "checksum")).alias("v")).select("instance", "repo", "v.np_count", "v.checksum")
    kept, _ = materialize(latest, "latest")
    side = lambda name: kept.where(F.col("instance") == name)
    return differences(side("inst-a"), side("inst-b"), ["repo"], ["np_count", "checksum"])


#: Parts of the time line after each of which p4_found and p5_found put a new state in force.
BATCHES = 3


def _cuts(df: DataFrame, col: str, parts: int = BATCHES) -> list:
    """Times that split the rows in about equal parts."""
    shares = [k / parts for k in range(1, parts)]
    cuts = df.select(F.unix_micros(F.col(col).cast("timestamp")).alias("t")).agg(F.percentile_approx("t", shares).alias("c")).first()[0]
    return cuts or []


def _part(col: str, cuts: list) -> Column:
    """The part a row falls into; rows without a time are in the last one."""
    t, part = F.unix_micros(F.col(col).cast("timestamp")), F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        part = F.when(t <= F.lit(cuts[k]), k).otherwise(part)
    return part


def successful_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, setup_id, load_counter, polled_at of the successful runs, and the place of their setup in time."""
    polls = table(spark, sf_dir, "registry_polls").where(clean("outcome") == "ok").where("setup_id is not null and load_counter is not null and polled_at is not null")
    places = polls.groupBy("setup_id").agg(F.min(F.unix_micros(F.col("polled_at").cast("timestamp"))).alias("began")).select("setup_id", F.struct("began", "setup_id").alias("place"))
    return polls.select("run_id", "setup_id", "load_counter", "polled_at").join(places, "setup_id")


def sightings(feed: DataFrame, runs: DataFrame) -> DataFrame:
    """All that the runs see of the feed, whatever other runs saw, each with the first of them: setup_id, load_number, code,
    run_id, polled_at, place. ``feed``: setup_id, load_number, code, arrived_at."""
    readings = runs.select(F.col("setup_id").alias("grp"), F.col("polled_at").alias("at"), F.col("load_counter").alias("lvl"), F.col("run_id").alias("id"))
    points = feed.select(F.col("setup_id").alias("grp"), F.col("arrived_at").alias("at"), F.col("load_number").alias("lvl"), "code")
    seen = first_reading(points, readings).select(F.col("grp").alias("setup_id"), F.col("lvl").alias("load_number"), "code", F.col("id").alias("run_id"))
    return seen.join(runs.select("run_id", "polled_at", "place"), "run_id")


STATE_DUE = "code string, content_hash string, place struct<began: bigint, setup_id: bigint>"


def due_numbers(rows: DataFrame, state: VersionedState, work) -> None:
    """One span of runs: what they see passes through the keyed state, and what is due goes to ``work``. The key is the
    nanopub, its contents the numbers it was seen under; a number that the state does not hold is due, unless the
    nanopub was seen under an earlier setup. Rows without a nanopub are always due."""
    places, cols = state.read().select("code", "place"), ["setup_id", "load_number", "polled_at", "run_id"]

    def select(fresh: DataFrame) -> None:
        earliest = places.unionByName(fresh.select("code", "place")).groupBy("code").agg(F.min("place").alias("earliest"))
        known = fresh.join(earliest, "code").where("place <= earliest")
        work(known.select(*cols).unionByName(rows.where("code is null").select(*cols)))

    process(rows.where("code is not null"), state, ["code"], select, classify)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load numbers each successful run had to process. The runs are replayed in a few spans of time, of which each
    reads the state the one before put in force; see due_numbers()."""
    runs, size = materialize(successful_runs(spark, sf_dir), "runs")
    feed = table(spark, sf_dir, "window_feed").groupBy("setup_id", "load_number", F.coalesce(artifact_code("np_id"), clean("np_id")).alias("code")).agg(F.min("arrived_at").alias("arrived_at"))
    feed, _ = materialize(feed, "feed")
    state = VersionedState(spark, scratch(spark, "p4-state"), STATE_DUE)
    cuts, out = _cuts(runs, "polled_at"), []
    for k in range(len(cuts) + 1):
        span = runs.where(_part("polled_at", cuts) == k)
        own = feed.join(broadcast_if_small(span.select("setup_id").distinct(), size), "setup_id", "left_semi")
        rows, _ = materialize(sightings(own, span).withColumn("content_hash", content_hash("setup_id", "load_number")), "sightings")
        due_numbers(rows, state, lambda due: out.append(materialize(due, "due")[0]))
    per = reduce(DataFrame.unionByName, out).groupBy("setup_id", "load_number").agg(F.min_by("run_id", F.struct("polled_at", "run_id")).alias("run_id"))
    return per.select("run_id", "load_number")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a nanopub in the feed but the first; rows without a time come last."""
    feed = table(spark, sf_dir, "window_feed")
    key, cuts = F.coalesce(artifact_code("np_id"), clean("np_id")), _cuts(feed, "arrived_at")
    own = feed.select(F.col("setup_id").alias("producer"), F.col("load_number").alias("number"), key.alias("key"), F.struct(F.col("arrived_at").isNull().alias("undated"), "arrived_at", "feed_id").alias("ord"), _part("arrived_at", cuts).alias("part"))
    messages, _ = materialize(own.where("key is not null").groupBy("part", "producer", "number", "key").agg(F.min("ord").alias("ord")), "messages", ("part",))
    runs, seen, kept = spark.createDataFrame([], STATE_RUNS), VersionedState(spark, scratch(spark, "p5-seen"), STATE_SEEN), []
    for k in range(len(cuts) + 1):
        new, ids = accept(messages.where(F.col("part") == k).drop("part"), runs, seen.read())
        kept.append(materialize(new.select(F.col("first.feed_id").alias("feed_id")), "kept")[0])
        if k < len(cuts):
            runs, _ = materialize(advance_runs(ids, runs), "runs")
            seen.swap(seen.stage(ids))
    return feed.where(clean("np_id").isNotNull()).select("feed_id").join(reduce(DataFrame.unionByName, kept), "feed_id", "left_anti")
