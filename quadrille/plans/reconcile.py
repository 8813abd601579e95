"""Is every nanopub in every shard it belongs to?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.ingest import shards


def missing(nanopubs: DataFrame, actual: DataFrame, driver: str = "meta") -> DataFrame:
    """repo, np of memberships that should exist and do not; the driving shard is not checked against itself."""
    expected = shards(nanopubs).where(F.col("repo") != driver).select("repo", "np")
    return expected.join(actual.select("repo", "np").distinct(), ["repo", "np"], "left_anti")


#: Minutes for which a nanopub that is not in the driving shard yet may still be on its way.
IN_FLIGHT = 30


def completion_gate(nanopubs: DataFrame, actual: DataFrame, now: Column, driver: str = "meta", minutes: int = IN_FLIGHT) -> DataFrame:
    """np, load_number of nanopubs that are not in the driving shard, which is written last, and are young enough to be
    still loading: the sweep must halt below the first of them. Older ones are lost and count as lacking."""
    young = nanopubs.where(F.col("loaded_at") > now - F.make_interval(mins=F.lit(minutes)))
    return young.join(actual.where(F.col("repo") == driver).select("np"), "np", "left_anti").select("np", "load_number")


def forward_sweep(nanopubs: DataFrame, actual: DataFrame, checkpoint: int, limit: int | None = 1000, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The next nanopubs above the checkpoint by load number: what they lack, and the new checkpoint (one row), which
    stops below the first that lacks something and, with ``now``, below the first that is still loading."""
    page = nanopubs.where(F.col("load_number") > checkpoint)
    if now is not None:
        gate = completion_gate(page, actual, now).agg(F.min("load_number").alias("halt"))
        page = page.crossJoin(F.broadcast(gate)).where("halt is null or load_number < halt").drop("halt")
    if limit is not None:
        page = page.orderBy("load_number").limit(limit)
    lack = missing(page, actual).join(page.select("np", "load_number"), "np")
    found = page.agg(F.max("load_number").alias("top")).crossJoin(lack.agg(F.min("load_number").alias("gap")))
    return lack, found.select(F.greatest(F.lit(checkpoint), F.coalesce(F.least("top", F.col("gap") - 1), F.col("top"), F.lit(checkpoint))).alias("checkpoint"))


def retro_sweep(nanopubs: DataFrame, actual: DataFrame, checkpoint: int, now: Column, hours: int = 24, limit: int | None = None, below: int | None = None) -> DataFrame:
    """What the nanopubs of the last hours at or below the checkpoint lack. With ``limit`` only the newest so many are
    looked at; ``below`` goes on with those under the least load number of the page before (see page_end())."""
    return missing(_retro_page(nanopubs, checkpoint, now, hours, limit, below), actual)


def _retro_page(nanopubs: DataFrame, checkpoint: int, now: Column, hours: int, limit: int | None, below: int | None) -> DataFrame:
    page = nanopubs.where((F.col("load_number") <= checkpoint) & (F.col("loaded_at") >= now - F.make_interval(hours=F.lit(hours))))
    if below is not None:
        page = page.where(F.col("load_number") < below)
    return page if limit is None else page.orderBy(F.col("load_number").desc()).limit(limit)


def page_end(nanopubs: DataFrame, checkpoint: int, now: Column, hours: int = 24, limit: int | None = None, below: int | None = None) -> int | None:
    """The least load number of a page of the retro sweep, to go on below; None after the last page."""
    return _retro_page(nanopubs, checkpoint, now, hours, limit, below).agg(F.min("load_number")).first()[0]


def repair(lack: DataFrame, nanopubs: DataFrame, sink, epoch: int = 0) -> DataFrame:
    """Load what is lacking: the rows of shards() for the missing memberships, handed to an idempotent sink. Nanopubs
    that cannot be had remain missing. The shard spaces may stay without those that it has no rows of."""
    rows = shards(nanopubs).join(lack.select("repo", "np").distinct(), ["repo", "np"], "left_semi")
    sink(rows, epoch)
    return rows


def consistent(counts: DataFrame) -> DataFrame:
    """Shards whose counts or checksums are not equal on all instances: repo. ``counts``: instance, repo, np_count,
    checksum; a shard that some instance lacks differs."""
    n = counts.select("instance").distinct().agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("repo").agg(F.countDistinct("instance").alias("m"), F.countDistinct(F.struct("np_count", "checksum")).alias("k"))
    return per.crossJoin(n).where("m < n or k > 1").select("repo")


def sync_lag(registry: Column, loaded: Column) -> Column:
    """How far a shard is behind; -1 if unknown."""
    return F.when(registry.isNull() | loaded.isNull(), -1).otherwise(F.greatest(registry - loaded, F.lit(0)))


def shard_counts(repos: DataFrame) -> DataFrame:
    """Numbers of shards by kind."""
    kind = F.when(F.col("repo").startswith("pubkey_"), "pubkey").when(F.col("repo").startswith("type_"), "type").otherwise("other")
    return repos.select("repo").distinct().groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
