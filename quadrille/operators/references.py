"""References to records that do not exist, are gone or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.runs import WIDTH, compress, match
from quadrille.session import materialize

#: Blocks of the integers that stand for keys, each small enough to be sorted by one task.
BLOCKS = 4096
#: A key with more than this share of the references is joined apart; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE, HOT_LEAST = 1 / 2000, 100_000


def integer_key(df: DataFrame, blocks: int = BLOCKS) -> tuple[Column, int]:
    """The integer that stands for a key, and the width of a block of them: integers stand for themselves, other keys
    are hashed to 64 bits, which spreads them evenly over the blocks."""
    if dict(df.dtypes)["key"] in ("tinyint", "smallint", "int", "bigint"):
        return F.col("key").cast("long"), WIDTH
    return F.xxhash64("key"), 1 << (64 - max(1, (blocks - 1).bit_length()))


def orphans(refs: DataFrame, parents: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """References without a valid target at their time: the columns of ``refs`` and ``reason``.

    ``refs``: key, at and any other columns (one named reason is replaced). ``parents``: key, since, until, one row or more per key; a
    record exists from the earliest ``since`` and is deleted from the earliest ``until`` (null = never). Reasons, the
    first that fits: ``missing`` (null key, or a key that no parent has), ``late`` (since > at), ``deleted``
    (until <= at). A reference without a time can only be missing; a parent without ``since`` exists from the start.

    The sorted integers of the parents' keys are compressed to runs; the integer of a referenced key is matched to the
    last run that starts at or before it, and is missing beyond the run's end. Only keys inside a run are looked up
    among the parents, for their times and, where the integer is a hash, to make sure of the key. Referenced keys are
    combined before they are matched; rows are joined only with the keys that can make an orphan of them.
    """
    spark = refs.sparkSession
    kind = dict(refs.dtypes)["key"]
    own = [c for c in refs.columns if c not in ("key", "at", "reason")]
    refs = refs.select("key", "at", F.struct(*(F.col(f"`{c}`") for c in own), F.lit(0).alias("_")).alias("_own"))
    num, width = integer_key(refs, blocks)
    asked = refs.where("key is not null").groupBy("key").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n")).withColumn("num", num)
    held, _ = materialize(parents.where("key is not null").select(F.col("key").cast(kind).alias("key"), "since", "until").groupBy("key").agg(F.min("since").alias("since"), F.min("until").alias("until")).withColumn("num", num), "parents")
    matched, _ = materialize(match(asked, compress(held, [], "num", width), [], "num", width).select("key", "a", "b", "n", "num", "covered"), "matched")
    beyond = matched.where("not covered").select("key", F.lit(False).alias("held"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("until"), "n")
    inside = matched.where("covered").join(held.select("num", "key", "since", "until", F.lit(True).alias("held")), ["num", "key"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    suspects, _ = materialize(beyond.unionByName(inside.where("not held or since > a or until <= b").select(*beyond.columns)), "suspects")
    total = matched.agg(F.sum("n")).first()[0] or 0
    hot_n = max(HOT_LEAST, total * HOT_SHARE)
    hot = [x[0] for x in matched.where(F.col("n") > hot_n).select("key").collect()]  # fewer than 1 / HOT_SHARE keys
    named = refs.where("key is not null")
    if hot:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], f"key {kind}"))
        apart = named.join(F.broadcast(suspects.join(keys, "key", "left_semi")), "key")
        joined = apart.unionByName(named.join(keys, "key", "left_anti").join(suspects.join(keys, "key", "left_anti"), "key"))
    else:
        joined = named.join(suspects, "key")
    reason = F.when(~F.col("held"), "missing").when(F.col("since") > F.col("at"), "late").when(F.col("until") <= F.col("at"), "deleted")
    found = joined.withColumn("reason", reason).where("reason is not null").select("key", "at", "_own", "reason")
    found = found.unionByName(refs.where("key is null").select("key", "at", "_own", F.lit("missing").alias("reason")))
    return found.select("key", "at", *(F.col("_own")[c].alias(c) for c in own), "reason")


def report(found: DataFrame, by: list[str]) -> DataFrame:
    """Orphans per table, period and reason."""
    return found.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_keys"))
