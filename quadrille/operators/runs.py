"""Sets of integers as disjoint runs, and as-of matches against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers are handled in blocks of this width, so that one group with most of the rows is spread over many tasks.
WIDTH = 1 << 16


def block_of(num: Column, width: int = WIDTH) -> Column:
    if width & (width - 1) == 0:
        return F.shiftright(num.cast("long"), width.bit_length() - 1)
    return F.floor(num / F.lit(width)).cast("long")


def compress(keys: DataFrame, group: list[str], num: str, width: int = WIDTH) -> DataFrame:
    """The distinct numbers of each group as runs of consecutive ones: group, block, run_start, run_end.

    A run ends at the border of its block. Null numbers and nulls in the group form no run."""
    x = keys.select(*group, F.col(num).cast("long").alias("num")).dropna().distinct().withColumn("block", block_of(F.col("num"), width))
    island = F.col("num") - F.row_number().over(Window.partitionBy(*group, "block").orderBy("num"))
    return x.withColumn("island", island).groupBy(*group, "block", "island").agg(F.min("num").alias("run_start"), F.max("num").alias("run_end")).drop("island")


def merge(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """The union of two sets of runs, overlapping and adjoining ones as one."""
    w = Window.partitionBy(*group, "block").orderBy("run_start", "run_end")
    reach = F.max("run_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = a.unionByName(b).withColumn("fresh", F.when(F.col("run_start") <= reach + 1, 0).otherwise(1))
    x = x.withColumn("k", F.sum("fresh").over(w))
    return x.groupBy(*group, "block", "k").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")).drop("k")


def match(probes: DataFrame, runs: DataFrame, group: list[str], num: str, width: int = WIDTH) -> DataFrame:
    """Each probe with run_start and run_end of the last run that starts at or before its number (within its block;
    null if there is none) and ``covered``: whether the number lies in that run.

    Probes should be distinct numbers; a null number or group is not covered."""
    keep = [c for c in probes.columns if c not in ("block", "run_start", "run_end", "covered")]
    p = probes.select(*keep, F.col(num).cast("long").alias("_n"), block_of(F.col(num), width).alias("block"))
    whole = F.col("_n").isNotNull()
    for g in group:
        whole &= F.col(g).isNotNull()
    r = runs.select(*group, "block", F.col("run_start").alias("_n"), "run_start", "run_end")
    x = r.withColumn("_tag", F.lit(0)).unionByName(p.where(whole).withColumn("_tag", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*group, "block").orderBy("_n", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    found = x.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("run_start", "run_end")}).where("_tag = 1")
    found = found.withColumn("covered", F.coalesce(F.col("_n") <= F.col("run_end"), F.lit(False)))
    rest = p.where(~whole).withColumn("covered", F.lit(False))
    return found.unionByName(rest, allowMissingColumns=True).select(*keep, "run_start", "run_end", "covered")
