"""Differences between two copies of a table, by content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.session import materialize

#: Rows whose hashes roll together, and the mean number of rows in a chunk.
ROLL, MEAN = 4, 32


def chunk(rows: DataFrame, roll: int = ROLL, mean: int = MEAN, key: tuple[str, ...] = ("_h",)) -> DataFrame:
    """Rows with the chunk they fall into. ``rows``: _side, _lane, _h (hash of the key), _row_hash. Within a lane and side
    rows are sorted by ``key``; a chunk ends after a row where the hash over it and the rows before meets the condition."""
    w = Window.partitionBy("_lane", "_side").orderBy(*key, "_row_hash")
    rolled = F.sum(F.shiftright("_h", 8)).over(w.rowsBetween(-(roll - 1), 0))
    cut = F.when(F.pmod(F.xxhash64(rolled), F.lit(mean)) == 0, 1).otherwise(0)
    return rows.withColumn("_cut", cut).withColumn("_chunk", F.coalesce(F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def differences(a: DataFrame, b: DataFrame, key: list[str], fields: list[str], lanes: int | None = None, roll: int = ROLL, mean: int = MEAN) -> DataFrame:
    """What two copies differ in: key, finding, where finding is ``missing_a``, ``missing_b`` or the name of a field
    whose values differ (one row each); null equals null only.

    Both have one row per key (of repeated ones the greatest counts); a null key is a key. Further columns are
    ignored; names that start with _ are reserved. A hash of the key spreads any keys evenly over the lanes. In a lane
    rows are sorted by the key and cut into chunks at places that depend on the content alone, so that both copies
    are cut alike wherever they agree; the chunked rows are written once. Chunks with the same fingerprint in both
    copies drop out; only rows of the others are compared. Two empty copies do not differ.
    """
    spark = a.sparkSession
    lanes = lanes or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def hashed(df: DataFrame, side: str) -> DataFrame:
        parts: list[Column] = [x for f in fields for x in (F.col(f), F.col(f).isNull())]
        return df.select(*key, *fields, F.lit(side).alias("_side"), F.xxhash64(*key).alias("_h"), F.xxhash64(*key, *parts).alias("_row_hash"), F.xxhash64(F.lit("b"), *key, *parts).alias("_row_hash2"))

    both = hashed(a, "a").unionByName(hashed(b, "b")).withColumn("_lane", F.pmod(F.shiftright("_h", 40), F.lit(lanes)))
    rows, _ = materialize(chunk(both.repartition("_lane"), roll, mean, tuple(key)), "chunks")
    prints = rows.groupBy("_lane", "_side", "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor("_row_hash").alias("_x"), F.bit_xor("_row_hash2").alias("_y"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    same = ["_lane", "_n", "_x", "_y", "_lo", "_hi"]
    only = lambda s, t: prints.where(F.col("_side") == s).join(prints.where(F.col("_side") == t).select(*same), same, "left_anti").select("_lane", "_side", "_chunk")
    open_ = rows.join(only("a", "b").unionByName(only("b", "a")), ["_lane", "_side", "_chunk"], "left_semi")
    value = F.struct(*fields)
    pair = open_.groupBy("_lane", *key).agg(F.max(F.when(F.col("_side") == "a", F.struct(F.lit(1).alias("x"), value.alias("v")))).alias("_a"), F.max(F.when(F.col("_side") == "b", F.struct(F.lit(1).alias("x"), value.alias("v")))).alias("_b"))
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    found = F.array_compact(
        F.array(F.when(F.col("_a").isNull(), F.lit("missing_a")), F.when(F.col("_b").isNull(), F.lit("missing_b")), *(F.when(there & ~F.col(f"_a.v.{f}").eqNullSafe(F.col(f"_b.v.{f}")), F.lit(f)) for f in fields))
    )
    return pair.select(*key, F.explode(found).alias("finding"))
