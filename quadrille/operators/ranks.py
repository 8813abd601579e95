"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, group: list[str], order: list[str], block: Column, name: str = "rn") -> DataFrame:
    """Adds row numbers from 1 within each group, in the order of the columns ``order``. ``block`` must not fall as the
    first of them rises. Rows are numbered within (group, block) and the counts of the blocks before are added, so a
    group with most of the rows is spread over as many tasks as it has blocks. Names that start with _ are reserved."""
    x = df.withColumn("_b", block)
    sizes = x.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    x = x.withColumn("_r", F.row_number().over(within)).join(base, [*group, "_b"])
    return x.withColumn(name, F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")
