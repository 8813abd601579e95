"""For points (time, level), the first of a group's readings that is at or after the time and at or above the level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.ranks import row_numbers
from quadrille.session import broadcast_if_small, materialize

#: Children of a node in the search tree, and the span of times numbered by one task where they are not timestamps, which
#: are numbered by day.
FAN, SPAN = 128, 86_400


def _index(readings: DataFrame, fan: int) -> list[tuple[DataFrame, int]]:
    """Levels of a search tree over each group's readings, leaves first. A node keeps of each child, in time order,
    its last time, its highest level and its number (of leaves: the reading's id)."""
    whole = readings.where("grp is not null and at is not null and lvl is not null").select("grp", "at", "lvl", "id")
    block = F.unix_date(F.to_date("at")).cast("long") if dict(whole.dtypes)["at"].startswith("timestamp") else F.floor(F.col("at") / SPAN).cast("long")
    flat = row_numbers(whole, ["grp"], ["at", "id"], block, "i")
    levels = []
    while True:
        node = flat.withColumn("node", F.floor((F.col("i") - 1) / fan).cast("long")).groupBy("grp", "node").agg(F.sort_array(F.collect_list(F.struct("i", "at", "lvl", "id"))).alias("kids"))
        kept, size = materialize(node, "index")
        levels.append((kept, size))
        if not kept.where("node > 0").limit(1).count():
            return levels
        flat = kept.select("grp", F.element_at("kids", -1)["at"].alias("at"), F.array_max(F.transform("kids", lambda k: k["lvl"])).alias("lvl"), F.col("node").alias("id"), (F.col("node") + 1).alias("i"))


def first_reading(points: DataFrame, readings: DataFrame, fan: int = FAN) -> DataFrame:
    """``points``: grp, at, lvl and any other columns; ``readings``: grp, at, lvl, id (long). Adds ``id`` of the first
    reading of the group, in the order of (at, id), with reading.at >= at and reading.lvl >= lvl; points without one,
    or with a null, drop out. Levels need not rise with time.

    Points descend a tree with joins on (grp, node), so a group may hold any share of the points or readings."""
    levels = _index(readings, fan)
    top = len(levels) - 1
    first = lambda arr, cond: F.get(F.filter(arr, cond), F.lit(0))
    x = points.where("grp is not null and at is not null and lvl is not null").withColumns({"_edge": F.lit(0).cast("long"), "_id": F.lit(None).cast("long"), **{f"_next{k}": F.lit(None).cast("long") for k in range(top)}})
    at, lvl = F.col("at"), F.col("lvl")
    for k in range(top, -1, -1):  # along the nodes that hold the first reading at or after the time
        nodes, size = levels[k]
        x = x.join(broadcast_if_small(nodes.select("grp", F.col("node").alias("_edge"), "kids"), size), ["grp", "_edge"], "left")
        if k == 0:
            x = x.withColumn("_id", first("kids", lambda c: (c["at"] >= at) & (c["lvl"] >= lvl))["id"]).drop("kids")
        else:
            x = x.withColumn("_e", first("kids", lambda c: c["at"] >= at)["id"])
            x = x.withColumn(f"_next{k - 1}", first("kids", lambda c: (c["id"] > F.col("_e")) & (c["lvl"] >= lvl))["id"]).drop("_edge", "kids").withColumnRenamed("_e", "_edge")
    for k in range(top):  # nearest first: down the node after the edge in which the level is reached
        y, step = F.when(F.col("_id").isNull(), F.col(f"_next{k}")), k
        x = x.withColumn("_at", y)
        while step >= 0:
            nodes, size = levels[step]
            x = x.join(broadcast_if_small(nodes.select("grp", F.col("node").alias("_at"), "kids"), size), ["grp", "_at"], "left")
            x = x.withColumn("_at", first("kids", lambda c: c["lvl"] >= lvl)["id"]).drop("kids")
            step -= 1
        x = x.withColumn("_id", F.coalesce("_id", "_at")).drop("_at")
    own = [c for c in points.columns if c != "id"]
    return x.where("_id is not null").select(*own, F.col("_id").alias("id"))

