"""What changed between consecutive full snapshots, from signed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_changes(states: DataFrame, last: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Records added, removed or changed between each snapshot and the one before: key, ord (of the later
    snapshot), change_kind and, for changed ones, the names of the fields that differ.

    ``states``: one row per record and snapshot (key with chain_id, ord = 1, 2, ..., fields). ``last``: chain_id and
    last_ord. Each row gives a presence marker and a cell per field, once with +1 for the comparison that ends at its
    snapshot and once with -1 for the one that starts there; cells that are equal in both cancel out. What remains
    tells the change. Null is a value like any other; further columns are ignored, names that start with _ are
    reserved, rows repeated within a snapshot must be removed before. The first snapshot of a chain is compared with nothing.
    """
    cell = lambda at, field, value, sign: F.struct(at.cast("long").alias("_at"), F.lit(field).alias("_field"), value.alias("_value"), F.lit(sign).alias("_sign"))
    here, after = F.col("ord"), F.col("ord") + 1
    none = F.lit(None).cast("string")
    cells = F.array(*(cell(at, f, F.col(f).cast("string") if f else none, sign) for at, sign in ((here, 1), (after, -1)) for f in ("", *fields)))
    x = states.join(last, "chain_id").select(*key, "last_ord", F.explode(cells).alias("_c")).where("_c._at > 1 and _c._at <= last_ord").select(*key, "_c.*")
    sums = x.groupBy(*key, "_at", "_field", "_value").agg(F.sum("_sign").alias("_d")).where("_d <> 0")
    rows = sums.groupBy(*key, "_at").agg(F.max(F.when(F.col("_field") == "", F.col("_d"))).alias("presence"), F.sort_array(F.collect_set(F.when(F.col("_field") != "", F.col("_field")))).alias("changed_fields"))
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return rows.select(*key, F.col("_at").alias("ord"), kind.alias("change_kind"), F.when(F.col("presence").isNull(), F.col("changed_fields")).alias("changed_fields"))
