"""Bitemporal ledger of changing entity attributes, built from periodic snapshots that may arrive late.

Valid time is the place in a chain of snapshots, recorded time is when a snapshot arrived. What was believed at
some recorded time follows from the snapshots known then, so a sweep over the arrivals of a chain gives, once for
all its entities, the pairs of snapshots that were neighbours and for how long. An entity changes between two
neighbours if its state differs there; a late snapshot splits the pair it falls between, and with it every interval
that spans the pair. Rows that it makes untrue keep their content and only get ``recorded_to``.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators.incremental import VersionedState
from quadrille.session import broadcast_if_small, materialize

NEIGHBOURS = "chain_id long, pos long, before long, after long, rec_from timestamp, rec_to timestamp"


def sweep_neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
    """All pairs of neighbours that one chain ever had, by the positions they span.

    A pair (before, after) spans the positions before + 1 .. after; before = 0 stands for the start of the chain.
    rec_to is null while the pair still holds."""
    known, since, out = [0], {}, []
    for r in pdf.sort_values(["recorded", "ord"], na_position="first").itertuples():
        k = bisect.bisect_left(known, r.ord)
        before, after = known[k - 1], known[k] if k < len(known) else None
        if after is not None:
            out.append((before, after, since.pop((before, after)), r.recorded))
            since[r.ord, after] = r.recorded
        since[before, r.ord] = r.recorded
        known.insert(k, r.ord)
    out += [(b, a, t, pd.NaT) for (b, a), t in since.items()]
    rows = [(pdf.chain_id.iloc[0], i, b, a, t, u) for b, a, t, u in out if pd.isna(u) or pd.isna(t) or t < u for i in range(b + 1, a + 1)]
    return pd.DataFrame(rows, columns=["chain_id", "pos", "before", "after", "rec_from", "rec_to"])


def neighbours(chain: DataFrame) -> DataFrame:
    """``chain``: chain_id, ord (1, 2, ... without holes) and recorded; one row per snapshot."""
    return chain.select("chain_id", F.col("ord").cast("long"), "recorded").groupBy("chain_id").applyInPandas(sweep_neighbours, NEIGHBOURS)


def changes(states: DataFrame, last: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """The positions at which an entity's state differs from that at the position before, in the order of the chain
    as it is known now: key, pos, old and new state (null = absent). ``last``: chain_id and its last position."""
    w = Window.partitionBy(*key).orderBy("ord")
    state = F.struct(*attrs)
    near = states.join(last, "chain_id").select(
        *key, "ord", state.alias("_s"), "last_ord", F.lag("ord").over(w).alias("_p"), F.lag(state).over(w).alias("_ps"), F.lead("ord").over(w).alias("_n")
    )
    adjoining = F.coalesce(F.col("_p") == F.col("ord") - 1, F.lit(False))
    start = F.when(~adjoining | ~F.col("_ps").eqNullSafe(F.col("_s")), F.struct(F.col("ord").cast("long").alias("pos"), F.when(adjoining, F.col("_ps")).alias("old"), F.col("_s").alias("new")))
    end = F.when(F.coalesce(F.col("_n") > F.col("ord") + 1, F.col("ord") < F.col("last_ord")), F.struct((F.col("ord") + 1).cast("long").alias("pos"), F.col("_s").alias("old"), F.when(F.lit(False), F.col("_s")).alias("new")))
    return near.select(*key, F.explode(F.array_compact(F.array(start, end))).alias("_c")).select(*key, "_c.pos", "_c.old", "_c.new")


def build_ledger(states: DataFrame, chain: DataFrame, attrs: list[str], key: tuple[str, ...] = ("pk", "agent", "chain_id"), small=lambda df: df) -> DataFrame:
    """Every version of every entity: key, state (struct of the attributes), from_ord, to_ord (null = open),
    recorded_from, recorded_to (null = still believed).

    ``states``: one row per entity and snapshot it is present in (key with chain_id, ord, attributes). ``chain``:
    chain_id, ord, recorded. Equal states of neighbouring snapshots form one version; null equals null. An entity
    that is absent from a snapshot has no version there. Snapshots without a time of receipt count as recorded
    before all others. Columns beyond these are ignored; names that start with _ are reserved. Empty tables give an
    empty ledger. ``small`` may put a broadcast hint on tables of the size of ``chain``.
    """
    key = list(key)
    last = chain.groupBy("chain_id").agg(F.max("ord").alias("last_ord"))
    found = changes(states, small(last), key, attrs)
    spans = found.join(small(neighbours(chain)), ["chain_id", "pos"])
    one = spans.where("before + 1 = after").select(*key, F.col("after").alias("ord"), "rec_from", "rec_to", "new")
    # a pair of neighbours that spans several changes is a change itself only if its two ends differ
    wide = (
        spans.where("before + 1 < after").groupBy(*key, "before", "after", "rec_from", "rec_to").agg(F.min_by("old", "pos").alias("old"), F.max_by("new", "pos").alias("new"))
        .where(~F.col("old").eqNullSafe(F.col("new"))).select(*key, F.col("after").alias("ord"), "rec_from", "rec_to", "new")
    )
    return _pair(one.unionByName(wide), key)


def _pair(starts: DataFrame, key: list[str]) -> DataFrame:
    """Join each start of a version with the next start that was believed at the same time."""
    entity = Window.partitionBy(*key)
    inward = Window.partitionBy(*key).orderBy("ord", F.col("rec_from").asc_nulls_first())
    never = F.lit("9999-01-01").cast("timestamp")
    first = F.lit("0001-01-01").cast("timestamp")
    s = starts.withColumns({"f": F.coalesce("rec_from", first), "u": F.coalesce("rec_to", never)})
    s = s.withColumns({"nf": F.lead("f").over(inward), "late": (F.col("u") < never) | (F.lead("f").over(inward) < F.col("f"))})
    s = s.withColumn("late", F.max(F.coalesce("late", F.lit(False))).over(entity))
    s = s.withColumn("ts", F.when(F.col("late"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("late"), F.array("f", "u"))).over(entity))))))
    # in-order entities need their own start and the next; others every moment at which something was learnt
    plain = F.when(F.col("nf").isNull() | (F.col("nf") == F.col("f")), F.array(F.struct(F.col("f").alias("t"), never.alias("n")))).otherwise(F.array(F.struct(F.col("f").alias("t"), F.col("nf").alias("n")), F.struct(F.col("nf").alias("t"), never.alias("n"))))
    swept = F.filter(F.transform("ts", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("ts", i + 1), never).alias("n"))), lambda x: (x["t"] >= F.col("f")) & (x["t"] < F.col("u")))
    s = s.select(*key, "ord", "new", F.explode(F.when(F.col("late"), swept).otherwise(plain)).alias("x")).select(*key, "ord", "new", "x.t", "x.n")
    at = Window.partitionBy(*key, "t").orderBy("ord")
    v = s.withColumn("to_ord", F.lead("ord").over(at)).where("new is not null")
    # a version that was given up may come to be believed again
    same = Window.partitionBy(*key, "ord", "to_ord").orderBy("t")
    v = v.withColumn("fresh", F.when(F.lag("n").over(same) == F.col("t"), 0).otherwise(1)).withColumn("spell", F.sum("fresh").over(same))
    v = v.groupBy(*key, F.col("ord").alias("from_ord"), "to_ord", "spell").agg(F.first("new").alias("state"), F.min("t").alias("a"), F.max("n").alias("b"))
    return v.select(*key, "state", "from_ord", "to_ord", F.nullif("a", first).alias("recorded_from"), F.nullif("b", never).alias("recorded_to"))


def believed(ledger: DataFrame, recorded: str | None = None) -> DataFrame:
    """The rows held true at a recorded time, or now."""
    if recorded is None:
        return ledger.where("recorded_to is null")
    t = F.lit(recorded).cast("timestamp")
    return ledger.where((F.coalesce(F.col("recorded_from") <= t, F.lit(True))) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > t)))


class LedgerStore:
    """A ledger kept under one folder, to which snapshots are applied as they arrive, early or late.

    Rows: the key columns, chain_id, state, from_pos, to_pos (null = open), recorded_from, recorded_to (null = still
    believed). Positions are any numbers that order a chain, such as its counters. Nothing is overwritten: a part
    brings new rows, and says of earlier ones when they were superseded."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], key_schema: str, state_type: str):
        self.spark, self.key = spark, [*key, "chain_id"]
        self.rows = VersionedState(spark, f"{path}/rows", f"{key_schema}, chain_id long, state {state_type}, from_pos long, to_pos long, recorded_from timestamp, recorded_to timestamp")
        self.chain = VersionedState(spark, f"{path}/chain", "chain_id long, pos long, recorded timestamp")

    def read(self) -> DataFrame:
        own = [*self.key, "state", "from_pos", "to_pos", "recorded_from"]
        return self.rows.read().groupBy(*own).agg(F.max("recorded_to").alias("recorded_to")).where("recorded_to is null or recorded_from < recorded_to")

    def apply(self, snaps: DataFrame, states: DataFrame, attrs: list[str]) -> None:
        """Take in one snapshot of each chain in ``snaps`` (chain_id, pos, recorded) with its ``states`` (key, chain_id, pos,
        attributes; one row per entity present). The interval that spans a late snapshot is split where the state
        differs, and its row is superseded at ``recorded`` (a null counts as the beginning of time). Snapshots that are
        known already are passed over, so a call that failed may be repeated. Applied in the order of arrival, the
        result is that of build_ledger() over all of them."""
        known = self.chain.read()
        snaps, size = materialize(snaps.select("chain_id", F.col("pos").cast("long"), F.coalesce("recorded", F.lit("0001-01-01").cast("timestamp")).alias("recorded")).join(known, ["chain_id", "pos"], "left_anti"), "snaps")
        near = snaps.join(known.select("chain_id", F.col("pos").alias("other")), "chain_id", "left").groupBy("chain_id", "pos", "recorded").agg(F.min(F.when(F.col("other") > F.col("pos"), F.col("other"))).alias("next"))
        place = broadcast_if_small(near, size)
        held = self.read().where("recorded_to is null").join(place, "chain_id")
        row = F.struct("state", "from_pos", "to_pos", "recorded_from")
        spans = (F.col("from_pos") < F.col("pos")) & (F.col("to_pos").isNull() | (F.col("to_pos") > F.col("pos")))
        old = held.withColumn("x", row).select(*self.key, "pos", "recorded", "next", F.when(spans, F.col("x")).alias("c"), F.when(F.col("from_pos") == F.col("next"), F.col("x")).alias("f")).where("c is not null or f is not null")
        state = F.struct(*(F.col(a) for a in attrs))
        new = states.withColumn("_s", state).select(*self.key, F.col("pos").cast("long"), "_s").join(place, ["chain_id", "pos"])
        both = old.withColumn("s", F.when(F.lit(False), F.col("c.state"))).unionByName(new.select(*self.key, "pos", "recorded", "next", F.col("_s").alias("s")), allowMissingColumns=True)
        x = both.groupBy(*self.key, "pos", "recorded", "next").agg(*(F.max(n).alias(n) for n in "cfs")).where(~F.col("s").eqNullSafe(F.col("c.state")))
        put = lambda st, a, b, since, until: F.struct(st.alias("state"), a.alias("from_pos"), b.alias("to_pos"), since.alias("recorded_from"), until.alias("recorded_to"))
        at, p, nxt, open_ = F.col("recorded"), F.col("pos"), F.col("next"), F.lit(None).cast("timestamp")
        there, ends = F.col("c").isNotNull(), F.col("c.to_pos")
        joins = F.col("f").isNotNull() & F.col("s").eqNullSafe(F.col("f.state")) & (~there | ends.eqNullSafe(nxt))
        pieces = F.array_compact(
            F.array(
                F.when(there, put(F.col("c.state"), F.col("c.from_pos"), ends, F.col("c.recorded_from"), at)), F.when(there, put(F.col("c.state"), F.col("c.from_pos"), p, at, open_)),
                F.when(joins, put(F.col("f.state"), F.col("f.from_pos"), F.col("f.to_pos"), F.col("f.recorded_from"), at)), F.when(F.col("s").isNotNull(), put(F.col("s"), p, F.when(joins, F.col("f.to_pos")).otherwise(nxt), at, open_)),
                F.when(there & nxt.isNotNull() & (ends.isNull() | (ends > nxt)), put(F.col("c.state"), nxt, ends, at, open_)),
            )
        )
        self.rows.swap(self.rows.stage(x.select(*self.key, F.explode(pieces).alias("r")).select(*self.key, "r.*")))
        self.chain.swap(self.chain.stage(snaps))
