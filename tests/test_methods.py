"""The methods decide: what they drop or let pass changes the result, and is counted."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrille.operators import references, sequences
from quadrille.operators.incremental import VersionedState, content_hash, process
from quadrille.operators.references import orphans
from quadrille.operators.runs import compress
from quadrille.operators.sequences import STATE_RUNS, STATE_SEEN, accept, advance, judge
from quadrille.queries import data

T0 = datetime(2024, 1, 1)


def batch(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "producer long, number long, key string, id int").withColumn("ord", F.struct("id"))


def test_ranges_decide_repeats(spark, monkeypatch):
    first = batch(spark, [(1, n, f"m{n}") for n in range(1, 21)])
    runs, seen = spark.createDataFrame([], STATE_RUNS), spark.createDataFrame([], STATE_SEEN)
    kept, ids = accept(first, runs, seen)
    assert kept.count() == 20
    runs, seen = advance(ids, runs, seen)
    assert [(r.run_start, r.run_end) for r in runs.collect()] == [(1, 20)]
    # ten repeats, five that are new, one numbered anew by another producer, one malformed, one number of another message
    second = batch(spark, [(1, n, f"m{n}") for n in range(11, 21)] + [(1, n, f"m{n}") for n in range(21, 26)] + [(2, 1, "m3"), (None, 7, "m9"), (1, 5, "other")])
    ids, _ = judge(second, runs, seen)
    assert {r.how: r.n for r in ids.groupBy("how").agg(F.count("*").alias("n")).collect()} == {"covered": 10, "new": 5, "lookup": 3}
    assert sorted(r.key for r in accept(second, runs, seen)[0].collect()) == ["m21", "m22", "m23", "m24", "m25", "other"]
    # without the runs the same repeats would need the lookup
    monkeypatch.setattr(sequences, "match", lambda probes, *_: probes.withColumn("covered", F.lit(False)))
    assert judge(second, runs, seen)[0].where("how = 'covered'").count() == 0
    assert judge(second, runs, seen)[0].where("how = 'lookup'").count() == 12
    # and without lookups covered numbers still end at the runs
    monkeypatch.undo()
    assert accept(batch(spark, [(1, n, f"m{n}") for n in range(1, 21)]), runs, seen.where("false").unionByName(seen))[0].count() == 0


def test_runs_decide_orphans(spark, monkeypatch):
    """Integer keys: a thousand parents are two runs, and what lies between or beyond them is missing."""
    parents = spark.range(1, 1001).where("id <> 500").select(F.col("id").alias("key"), F.lit(None).cast("timestamp").alias("since"), F.when(F.col("id") == 7, F.lit(T0)).alias("until"))
    assert compress(parents, [], "key").count() == 2
    refs = spark.createDataFrame([(1, T0, 1), (7, T0, 2), (500, T0, 3), (1001, None, 4), (0, T0, 5), (None, T0, 6), (-70_000, T0, 7)], "key long, at timestamp, row int")
    assert sorted((r.row, r.reason) for r in orphans(refs, parents).collect()) == [(2, "deleted"), (3, "missing"), (4, "missing"), (5, "missing"), (6, "missing"), (7, "missing")]
    monkeypatch.setattr(references, "match", lambda probes, *_: probes.withColumn("covered", F.lit(False)))
    assert orphans(refs, parents).where("reason = 'missing'").count() == 7
    monkeypatch.setattr(references, "compress", lambda *_: spark.createDataFrame([], "block long, run_start long, run_end long"))
    monkeypatch.undo()
    assert orphans(refs, parents).where("reason = 'missing'").count() == 5


def test_state_parts(spark, tmp_path, monkeypatch):
    state = VersionedState(spark, f"file://{tmp_path}/s", "k string, content_hash string")
    load = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string").withColumn("content_hash", content_hash("k"))
    done = []
    work = lambda df: done.append(sorted(r.k or "" for r in df.collect()))
    process(load("a", "b", None), state, ["k"], work)
    process(load("a", "b", "c", None), state, ["k"], work)
    assert done == [["", "a", "b"], ["", "c"]]
    assert [state.spark.read.parquet(f"{state.path}/{p}").count() for p in state.parts] == [2, 1]  # a run adds what it learnt
    before = state.read()
    unused = state.stage(load("x"))
    state.compact()
    assert len(state.parts) == 1 and sorted(r.k for r in state.read().collect()) == ["a", "b", "c"]
    assert before.count() == 3  # readers of the version before are not disturbed
    assert unused in state.clean() and state.clean() == []
    monkeypatch.setattr("quadrille.operators.incremental.MANY_PARTS", 1)
    process(load("d"), state, ["k"], work)
    assert len(state.parts) == 1 and state.read().count() == 4


def test_a_crash_before_the_swap_repeats_the_span(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(7, 1, "a", T0, 1), (7, 2, "b", T0, 1), (7, 3, None, T0, 1)], "setup_id long, load_number long, code string, polled_at timestamp, run_id long")
    rows = rows.withColumns({"place": F.struct(F.lit(0).cast("long").alias("began"), "setup_id"), "content_hash": content_hash("setup_id", "load_number")})
    state = VersionedState(spark, f"file://{tmp_path}/s", data.STATE_DUE)
    done = []
    work = lambda due: done.append(sorted(r.load_number for r in due.collect()))
    swap = VersionedState.swap

    def crash(*_):
        raise OSError("lost between stage and swap")

    monkeypatch.setattr(VersionedState, "swap", crash)
    with pytest.raises(OSError):
        data.due_numbers(rows, state, work)
    assert state.version is None
    monkeypatch.setattr(VersionedState, "swap", swap)
    data.due_numbers(rows, state, work)
    later = rows.unionByName(rows.where("load_number = 1").withColumns({"setup_id": F.lit(8).cast("long"), "place": F.struct(F.lit(1).cast("long").alias("began"), F.lit(8).cast("long").alias("setup_id")), "content_hash": F.lit("other")}))
    data.due_numbers(later, state, work)
    assert done == [[1, 2, 3], [1, 2, 3], [3]]
    assert len(state.clean()) == 1


def test_shared_folder_is_asked_for_on_clusters(monkeypatch):
    from quadrille import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    assert T0 + timedelta(0) == T0
