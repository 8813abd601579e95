"""References, sequences, differences, incremental runs and the search tree against plain Python, and their edges."""

import base64
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions.text import base64_bytes
from quadrille.operators import references
from quadrille.operators.chunkdiff import differences
from quadrille.operators.closure import closure
from quadrille.operators.firstmatch import first_reading
from quadrille.operators.incremental import VersionedState, classify, content_hash, process
from quadrille.operators.references import orphans, report
from quadrille.operators.runs import compress, match, merge
from quadrille.operators.sequences import STATE_RUNS, STATE_SEEN, accept, advance

T0 = datetime(2024, 1, 1)
quick = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-40, 40)), max_size=60), st.lists(st.tuples(st.integers(0, 2), st.integers(-45, 45)), max_size=30, unique=True))
def test_runs(spark, keys, probes):
    a, b = keys[::2], keys[1::2]
    df = lambda x: spark.createDataFrame(x, "g int, num int")
    runs = merge(compress(df(a), ["g"], "num", 16), compress(df(b), ["g"], "num", 16), ["g"])
    covered = {(r.g, n) for r in runs.collect() for n in range(r.run_start, r.run_end + 1)}
    assert covered == set(keys)
    got = match(df(probes).withColumn("covered", F.lit("clash")), runs, ["g"], "num", 16).collect()
    assert {(r.g, r.num): r.covered for r in got} == {p: p in covered for p in probes}


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 7), (1, 7)], "g int, num int")
    runs = compress(df, ["g"], "num")
    assert [(r.run_start, r.run_end) for r in runs.collect()] == [(7, 7)]
    assert sorted(r.covered for r in match(df, runs, ["g"], "num").collect()) == [False, False, True, True]


def naive_orphans(refs, parents):
    out = []
    for key, at, row in refs:
        own = [p for p in parents if key is not None and p[0] == key]
        since = min((p[1] for p in own if p[1]), default=None)
        until = min((p[2] for p in own if p[2]), default=None)
        reason = "missing" if not own else "late" if at and since and since > at else "deleted" if at and until and until <= at else None
        if reason:
            out.append((key, at, row, reason))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_orphans(spark, rows, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(references, "HOT_LEAST", 2)
        monkeypatch.setattr(references, "HOT_SHARE", 0.1)
    rng = random.Random(3)
    t = lambda: rng.choice([None, *(T0 + timedelta(k) for k in range(5))])
    keys = [f"k{k}" for k in range(40)]
    refs = [(rng.choice([None, "k1", "k1", *keys]), t(), k) for k in range(300)]
    parents = [(rng.choice(keys[:30] + [None]), t(), t()) for _ in range(60)]
    r = spark.createDataFrame([(*x, "u") for x in refs], "key string, at timestamp, since int, n string")
    p = spark.createDataFrame([(*x, 1) for x in parents], "key string, since timestamp, until timestamp, at int").drop("at")
    assert rows(orphans(r, p, 4).select("key", "at", "since", "reason")) == naive_orphans(refs, parents)
    assert {x.reason for x in report(orphans(r, p, 4).withColumn("m", F.lit(1)), ["m"]).collect()} == {"missing", "late", "deleted"}
    assert orphans(r.limit(0), p).count() == 0
    assert orphans(r, p.limit(0)).where("reason <> 'missing'").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sequences(spark, seed):
    rng = random.Random(seed)
    true_key = {}
    rows = []
    for k in range(200):
        producer, number = rng.choice([1, 1, 1, 2, None]), rng.choice([None, 0, *range(1, 40)])
        key = true_key.setdefault((producer, number), f"m{rng.randint(0, 60)}") if rng.random() < 0.9 else f"m{rng.randint(0, 60)}"
        rows.append((producer, number, rng.choice([None, key, key, key, key]), k // 3, k))
    first = {}
    for *_, key, t, k in sorted(rows, key=lambda r: (r[3], r[4])):
        if key is not None:
            first.setdefault(key, k)
    df = spark.createDataFrame(rows, "producer long, number long, key string, t int, id int").withColumn("ord", F.struct("t", "id")).withColumn("covered", F.lit(1))
    runs, seen, kept = spark.createDataFrame([], STATE_RUNS), spark.createDataFrame([], STATE_SEEN), []
    for low, high in ((0, 20), (20, 45), (45, 100)):
        new, ids = accept(df.where((F.col("t") >= low) & (F.col("t") < high)), runs, seen)
        kept += [r["first"].id for r in new.collect()]
        runs, seen = advance(ids, runs, seen)
        runs, seen = runs.cache(), seen.cache()
    assert sorted(kept) == sorted(first.values())
    again, _ = accept(df, runs, seen)
    assert again.count() == 0
    assert accept(df.limit(0), runs, seen)[0].count() == 0


@quick
@given(st.dictionaries(st.sampled_from([None, *"abcdefghijklmnop"]), st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, "x", ""]))), st.dictionaries(st.sampled_from([None, *"abcdefghijklmnop"]), st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, "x", ""]))))
def test_differences(spark, a, b):
    df = lambda d: spark.createDataFrame([(k, *v, "z") for k, v in d.items()], "a string, n int, h string, side string")
    want = [(k, "missing_a") for k in b.keys() - a.keys()] + [(k, "missing_b") for k in a.keys() - b.keys()]
    want += [(k, f) for k in a.keys() & b.keys() for f, i in (("n", 0), ("h", 1)) if a[k][i] != b[k][i]]
    got = [tuple(r) for r in differences(df(a), df(b), ["a"], ["n", "h"], 4, mean=3).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_differences_look_only_at_unequal_chunks(spark):
    from quadrille.operators.chunkdiff import chunk

    df = spark.range(4000).select(F.lit(0).alias("_lane"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("_side"), F.xxhash64("id").alias("_h"), F.xxhash64("id", F.lit(1)).alias("_row_hash"), "id")
    moved = df.where("not (_side = 'b' and id = 77)")
    sizes = chunk(moved).groupBy("_side", "_chunk").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.count("*").alias("n"))
    same = sizes.groupBy("lo", "hi", "n").agg(F.count("*").alias("k")).where("k = 2").count()
    assert sizes.count() / 2 - same <= 3  # a missing row spoils its own neighbourhood only


def test_base64_spellings(spark):
    raw = bytes(range(248, 256)) * 4
    plain = base64.b64encode(raw).decode()
    forms = [plain, plain.rstrip("="), plain.translate(str.maketrans("+/", "-_")), f" {plain} "]
    df = spark.createDataFrame([(f,) for f in [*forms, None, "", "!", "abcde"]], "c string").select(base64_bytes("c").alias("b"))
    assert [bytes(r.b) if r.b is not None else None for r in df.collect()] == [raw] * 4 + [None] * 4


def test_incremental_survives_failure(spark, tmp_path):
    state = VersionedState(spark, f"file://{tmp_path}/s", "k string, content_hash string")
    load = lambda rows: spark.createDataFrame(rows, "k string, v string, change string").withColumn("content_hash", content_hash("k", "v")).drop("change")
    done = []

    def work(df):
        done.append(sorted((r.k or "", r.change) for r in df.collect()))

    def crash(_):
        raise RuntimeError

    first = load([("a", "1", ""), ("b", "", "")])
    with pytest.raises(RuntimeError):
        process(first, state, ["k"], crash)
    assert state.version is None
    process(first, state, ["k"], work)
    second = load([("a", "2", ""), ("b", "", ""), ("c", None, ""), ("c", None, "")])
    state.stage(second.select("k", "content_hash"))  # a version that never came into force
    process(second, state, ["k"], work)
    process(second, state, ["k"], work)
    assert done == [[("a", "new"), ("b", "new")], [("a", "changed"), ("c", "new"), ("c", "new")], []]
    assert classify(second.limit(0), state.read(), ["k"]).count() == 0
    nulls = load([(None, "1", "")])
    assert [r.change for r in classify(nulls, state.read(), ["k"]).collect()] == ["new"]
    h = load([("a", None, ""), ("a", "", "")]).select("content_hash").distinct()
    assert h.count() == 2


@pytest.mark.parametrize("fan", [2, 3, 128])
def test_first_reading(spark, fan, monkeypatch):
    monkeypatch.setattr("quadrille.operators.firstmatch.SPAN", 7 * fan)
    rng = random.Random(fan)
    readings = [(g, rng.randint(0, 60), max(0, k + rng.randint(-6, 2)), 100 * g + k) for g in (1, 2) for k in range(40)]
    readings += [(None, 1, 1, 900), (1, None, 1, 901), (1, 1, None, 902)]
    points = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(70)]), rng.choice([None, *range(45)]), k) for k in range(300)]
    want = {}
    for g, t, lvl, k in points:
        fit = [(a, i) for h, a, v, i in readings if None not in (g, t, lvl, h, a, v) and h == g and a >= t and v >= lvl]
        if fit:
            want[k] = min(fit)[1]
    got = first_reading(spark.createDataFrame(points, "grp int, at int, lvl int, k int"), spark.createDataFrame(readings, "grp int, at int, lvl int, id long"), fan)
    assert {r.k: r.id for r in got.collect()} == want


@quick
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12))
def test_closure(spark, edges):
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {tuple(r) for r in closure(df).collect()} == reach
    seeds = spark.createDataFrame([(0,), (3,)], "src int")
    assert {tuple(r) for r in closure(df, seeds).collect()} == {p for p in reach if p[0] in (0, 3)}
