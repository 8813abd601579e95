"""The bitemporal ledger and the signed cells against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrille.operators.cells import snapshot_changes
from quadrille.operators.history import believed, build_ledger
from quadrille.plans.snapshots import Snapshots

T0 = datetime(2024, 1, 1)
KEY = ("pk", "agent", "chain_id")


def stretches(states: dict[int, str], known: list[int]) -> set[tuple]:
    """(from, to or None, state) over the known snapshots in order."""
    out, start = [], None
    for k in known:
        if start and states.get(k) != start[1]:
            out.append((start[0], k, start[1]))
            start = None
        if states.get(k) is not None and start is None:
            start = (k, states[k])
    if start:
        out.append((start[0], None, start[1]))
    return set(out)


def history(states: dict[int, str], recorded: dict[int, int]) -> dict[int, set[tuple]]:
    """What is believed after each arrival."""
    return {t: stretches(states, sorted(k for k in recorded if recorded[k] <= t)) for t in sorted(set(recorded.values()))}


@pytest.mark.parametrize("seed", range(6))
def test_ledger_is_what_was_believed_at_every_time(spark, seed):
    rng = random.Random(seed)
    chain, states, truth = [], [], {}
    for c in range(3):
        n = rng.randint(1, 9)
        order = list(range(1, n + 1))
        if seed:
            rng.shuffle(order)
        recorded = {k: t for t, k in enumerate(order)}
        if n > 3:
            recorded[order[1]] = recorded[order[0]]  # two at the same time
        chain += [(c, k, T0 + timedelta(hours=recorded[k])) for k in recorded]
        for e in range(6):
            own = {k: rng.choice("AAB") for k in recorded if rng.random() < 0.8}
            states += [(b"k%d" % e, "agent", c, k, v) for k, v in own.items()]
            truth[b"k%d" % e, c] = history(own, recorded)
    ledger = build_ledger(spark.createDataFrame(states, "pk binary, agent string, chain_id long, ord int, status string"), spark.createDataFrame(chain, "chain_id long, ord int, recorded timestamp"), ["status"], KEY)
    got = ledger.select("pk", "chain_id", "from_ord", "to_ord", "state.status", "recorded_from", "recorded_to").collect()
    for (pk, c), steps in truth.items():
        for t, want in steps.items():
            at = T0 + timedelta(hours=t)
            have = [(r.from_ord, r.to_ord, r.status) for r in got if bytes(r.pk) == pk and r.chain_id == c and r.recorded_from <= at and (r.recorded_to is None or at < r.recorded_to)]
            assert len(have) == len(set(have))
            assert set(have) == want, (pk, c, t)
    now = believed(ledger).count()
    assert now == sum(len(steps[max(steps)]) for steps in truth.values())
    assert believed(ledger, "2030-01-01").count() == now


def test_ledger_edges(spark):
    states = "pk binary, agent string, chain_id long, ord int, status string, extra string, pos long, s string"
    chain = spark.createDataFrame([(1, 1, None), (1, 2, T0)], "chain_id long, ord int, recorded timestamp")
    empty = build_ledger(spark.createDataFrame([], states), chain, ["status"], KEY)
    assert empty.count() == 0
    df = spark.createDataFrame([(b"a", "x", 1, 1, None, "1", 5, "u"), (b"a", "x", 1, 2, None, "2", 6, "v")], states)
    one = build_ledger(df, chain, ["status"], KEY).collect()
    assert [(r.from_ord, r.to_ord, r.state.status, r.recorded_from) for r in one] == [(1, None, None, None)]


def test_cells_against_sets(spark, rows):
    rng = random.Random(1)
    snaps = {k: {e: rng.choice(["A", "B", None]) for e in range(8) if rng.random() < 0.7} for k in range(1, 6)}
    df = spark.createDataFrame([(str(e), 1, k, v, "same") for k, s in snaps.items() for e, v in s.items()], "_key string, chain_id long, ord int, status string, other string").withColumnRenamed("_key", "at")
    last = spark.createDataFrame([(1, 5)], "chain_id long, last_ord int")
    want = set()
    for k in range(2, 6):
        a, b = snaps[k - 1], snaps[k]
        want |= {(str(e), k, "added") for e in b.keys() - a.keys()} | {(str(e), k, "removed") for e in a.keys() - b.keys()}
        want |= {(str(e), k, "changed") for e in a.keys() & b.keys() if a[e] != b[e]}
    got = snapshot_changes(df, last, ["at", "chain_id"], ["status", "other"])
    assert {(r["at"], r.ord, r.change_kind) for r in got.collect()} == want
    assert all(r.changed_fields == ["status"] for r in got.where("change_kind = 'changed'").collect())
    assert snapshot_changes(df.limit(0), last, ["at", "chain_id"], ["status"]).count() == 0


SNAPS = "delivery_id long, registry string, trust_state_hash string, trust_state_counter long, received_at timestamp, n_accounts long, ord string"
ACCS = "acc_row long, delivery_id long, pubkey string, agent string, status string, name string, name_created_at timestamp, h0 string, pk string"


def test_snapshots_rules(spark, rows, monkeypatch):
    snaps = spark.createDataFrame(
        [
            (1, " r ", "h1", 1, T0, 1, ""), (2, "r", "h2", 2, T0, 2, ""), (3, "r", "h2", 2, T0, 1, ""), (4, "r", "h2", 2, T0 + timedelta(1), 1, ""),
            (5, "r", "h3", 3, None, 0, ""), (6, None, "h", 1, T0, 0, ""), (7, "r", "h", None, T0, 0, ""), (8, "r", "h9", 9, T0, None, ""),
        ],
        SNAPS,
    )
    accs = spark.createDataFrame(
        [
            (1, 1, "AB ", "x", "Loaded", " n", None, "", ""), (2, 1, "ab", "x", "seen", "m", T0, "", ""), (3, 1, "ab", "x", "seen", "m", T0, "", ""), (4, 1, None, "x", "seen", "m", T0, "", ""),
            (5, 2, "ab", "x", "seen", None, None, "", ""), (6, 3, "ab", "x", "seen", " ", None, "", ""), (7, 4, "zz", "x", "seen", None, None, "", ""),
        ],
        ACCS,
    )
    for hot in (100_000, 1):
        monkeypatch.setattr("quadrille.plans.snapshots.HOT_REPEATS", hot)
        s = Snapshots(snaps, accs)
        assert rows(s.chain.select("registry", "counter", "ord", "next_counter", "delivery_id")) == [("r", 1, 1, 2, 1), ("r", 2, 2, 3, 3), ("r", 3, 3, None, 5)]
        assert rows(s.states("status", "name").select("agent", "ord", "status", "name")) == [("x", 1, "seen", "m"), ("x", 2, "seen", None)]
    none = Snapshots(snaps.limit(0), accs.limit(0))
    assert none.chain.count() == 0 and none.states("status").count() == 0


def test_long_key_survives_packing(spark):
    from quadrille.functions.text import pack_key, unpack_key

    keys = ["a" * 64, "g" * 64, "A" * 64, "", "x" * 100_000, "0" * 63, "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert df.where(unpack_key(pack_key(F.col("k"))) != F.col("k")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_applied_one_by_one(spark, tmp_path, seed):
    """At every arrival the stored ledger believes what a ledger built over all of them says of that time."""
    from quadrille.operators.history import LedgerStore

    rng = random.Random(seed)
    order = [(c, 10 * k) for c in (1, 2) for k in range(1, 6)]
    rng.shuffle(order)
    recorded = {x: T0 + timedelta(hours=i) for i, x in enumerate(order)}
    states = [(b"k%d" % e, "agent", c, p, rng.choice(["A", "A", "B", None])) for c, p in order for e in range(5) if rng.random() < 0.8]
    schema = "pk binary, agent string, chain_id long, pos long, status string"
    df = spark.createDataFrame(states, schema)
    store = LedgerStore(spark, f"file://{tmp_path}/ledger", ["pk", "agent"], "pk binary, agent string", "struct<status: string>")
    snap = lambda c, p: spark.createDataFrame([(c, p, recorded[c, p])], "chain_id long, pos long, recorded timestamp")
    for c, p in order:
        store.apply(snap(c, p), df.where((F.col("chain_id") == c) & (F.col("pos") == p)), ["status"])
    store.apply(snap(*order[0]), df.limit(0), ["status"])  # known already
    chain = spark.createDataFrame([(c, p // 10, t) for (c, p), t in recorded.items()], "chain_id long, ord int, recorded timestamp")
    built = build_ledger(df.withColumn("ord", (F.col("pos") / 10).cast("int")), chain, ["status"], KEY).collect()
    stored = store.read().collect()
    live = lambda r, at: r.recorded_from <= at and (r.recorded_to is None or at < r.recorded_to)
    for at in recorded.values():
        want = {(bytes(r.pk), r.chain_id, 10 * r.from_ord, r.to_ord and 10 * r.to_ord, r.state.status) for r in built if live(r, at)}
        have = [(bytes(r.pk), r.chain_id, r.from_pos, r.to_pos, r.state.status) for r in stored if live(r, at)]
        assert len(have) == len(set(have)) and set(have) == want, at
    assert store.rows.read().count() > len(stored)  # nothing was overwritten
