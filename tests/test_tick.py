"""Trust states and space states as the driver brings them up to date."""

import json

from test_plans import World, pairs

from quadrille.plans.resolve import EXT
from quadrille.plans.state import EngineState, SnapshotStore
from quadrille.plans.tick import SpaceStates, TrustStates


def ext(w):
    return {k: w.spark.createDataFrame(v, EXT[k]) for k, v in w.rows.items()}


def test_space_states(spark, tmp_path):
    store, record = SnapshotStore(spark, f"file://{tmp_path}/spaces"), f"file://{tmp_path}/record"
    s, w = SpaceStates(spark, store, record), World(spark)
    w.grant("dave", "alice")
    assert s.read() is None and s.tick(ext(w), "t1") == "built"
    admins = lambda: pairs(s.read()["admin"], "agent")
    assert admins() == {("alice",)} and s.tick(ext(w), "t1") == "idle"
    gone = w.grant("alice", "max")
    assert s.tick(ext(w), "t1") == "advanced" and admins() == {("alice",), ("max",)}
    w.invalidate("alice", gone)
    assert s.tick(ext(w), "t1") == "advanced" and admins() == {("alice",)}
    assert s.tick(ext(w), "t2") == "built" and EngineState.load(spark, record).processed_up_to == w.n
    assert s.tick(ext(w), "t2", rebuild=True) == "built" and len(store.versions()) == 2  # the one before stays for its readers
    lost = ext(w)
    lost["grant"] = lost["grant"].limit(0)
    assert s.tick(lost, "t3") == "held" and admins() == {("alice",)} and EngineState.load(spark, record).needs_full_rebuild
    assert s.tick(ext(w), "t2") == "built" and not EngineState.load(spark, record).needs_full_rebuild
    nobody = lost | {"acct": lost["acct"].limit(0)}
    assert s.tick(nobody, "t4") == "built" and admins() == set()


def test_trust_states(spark, tmp_path):
    store, record = SnapshotStore(spark, f"file://{tmp_path}/trust"), f"file://{tmp_path}/record"
    t = TrustStates(spark, store, record, keep=2)
    envelope = lambda h, n, **more: json.dumps({"trustStateHash": h, "trustStateCounter": {"$numberLong": str(n)}, "createdAt": "2024-01-01T00:00:00Z", "accounts": [{"pubkey": "k", "agent": f"a{n}", "status": "loaded"}], **more})
    texts = {"h1": envelope("h1", 1), "h2": envelope("h2", 2), "h3": envelope("h3", 3), "bad": envelope("bad", 9, accounts=None), "other": envelope("h1", 7), "old": envelope("old", 0)}
    assert t.tick(None, texts.get) == "idle" and t.tick("none", texts.get) == "missing"
    assert t.tick("h1", texts.get) == "loaded" and t.tick("h1", texts.get) == "idle"
    assert [t.tick(h, texts.get) for h in ("bad", "other")] == ["refused"] * 2
    assert EngineState.load(spark, record).current_trust_state == "h1"
    assert t.tick("h2", texts.get) == t.tick("h3", texts.get) == "loaded" and t.tick("old", texts.get) == "refused"
    assert len(store.versions()) == 2 and pairs(store.table("accounts"), "agent") == {("a3",)}
    assert pairs(store.table("quads").where("p like '%hasCurrentTrustState'"), "o") == {("http://purl.org/nanopub/admin/truststate/h3",)}
