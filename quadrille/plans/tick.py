"""The driver's steps: adopt a new trust state, bring the space state up to date. Each is one transaction: tables are
written as a version nobody reads, the pointer is moved, the engine's record is saved, and old versions are dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.resolve import Resolver, publishable
from quadrille.plans.state import EngineState, SnapshotStore
from quadrille.plans.trust import parse_envelopes, trust_quads


def _save(spark: SparkSession, path: str, state: EngineState, **changes) -> EngineState:
    new = EngineState(**(asdict(state) | changes))
    new.save(spark, path)
    return new


class TrustStates:
    """Trust states by hash, the newest ``keep`` of them, and the pointer to the current one."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, record: str, keep: int = 100):
        self.spark, self.store, self.record, self.keep = spark, store, record, max(1, keep)

    def tick(self, current_hash: str | None, fetch: Callable[[str], str | None]) -> str:
        """``current_hash``: what the registry names now; ``fetch``: the envelope of a hash as JSON text, or null. idle if
        there is nothing new, missing if it cannot be had, refused if it is not whole, is another or older than what is
        in force; else loaded. Only loaded changes anything."""
        state = EngineState.load(self.spark, self.record)
        if not current_hash or current_hash == state.current_trust_state:
            return "idle"
        text = fetch(current_hash)
        if text is None:
            return "missing"
        snaps, accounts, edges = parse_envelopes(self.spark.createDataFrame([(text,)], "value string"))
        head = snaps.first()
        if not head.valid or head.trust_state_hash != current_hash:
            return "refused"
        version = f"{head.trust_state_counter:020d}-{current_hash}"
        before = self.store.current()
        if before is not None and before.split("-")[0] > version.split("-")[0]:
            return "refused"
        self.store.publish({"accounts": accounts, "edges": edges, "quads": trust_quads(snaps.where("valid"), accounts)}, version)
        _save(self.spark, self.record, state, current_trust_state=current_hash)
        newest = sorted(self.store.versions())[-self.keep :]
        self.store.clean(set(newest))
        return "loaded"


class SpaceStates:
    """The space state of the current trust state, brought up to date by ticks."""

    TABLES = ("admin", "alias", "subspace", "prefix", "maintained", "governing", "stamp", "attachment", "role")

    def __init__(self, spark: SparkSession, store: SnapshotStore, record: str):
        self.spark, self.store, self.record = spark, store, record

    def read(self, version: str | None = None) -> dict[str, DataFrame] | None:
        version = version or self.store.current()
        return {t: self.store.table(t, version) for t in self.TABLES} if version else None

    def tick(self, ext: dict[str, DataFrame], trust_hash: str, rebuild: bool = False) -> str:
        """``ext``: the extraction so far, with the mirrored accounts of ``trust_hash``. built: all tiers anew, since the
        trust state is another, there was none, or a rebuild is due; advanced: by the nanopubs loaded since; idle; or
        held: a build that would lose every admin is not put in force, and is tried again with the next tick."""
        state = EngineState.load(self.spark, self.record)
        top = ext["loads"].agg(F.max("ln")).first()[0]
        top = -1 if top is None else top
        version = self.store.current()
        old = self.read(version)
        anew = rebuild or state.needs_full_rebuild or old is None or not version.startswith(f"{trust_hash}-")
        if not anew and top <= (state.processed_up_to if state.processed_up_to is not None else -1):
            return "idle"
        new = Resolver(self.spark, ext).build() if anew else Resolver(self.spark, ext, since=state.processed_up_to).build(old)
        if not publishable(new, old, ext["acct"]):
            _save(self.spark, self.record, state, needs_full_rebuild=True)
            return "held"
        k = int(version.rpartition("-")[2]) + 1 if version else 0
        name = f"{trust_hash}-{top}-{k}"
        self.store.publish({t: new[t] for t in self.TABLES}, name)
        _save(self.spark, self.record, state, processed_up_to=top, current_space_state=name, needs_full_rebuild=False)
        self.store.clean({version} if version else set())  # readers of the state before may still be at it
        return "built" if anew else "advanced"
