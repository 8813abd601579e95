"""The engine's own small state: one record replaced as a whole, versions of tables behind a pointer, loader status."""

from __future__ import annotations

import json
import random
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quadrille.session import hadoop_path, read_text, replace_text


@dataclass
class EngineState:
    """Counters, flags and pointers; saved and adopted together."""

    status: str = "launching"
    load_counter: int = -1
    setup_id: int | None = None
    spaces_counter: int = 0
    processed_up_to: int | None = None
    current_trust_state: str | None = None
    current_space_state: str | None = None
    needs_full_rebuild: bool = False
    reconciliation_checkpoint: int = -1
    repo_init_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def save(self, spark: SparkSession, path: str) -> None:
        replace_text(spark, path, json.dumps(asdict(self)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EngineState:
        text = read_text(spark, path)
        return cls(**json.loads(text)) if text else cls()


# From which states the loader may go to each.
MOVES = {
    "loading_initial": {"launching", "loading_initial", "resetting"},
    "loading_updates": {"launching", "loading_updates", "ready"},
    "ready": {"launching", "loading_initial", "loading_updates", "ready", "resetting"},
    "resetting": {"loading_initial", "loading_updates", "ready", "resetting"},
}


class LoaderStatus:
    """Where the loader stands. A move is saved first and adopted then; a counter never falls except by a reset."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.state = spark, path, EngineState.load(spark, path)

    def move(self, to: str, counter: int | None = None, setup_id: int | None = None) -> EngineState:
        now = self.state
        if now.status not in MOVES[to]:
            raise ValueError(f"no way from {now.status} to {to}")
        counter = -1 if to == "resetting" else now.load_counter if counter is None else counter
        if counter < now.load_counter and to != "resetting":
            raise ValueError(f"counter falls from {now.load_counter} to {counter}")
        new = EngineState(**(asdict(now) | {"status": to, "load_counter": counter, "setup_id": now.setup_id if setup_id is None else setup_id}))
        new.save(self.spark, self.path)
        self.state = new
        return new


def next_step(state: EngineState, counter: int | None, setup_id: int | None, registry_status: str = "ready") -> str:
    """What a poll of the registry calls for: wait (no usable reading), resync (another setup, a counter that fell, or
    data of an unknown setup), load, or idle."""
    if counter is None or registry_status not in ("ready", "updating"):
        return "wait"
    if state.setup_id is not None and setup_id is not None and state.setup_id != setup_id:
        return "resync"
    if counter < state.load_counter or (state.setup_id is None and setup_id is not None and state.load_counter >= 0):
        return "resync"
    return "load" if counter > state.load_counter else "idle"


def backoff(attempt: int, base: float = 1.0, top: float = 60.0, rng: random.Random | None = None) -> float:
    """Seconds before a further attempt: doubled each time, give or take a half."""
    return min(top, base * 2**attempt) * (0.5 + (rng or random).random())


class Breaker:
    """Opens after some failures in a row, for some seconds."""

    def __init__(self, failures: int = 3, seconds: float = 30.0):
        self.limit, self.seconds, self.failed, self.until = failures, seconds, 0, 0.0

    def allows(self, now: float) -> bool:
        return now >= self.until

    def record(self, ok: bool, now: float) -> None:
        self.failed = 0 if ok else self.failed + 1
        if self.failed >= self.limit:
            self.until, self.failed = now + self.seconds, 0


class SnapshotStore:
    """Sets of tables in versions; readers see the one the pointer names. Versions nobody points at are orphans."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        return read_text(self.spark, f"{self.path}/CURRENT")

    def stage(self, tables: dict[str, DataFrame], version: str) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")

    def flip(self, version: str) -> None:
        replace_text(self.spark, f"{self.path}/CURRENT", version)

    def publish(self, tables: dict[str, DataFrame], version: str) -> None:
        self.stage(tables, version)
        self.flip(version)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{version or self.current()}/{name}")

    def versions(self) -> list[str]:
        fs, p = hadoop_path(self.spark, self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def clean(self, keep: set[str] = frozenset()) -> list[str]:
        gone = [v for v in self.versions() if v != self.current() and v not in keep]
        for v in gone:
            fs, p = hadoop_path(self.spark, f"{self.path}/{v}")
            fs.delete(p, True)
        return gone
