"""The loader: one probe of the registry and what follows from it, over and over."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.state import Breaker, LoaderStatus, backoff, next_step
from quadrille.streaming.feed import in_order

#: Attempts at a probe or a batch before it counts as failed.
ATTEMPTS = 8


@dataclass(frozen=True)
class Reading:
    """What a probe of the registry says."""

    counter: int | None
    setup_id: int | None
    status: str = "ready"


def probe_files(spark: SparkSession, path: str, setup_id: int | None = None) -> Reading:
    """The reading of a feed that is a folder of Parquet files on any file system Spark reads."""
    return Reading(spark.read.parquet(path).agg(F.max("counter")).first()[0], setup_id)


class Loader:
    """Drains a feed of nanopubs with a rising ``counter`` into a sink, batch by batch.

    ``probe``: gives a Reading. ``feed``: gives the rows above one counter up to another. ``sink``: (rows, epoch), which
    may be called again with the same epoch and must then change nothing (see feed.append_once); the epoch of a batch
    is the counter it ends at. The counter is saved after the sink returned, so a batch is repeated if and only if the
    loader ended between the two. A probe or batch that fails is tried again after a growing time; a probe that keeps
    failing opens the breaker. ``clear``: empties the sink's tables when the registry was set up anew."""

    def __init__(self, status: LoaderStatus, probe: Callable[[], Reading], feed: Callable[[int, int], DataFrame], sink, clear: Callable[[], None] = lambda: None, batch: int = 1000, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.status, self.probe, self.feed, self.sink, self.clear = status, probe, feed, sink, clear
        self.batch, self.attempts, self.sleep, self.clock = batch, attempts, sleep, clock
        self.breaker = Breaker()

    def _try(self, action):
        for k in range(self.attempts):
            try:
                return action()
            except Exception:
                if k + 1 == self.attempts:
                    raise
                self.sleep(backoff(k))

    def tick(self) -> str:
        """One poll; what it came to: open (the breaker), wait, idle, load or resync."""
        now = self.clock()
        if not self.breaker.allows(now):
            return "open"
        try:
            reading = self._try(self.probe)
        except Exception:
            self.breaker.record(False, now)
            return "wait"
        self.breaker.record(True, now)
        state = self.status.state
        step = next_step(state, reading.counter, reading.setup_id, reading.status)
        if step == "resync":
            if state.status == "launching":
                self.status.move("ready")
            self.status.move("resetting", setup_id=reading.setup_id)
            self.clear()
        if step in ("load", "resync"):
            self.drain(reading)
        return step

    def drain(self, target: Reading) -> None:
        """Load up to the counter that the probe saw; what came since is for the next tick."""
        way = "loading_initial" if self.status.state.load_counter < 0 else "loading_updates"
        self.status.move(way, setup_id=target.setup_id)
        while (low := self.status.state.load_counter) < target.counter:
            high = min(low + self.batch, target.counter)
            self._try(lambda: self.sink(in_order(self.feed(low, high), low), high))  # noqa: B023
            self.status.move(way, high)
        self.status.move("ready")

    def run(self, every: float = 2.0, ticks: int | None = None) -> None:
        """Tick at a fixed rate; ``ticks``: end after so many."""
        done = 0
        while ticks is None or done < ticks:
            began = self.clock()
            self.tick()
            done += 1
            if ticks is None or done < ticks:
                self.sleep(max(0.0, every - (self.clock() - began)))


class Schedule:
    """Tasks at rates of their own, run one after the other by run_due(). A task that fails is due again at its next
    time and does not keep the others from running."""

    def __init__(self, tasks: dict[str, tuple[float, Callable[[], object]]], clock: Callable[[], float] = time.monotonic):
        self.tasks, self.clock, self.next, self.failed = tasks, clock, dict.fromkeys(tasks, 0.0), {}

    def run_due(self) -> list[str]:
        """The names of the tasks that were due, in their order; errors are kept in ``failed``."""
        now, ran = self.clock(), []
        for name, (every, task) in self.tasks.items():
            if now >= self.next[name]:
                self.next[name] = now + every
                ran.append(name)
                try:
                    task()
                    self.failed.pop(name, None)
                except Exception as e:
                    self.failed[name] = e
        return ran
