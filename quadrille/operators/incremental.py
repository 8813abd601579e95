"""Processing only what is new or changed since the last successful run."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.session import hadoop_path, materialize, read_text, replace_text

#: Parts of a state beyond which a run writes it anew as one part.
MANY_PARTS = 64


class VersionedState:
    """A table of (key, content_hash, ...) under one folder: parts, and a manifest of those in force.

    A run adds a part with what it learnt. The part is written whole before the manifest is replaced by an atomic
    rename; a run that fails before that leaves the old version in force and its own part unused. Readers of a version
    are not disturbed by later ones until clean() is called. One run at a time may write."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _manifest(self) -> dict:
        text = read_text(self.spark, f"{self.path}/CURRENT")
        return json.loads(text) if text else {"version": None, "parts": []}

    @property
    def version(self) -> str | None:
        return self._manifest()["version"]

    @property
    def parts(self) -> list[str]:
        return self._manifest()["parts"]

    def read(self) -> DataFrame:
        parts = self.parts
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def stage(self, rows: DataFrame) -> str:
        """Write a part; not in force until swap()."""
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def swap(self, part: str, whole: bool = False) -> None:
        """Put a part in force, with those before it or (``whole``) instead of them."""
        replace_text(self.spark, f"{self.path}/CURRENT", json.dumps({"version": f"v-{uuid.uuid4().hex}", "parts": [*([] if whole else self.parts), part]}))

    def compact(self) -> None:
        """Write the state anew as one part."""
        self.swap(self.stage(self.read()), whole=True)

    def clean(self) -> list[str]:
        """Remove the parts that are not in force: those of failed runs, and those that were replaced."""
        fs, p = hadoop_path(self.spark, self.path)
        kept = set(self.parts)
        gone = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in kept) if fs.exists(p) else []
        for name in gone:
            fs.delete(hadoop_path(self.spark, f"{self.path}/{name}")[1], True)
        return gone


def content_hash(*cols: str):
    """A hash over the columns; nulls and the borders between columns count."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def classify(rows: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Current rows (key, content_hash, ...) against the state: adds ``change`` = new, changed or same. A key may have
    several contents in the state; a row whose content is among them is the same. Repeated rows are judged alike; a
    null in the key never matches."""
    held = state.select(*key, "content_hash", F.lit(True).alias("_same")).distinct()
    keys = state.select(*key, F.lit(True).alias("_known")).distinct()
    x = rows.join(held, [*key, "content_hash"], "left").join(keys, key, "left")
    change = F.when(F.col("_same"), "same").when(F.col("_known"), "changed").otherwise("new")
    return x.withColumn("change", change).drop("_same", "_known")


def process(rows: DataFrame, state: VersionedState, key: list[str], work, judge=classify) -> DataFrame:
    """One run: hand the new and changed rows to ``work`` and put what they add to the state in force only after it
    returned. Rows are repeated to ``work`` if and only if it failed, or the run ended before the swap. Rows with a null
    in the key are handed over each time and leave no trace in the state."""
    before = state.read()
    due, _ = materialize(judge(rows, before, key).where("change <> 'same'"), "due")
    work(due)
    state.swap(state.stage(due.dropna(subset=key).select(*before.columns).distinct()))
    if len(state.parts) > MANY_PARTS:
        state.compact()
    return due
