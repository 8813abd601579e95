"""A restartable feed in the order of a counter, as a Structured Streaming source, and its idempotent sink."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quadrille.session import hadoop_path


class Span(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _files(path: str):
    """The file system and the files of a glob, which may be a URI of any file system that Arrow knows."""
    import fnmatch
    import glob
    import posixpath

    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), sorted(glob.glob(path))
    system, pattern = fs.FileSystem.from_uri(path.replace("*", "%2A"))
    pattern = pattern.replace("%2A", "*")
    folder = posixpath.dirname(pattern)
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.path, pattern))


def _dataset(path: str):
    import pyarrow.dataset as ds

    system, files = _files(path)
    return ds.dataset(files, filesystem=system, format="parquet")


def _rows(span: Span, columns: list[str]) -> Iterator:
    import pyarrow.dataset as ds

    c = ds.field("counter")
    yield from _dataset(span.path).to_batches(columns=columns, filter=(c > span.low) & (c <= span.high))


class CounterFeed(DataSource):
    """Parquet files with a rising ``counter``. Options: path (a glob, or a URI with one), batch (records of a micro-batch), start (the
    counter to begin after). The offset is the counter, so a restart goes on exactly where the last batch ended."""

    @classmethod
    def name(cls) -> str:
        return "counterfeed"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_dataset(self.options["path"]).schema)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema.names)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema.names)


def _top(path: str) -> int:
    """The highest counter, from the files' statistics where they have them."""
    import pyarrow.parquet as pq

    top = -1
    system, files = _files(path)
    for f in files:
        meta = pq.ParquetFile(f, filesystem=system).metadata
        k = meta.schema.names.index("counter")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(k).statistics
            top = max(top, s.max if s is not None and s.has_min_max else max(pq.read_table(f, columns=["counter"], filesystem=system)["counter"].to_pylist(), default=-1))
    return top


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns, self.start = options["path"], columns, int(options.get("start", -1))

    def partitions(self):
        top, n = _top(self.path), 8
        step = max(1, -(-(top - self.start) // n))
        return [Span(self.path, low, min(low + step, top)) for low in range(self.start, top, step)]

    def read(self, partition):
        yield from _rows(partition, self.columns)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.start, self.batch = int(options.get("start", -1)), int(options.get("batch", 1 << 62))
        self.at = self.start

    def initialOffset(self) -> dict:
        return {"counter": self.start}

    def latestOffset(self) -> dict:
        top = _top(self.path)
        self.at = min(top, self.at + self.batch) if top > self.at else self.at
        return {"counter": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at, end["counter"])
        low, high = start["counter"], end["counter"]
        step = max(1, -(-(high - low) // 8))
        return [Span(self.path, k, min(k + step, high)) for k in range(low, high, step)]

    def read(self, partition):
        yield from _rows(partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


def append_once(path: str, key: list[str]):
    """A foreachBatch sink: rows whose key is not in the table yet, each once. A batch that is delivered again, or a
    failed one that is repeated, changes nothing: every batch has its own folder, which is overwritten."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, p = hadoop_path(spark, path)
        rows = batch.dropDuplicates(key)
        if fs.exists(p):
            others = [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != f"epoch={epoch}"]
            if others:
                rows = rows.join(spark.read.parquet(*others).select(*key).distinct(), key, "left_anti").select(*batch.columns)
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def in_order(batch: DataFrame, last: int) -> DataFrame:
    """The batch, or an error on a row whose counter is not above the last one committed."""
    return batch.withColumn("counter", F.when(F.col("counter") > last, F.col("counter")).otherwise(F.raise_error(F.concat(F.lit("counter fell to "), F.col("counter").cast("string"))).cast("long")))


def register(spark: SparkSession) -> None:
    """Make the source known. It is sent to its workers by value, since they plan it without this package's files."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CounterFeed)


def run_once(spark: SparkSession, source: str, sink, checkpoint: str, **options) -> None:
    """Drain what the feed has into the sink and stop."""
    register(spark)
    s = spark.readStream.format("counterfeed").options(path=source, **options).load()
    q = s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def latest_wins(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest event of each key; grants and revocations of one key decide by (time, subject). On a stream use it
    in complete or update mode."""
    cols = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max(F.struct(*order, *(c for c in cols if c not in order))).alias("x")).select(*key, *(f"x.{c}" for c in cols))


def within(rows: DataFrame, time: str, now, days: int = 30) -> DataFrame:
    """Rows of the last days before ``now``; with a watermark on a stream, older state is dropped."""
    return rows.where(F.col(time) >= now - F.make_interval(days=F.lit(days)))
