"""Session helpers: the shared folder, materialised intermediates and size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if its Parquet files hold no more than this.
BROADCAST_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "quadrille", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset a temporary one serves a local session,
    and a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='quadrille-')}"
    spark.sparkContext.setCheckpointDir(base)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone
            pass


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quadrille-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file by an atomic rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = hadoop_path(spark, path)
    _, draft = hadoop_path(spark, f"{path}.next-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or null if it is not there."""
    fs, p = hadoop_path(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None


@contextmanager
def scratch_scope():
    """Intermediates written within are removed at its end. What was computed from them must have been written or
    collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            remove(spark, path)
        del _written[before:]


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Write df to the shared folder, in a folder for each value of ``by``, and read it back: cuts the lineage,
    survives lost executors and gives the optimizer exact sizes. Returns the table and the bytes of its files."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), size_of(spark, path)


def broadcast_if_small(df: DataFrame, n_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a materialised table whose measured size is under the limit, else a plain join."""
    return F.broadcast(df) if n_bytes <= limit else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for clusters where it is not installed. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    target = f"{scratch(spark, 'code')}/quadrille.zip"
    fs, path = hadoop_path(spark, target)
    out = fs.create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)


def with_timeout(spark: SparkSession, seconds: float, action):
    """Run an action; its jobs are cancelled after some seconds, and it fails then."""
    group = f"quadrille-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    timer = threading.Timer(seconds, lambda: sc.cancelJobGroup(group))
    sc.setJobGroup(group, "with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
