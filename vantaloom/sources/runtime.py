"""Session-level plumbing: the shared folder, staged tables and shipping the package.

A staged table is a Parquet table in the folder that the cluster shares
(``spark.checkpoint.dir``). It cuts lineage like ``checkpoint()`` does, but keeps
columns, so that a later read prunes them, and it survives lost executors.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parent.parent
_staged: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()
_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session has none (tests, a laptop) a folder of this machine is set:
    driver and executors are then one process, so it is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_root[app] = tempfile.mkdtemp(prefix="vantaloom-")
        spark.sparkContext.setCheckpointDir(_local_root[app])
    return "file://" + _local_root[app]


def release() -> None:
    """Delete what ``stage`` and ``scratch`` have written so far; for a driver that lives on after the results that need it are written."""
    for spark, path in _staged:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; the folder is the cluster's to clean
            pass
    _staged.clear()


atexit.register(release)


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted like a staged table."""
    path = f"{shared_root(spark)}/vantaloom-{label}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, label: str, compression: str = "zstd", level: int = 3, page: int = 1 << 20) -> DataFrame:
    """Write ``df`` to the shared folder once and return the table read back; ``level`` is zstd's, ``page`` the bytes that it compresses together."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, jobs hand Python at most so many rows at a time; for rows that hold much. Only jobs that end within are affected."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, also where it is not installed."""
    home = str(_PACKAGE.parent)
    app = spark.sparkContext.applicationId
    if app in _shipped or home in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if spark.sparkContext.master.startswith("local[") and os.path.realpath(os.getcwd()) == home:
        return
    archive = Path(tempfile.mkdtemp(prefix="vantaloom-")) / "vantaloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row of a table holds."""
    out = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, T.StringType | T.BinaryType):
            out = out + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return out


def small_side(df: DataFrame, most_rows: int = 100_000, most_mb: float = 64) -> DataFrame:
    """``df`` with a broadcast hint where it has few rows and few bytes; else as it is, for a shuffled join. One row comes back to tell."""
    n, size = df.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and size <= most_mb * 1e6 else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer partitions, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
