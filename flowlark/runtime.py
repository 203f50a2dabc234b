"""Cutting lineage through the folder all executors share, and ranks over a whole relation without a single sorting task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW_BITS = 33  # of monotonically_increasing_id: the place within a partition


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='flowlark-')}"
        context.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  at exit the session may be gone
        pass


_scopes = threading.local()


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes in this block, in this thread, are removed at its end."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        for path in _scopes.paths:
            _remove(spark, path)
        _scopes.paths = outer


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again; removed at the end of the ``passing`` block it is made in, or else of the driver."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (scope := getattr(_scopes, "paths", None)) is not None:
        scope.append(path)
    else:
        atexit.register(_remove, df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """As ``written``, but whatever block it is made in, the table stays until the driver ends."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), None
    try:
        return written(df, label)
    finally:
        _scopes.paths = outer


def with_rank(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """Adds the 0-based rank of each row in ``order`` over all rows (ties in any order).

    Rows are dealt by range and sorted within partitions; a partition's first
    rank is the number of rows before it. The driver sees one count a partition.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    dealt = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", _ROW_BITS)
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}
    first, rows = 0, []
    for k in sorted(counts):
        rows.append((k, first))
        first += counts[k]
    starts = spark.createDataFrame(rows or [(0, 0)], "_part long, _first long")
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_first") + F.col("_place") - F.shiftleft("_part", _ROW_BITS)).drop("_part", "_first", "_place")
