"""What the operators of this subpackage share: reading tables, cutting lineage, grouped Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local, as in tests, a temporary
    folder is taken; on a cluster executors could not read it.
    """
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


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then left to its owner
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


#: Bytes of a row group of staged tables. A task holds one of those it reads and one of those it writes on the heap; Spark's 128 MB is more than a core may have.
ROW_GROUP = 1 << 24
#: Rows of a row group of tables whose rows hold whole texts or sets. Spark's reader holds the values of 4,096 rows in one array, if a row group has as many, and doubles it as it grows.
WIDE_ROWS = 512


def stage_table(df: DataFrame, label: str, *, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    Rows are ``wide`` if they hold whole texts or sets: their row groups are
    short, as memory of a task that reads them goes with rows times their size.
    """
    path = fresh_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    if wide:
        writer = writer.option("parquet.block.row.count.limit", WIDE_ROWS)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove tables of ``stage_table`` that nothing will read again."""
    for df in staged:
        remove_path(df.sparkSession, df.staged_path)


def non_null_text(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys out of batches that are sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            values = column.to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if starts[1] == 0:
            starts = starts[1:]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(c[a].as_py() for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column, a longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binary_values(column: pa.ChunkedArray | pa.Array, kind: type) -> list[np.ndarray]:
    """One numpy array for each binary value."""
    return [np.frombuffer(x.as_buffer(), dtype=kind) if x.is_valid else np.zeros(0, dtype=kind) for x in column]
