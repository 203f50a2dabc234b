"""A folder of tables that become visible batch by batch, each once, whatever fails.

``format("committed")`` writes for batch queries and for streams. Tasks put
Parquet files aside, under names of their own; a commit writes one manifest
that names them, under the number of its batch, in a single step. A reader sees
what manifests name and nothing else: not the files of a task that was lost or
run twice, nor those of a batch that was given up. A batch whose number has a
manifest is not committed again, so a stream that repeats a batch after a
failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class _Store:
    """The folder, in any store that pyarrow opens; a path without a scheme is local."""

    def __init__(self, path: str) -> None:
        parts = urlsplit(path)
        if parts.scheme in ("", "file"):
            self.files, self.root = fs.LocalFileSystem(), unquote(parts.path).rstrip("/")
        else:
            self.files, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            self.root = root.rstrip("/")

    def names(self, folder: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def remove(self, name: str) -> None:
        if self.files.get_file_info(f"{self.root}/{name}").type == fs.FileType.File:
            self.files.delete_file(f"{self.root}/{name}")

    def text(self, name: str) -> str:
        with self.files.open_input_stream(f"{self.root}/{name}") as file:
            return file.read().decode()

    def put(self, name: str, text: str) -> None:
        """All of the file or none: written aside, then moved to its name."""
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as file:
            file.write(text.encode())
        self.files.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0], recursive=True)
        self.files.move(aside, f"{self.root}/{name}")


@dataclass
class _Part(WriterCommitMessage):
    """Files of one task."""

    names: list[str] = field(default_factory=list)
    rows: int = 0


def _put_parts(path: str, schema: StructType, batches: Iterator[pa.RecordBatch]) -> _Part:
    """Each task, and each attempt of one, writes under a name of its own."""
    store, part, writer = _Store(path), _Part(), None
    try:
        for batch in batches:
            if writer is None:
                store.files.create_dir(f"{store.root}/data", recursive=True)
                part.names.append(f"data/{uuid.uuid4().hex}.parquet")
                writer = pq.ParquetWriter(f"{store.root}/{part.names[-1]}", to_arrow_schema(schema), filesystem=store.files, compression="zstd")
            writer.write_batch(batch.cast(to_arrow_schema(schema)))
            part.rows += batch.num_rows
    finally:
        if writer is not None:
            writer.close()
    return part


def _commit(path: str, parts: list[_Part | None], name: str) -> None:
    store = _Store(path)
    if f"{name}.json" in store.names("manifests"):
        _give_up(path, parts)  # this batch is there already
        return
    made = [p for p in parts if p is not None]
    store.put(f"manifests/{name}.json", json.dumps({"files": [n for p in made for n in p.names], "rows": sum(p.rows for p in made)}))


def _give_up(path: str, parts: list[_Part | None]) -> None:
    store = _Store(path)
    for part in parts:
        for name in part.names if part is not None else ():
            store.remove(name)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.name = options.get("batch") and f"batch-{int(options['batch']):020d}" or f"write-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _put_parts(self.path, self.schema, iterator)

    def commit(self, messages: list[_Part | None]) -> None:
        store = _Store(self.path)
        before = store.names("manifests") if self.overwrite else []
        _commit(self.path, messages, self.name)
        for old in before:
            store.remove(f"manifests/{old}")

    def abort(self, messages: list[_Part | None]) -> None:
        _give_up(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _put_parts(self.path, self.schema, iterator)

    def commit(self, messages: list[_Part | None], batchId: int) -> None:  # noqa: N803
        _commit(self.path, messages, f"batch-{batchId:020d}")

    def abort(self, messages: list[_Part | None], batchId: int) -> None:  # noqa: N803
        _give_up(self.path, messages)


class CommittedDataSource(DataSource):
    """``df.write.format("committed").mode("append").save(path)``, with option ``batch`` for a number of one's own, or ``writeStream``.

    Manifests of streams carry the stream's batch numbers, so a folder takes
    one stream.
    """

    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        raise NotImplementedError("read with read_committed")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedDataSource)


def read_committed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows that were committed under ``path``."""
    store = _Store(path)
    named = [n for m in store.names("manifests") for n in json.loads(store.text(f"manifests/{m}"))["files"]]
    reader = spark.read.schema(schema)
    return reader.parquet(*[f"{path.rstrip('/')}/{n}" for n in named]) if named else spark.createDataFrame([], schema)


def committed_consumer(spark: SparkSession, path: str):
    """A consumer of findings (``streaming.detection``): each batch of findings is visible once, however often it is delivered."""
    register(spark)

    def consume(findings: DataFrame, number: int) -> None:
        findings.write.format("committed").mode("append").option("batch", str(number)).save(path)

    return consume
