"""Classic capture files (version 2.4) as observations.

``read_captures`` cuts captures into byte ranges. Records have no marks, so a
range is searched for a place from which a chain of headers makes sense; each
range also says where its last record ends, and a range whose guess is not that
end of its neighbour is read again from there. What is left is exact, whatever
payloads look like. The ``pcap`` data source reads mounted files record by
record, and, as a stream, what was appended to them since the last offset.
"""

from __future__ import annotations

import glob
import io
import os
import stat
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from flowlark.errors import CaptureError
from flowlark.runtime import written
from flowlark.schemas import OBSERVATION


#: Magic numbers with byte order, parts of a second, parts of a microsecond.
_FORMATS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6, 1), b"\xa1\xb2\xc3\xd4": (">", 10**6, 1), b"\x4d\x3c\xb2\xa1": ("<", 10**9, 1000), b"\xa1\xb2\x3c\x4d": (">", 10**9, 1000)}
#: Fixed texts.
_TEXTS = {
    "magic": "unsupported PCAP magic number", "version": "PCAP version must be 2.4", "snaplen": "PCAP snaplen must be positive", "network": "PCAP additional link-type information is unsupported",
    "fraction": "PCAP timestamp fraction exceeds its resolution", "captured": "PCAP captured length exceeds snaplen", "original": "PCAP original length is smaller than captured length", "file": "PCAP source requires a regular file",
}


def _require(**holds: bool) -> None:
    """Raises for the first of the named conditions that does not hold."""
    for name, good in holds.items():
        if not good:
            raise CaptureError(_TEXTS[name])


class _Pieces:
    """The parts of a capture, one after the other, of which none may be cut short."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file, self.left = file, size

    def next(self, size: int, what: str) -> bytes:
        data = self.file.read(min(size, self.left))
        self.left -= len(data)
        if len(data) < size:
            raise CaptureError(f"truncated PCAP {what}")
        return data


@dataclass(frozen=True)
class Format:
    """What a capture's global header says."""

    order: str
    parts: int
    divisor: int
    snaplen: int
    network: int


HEADER, RECORD = 24, 16


def capture_format(head: bytes) -> Format:
    _require(magic=head[:4] in _FORMATS)
    order, parts, divisor = _FORMATS[head[:4]]
    version, snaplen, network = struct.unpack_from(f"{order}HH", head, 4), *struct.unpack_from(f"{order}II", head, 16)
    _require(version=version == (2, 4), snaplen=snaplen > 0, network=network < 1 << 16)
    return Format(order, parts, divisor, snaplen, network)


def records_from(pieces: _Pieces, form: Format, most: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Records up to the end, or of about ``most`` bytes: all that begin before."""
    left = pieces.left
    while pieces.left and (most is None or left - pieces.left < most):
        seconds, fraction, captured, original = struct.unpack(f"{form.order}4I", pieces.next(RECORD, "record header"))
        _require(fraction=fraction < form.parts, captured=captured <= form.snaplen, original=original >= captured)
        yield seconds * 1_000_000 + fraction // form.divisor, form.network, captured, original, pieces.next(captured, "packet payload")


def capture_records(file: BinaryIO, size: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(ts_us, link type, captured length, original length, bytes) of each record; raises at the first that is not well formed."""
    pieces = _Pieces(file, size)
    yield from records_from(pieces, capture_format(pieces.next(HEADER, "global header")))


_ARROW = pa.schema([("session", pa.string()), ("packet_index", pa.int64()), ("ts_us", pa.int64()), ("link_type", pa.int32()), ("captured_length", pa.int64()), ("original_length", pa.int64()), ("raw_bytes", pa.binary()), ("source", pa.string())])


def _batched(records: Iterator[tuple[int, int, int, int, bytes]], name: str, source: str, first: int = 0, rows: int = 4096, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for index, (ts, link, captured, original, data) in enumerate(records, first):
        held.append((name, index, ts, link, captured, original, data, source))
        n += captured
        if len(held) >= rows or n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)


def _observations(name: str, source: str, file: BinaryIO, size: int) -> Iterator[pa.RecordBatch]:
    yield from _batched(capture_records(file, size), name, source)


# --- captures in byte ranges --------------------------------------------------------------------------------------

#: Stores that executors read by byte range; files of any other go whole through Spark's reader.
RANGED = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs")
_CHAIN = 32  # headers that have to make sense behind a guess


def _ranged(path: str):
    """A file of a store, open at any place."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    store, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(place)


class _Ahead:
    """Reads a file forward from a place, some MB at a time."""

    def __init__(self, file, at: int, step: int = 1 << 22) -> None:
        self.file, self.step, self.base, self.held = file, step, at, b""

    def view(self, at: int, size: int) -> bytes:
        """``size`` bytes at ``at``, fewer at the end of the file; never before the last place asked for."""
        if at + size > self.base + len(self.held):
            kept = self.held[at - self.base :] if at < self.base + len(self.held) else b""
            self.file.seek(at + len(kept))
            self.base, self.held = at, kept + self.file.read(max(self.step, size - len(kept)))
        return self.held[at - self.base : at - self.base + size]


def likely_start(data: bytes, form: Format, stop: int, ends: bool) -> int | None:
    """The first place before ``stop`` in ``data`` from which headers follow one another; ``data`` may go on behind it, up to the file's end if ``ends``.

    Places are tried together: those whose header makes sense step to the next
    header, and drop out where that makes none.
    """
    n = len(data) - RECORD + 1
    if n <= 0:
        return None
    raw = np.frombuffer(data, dtype=np.uint8)
    word = lambda at: sum(raw[at + k : at + k + n].astype(np.int64) << (8 * (k if form.order == "<" else 3 - k)) for k in range(4))
    captured = word(8)
    sense = (word(4) < form.parts) & (captured <= form.snaplen) & (word(12) >= captured)
    step = RECORD + captured
    start = np.flatnonzero(sense[:stop] & (captured[:stop] > 0))
    at = start.copy()
    for _ in range(_CHAIN):
        at = np.where(at < n, at + step[np.minimum(at, n - 1)], at)
        # behind the data nothing is known, unless the file ends there
        good = np.where(at < n, sense[np.minimum(at, n - 1)], (at == len(data)) | (not ends))
        start, at = start[good], at[good]
        if not len(start):
            return None
    return int(start[0])


def range_ends(file, size: int, form: Format, start: int, stop: int) -> tuple[int | None, int]:
    """From the record at ``start``: the end of the last record that begins before ``stop`` (None if one makes no sense), and how many there are."""
    ahead, at, n = _Ahead(file, start), start, 0
    unpack = struct.Struct(f"{form.order}4I").unpack_from
    while at < min(stop, size):
        head = ahead.view(at, RECORD)
        if len(head) < RECORD:
            return None, n
        _, fraction, captured, original = unpack(head)
        if fraction >= form.parts or captured > form.snaplen or original < captured or at + RECORD + captured > size:
            return None, n
        at += RECORD + captured
        n += 1
    return at, n


_RANGES = "path string, size bigint, k bigint, start bigint, stop bigint, first bigint, last bigint, n bigint"


def _range(path: str, size: int, k: int, start: int, stop: int, first: int | None) -> tuple:
    """A range with the place of its first record (a guess where ``first`` is null), the end of its last, and their number."""
    last, n = None, 0
    with _ranged(path) as file:
        head = file.read(HEADER)
        try:
            form = capture_format(head) if len(head) == HEADER else None
        except CaptureError:
            form = None  # whoever reads the first range says why
        if form is not None:
            if first is None and k == 0:
                first = HEADER
            elif first is None:
                file.seek(start)
                # a guess is made of what is in the range and a few records behind it
                data = file.read(min(size, stop + 4 * (RECORD + min(form.snaplen, 1 << 18))) - start)
                found = likely_start(data, form, stop - start, start + len(data) >= size)
                first = None if found is None else start + found
            if first is not None:
                last, n = range_ends(file, size, form, first, stop)
    return path, size, k, start, stop, first, last, n


def _range_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _RANGES.split(", ")]
    kinds = [pa.string()] + [pa.int64()] * 7
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _range_batch([_range(*row[:6]) for row in zip(*(c.to_pylist() for c in batch.columns))])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order: one that does not begin where the one before ends is read again from there."""
    path, end = None, None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] == path and end is not None and row[5] != end:
                row = _range(*row[:5], end)
            path, end = row[0], row[6]
            out.append(row)
        yield _range_batch(out)


def _captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the captures under ``path``. Spark's reader passes over files without a byte, which are no captures and have to be seen."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for top in store.globStatus(place) or [] for s in (store.listStatus(top.getPath()) if top.isDirectory() else [top])]
    empty = [(s.getPath().toString(), 0) for s in found if s.isFile() and s.getLen() == 0 and s.getPath().getName()[:1] not in "._"]
    return files.unionByName(spark.createDataFrame(empty, "path string, size bigint")) if empty else files


def capture_ranges(spark: SparkSession, path: str, *, split_bytes: int = 1 << 27) -> DataFrame:
    """(path, first, last, n, index): the ranges of all captures under ``path``, verified, each with the number of its first packet.

    A range's guess holds if its neighbour before ends there. Others are read
    again from that end, all together. Where neighbours' ends have moved by
    that, which takes payloads that look like records, a task for each such
    capture goes along its ranges and reads what does not fit again (headers
    only). A range behind one that makes no sense is not read: that one raises.
    """
    files = _captures(spark, path)
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("size") / split_bytes) - 1).cast("bigint"))).alias("k"))
    none = F.lit(None).cast("bigint")
    cut = written(cut.select("path", "size", "k", (F.col("k") * split_bytes).alias("start"), ((F.col("k") + 1) * split_bytes).alias("stop"), none.alias("first"), none.alias("last"), none.alias("n")), "ranges")
    spread = lambda df: df.repartition(max(1, min(100_000, df.count())))
    ranges = written(spread(cut).mapInArrow(_searched, _RANGES), "ranges")
    along = Window.partitionBy("path").orderBy("k")
    joined = ranges.withColumn("_before", F.lag("last").over(along))
    moved = F.col("_before").isNotNull() & ~F.col("first").eqNullSafe(F.col("_before"))
    again = written(joined.where(moved).withColumn("first", F.col("_before")).drop("_before"), "ranges-again")
    if again.limit(1).count():
        kept = ranges.join(again.select("path", "k"), ["path", "k"], "left_anti").select(*ranges.columns)
        ranges = written(kept.unionByName(spread(again).mapInArrow(_searched, _RANGES)), "ranges")
        odd = written(ranges.withColumn("_before", F.lag("last").over(along)).where(moved).select("path").distinct(), "ranges-odd")
        if odd.limit(1).count():
            walked = ranges.join(odd, "path", "left_semi").select(*ranges.columns).repartition("path").sortWithinPartitions("path", "k").mapInArrow(_walked, _RANGES)
            ranges = written(ranges.join(odd, "path", "left_anti").select(*ranges.columns).unionByName(walked), "ranges")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    bad = F.max(F.col("last").isNull().cast("int")).over(before)
    placed = ranges.withColumns({"index": F.coalesce(F.sum("n").over(before), F.lit(0)), "_bad": F.coalesce(bad, F.lit(0))})
    return placed.where("_bad = 0 AND (last IS NULL OR n > 0 OR k = 0)").select("path", "size", "first", "last", "n", "index")


def _read_ranges(source: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, first, last, index in zip(*(batch.column(k).to_pylist() for k in ("path", "size", "first", "last", "index"))):
                with _ranged(path) as file:
                    form = capture_format(_Pieces(file, size).next(HEADER, "global header"))
                    file.seek(first)
                    end = size if last is None else last
                    yield from _batched(records_from(_Pieces(file, end - first), form), path, source or path, index)

    return run


def read_captures(spark: SparkSession, path: str, *, source: str | None = None, split_bytes: int = 1 << 27) -> DataFrame:
    """Observations of all captures under ``path``; a capture's path is its session, and its source unless one is given.

    A capture is cut into ranges of ``split_bytes``, so that it is the work of
    many tasks, each holding some MB of it. A capture that is not well formed
    raises an error when it is read. In a store that has no ranges (``RANGED``)
    a capture goes whole through Spark's reader, and is one task's.
    """
    if urlsplit(path).scheme in RANGED:
        ranges = written(capture_ranges(spark, path, split_bytes=split_bytes), "captures")
        return ranges.repartition(max(1, min(100_000, ranges.count()))).mapInArrow(_read_ranges(source), OBSERVATION)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                yield from _observations(name, source or name, io.BytesIO(data), data.size)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(whole, OBSERVATION)


def _regular(path: str) -> BinaryIO:
    """A regular file, opened for reading. What is opened is asked for its kind, without waiting on a pipe or device."""
    file = os.fdopen(os.open(path, os.O_RDONLY | getattr(os, "O_NONBLOCK", 0)), "rb", closefd=True) if not os.path.isdir(path) else None
    regular = file is not None and stat.S_ISREG(os.fstat(file.fileno()).st_mode)
    if file is not None and not regular:
        file.close()
    _require(file=regular)
    return file


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(self.options["path"])) or [self.options["path"]]
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        try:
            with _regular(partition.path) as file:
                yield from _observations(partition.path, self.options.get("source", partition.path), file, os.fstat(file.fileno()).st_size)
        except OSError as error:
            raise CaptureError(f"PCAP source could not be read: {partition.path}") from error


@dataclass
class _Grown(InputPartition):
    """What was appended to a capture: bytes from ``first`` to ``last``, packets from ``index`` on."""

    path: str
    first: int
    last: int
    index: int


class _StreamReader(DataSourceStreamReader):
    """Captures that grow. An offset has, by file, the end of the last whole record and the number of records before.

    A record that is not whole yet waits. One that makes no sense raises.
    ``maxbytespertrigger`` bounds what one offset adds to each file.
    """

    def __init__(self, options: dict) -> None:
        self.options, self.known = options, {}
        self.most = int(options.get("maxbytespertrigger", 1 << 62))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in sorted(glob.glob(self.options["path"])):
            with _regular(path) as file:
                size = os.fstat(file.fileno()).st_size
                head = file.read(HEADER)
                if len(head) < HEADER:
                    continue
                at, n = self.known.get(path, (HEADER, 0))
                self.known[path] = self._whole(file, size, capture_format(head), at, n)
        return {path: list(place) for path, place in self.known.items()}

    def _whole(self, file: BinaryIO, size: int, form: Format, at: int, n: int) -> tuple[int, int]:
        ahead, unpack, began = _Ahead(file, at), struct.Struct(f"{form.order}4I").unpack_from, at
        while at + RECORD <= size and at - began < self.most:
            _, fraction, captured, original = unpack(ahead.view(at, RECORD))
            _require(fraction=fraction < form.parts, captured=captured <= form.snaplen, original=original >= captured)
            if at + RECORD + captured > size:
                break
            at, n = at + RECORD + captured, n + 1
        return at, n

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for path, place in end.items():  # after a restart this is what is known
            if tuple(place) > self.known.get(path, (HEADER, 0)):
                self.known[path] = tuple(place)
        begun = {path: start.get(path, [HEADER, 0]) for path in end}
        return [_Grown(path, begun[path][0], place[0], begun[path][1]) for path, place in sorted(end.items()) if place[0] > begun[path][0]]

    def read(self, partition: _Grown) -> Iterator[pa.RecordBatch]:
        with _regular(partition.path) as file:
            form = capture_format(file.read(HEADER))
            file.seek(partition.first)
            yield from _batched(records_from(_Pieces(file, partition.last - partition.first), form), partition.path, self.options.get("source", partition.path), partition.index)

    def commit(self, end: dict) -> None:
        pass


class PcapDataSource(DataSource):
    """``spark.read.format("pcap").load(path or pattern)``, or ``spark.readStream``; option ``source`` names the capture."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return OBSERVATION

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapDataSource)
