"""Decoding and admission of packets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.errors import FlowError, PacketAnalysisError
from flowlark.functions.wire import DECODED, decode


class InadmissiblePacket(FlowError):
    """A packet that decodes but belongs to no flow, in strict mode."""


#: Bytes of packets that are decoded at once; the decoder holds some thirty for each.
DECODED_BYTES = 1 << 22


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``DECODED_BYTES`` of packets, a larger packet alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + DECODED_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: What admission and identity need of a decoded packet, and its payload.
FLOW_FIELDS = ("failure_classification", "src_addr", "dst_addr", "src_port", "dst_port", "protocol", "icmp_echo_id", "payload", "admitted")
#: What protocol folds need besides.
STREAM_FIELDS = (*FLOW_FIELDS, "tcp_seq", "syn", "fin", "rst", "is_fragment")


def decode_packets(observations: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Adds the decoded columns (null where a layer is absent) and the classification of packets that fail.

    One Arrow pass, no shuffle, some bytes at a time; ``raw_bytes`` does not
    come back from Python. Where ``fields`` names the decoded columns that are
    wanted, only these come back.
    """
    wanted = tuple(n for n in DECODED if fields is None or n in fields)
    kept = [c for c in observations.columns if c not in DECODED]
    rows = observations.select(*[c for c in kept if c != "raw_bytes"], F.col("raw_bytes").alias("_raw"))
    names = [c for c in rows.columns if c != "_raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _pieces(whole, len(names))):
            try:
                found = decode(batch.column(names.index("link_type")), batch.column(len(names)), wanted)
            except Exception as error:  # every property of a packet has a classification
                raise PacketAnalysisError(f"packets cannot be decoded: {error}") from error
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *found.columns], names=[*names, *found.schema.names])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, ", ".join([schema, *(f"{n} {DECODED[n]}" for n in wanted)]))


def valid_observation() -> Column:
    """True for a well-formed observation: a time, a source that is not blank, lengths that agree with the bytes."""
    return (
        F.col("ts_us").isNotNull()
        & (F.length(F.trim(F.coalesce("source", F.lit("")))) > 0)
        & (F.col("captured_length") == F.octet_length("raw_bytes"))
        & F.coalesce(F.col("original_length") >= F.col("captured_length"), F.lit(True))
        & F.coalesce(F.col("link_type").between(0, 65535), F.lit(True))
    )


def checked_observations(observations: DataFrame) -> DataFrame:
    """The observations; one that is not well formed raises an error when it is read."""
    wrong = F.raise_error(F.concat(F.lit("DetectionError: observation "), F.coalesce(F.col("packet_index").cast("string"), F.lit("?")), F.lit(" is not well formed")))
    return observations.where(F.when(F.coalesce(valid_observation(), F.lit(False)), F.lit(True)).otherwise(wrong.cast("boolean")))


def admitted(decoded: DataFrame, *, strict: bool = False) -> DataFrame:
    """Packets that belong to a flow: TCP, UDP, ICMP over IPv4 and ICMPv6 over IPv6.

    Failed packets are left out. One that decodes but has no flow is left out
    too, or, with ``strict``, raises an error when the result is computed.
    """
    passed = decoded.where("failure_classification IS NULL")
    if not strict:
        return passed.where("admitted")
    check = F.when(~F.col("admitted"), F.raise_error(F.concat(F.lit("packet "), F.col("packet_index").cast("string"), F.lit(" decodes but belongs to no flow (InadmissiblePacket)")))).otherwise(F.lit(True))
    return passed.where(check.cast("boolean"))


def quarantined(decoded: DataFrame) -> DataFrame:
    """Packets that decode but belong to no flow."""
    return decoded.where("failure_classification IS NULL AND NOT admitted")


def dns_candidate() -> Column:
    """UDP packets from or to port 53: their payload is a message."""
    return (F.col("protocol") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))


def ldap_candidate() -> Column:
    on = lambda p: (F.col("src_port") == p) | (F.col("dst_port") == p)
    return (F.col("protocol") == 6) & on(389) & ~on(636) & (F.hex(F.substring("payload", 1, 1)) == "30")
