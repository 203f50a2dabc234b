"""DNS requests and responses of flows, matched by window functions: no flow is gone through by one task.

Messages of a flow meet under the direction of the request and the id. There,
in order, a response answers the request before it if it asks the same and is
the first to do so; a request that comes while one is open makes all that
follows ambiguous. What is open at once is a running sum over the flow, in two
steps; the message that would open one too many shuts the flow. Of a message
only its header and the digest of its questions go through all this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.dns_batch import Messages
from flowlark.functions.folds import CLOSED, LIMIT, PENDING_REQUESTS
from flowlark.runtime import written
from flowlark.schemas import WINDOW_KEY

_HEADS = "dns_id int, dns_flags int, dns_asks binary"


def complete_messages(packets: DataFrame) -> DataFrame:
    """The packets whose payload is a whole DNS message, with its id, flags and a digest of what it asks (opcode and questions, letters alike in either case)."""
    at = packets.columns.index("payload")
    names = [f.split()[0] for f in _HEADS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ids, flags, asks = Messages(batch.column(at)).heads()
            own = batch.take(pa.array(places, pa.int64()))
            added = [pa.array(ids, pa.int32()), pa.array(flags, pa.int32()), pa.array([hashlib.sha1(x).digest() for x in asks], pa.binary())]
            yield pa.RecordBatch.from_arrays([*own.columns, *added], names=[*batch.schema.names, *names])

    return packets.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in packets.dtypes), _HEADS]))


def _marked(m: DataFrame) -> DataFrame:
    """Messages with what they do: ``opens``, ``matched`` or ``ambiguous``, the request before, what is open after, and the next message of the same id.

    All windows have one order, so a message is dealt and sorted once.
    """
    along = Window.partitionBy(*WINDOW_KEY, "side", "dns_id").orderBy("packet_index")
    earlier, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    me = F.struct("packet_index", "ts_us", "is_forward", "dns_flags", "dns_asks", "payload")
    m = m.withColumns({"last": F.last(F.when(F.col("asks"), me), ignorenulls=True).over(earlier), "next": F.lead("packet_index").over(along)})
    m = m.withColumn("same", F.coalesce(~F.col("asks") & (F.col("last")["dns_asks"] == F.col("dns_asks")), F.lit(False)))
    # answered: an answer to the request before came between
    hit = F.last(F.when(F.col("same"), F.col("packet_index")), ignorenulls=True).over(earlier)
    m = m.withColumn("answered", F.coalesce(hit > F.col("last")["packet_index"], F.lit(False)))
    clash = F.col("asks") & F.col("last").isNotNull() & ~F.col("answered")
    m = m.withColumn("ambiguous", F.max(clash).over(upto))
    m = m.withColumns({"matched": F.col("same") & ~F.col("answered") & ~F.col("ambiguous"), "opens": F.col("asks") & ~F.col("ambiguous")})
    opening, closing = (F.last(F.when(F.col(c), v), ignorenulls=True).over(upto) for c, v in (("opens", me), ("matched", F.col("packet_index"))))
    m = m.withColumns({"opening": opening, "closing": closing})
    return m.withColumn("open_after", F.when(F.col("closing").isNull() | (F.col("closing") < F.col("opening")["packet_index"]), F.col("opening")))


def _shut_at(marked: DataFrame, limit: int) -> DataFrame:
    """(flow, ``shut``): the first message that would open more than ``limit`` requests, by a running sum in two steps."""
    rows = marked.where("opens OR matched").select(*WINDOW_KEY, "packet_index", F.when(F.col("opens"), 1).otherwise(-1).alias("change")).withColumn("slice", F.floor(F.col("packet_index") / (1 << 20)))
    slices = rows.groupBy(*WINDOW_KEY, "slice").agg(F.sum("change").alias("change"))
    before = Window.partitionBy(*WINDOW_KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*WINDOW_KEY, "slice", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy(*WINDOW_KEY, "slice").orderBy("packet_index").rowsBetween(Window.unboundedPreceding, -1)
    opened = rows.join(slices, [*WINDOW_KEY, "slice"]).withColumn("open", F.col("base") + F.coalesce(F.sum("change").over(inner), F.lit(0)))
    return opened.where((F.col("change") > 0) & (F.col("open") >= limit)).groupBy(*WINDOW_KEY).agg(F.min("packet_index").alias("shut"))


def dns_transactions(packets: DataFrame, *, limit: int = PENDING_REQUESTS) -> DataFrame:
    """What becomes of each request and response: rows of kind ``dns_transaction``, as the protocol folds give them for one flow.

    ``packets`` have the flow's number (``sequence_number``), ``packet_index``,
    ``ts_us``, ``is_forward`` and the ``payload``, one message each. A request is
    ``pending`` when it comes, or ``ambiguous``; a response is ``matched``,
    ``unmatched`` or ``ambiguous``; what is open at the end is ``unresolved``
    once more, at no packet. The message that would open more than ``limit``
    requests, and all after it, find nothing; what was open then is unresolved.
    """
    m = complete_messages(packets.select(*WINDOW_KEY, "packet_index", "ts_us", "is_forward", "payload"))
    m = m.withColumn("asks", F.col("dns_flags").bitwiseAND(0x8000) == 0).withColumn("side", F.col("is_forward") == F.col("asks"))
    m = written(m, "messages")
    # only a flow with more requests than that can have too many of them open
    many = written(m.where("asks").groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*WINDOW_KEY), "busy-flows")
    marked = _marked(m)
    if many.limit(1).count():
        shut = _shut_at(_marked(m.join(many, list(WINDOW_KEY), "left_semi")), limit)
        marked = marked.join(shut, list(WINDOW_KEY), "left")
    else:
        marked = marked.withColumn("shut", F.lit(None).cast("bigint"))
    lost = F.coalesce(F.col("packet_index") >= F.col("shut"), F.lit(False))
    status = F.when(lost, F.when(F.col("asks"), "unresolved").otherwise("unmatched")).when(F.col("ambiguous"), "ambiguous").when(F.col("matched"), "matched").when(F.col("opens"), "pending").otherwise("unmatched")
    reason = F.when(F.col("shut").isNotNull(), F.lit(LIMIT)).otherwise(F.lit(CLOSED))
    fields = ("packet_index", "is_forward", "ts_us", "status", "reason", "code", "raw", "asked_us", "request_raw")
    event = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, fields)])
    asked, left = F.when(~lost & F.col("matched"), F.col("last")), F.col("open_after")
    own = event(F.col("packet_index"), F.col("is_forward"), F.col("ts_us"), status, F.when(lost, F.lit(LIMIT)), F.col("dns_flags"), F.col("payload"), asked["ts_us"], asked["payload"])
    end = event(F.col("shut"), left["is_forward"], left["ts_us"], F.lit("unresolved"), reason, left["dns_flags"], left["payload"], F.lit(None).cast("bigint"), F.lit(None).cast("binary"))
    # the last message of an id, or the last before the flow was shut, tells what stays open
    last = ~lost & left.isNotNull() & (F.col("next").isNull() | F.coalesce(F.col("next") >= F.col("shut"), F.lit(False)))
    e = marked.select("session", "sequence_number", "dns_id", F.explode(F.when(last, F.array(own, end)).otherwise(F.array(own))).alias("e")).select("session", "sequence_number", "dns_id", "e.*")
    none = lambda kind: F.lit(None).cast(kind)
    return e.select(
        "session", "sequence_number", "packet_index", F.lit("dns_transaction").alias("kind"), "is_forward", "ts_us", "status", "reason", none("string").alias("relation"), none("string").alias("operation"),
        F.col("dns_id").cast("bigint").alias("message_id"), F.col("code").cast("bigint").alias("code"), none("bigint").alias("length"), none("bigint").alias("response_count"), (F.col("ts_us") - F.col("asked_us")).alias("latency_us"), "raw", "request_raw",
    )


def datagram_transactions(packets: DataFrame, *, limit: int = PENDING_REQUESTS) -> DataFrame:
    """``dns_transactions`` of the packets of ``in_windows`` that are DNS over UDP."""
    return dns_transactions(packets.where("protocol = 17 AND (a_port = 53 OR b_port = 53)"), limit=limit)
