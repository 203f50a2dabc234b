"""Detection on a stream of observations.

Windows close by observation only: at the next packet of their flow, when they
have to give way, or when the capture ends. Each micro-batch is judged packet by
packet, cut into windows and aggregated as any batch is; the aggregated parts,
one row for a flow's window, meet the table of open windows (``windows``), one
aggregate of fixed size each, in one join. So neither the state nor a batch's
work grows with the packets that a flow has had before; a batch reads and writes
all open windows.

A folder holds what joins the batches: the parts of the batch at work, the
windows that are open after it, the number of each window by the batch that opened it, and for each session the next
free number and the latest time. Marks tell what a batch has done, so a new
object on the same folder goes on where the last one stopped, and a batch that
is run again gives the same findings and delivers only what was not delivered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlark.errors import FlowError
from flowlark.operators import detectors, evaluation, flows
from flowlark.operators.decoding import admitted, checked_observations, decode_packets
from flowlark.plans.pipeline import STATE_COLUMNS, DetectionSettings
from flowlark.runtime import passing, shared_folder, with_rank, written
from flowlark.schemas import IDENTITY
from flowlark.streaming import matching, windows
from flowlark.streaming.folder import Folder

#: Takes findings and the number of their batch.
Consumer = Callable[[DataFrame, int], None]
FINAL = 1 << 62
_SESSIONS = "session string, next_number bigint, frontier_us bigint"


_NUMBERS = "session string, first_packet_index bigint, number bigint, first_batch bigint"


class DetectionStream:
    """Gives packet findings at once and flow findings when windows close, numbered as in one run over everything.

    ``folder`` keeps the state; without one a new folder among the shared ones
    is taken. Packets must come in order: a falling time in a session raises an
    error, in a batch or from one to the next, unless there is a consumer for
    ``late`` packets: it then gets those, with the time they had to reach, and
    the others go on.
    """

    def __init__(self, spark: SparkSession, settings: DetectionSettings, packet_consumer: Consumer, flow_consumer: Consumer, folder: str | None = None, late_consumer: Consumer | None = None) -> None:
        self.spark, self.settings = spark, settings
        self.consumers = {"packet": packet_consumer, "flow": flow_consumer, "late": late_consumer}
        self.folder = Folder(spark, folder or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}")
        self.last = max((n for n in self.folder.numbers("batch-") if self.folder.marked(f"batch-{n}/committed")), default=-1)
        columns = ", ".join(f"{n} {t}" for n, t in flows.column_types(STATE_COLUMNS))
        self.columns, self.schema = columns, windows.part_schema(spark, columns)

    @property
    def finished(self) -> bool:
        return self.folder.marked(f"batch-{FINAL}/committed")

    def _deliver(self, kind: str, number: int, findings: DataFrame) -> None:
        mark = f"batch-{number}/{kind}-delivered"
        if not self.folder.marked(mark):
            self.consumers[kind](findings, number)
            self.folder.mark(mark)

    def _commit(self, number: int) -> None:
        self.folder.mark(f"batch-{number}/committed")
        self.folder.remove(f"parts/batch-{number}")
        for old in self.folder.numbers("batch-"):
            for table in ("sessions", "seen", "closed") if old < self.last else ():
                self.folder.remove(f"batch-{old}/{table}")
            if old < self.last:
                self.folder.remove(f"windows/batch-{old}")
        self.last = number

    def batch(self, observations: DataFrame, number: int | None = None) -> None:
        """Handle a batch (without a number: the next one). One that is committed is passed over."""
        self._handle(number, lambda n: self._part(observations, n))

    def _handle(self, number: int | None, part: Callable[[int], None]) -> None:
        if self.finished:
            raise RuntimeError("the stream has ended")
        number = self.last + 1 if number is None else number
        if number <= self.last:
            return
        with passing(self.spark):
            if not self.folder.marked(f"batch-{number}/parted"):
                part(number)
            self._close(number)
            self._commit(number)

    def packets(self, packets: DataFrame, number: int | None = None) -> None:
        """As ``batch``, for packets that are decoded and have their identity; they have no packet findings."""
        self._handle(number, lambda n: self._parted(self._in_order(written(packets.select(*STATE_COLUMNS), f"packets-{n}"), n), n))

    def _sessions(self) -> DataFrame:
        return self.folder.get(f"batch-{self.last}/sessions", _SESSIONS) if self.last >= 0 else self.spark.createDataFrame([], _SESSIONS)

    def _in_order(self, packets: DataFrame, number: int) -> DataFrame:
        """The batch's packets that are in order; any other is late, or an error."""
        on_time, late = flows.split_late(packets, self._sessions().where("frontier_us IS NOT NULL"))
        if self.consumers["late"] is None:
            found = late.orderBy("packet_index").select("packet_index").first()
            if found is not None:
                raise FlowError(f"packet {found[0]} is earlier than one before it")
            return packets
        self._deliver("late", number, late)
        return written(on_time, f"on-time-{number}")

    def _part(self, observations: DataFrame, number: int) -> None:
        """Judge the batch's packets and write its windows' parts, where the stateful query finds them."""
        decoded = written(decode_packets(checked_observations(observations)).select(*detectors.PACKET_COLUMNS), f"batch-{number}")
        self._deliver("packet", number, detectors.packet_findings(decoded, self.settings.packet))
        packets = flows.with_identity(admitted(decoded, strict=self.settings.strict)).select(*STATE_COLUMNS)
        self._parted(self._in_order(written(packets, f"packets-{number}"), number), number)

    def _parted(self, packets: DataFrame, number: int) -> None:
        parts = windows.window_parts(packets, timeout_us=self.settings.timeout_us, batch=number, evicted=self._evicted(packets))
        self.folder.put(f"parts/batch-{number}", parts.select(*windows.marked_schema(self.schema).names))
        seen = packets.groupBy("session").agg(F.max("ts_us").alias("top"))
        after = self._sessions().join(seen, "session", "full_outer").select("session", F.coalesce("next_number", F.lit(0).cast("bigint")).alias("next_number"), F.greatest("frontier_us", "top").alias("frontier_us"))
        self.folder.put(f"batch-{number}/seen", after)
        self.folder.mark(f"batch-{number}/parted")

    def _evicted(self, packets: DataFrame) -> DataFrame | None:
        """Windows that give way in this batch. With a limit, no more than that are open in a session, so what the state holds is small."""
        limit = self.settings.max_active
        if limit is None:
            return None
        held = self._held()
        key = ["session", *IDENTITY]
        known = packets.select(*key) if held is None else packets.select(*key).unionByName(held.select(*key))
        if known.distinct().groupBy("session").count().where(F.col("count") > limit).limit(1).count() == 0:
            return None
        open_ = None if held is None else held.select(*key, F.col("first_packet_index").alias("packet_index"), F.col("last_packet_index").alias("last_index"), F.col("last_us").alias("ts_us"))
        return written(flows.evictions(packets, timeout_us=self.settings.timeout_us, max_active=limit, open_=open_), "evictions")

    def _held(self) -> DataFrame | None:
        return windows.open_windows(self.spark, f"{self.folder.path}/windows", self.last) if self.folder.marked(f"windows/batch-{self.last}") else None

    def _close(self, number: int) -> None:
        """Bring the batch's parts to the open windows and deliver what closes."""
        self._numbered(number)
        self._deliver_closed(number)

    def _numbered(self, number: int) -> None:
        """Windows opened in this batch take the next free numbers of their sessions, in the order of their first packets; windows closed in it have theirs from the batch that opened them."""
        with passing(self.spark):
            parts = self.folder.get(f"parts/batch-{number}", windows.marked_schema(self.schema))
            after = written(windows.advanced(self._held(), parts, self.schema, self.settings.timeout_us), f"windows-{number}")
            sessions = self.folder.get(f"batch-{number}/seen", _SESSIONS)
            opened = with_rank(after.where("fresh").select("session", "first_packet_index"), "rank", "session", "first_packet_index")
            first = opened.groupBy("session").agg(F.min("rank").alias("from"), F.count(F.lit(1)).alias("more"))
            base = first.join(sessions, "session").select("session", "from", "more", F.col("next_number"))
            numbers = opened.join(base, "session").select("session", "first_packet_index", (F.col("next_number") + F.col("rank") - F.col("from")).alias("number"))
            self.folder.put(f"numbers/first_batch={number}", numbers)
            self.folder.put(f"batch-{number}/sessions", sessions.join(first, "session", "left").select("session", (F.col("next_number") + F.coalesce("more", F.lit(0))).alias("next_number"), "frontier_us"))
            self.folder.put(f"windows/batch-{number}", after.where("closure_reason IS NULL").select(*windows.held_schema(self.schema).names))
            self._put_closed(after.where("closure_reason IS NOT NULL").drop("fresh"), number)

    def _put_closed(self, closed: DataFrame, number: int) -> None:
        # only numbers of batches that opened one of these are read
        numbers = self.spark.read.schema(_NUMBERS).parquet(f"{self.folder.path}/numbers")
        state = closed.join(numbers, ["session", "first_packet_index", "first_batch"]).withColumnRenamed("number", "sequence_number").withColumn("ip_version", flows.ip_version())
        self.folder.put(f"batch-{number}/closed", state)

    def _deliver_closed(self, number: int) -> None:
        if self.folder.marked(f"batch-{number}/closed"):
            state = self.spark.read.parquet(f"{self.folder.path}/batch-{number}/closed")
            self._deliver("flow", number, detectors.flow_findings(state, self.settings.volume, self.settings.control))

    def finish(self) -> None:
        """The capture ends: what is open closes. A second call, here or after a restart, does nothing."""
        if self.finished:
            return
        with passing(self.spark):
            held = self._held()
            if held is not None:
                self._put_closed(held, FINAL)
                self._deliver_closed(FINAL)
            self.folder.mark(f"batch-{FINAL}/committed")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a streaming DataFrame of observations; call ``finish`` when the query has ended."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class StreamingEvaluation:
    """Findings of a stream against ground truth; ``packets`` and ``flow_findings`` are consumers.

    ``metrics`` can be asked for after any batch: they are those of all findings
    so far. A packet's identity holds its place, so a batch's packet findings
    are matched at once. A flow finding may have to give way to a later one
    with the wanted decision, so each identity's findings are counted in a
    state store and its share is put anew. No findings are kept, and a batch
    that is delivered again changes nothing.
    """

    def __init__(self, spark: SparkSession, packet_expectations: DataFrame, flow_expectations: DataFrame, folder: str | None = None) -> None:
        evaluation.check_expectations(packet_expectations, evaluation.PACKET_IDENTITY)
        evaluation.check_expectations(flow_expectations, evaluation.FLOW_IDENTITY)
        path = folder or f"{shared_folder(spark).rstrip('/')}/evaluation-{uuid.uuid4().hex}"
        self.spark = spark
        self.packet_channel = matching.PlacedMatching(Folder(spark, f"{path}/packet"), packet_expectations, evaluation.PACKET_IDENTITY)
        self.flow_channel = matching.KeyedMatching(Folder(spark, f"{path}/flow"), flow_expectations, evaluation.FLOW_IDENTITY)

    def packets(self, findings: DataFrame, number: int) -> None:
        self.packet_channel.add(evaluation.finding_identities(findings, packet=True, index="finding_index"), number)

    def flow_findings(self, findings: DataFrame, number: int) -> None:
        self.flow_channel.add(evaluation.finding_identities(findings.withColumn("finding_index", F.lit(0)), packet=False, index="finding_index"), number)

    def metrics(self) -> DataFrame:
        """Metrics by channel, of the batches so far."""
        return matching.metrics(self.spark, packet=self.packet_channel.counts(), flow=self.flow_channel.counts())

    def finish(self) -> DataFrame:
        return self.metrics()


def evaluate_stream(spark: SparkSession, observations: DataFrame | Iterable[DataFrame], settings: DetectionSettings, packet_expectations: DataFrame, flow_expectations: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Detection and evaluation of a whole stream: metrics by channel.

    ``observations`` is a streaming DataFrame, or batches in order, numbered
    from 0. With a ``folder`` a run that failed can be repeated and goes on
    after the last batch that was committed; any error ends the run.
    """
    folder = folder or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    evaluated = StreamingEvaluation(spark, packet_expectations, flow_expectations, f"{folder}/evaluation")
    stream = DetectionStream(spark, settings, evaluated.packets, evaluated.flow_findings, f"{folder}/state")
    if isinstance(observations, DataFrame):
        stream.start(observations, f"{folder}/source").awaitTermination()
    else:
        for number, part in enumerate(observations):
            if not stream.finished:
                stream.batch(part, number)
    stream.finish()
    return evaluated.finish()
