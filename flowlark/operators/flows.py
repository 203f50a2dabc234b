"""Canonical flows, their inactivity windows and the packets' places in them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.errors import FlowError
from flowlark.functions.wire import DECODED
from flowlark.runtime import with_rank, written
from flowlark.schemas import CLOSED_BY_CAPACITY, CLOSED_BY_END, CLOSED_BY_INACTIVITY, CLOSED_BY_REQUEST, IDENTITY, MAX_ACTIVE_WINDOWS, OBSERVATION


_IDENTITY_TYPES = {"a_addr": "binary", "b_addr": "binary", "a_port": "int", "b_port": "int", "is_forward": "boolean"}


def with_identity(packets: DataFrame) -> DataFrame:
    """Adds the canonical endpoints and ``is_forward``.

    The smaller (address, port) is endpoint a; of ICMP only addresses count and
    ports are null. A packet is forward if its sender is endpoint a; from an
    endpoint to itself it is forward. Spark orders binary values by unsigned bytes.
    """
    icmp = F.col("protocol").isin(1, 58)
    port = lambda c: F.when(~icmp, F.col(c))
    source = F.struct(F.col("src_addr").alias("addr"), F.coalesce(port("src_port"), F.lit(-1)).alias("port"))
    target = F.struct(F.col("dst_addr").alias("addr"), F.coalesce(port("dst_port"), F.lit(-1)).alias("port"))
    swap = target < source
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    return packets.withColumns({
        "a_addr": pick(F.col("src_addr"), F.col("dst_addr")), "b_addr": pick(F.col("dst_addr"), F.col("src_addr")),
        "a_port": pick(port("src_port"), port("dst_port")), "b_port": pick(port("dst_port"), port("src_port")),
        "icmp_echo_id": F.when(icmp, F.col("icmp_echo_id")), "is_forward": ~swap,
    })


def ip_version() -> Column:
    return F.when(F.length("a_addr") == 4, 4).when(F.length("a_addr") == 16, 6)


def flow_tracker(packets: DataFrame) -> DataFrame:
    """Packets, first and last index of each identity; unbounded and without windows."""
    return packets.groupBy("session", *IDENTITY).agg(F.count(F.lit(1)).alias("packet_count"), F.min("packet_index").alias("first_packet_index"), F.max("packet_index").alias("last_packet_index"))


def _frontier(packets: DataFrame) -> DataFrame:
    """Adds the latest time before each packet in its session.

    The running maximum comes in two steps: within slices of the packet order,
    and over the slices' maxima, so no task holds a session.
    """
    size = 1 << 20
    sliced = packets.withColumn("_slice", F.floor(F.col("packet_index") / size))
    tops = sliced.groupBy("session", "_slice").agg(F.max("ts_us").alias("_top"))
    before = Window.partitionBy("session").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(before)).drop("_top")
    inner = Window.partitionBy("session", "_slice").orderBy("packet_index").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.max("ts_us").over(inner), F.col("_before"))
    return sliced.join(tops, ["session", "_slice"]).withColumn("frontier_us", reached).drop("_slice", "_before")


def frontier_violations(packets: DataFrame) -> DataFrame:
    """Packets that are earlier than one before them in their session."""
    return _frontier(packets).where("ts_us < frontier_us")


def split_late(packets: DataFrame, reached: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets in order, late packets with ``frontier_us``, the time that they had to reach).

    A packet is late if it is earlier than one before it in its session, or than
    the session's ``frontier_us`` in ``reached``. Late packets do not move the
    frontier, so leaving them out leaves the others in order.
    """
    seen = _frontier(packets)
    if reached is not None:
        reached = reached.select(F.col("session").alias("_session"), F.col("frontier_us").alias("_reached"))
        seen = seen.join(F.broadcast(reached), F.col("session").eqNullSafe(F.col("_session")), "left").withColumn("frontier_us", F.greatest("frontier_us", "_reached")).drop("_session", "_reached")
    late = F.coalesce(F.col("ts_us") < F.col("frontier_us"), F.lit(False))
    return seen.where(~late).drop("frontier_us"), seen.where(late)


def check_frontier(packets: DataFrame) -> None:
    """Raises an error if a packet is earlier than one before it in its session."""
    found = frontier_violations(packets.select("session", "packet_index", "ts_us")).select("packet_index").first()
    if found is not None:
        raise FlowError(f"packet {found[0]} is earlier than one before it")


def column_types(names: tuple[str, ...]) -> list[tuple[str, str]]:
    """Names and types of columns of decoded packets with identity."""
    known = dict(c.strip().split(" ", 1) for c in OBSERVATION.split(",")) | DECODED
    return [(n, known.get(n) or _IDENTITY_TYPES[n]) for n in names]


#: A flow with more packets than this is cut at these places of the capture while its windows are found.
SLICE = 1 << 22
#: Flows are counted by groups of their hashes; only those in a group with more than a slice's packets can be that long.
FLOW_GROUPS = 1 << 13
#: Those that the eviction scan goes through in one task, row by row in Python.
SCAN_SLICE = 1 << 19


def _rows(packets: DataFrame, controls: DataFrame | None) -> DataFrame:
    """Packets and control rows with the hash of their flow: one number to deal and sort by, before the flow itself."""
    rows = packets.withColumn("_control", F.lit(False))
    if controls is not None:
        rows = rows.unionByName(controls.withColumn("_control", F.lit(True)), allowMissingColumns=True)
    return rows.withColumn("_flow", F.xxhash64("session", *IDENTITY))


def _long_groups(rows: DataFrame, slice_packets: int) -> list[int]:
    """Groups of flows that have more than a slice's packets together, fewer than the capture has slices; any other flow is shorter than that."""
    counts = rows.where("NOT _control").groupBy(F.pmod("_flow", F.lit(FLOW_GROUPS)).alias("_group")).count()
    return sorted(r[0] for r in counts.where(F.col("count") > slice_packets).select("_group").collect())


def _local(rows: DataFrame, timeout_us: int, keys: tuple[str, ...]) -> DataFrame:
    """Gaps, breaks and the last packet of the same direction, among the rows of the same ``keys``: a flow, or its slice.

    ``_seg`` counts the breaks after the first of these rows; ``_own`` is the
    (``_seg``, time) of the last packet of the row's direction.
    """
    order = Window.partitionBy(*keys).orderBy("packet_index", "_control")
    last_ts, after_control = F.lag("ts_us").over(order), F.lag("_control").over(order)
    first = F.lag("packet_index").over(order).isNull()
    rows = rows.withColumn("_first", first).withColumn("_break", ~F.col("_control") & ~first & (after_control | last_ts.isNull() | (F.col("ts_us") - last_ts >= timeout_us)))
    rows = rows.withColumn("_gap", F.col("ts_us") - last_ts)
    rows = rows.withColumn("_seg", F.sum(F.col("_break").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto, state = order.rowsBetween(Window.unboundedPreceding, -1), F.struct("_seg", "ts_us")
    seen = [F.last(F.when(side & ~F.col("_control"), state), ignorenulls=True).over(upto) for side in (F.col("is_forward"), ~F.col("is_forward"))]
    return rows.withColumn("_own", F.when(F.col("is_forward"), seen[0]).otherwise(seen[1]))


def _carried(local: DataFrame, timeout_us: int) -> DataFrame:
    """What each slice of a flow takes over from those before: its first segment, the row before and the last packet of each direction.

    One narrow row for each flow and slice, so that even a flow with most packets of a capture is a short list here.
    """
    keys = ["session", *IDENTITY, "_slice"]
    at = F.struct("packet_index", "_control")
    side = lambda c: F.max_by(F.struct("_seg", "ts_us"), F.when(c & ~F.col("_control"), at))
    slices = local.groupBy(*keys).agg(F.max("_seg").alias("breaks"), F.min_by(F.struct("ts_us", "_control"), at).alias("head"), F.max_by(F.struct("ts_us", "_control"), at).alias("tail"), side(F.col("is_forward")).alias("fwd"), side(~F.col("is_forward")).alias("rev"))
    order = Window.partitionBy("session", *IDENTITY).orderBy("_slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("tail").over(order)
    fresh = ~F.col("head")["_control"] & (last.isNull() | last["_control"] | (F.col("head")["ts_us"] - last["ts_us"] >= timeout_us))
    slices = slices.withColumn("_fresh", fresh).withColumn("_before_us", F.when(~last["_control"], last["ts_us"]))
    slices = slices.withColumn("_base", F.coalesce(F.sum(F.col("_fresh").cast("bigint") + F.col("breaks")).over(before), F.lit(0)) + F.col("_fresh").cast("bigint"))
    shifted = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col("_base") + F.col(c)["_seg"]).alias("_seg"), F.col(c)["ts_us"].alias("ts_us")))
    return slices.select(*keys, "_fresh", "_before_us", "_base", F.last(shifted("fwd"), ignorenulls=True).over(before).alias("_fwd"), F.last(shifted("rev"), ignorenulls=True).over(before).alias("_rev"))


def _segmented(packets: DataFrame, timeout_us: int, controls: DataFrame | None, slice_packets: int = SLICE) -> tuple[DataFrame, bool]:
    """(rows with ``_flow``, ``segment``: number of the window within its identity (from 1), and gaps to the packets before in the window; whether flows lie whole in a task, in order).

    They do unless some flow may have more than ``slice_packets`` packets. Such
    flows are cut; what a slice takes over comes from a narrow table of theirs.
    """
    rows = _rows(packets, controls)
    long, flow = _long_groups(rows, slice_packets), ("_flow", "session", *IDENTITY)
    helpers = ("_first", "_break", "_gap", "_seg", "_own")
    if not long:
        local = _local(rows.repartition("_flow"), timeout_us, flow)
        return _joined(local, ~F.col("_control"), F.lit(None).cast("bigint"), F.lit(1).cast("bigint"), F.lit(None).cast("struct<_seg:bigint,ts_us:bigint>")).drop(*helpers), True
    cut = F.pmod("_flow", F.lit(FLOW_GROUPS)).isin(long)
    rows = rows.withColumn("_slice", F.when(cut, F.floor(F.col("packet_index") / slice_packets)).otherwise(0))
    local, match = written(_local(rows, timeout_us, (*flow, "_slice")), "slices"), F.lit(True)
    keys = ["session", *IDENTITY, "_slice"]
    carried = _carried(local.where(cut), timeout_us)
    carried = carried.select(*[F.col(k).alias(f"_c{k}") for k in keys], "_fresh", "_before_us", "_base", "_fwd", "_rev")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    sliced = local.where(cut).join(carried, match).drop(*[f"_c{k}" for k in keys])
    sliced = _joined(sliced, F.col("_fresh"), F.col("_before_us"), F.col("_base"), F.when(F.col("is_forward"), F.col("_fwd")).otherwise(F.col("_rev")))
    whole = _joined(local.where(~cut), ~F.col("_control"), F.lit(None).cast("bigint"), F.lit(1).cast("bigint"), F.lit(None).cast("struct<_seg:bigint,ts_us:bigint>"))
    return whole.drop(*helpers, "_slice").unionByName(sliced.drop(*helpers, "_slice", "_fresh", "_before_us", "_base", "_fwd", "_rev")), False


def _joined(local: DataFrame, fresh: Column, before: Column, base: Column, earlier: Column) -> DataFrame:
    """``local`` with what its rows' slice takes over."""
    segment = base + F.col("_seg")
    gap = F.when(F.col("_first"), F.when(~fresh, F.col("ts_us") - before)).when(~F.col("_break"), F.col("_gap"))
    own = F.when(F.col("_own").isNotNull(), F.struct((base + F.col("_own")["_seg"]).alias("_seg"), F.col("_own")["ts_us"].alias("ts_us"))).otherwise(earlier)
    return local.withColumn("segment", segment).withColumn("gap_us", gap).withColumn("direction_gap_us", F.when(own["_seg"] == segment, F.col("ts_us") - own["ts_us"]))


def flow_segments(packets: DataFrame, *, timeout_us: int, slice_packets: int = SLICE) -> DataFrame:
    """Packets with ``segment``, the number of their window within its flow (from 1): each window whole in a task, its packets in order, one window after the other.

    These are the windows of ``sessionize`` without a limit of active ones, and
    without the numbers that they have in their session.
    """
    rows, together = _segmented(packets, timeout_us, None, slice_packets)
    flow = ("_flow", "session", *IDENTITY)
    # where flows lie whole in a task they are in this order already, and Spark leaves the sort out
    rows = rows.sortWithinPartitions(*flow, "packet_index") if together else rows.repartition(*flow, "segment").sortWithinPartitions(*flow, "segment", "packet_index")
    return rows.select(*packets.columns, "segment")


def sessionize(packets: DataFrame, *, timeout_us: int, max_active: int | None = MAX_ACTIVE_WINDOWS, controls: DataFrame | None = None, slice_packets: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(packets with ``sequence_number`` and gaps, windows with closing).

    A window of an identity ends when its next packet comes ``timeout_us`` or
    more after its last (equal counts), at a control row (``session``, identity
    columns, ``packet_index``: closed after that packet), when the number of
    active windows is at ``max_active`` and another identity comes (the one
    with the earliest last packet, then the smallest number, is closed), or at
    the end of the session. Numbers count the windows of a session in the order
    of their first packets. Packets need ``session``, ``packet_index``,
    ``ts_us``, identity columns and ``is_forward``.

    Where no session has more identities than ``max_active`` (an exact count),
    nothing can be evicted and windows of different flows are independent.
    Otherwise a narrow scan in packet order, with a state of ``max_active``
    entries, finds the evictions; they become control rows.

    Flows with more than ``slice_packets`` packets are followed in slices of as
    many packets of the capture, so that a flow with most of them is the work of
    many tasks.
    """
    if max_active is not None:
        many = packets.select("session", *IDENTITY).distinct().groupBy("session").count().where(F.col("count") > max_active).limit(1).count()
        if many:
            evicted = written(evictions(packets, timeout_us=timeout_us, max_active=max_active, controls=controls, slice_packets=min(slice_packets, SCAN_SLICE)), "evictions")
            both = evicted if controls is None else evicted.unionByName(controls.withColumn("reason", F.lit(CLOSED_BY_REQUEST)).withColumn("closed_at", F.col("packet_index")), allowMissingColumns=True)
            return _windows(packets, timeout_us, both, slice_packets)
    marked = None if controls is None else controls.withColumn("reason", F.lit(CLOSED_BY_REQUEST)).withColumn("closed_at", F.col("packet_index"))
    return _windows(packets, timeout_us, marked, slice_packets)


def windows_between(packets: DataFrame, timeout_us: int, controls: DataFrame | None = None, slice_packets: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """As ``sessionize``, with control rows that have a ``reason`` and ``closed_at``, and no limit of active windows."""
    return _windows(packets, timeout_us, controls, slice_packets)


def _windows(packets: DataFrame, timeout_us: int, controls: DataFrame | None, slice_packets: int) -> tuple[DataFrame, DataFrame]:
    rows = packets.withColumn("reason", F.lit(None).cast("string")).withColumn("closed_at", F.lit(None).cast("bigint"))
    segmented = written(_segmented(rows, timeout_us, controls, slice_packets)[0].drop("_flow"), "segments")
    keys = ["session", *IDENTITY, "segment"]
    closing = F.when(F.col("_control"), F.struct("packet_index", "reason", "closed_at"))
    firsts = segmented.where("segment > 0").groupBy(*keys).agg(F.min(F.when(~F.col("_control"), F.col("packet_index"))).alias("first_packet_index"), F.max(F.when(~F.col("_control"), F.col("packet_index"))).alias("last_packet_index"), F.min("ts_us").alias("first_us"), F.max(F.when(~F.col("_control"), F.col("ts_us"))).alias("last_us"), F.min(closing).alias("closing"))
    following = Window.partitionBy("session", *IDENTITY).orderBy("segment")
    firsts = firsts.withColumn("_next", F.lead("first_packet_index").over(following))
    reason = F.when(F.col("closing").isNotNull(), F.col("closing")["reason"]).when(F.col("_next").isNotNull(), F.lit(CLOSED_BY_INACTIVITY)).otherwise(F.lit(CLOSED_BY_END))
    at = F.when(F.col("closing").isNotNull(), F.col("closing")["closed_at"]).otherwise(F.col("_next"))
    ranked = with_rank(firsts.withColumn("closure_reason", reason).withColumn("closed_at", at).drop("closing", "_next"), "_rank", "session", "first_packet_index")
    starts = ranked.groupBy("session").agg(F.min("_rank").alias("_base"))
    windows = ranked.join(starts, "session").withColumn("sequence_number", F.col("_rank") - F.col("_base")).drop("_rank", "_base")
    numbers = windows.select(*[F.col(k).alias(f"_{k}") for k in keys], "sequence_number")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = segmented.where("NOT _control").join(numbers, match).drop(*[f"_{k}" for k in keys], "_control", "reason", "closed_at")
    return placed, windows


def closure_order(windows: DataFrame) -> DataFrame:
    """Adds ``closure_rank`` by the packet that closes a window, those of the session's end last, then by number."""
    order = [F.col("session"), F.coalesce("closed_at", F.lit(2**62)), F.col("sequence_number")]
    return with_rank(windows, "closure_rank", *order)


class ActiveWindows:
    """The identities with an open window of one session, bounded; the heap holds outdated entries until they surface."""

    def __init__(self, limit: int, timeout_us: int) -> None:
        self.limit, self.timeout = limit, timeout_us
        self.open: dict[tuple, tuple[int, int]] = {}
        self.heap: list[tuple[int, int, tuple]] = []
        self.created = self.carried = 0
        self.ordered = False  # whether the order of carried windows decided anything

    def carry(self, key: tuple, ts: int) -> None:
        """A window that is open from the start, after those carried before it by number."""
        self.open[key] = (ts, self.created)
        heapq.heappush(self.heap, (ts, self.created, key))
        self.created += 1
        self.carried = self.created

    def close(self, key: tuple) -> None:
        self.open.pop(key, None)

    def _top(self) -> tuple[int, int, tuple] | None:
        """The open window that has to go next; outdated entries above it are dropped."""
        while self.heap and self.open.get(self.heap[0][2]) != self.heap[0][:2]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None

    def packet(self, key: tuple, ts: int) -> tuple | None:
        """Note a packet; returns the identity that had to go, if one had."""
        victim, known = None, self.open.get(key)
        if known is not None and ts - known[0] < self.timeout:
            number = known[1]
        else:
            if known is None and len(self.open) >= self.limit:
                last, number, victim = self._top()
                del self.open[victim]
                following = self._top()
                if following is not None and following[0] == last and max(number, following[1]) < self.carried:
                    self.ordered = True
            number = self.created
            self.created += 1
        self.open[key] = (ts, number)
        heapq.heappush(self.heap, (ts, number, key))
        if len(self.heap) > 8 * self.limit + 64:
            self.heap = [(t, n, k) for k, (t, n) in self.open.items()]
            heapq.heapify(self.heap)
        return victim


_SCANNED = "kind string, session string, slice bigint, packet_index bigint, closed_at bigint, ts_us bigint, number bigint, ordered boolean"
_EVICTED, _MARK, _END, _START = "evicted", "mark", "end", "start"


def _arrays(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _scan(rows: DataFrame, timeout_us: int, limit: int, kinds: str) -> DataFrame:
    """Each slice from the windows it starts with: windows that give way, and those that are open at its end with their order.

    Numbers below that of the mark are places among the windows it started with;
    others count what it opened. The mark says whether the order of the former
    decided anything.
    """
    out = f"{_SCANNED}, {kinds}"
    rows = rows.select("session", "slice", "carried", "packet_index", "control", "ts_us", "last_index", *IDENTITY)
    rows = rows.repartition("session", "slice").sortWithinPartitions("session", "slice", F.col("carried").desc(), "packet_index", "control")
    key_types = [rows.schema[c].dataType for c in IDENTITY]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("kind", pa.string()), ("session", pa.string()), *((n, pa.int64()) for n in ("slice", "packet_index", "closed_at", "ts_us", "number")), ("ordered", pa.bool_()), *((c, to_arrow_type(t)) for c, t in zip(IDENTITY, key_types))])
    nothing = (None,) * len(IDENTITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, active, last, found = None, None, {}, []

        def ended() -> list[tuple]:
            ends = sorted((number, key, ts) for key, (ts, number) in active.open.items())
            return [(_MARK, *place, None, None, None, active.carried, active.ordered, *nothing), *((_END, *place, last[key], None, ts, number, None, *key) for number, key, ts in ends)]

        for batch in batches:
            for session, number, carried, index, control, ts, own, *key in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(key)
                if place != (session, number):
                    found += [] if place is None else ended()
                    place, active, last = (session, number), ActiveWindows(limit, timeout_us), {}
                if carried:
                    active.carry(key, ts)
                elif control:
                    active.close(key)
                    continue
                else:
                    victim = active.packet(key, ts)
                    if victim is not None:
                        found.append((_EVICTED, session, number, last.pop(victim), index, None, None, None, *victim))
                last[key] = own
            if len(found) >= 4096:
                yield _arrays(found, schema)
                found = []
        yield _arrays(found if place is None else found + ended(), schema)

    return rows.mapInArrow(run, out)


def _guessed_starts(sliced: DataFrame, limit: int) -> DataFrame:
    """Windows that are likely open at the start of each slice but a session's first: the identities seen last, in the order of their last packets.

    Where times rise strictly and nothing is closed on request this is right.
    Of each slice only the ``limit`` identities seen last are read, and no more
    than those are held on the way through a session's slices.
    """
    of_packet = lambda c: F.when(~F.col("control"), F.col(c))
    lasts = sliced.groupBy("session", "slice", *IDENTITY).agg(F.max(of_packet("packet_index")).alias("packet_index"), F.max("ts_us").alias("ts_us"), F.max(F.when(F.col("control"), F.col("packet_index"))).alias("closed"))
    lasts = lasts.withColumn("closed", F.coalesce(F.col("closed") >= F.coalesce("packet_index", F.lit(-1)), F.lit(False))).withColumn("packet_index", F.coalesce("packet_index", F.lit(-1).cast("bigint")))
    latest = Window.partitionBy("session", "slice").orderBy(F.col("packet_index").desc())
    rows = lasts.withColumn("_place", F.row_number().over(latest)).where((F.col("_place") <= limit) | F.col("closed")).select("session", "slice", "packet_index", "ts_us", "closed", *IDENTITY)
    rows = rows.repartition("session").sortWithinPartitions("session", "slice", "packet_index")
    out = rows.drop("closed").withColumn("number", F.lit(0).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = None, {}
        for batch in batches:
            kept = batch.select([n for n in batch.schema.names if n != "closed"]).schema
            for session, number, index, ts, closed, *key in zip(*(c.to_pylist() for c in batch.columns)):
                if place is None or place[0] != session:
                    place, seen = (session, number), {}
                elif place[1] != number:
                    place, seen = (session, number), dict(list(seen.items())[-limit:])
                    rows = [(session, number, *at, *k, n) for n, (k, at) in enumerate(seen.items())]
                    yield _arrays(rows, kept.append(pa.field("number", pa.int64())))
                key = tuple(key)
                seen.pop(key, None)
                if not closed:
                    seen[key] = (index, ts)

    return rows.mapInArrow(run, out.schema).select("session", "slice", "packet_index", "ts_us", "number", *IDENTITY)


def _misled(starts: DataFrame, scans: DataFrame) -> DataFrame:
    """What the first slice of each session that started from something else should have started from: a mark, and its windows in order.

    A session's slices are gone through in order, of each the windows at its
    start and end, so that no more than a limit of windows is held.
    """
    kinds = dict(starts.dtypes)
    all_ = starts.select(F.lit(_START).alias("kind"), "session", "slice", "packet_index", "ts_us", "number", F.lit(None).cast("boolean").alias("ordered"), *IDENTITY)
    all_ = all_.unionByName(scans.where(F.col("kind") != _EVICTED).select(*all_.columns))
    stage = F.when(F.col("kind") == _START, 0).when(F.col("kind") == _MARK, 1).otherwise(2)
    rows = all_.withColumn("stage", stage).repartition("session").sortWithinPartitions("session", "slice", "stage", "number").drop("stage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, true, start, mark, ends, out, lost, schema = None, {}, {}, None, [], [], False, None

        def settle() -> None:
            """Hold what a slice started from against what it should have, and go on to what it left."""
            nonlocal true, lost
            if lost:
                return
            carried, ordered = mark
            same = start == true and (not ordered or list(start) == list(true))
            if not same:
                lost = True
                out.append((_MARK, *place, None, None, None, None, *(None,) * len(IDENTITY)))
                out.extend((_START, *place, index, ts, n, None, *key) for n, (key, (index, ts)) in enumerate(true.items()))
                return
            left = {key: at for key, number, at in ends if number < carried}
            opened = {key: at for key, number, at in ends if number >= carried}
            true = {key: left[key] for key in true if key in left} | opened

        for batch in batches:
            schema = batch.schema
            for kind, session, number, index, ts, order, ordered, *key in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (session, number):
                    if place is not None:
                        settle()
                        if place[0] != session:
                            true, lost = {}, False
                    place, start, mark, ends = (session, number), {}, None, []
                if kind == _START:
                    start[tuple(key)] = (index, ts)
                elif kind == _MARK:
                    mark = (order, ordered)
                else:
                    ends.append((tuple(key), order, (index, ts)))
        if place is not None:
            settle()
        if schema is not None:
            yield _arrays(out, schema)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in all_.dtypes))


def evictions(packets: DataFrame, *, timeout_us: int, max_active: int, controls: DataFrame | None = None, slice_packets: int = SLICE, open_: DataFrame | None = None) -> DataFrame:
    """Control rows for windows that give way: identity, ``packet_index`` of their last packet, ``closed_at`` and the reason.

    ``open_`` has the windows that are open before: session, identity,
    ``packet_index`` of their first and ``last_index`` of their last packet, and
    the time of the last.

    Slices of a session are scanned beside each other, each from the windows
    that are likely open at its start. Ties of times, which numbers decide, and
    closings on request, which leave a place free, can make that wrong; what
    each slice leaves is held against what the next one started from, and a
    slice that was misled is scanned again from what is right, until none is.
    So no task goes through more than a slice.
    """
    narrow = packets.select("session", "packet_index", F.lit(False).alias("control"), "ts_us", *IDENTITY)
    if controls is not None:
        narrow = narrow.unionByName(controls.select("session", "packet_index", F.lit(True).alias("control"), F.lit(None).cast("bigint").alias("ts_us"), *IDENTITY))
    types = dict(packets.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in IDENTITY)
    ends = narrow.agg(F.min("packet_index"), F.max("packet_index")).first()
    several = open_ is None and ends[0] is not None and ends[0] // slice_packets != ends[1] // slice_packets
    sliced = narrow.withColumn("slice", F.floor(F.col("packet_index") / slice_packets) if several else F.lit(0).cast("bigint"))
    as_rows = lambda df: df.withColumns({"carried": F.lit(False), "last_index": F.col("packet_index")})
    from_start = lambda df: df.select("session", "slice", F.lit(True).alias("carried"), F.col("number").alias("packet_index"), F.lit(False).alias("control"), "ts_us", F.col("packet_index").alias("last_index"), *IDENTITY)
    if not several:
        rows = as_rows(sliced)
        if open_ is not None:
            rows = rows.unionByName(open_.select("session", F.lit(0).cast("bigint").alias("slice"), F.lit(True).alias("carried"), "packet_index", F.lit(False).alias("control"), "ts_us", "last_index", *IDENTITY))
        scans = _scan(rows, timeout_us, max_active, kinds)
    else:
        sliced = written(sliced, "slices")
        starts = written(_guessed_starts(sliced, max_active), "starts")
        scans = written(_scan(as_rows(sliced).unionByName(from_start(starts)), timeout_us, max_active, kinds), "scans")
        while True:
            right = written(_misled(starts, scans), "misled")
            again = right.where(F.col("kind") == _MARK).select(F.col("session").alias("_session"), F.col("slice").alias("_slice"))
            if again.limit(1).count() == 0:
                break
            hit = F.col("session").eqNullSafe(F.col("_session")) & (F.col("slice") == F.col("_slice"))
            fresh = right.where(F.col("kind") == _START).select(*starts.columns)
            redone = _scan(as_rows(sliced.join(F.broadcast(again), hit, "left_semi")).unionByName(from_start(fresh)), timeout_us, max_active, kinds)
            starts = written(starts.join(F.broadcast(again), hit, "left_anti").unionByName(fresh), "starts")
            scans = written(scans.join(F.broadcast(again), hit, "left_anti").unionByName(redone), "scans")
    return scans.where(F.col("kind") == _EVICTED).select("session", "packet_index", "closed_at", F.lit(CLOSED_BY_CAPACITY).alias("reason"), *IDENTITY)


def packed_addresses(df: DataFrame, **columns: str) -> DataFrame:
    """Adds the packed form (4 or 16 bytes) of textual IP addresses: ``new="old"``; a null stays null.

    A text that is no address, or an IPv6 address with a scope, raises an error.
    """
    import ipaddress

    def pack(text: str) -> bytes:
        address = ipaddress.ip_address(text)
        if address.version == 6 and address.scope_id is not None:
            raise ValueError("scoped IPv6 addresses are not supported by flow identity")
        return address.packed

    names, wanted = df.columns, list(columns.items())
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{n}` binary" for n, _ in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pa.array([None if t is None else pack(t) for t in batch.column(names.index(old)).to_pylist()], pa.binary()) for _, old in wanted]
            yield pa.RecordBatch.from_arrays([*batch.columns, *packed], names=[*names, *(n for n, _ in wanted)])

    return df.mapInArrow(run, schema)
