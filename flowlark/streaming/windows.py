"""Windows of a stream as mergeable state: one aggregate for each open window, whatever number of packets it has seen.

A micro-batch is cut into windows and aggregated as any batch is; what goes to
the state are these parts, one row for a flow's window. The state is a table of
open windows as sums, extrema, and the times of their first and last packets. A
flow's first part of a batch is merged with its open window if it follows within
the timeout, with the gaps between the two; else it closes that one. All later
parts of the flow are windows of their own. So a batch is one join by flow.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from flowlark.operators import aggregates, flows
from flowlark.schemas import CLOSED_BY_END, CLOSED_BY_INACTIVITY, IDENTITY, WINDOW_KEY
from flowlark.streaming.folder import Folder

_SIDES = ("forward", "reverse")
#: First and last packets of each direction, from which gaps to what follows are made.
_EDGES = tuple(f"{side}_{end}_us" for side in _SIDES for end in ("first", "last"))
_OPEN, _CLOSED = "open", "closed"
LEADING = "leading"


def flow_key() -> Column:
    """A flow's identity as one text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return F.concat_ws(" ", F.hex("a_addr"), F.hex("b_addr"), *[part(c) for c in IDENTITY[2:]])


def window_parts(packets: DataFrame, *, timeout_us: int, batch: int, evicted: DataFrame | None = None) -> DataFrame:
    """The windows of one batch's packets, aggregated: rows with ``flow``, ``batch``, identity, closing and statistics.

    ``leading`` marks the first window of its flow in the batch. ``evicted`` are control rows of ``flows.evictions``. One that closes a
    window of an earlier batch becomes a row of its own, without statistics.
    """
    controls = None
    if evicted is not None:
        start = packets.groupBy("session").agg(F.min("packet_index").alias("_start"))
        evicted = evicted.join(F.broadcast(start), "session")
        controls = evicted.where("packet_index >= _start").drop("_start")
    placed, windows = flows.windows_between(packets, timeout_us, controls)
    edges = [f(F.when(F.col("is_forward") if side == "forward" else ~F.col("is_forward"), F.col("ts_us"))).alias(f"{side}_{end}_us") for side in _SIDES for end, f in (("first", F.min), ("last", F.max))]
    own = windows.select(*WINDOW_KEY, *IDENTITY, "closure_reason", "closed_at", "first_packet_index", "last_packet_index", (F.col("segment") == 1).alias(LEADING))
    parts = own.join(aggregates.statistics(placed, *edges), list(WINDOW_KEY)).drop("sequence_number")
    # the end of a batch closes nothing
    cut = F.col("closure_reason") != CLOSED_BY_END
    parts = parts.withColumns({"closure_reason": F.when(cut, F.col("closure_reason")), "closed_at": F.when(cut, F.col("closed_at"))})
    if evicted is not None:
        before = evicted.where("packet_index < _start").select("session", *IDENTITY, F.col("reason").alias("closure_reason"), "closed_at")
        parts = parts.unionByName(before, allowMissingColumns=True)
    return parts.select(flow_key().alias("flow"), F.lit(batch).cast("bigint").alias("batch"), *parts.columns)


def part_schema(spark: SparkSession, columns: str) -> StructType:
    """The schema of ``window_parts``."""
    empty = spark.createDataFrame([], columns)
    stats = aggregates.statistics(empty.withColumns({"sequence_number": F.lit(0).cast("bigint"), "gap_us": F.lit(0).cast("bigint"), "direction_gap_us": F.lit(0).cast("bigint")})).drop("sequence_number", "session")
    kinds = {f.name: f.dataType for f in empty.schema.fields}
    head = [StructField("flow", StringType()), StructField("batch", LongType()), StructField("session", StringType())]
    head += [StructField(c, kinds[c]) for c in IDENTITY]
    head += [StructField("closure_reason", StringType())] + [StructField(c, LongType()) for c in ("closed_at", "first_packet_index", "last_packet_index")]
    return StructType(head + [StructField(f.name, f.dataType) for f in stats.schema.fields] + [StructField(c, LongType()) for c in _EDGES])


def merged(window: dict, part: dict) -> dict:
    """An open window and what follows it: sums and extrema of both, and of the gap between them."""
    out = dict(window)
    out["last_packet_index"], out["last_us"] = part["last_packet_index"], max(window["last_us"], part["last_us"])
    for d in ("", *_SIDES):
        name = lambda x: f"{d}_{x}" if d else x  # noqa: B023, E731
        mine, its = window[name("packet_count")], part[name("packet_count")]
        for size in ("captured", "original"):
            least, most = name(f"min_{size}_length"), name(f"max_{size}_length")
            # the extrema of an empty direction are 0
            out[least] = min(window[least], part[least]) if mine and its else window[least] + part[least]
            out[most] = max(window[most], part[most])
        ends = (window[f"{d}_last_us"], part[f"{d}_first_us"]) if d else (window["last_us"], part["first_us"])
        gaps = [] if None in ends else [ends[1] - ends[0]]
        low, high, total = name("gap_us_min"), name("gap_us_max"), name("gap_us_sum")
        seen = [x for x in (window[low], part[low], *gaps) if x is not None]
        out[low] = min(seen) if seen else None
        seen = [x for x in (window[high], part[high], *gaps) if x is not None]
        out[high] = max(seen) if seen else None
        out[name("gap_count")] = window[name("gap_count")] + part[name("gap_count")] + len(gaps)
        out[total] = window[total] + part[total] + sum(gaps)
        out[name("gap_square_sum")] = window[name("gap_square_sum")] + part[name("gap_square_sum")] + sum(Decimal(g * g) for g in gaps)
    for n, value in part.items():
        if n.endswith(("_count", "_bytes", "_square_sum")) and "gap" not in n:
            out[n] = window[n] + value
    for side in _SIDES:
        first, last = f"{side}_first_us", f"{side}_last_us"
        out[first] = part[first] if window[first] is None else window[first]
        out[last] = window[last] if part[last] is None else part[last]
    return out


def advance(window: dict | None, parts: list[dict], timeout_us: int) -> tuple[dict | None, list[dict]]:
    """The open window after ``parts`` of one flow, in order, and what happened: windows opened and closed."""
    events = []

    def close(reason: str, at: int) -> None:
        nonlocal window
        events.append({**window, "kind": _CLOSED, "closure_reason": reason, "closed_at": at})
        window = None

    # a row without packets closes what was open before the batch
    for part in sorted(parts, key=lambda p: (p["first_packet_index"] is not None, p["first_packet_index"] or 0)):
        if part["first_packet_index"] is None:
            if window is not None:
                close(part["closure_reason"], part["closed_at"])
            continue
        if window is not None and part["first_us"] - window["last_us"] >= timeout_us:
            close(CLOSED_BY_INACTIVITY, part["first_packet_index"])
        if window is None:
            window = {**part, "first_batch": part["batch"]}
            events.append({"kind": _OPEN, **{k: window[k] for k in ("flow", "session", "first_batch", "batch", "first_packet_index")}})
        else:
            window = merged(window, part)
        window["batch"] = part["batch"]
        if part["closure_reason"] is not None:
            close(part["closure_reason"], part["closed_at"])
    return window, events


def held_schema(parts: StructType) -> StructType:
    return StructType([StructField("first_batch", LongType()), *parts.fields])


def marked_schema(parts: StructType) -> StructType:
    return StructType([*parts.fields, StructField(LEADING, BooleanType())])


def _merged(n: str, kind: str) -> Column:
    """As ``merged``: the value of a column of an open window (``h_``) and the part that follows it."""
    mine, its = F.col(f"h_{n}"), F.col(n)
    side = next((d for d in _SIDES if n.startswith(f"{d}_")), None)
    rest = n.removeprefix(f"{side}_") if side else n
    count = f"{side}_packet_count" if side else "packet_count"
    gap = F.col(f"{side}_first_us") - F.col(f"h_{side}_last_us") if side else F.col("first_us") - F.col("h_last_us")
    if rest in ("min_captured_length", "min_original_length"):
        return F.when((F.col(f"h_{count}") > 0) & (F.col(count) > 0), F.least(mine, its)).otherwise(mine + its)
    if rest in ("max_captured_length", "max_original_length"):
        return F.greatest(mine, its)
    if rest in ("gap_us_min", "gap_us_max"):
        return (F.least if rest == "gap_us_min" else F.greatest)(mine, its, gap)
    if rest == "gap_count":
        return mine + its + gap.isNotNull().cast("bigint")
    if rest == "gap_us_sum":
        return mine + its + F.coalesce(gap, F.lit(0))
    if rest == "gap_square_sum":
        square = gap.cast("decimal(19,0)") * gap.cast("decimal(19,0)")
        return mine + its + F.coalesce(square.cast(kind), F.lit(0).cast(kind))
    if n in ("last_packet_index", "batch"):
        return its
    if n == "last_us":
        return F.greatest(mine, its)
    if side and rest == "first_us":
        return F.coalesce(mine, its)
    if side and rest == "last_us":
        return F.coalesce(its, mine)
    if n.endswith(("_count", "_bytes", "_square_sum")):
        return mine + its
    return mine


def advanced(held: DataFrame | None, parts: DataFrame, schema: StructType, timeout_us: int) -> DataFrame:
    """As ``advance``, of all flows at once: their windows after ``parts``, which are those of one batch.

    ``fresh`` are those opened in the batch; without a ``closure_reason`` a window is open.
    """
    names, keys = schema.names, ["session", "flow"]
    own = ["first_batch", *names, "fresh"]
    begun = parts.where("first_packet_index IS NOT NULL").withColumns({"first_batch": F.col("batch"), "fresh": F.lit(True)})
    if held is None:
        return begun.select(*own)
    gone = parts.where("first_packet_index IS NULL").groupBy(*keys).agg(F.min(F.struct("closed_at", "closure_reason")).alias("gone"))
    before = held.select(*keys, F.lit(True).alias("h_open"), *[F.col(n).alias(f"h_{n}") for n in held.columns if n not in keys])
    rows = before.join(begun.where(LEADING), keys, "full_outer").join(gone, keys, "left")
    open_, led = F.col("h_open").isNotNull(), F.col("first_packet_index").isNotNull()
    follows = open_ & led & F.col("gone").isNull() & (F.col("first_us") - F.col("h_last_us") < timeout_us)
    old, new, both = F.lit(0), F.lit(1), F.lit(2)
    which = F.when(follows, F.array(both)).when(open_ & led, F.array(old, new)).when(open_, F.array(old)).otherwise(F.array(new))
    rows = rows.withColumn("which", F.explode(which))
    is_old, is_both = F.col("which") == 0, F.col("which") == 2
    ended = {
        "closure_reason": F.when(F.col("gone").isNotNull(), F.col("gone.closure_reason")).when(led, F.lit(CLOSED_BY_INACTIVITY)),
        "closed_at": F.when(F.col("gone").isNotNull(), F.col("gone.closed_at")).when(led, F.col("first_packet_index")),
    }

    def value(f: StructField) -> Column:
        if f.name in keys:
            return F.col(f.name)
        if f.name in ended:
            return F.when(is_old, ended[f.name]).otherwise(F.col(f.name)).alias(f.name)
        kind = f.dataType.simpleString()
        return F.when(is_both, _merged(f.name, kind)).when(is_old, F.col(f"h_{f.name}")).otherwise(F.col(f.name)).cast(kind).alias(f.name)

    first = F.when(F.col("which") == 1, F.col("first_batch")).otherwise(F.col("h_first_batch")).alias("first_batch")
    led_rows = rows.select(first, *[value(f) for f in schema.fields], (F.col("which") == 1).alias("fresh"))
    return led_rows.unionByName(begun.where(f"NOT {LEADING}").select(*own))


def open_windows(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The windows that are open after a batch (without its number: the last one), as closed by the end of the capture."""
    number = max(Folder(spark, path).numbers("batch-")) if number is None else number
    held = spark.read.parquet(f"{path}/batch-{number}")
    return held.withColumns({"closure_reason": F.lit(CLOSED_BY_END), "closed_at": F.lit(None).cast("bigint")})
