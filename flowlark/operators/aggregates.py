"""Exact aggregates of windows: volume, sizes, timing, control flags and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.operators.flows import ip_version
from flowlark.schemas import IDENTITY, TCP_FLAGS, WINDOW_KEY

_SQUARES = "decimal(38,0)"


def _only(direction: str, value: Column) -> Column:
    if direction == "forward":
        return F.when(F.col("is_forward"), value)
    return F.when(~F.col("is_forward"), value) if direction == "reverse" else value


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def _name(direction: str, name: str) -> str:
    return f"{direction}_{name}" if direction else name


def _square(value: Column) -> Column:
    wide = value.cast("decimal(19,0)")
    return wide * wide


def statistics(packets: DataFrame, *more: Column) -> DataFrame:
    """All sums, extrema and counters of a window (and ``more`` aggregates) in one grouping, with map-side combination.

    Sizes of an empty direction are 0. Gaps: number, sum, sum of squares, least
    and greatest, in microseconds, of all packets and of each direction (null
    extrema where there is no gap).
    """
    out: list[Column] = []
    for d in ("", "forward", "reverse"):
        one = _only(d, F.lit(1))
        out.append(F.count(one).alias(_name(d, "packet_count")))
        for size in ("captured", "original"):
            value = _only(d, F.col(f"{size}_length"))
            out += [_zero(F.sum(value)).alias(_name(d, f"{size}_bytes")), _zero(F.min(value)).alias(_name(d, f"min_{size}_length")), _zero(F.max(value)).alias(_name(d, f"max_{size}_length"))]
            out.append(F.coalesce(F.sum(_square(value)).cast(_SQUARES), F.lit(0).cast(_SQUARES)).alias(_name(d, f"{size}_square_sum")))
        gap = _only(d, F.col("direction_gap_us" if d else "gap_us"))
        out += [F.count(gap).alias(_name(d, "gap_count")), _zero(F.sum(gap)).alias(_name(d, "gap_us_sum")), F.min(gap).alias(_name(d, "gap_us_min")), F.max(gap).alias(_name(d, "gap_us_max"))]
        out.append(F.coalesce(F.sum(_square(gap)).cast(_SQUARES), F.lit(0).cast(_SQUARES)).alias(_name(d, "gap_square_sum")))
    if set(TCP_FLAGS) <= set(packets.columns):
        for d in ("forward", "reverse"):
            out += [F.count_if(_only(d, F.col(f))).alias(f"{d}_{f}_count") for f in TCP_FLAGS]
            out.append(F.count_if(_only(d, F.col("syn") & F.col("ack"))).alias(f"{d}_syn_ack_count"))
    return packets.groupBy(*WINDOW_KEY).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *out, *more)


def window_state(packets: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with identity, closing and statistics."""
    own = windows.select(*WINDOW_KEY, *IDENTITY, ip_version().alias("ip_version"), "closure_reason", "closed_at", "first_packet_index", "last_packet_index")
    return own.join(statistics(packets), list(WINDOW_KEY))


def histogram(packets: DataFrame, value: Column, *, name: str = "value", by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """Sparse histogram as rows: ``by``, the value and its count; nulls are left out."""
    rows = packets.select(*by, value.alias(name)).where(F.col(name).isNotNull())
    return rows.groupBy(*by, name).agg(F.count(F.lit(1)).alias("count"))


def exploded_histogram(packets: DataFrame, values: Column, *, name: str = "value", by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """As ``histogram``, of all elements of an array."""
    return packets.select(*by, F.explode(values).alias(name)).groupBy(*by, name).agg(F.count(F.lit(1)).alias("count"))


def summarized(hist: DataFrame, *, name: str = "value", by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """Count, distinct, min, max, sum, zero count and mean (numerator and denominator, and as a double) of a histogram."""
    n, total = F.sum("count"), F.sum(F.col(name) * F.col("count"))
    return hist.groupBy(*by).agg(n.alias("count"), F.count(F.lit(1)).alias("distinct"), F.min(name).cast("bigint").alias("min"), F.max(name).cast("bigint").alias("max"), total.alias("total"), F.coalesce(F.sum(F.when(F.col(name) == 0, F.col("count"))), F.lit(0)).cast("bigint").alias("zero_count"), (total / n).alias("mean"))


def _folded(held: pa.Table, by: list[str], limit: int) -> pa.Table:
    """Counts of equal values added up; of a group with more than ``limit`` values, or one that was full before, one row with a null value."""
    counts = held.group_by([*by, "value"], use_threads=False).aggregate([("count", "sum")]).rename_columns([*by, "value", "count"])
    groups = counts.append_column("none", pc.cast(pc.is_null(counts["value"]), pa.int32())).group_by(by, use_threads=False).aggregate([("value", "count"), ("none", "max")])
    full = pc.or_(pc.greater(groups["value_count"], limit), pc.equal(groups["none_max"], 1))
    if not pc.any(full).as_py():
        return counts
    # keys may be null, which no join of tables matches: rows find their group by its number
    at = counts.append_column("row", pa.array(np.arange(len(counts)))).group_by(by, use_threads=False).aggregate([("row", "list")])
    lists = at["row_list"].combine_chunks()
    of = np.empty(len(counts), dtype=np.int64)
    of[lists.flatten().to_numpy()] = np.repeat(np.arange(len(at)), lists.value_lengths().to_numpy())
    spilt = full.to_numpy(zero_copy_only=False)[of]  # both groupings list the groups as they first come
    kept = counts.filter(pa.array(~spilt))
    totals = counts.filter(pa.array(spilt)).group_by(by, use_threads=False).aggregate([("count", "sum")]).rename_columns([*by, "count"])
    return pa.concat_tables([kept, totals.append_column("value", pa.nulls(len(totals), counts.schema.field("value").type)).select(counts.column_names)])


def bounded_histogram(packets: DataFrame, value: Column, *, limit: int = 256, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward"), held_rows: int = 1 << 20) -> DataFrame:
    """(``by``, value, count): a histogram of which each task keeps at most ``limit`` values a group.

    A group that has more in a task is from there on one row with a null value,
    which holds its total. So what is shuffled is at most ``limit`` + 1 rows a
    group and task (and once more for each time that a task has passed
    ``held_rows`` rows on), and ``saturated`` gives the same from any order and
    cut of the rows. Null values are left out.
    """
    rows = packets.select(*by, value.cast("bigint").alias("value")).where("value IS NOT NULL")
    names = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0  # what is folded, and what came since, which is folded in when it is as much
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch]).append_column("count", pa.array(np.ones(batch.num_rows, dtype=np.int64)))
                held.append(_folded(new, names, limit).select([*names, "value", "count"]))
                fresh += len(held[-1])
            if len(held) > 1 and fresh >= max(1 << 16, len(held[0])):
                held, fresh = [_folded(pa.concat_tables(held), names, limit).select([*names, "value", "count"])], 0
                if len(held[0]) > held_rows:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
        if held:
            yield from _folded(pa.concat_tables(held), names, limit).select([*names, "value", "count"]).combine_chunks().to_batches()

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "count bigint"]))


def saturated(hist: DataFrame, *, limit: int = 256, name: str = "value", by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """Histograms (rows of one value may be several) as sorted arrays; one with more than ``limit`` values, or with a row of a null value, keeps its total only."""
    hist = hist.groupBy(*by, F.col(name).cast("bigint").alias(name)).agg(F.sum("count").alias("count"))
    # at most limit values of a group are gathered: groups with more are left out before, their counts are kept
    totals = hist.groupBy(*by).agg(F.sum("count").alias("total"), F.count(name).alias("distinct"), F.max(F.col(name).isNull()).alias("full"))
    small = totals.where(F.col("distinct") <= limit).where("NOT full").select(*[F.col(c).alias(f"_{c}") for c in by])
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    bins = hist.join(small, match, "left_semi").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("value"), "count"))).alias("bins")).select(*[F.col(c).alias(f"_{c}") for c in by], "bins")
    out = totals.join(bins, match, "left")
    return out.select(*by, "total", (F.col("full") | (F.col("distinct") > limit)).alias("saturated"), F.coalesce("bins", F.array().cast("array<struct<value:bigint,count:bigint>>")).alias("bins"))


def udp_statistics(packets: DataFrame, *, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    size = F.col("udp_length") - 8
    return packets.where("protocol = 17").groupBy(*by).agg(F.count(F.lit(1)).alias("datagrams"), F.count_if(size == 0).alias("empty"), F.min(size).alias("min_payload"), F.max(size).alias("max_payload"), F.sum(size).cast("bigint").alias("payload_bytes"), F.count_if(F.col("udp_surplus") > 0).alias("surplus_datagrams"), F.sum("udp_surplus").cast("bigint").alias("surplus_bytes"))


def ipv4_header_statistics(packets: DataFrame, *, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """Flag, option and congestion counters of IPv4 packets."""
    bit = lambda k: F.col("ip_flags").bitwiseAND(k) != 0
    options = F.octet_length("ip_options")
    return packets.where("ip_version = 4").groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.count_if(bit(4)).alias("reserved_flag"), F.count_if(bit(2)).alias("dont_fragment"), F.count_if(bit(1)).alias("more_fragments"), F.count_if(options > 0).alias("packets_with_options"), F.sum(options).cast("bigint").alias("option_bytes"), F.count_if(F.col("ecn").isin(1, 2)).alias("ecn_capable"), F.count_if(F.col("ecn") == 3).alias("congestion_experienced"))


def icmp_statistics(packets: DataFrame, *, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """(type, code) counts of ICMP and ICMPv6, and the roll-up by type (null code)."""
    rows = packets.where("icmp_type IS NOT NULL")
    pairs = rows.groupBy(*by, "protocol", "icmp_type", "icmp_code").agg(F.count(F.lit(1)).alias("count"))
    types = pairs.groupBy(*by, "protocol", "icmp_type").agg(F.sum("count").alias("count"))
    return pairs.unionByName(types.withColumn("icmp_code", F.lit(None).cast("int")))


def extension_header_statistics(packets: DataFrame, *, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """Chain lengths and repeated kinds of IPv6 packets."""
    kinds = F.transform("extension_headers", lambda h: h["header_type"])
    n = F.size(kinds)
    return packets.where("ip_version = 6").groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.count_if(n > 0).alias("packets_with_headers"), F.min(n).alias("min_chain"), F.max(n).alias("max_chain"), F.sum(n).cast("bigint").alias("headers"), F.sum(n - F.size(F.array_distinct(kinds))).cast("bigint").alias("duplicates"))


def extension_header_histograms(packets: DataFrame, *, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """(``by``, what, value, count): kinds of extension headers, and what comes after the last one."""
    kinds = F.transform("extension_headers", lambda h: F.struct(F.lit("header_type").alias("what"), h["header_type"].alias("value")))
    after = F.when(F.size("extension_headers") > 0, F.element_at("extension_headers", -1)["next_header"]).otherwise(F.col("next_header"))
    both = F.concat(kinds, F.array(F.struct(F.lit("terminal").alias("what"), after.alias("value"))))
    rows = packets.where("ip_version = 6").select(*by, F.explode(both).alias("v"))
    return rows.groupBy(*by, "v.what", "v.value").agg(F.count(F.lit(1)).alias("count"))


def fragment_place(header: Column) -> Column:
    """Where a Fragment Header places its packet: whole (an atomic fragment), first, intermediate or last; null without one."""
    offset, more = header["fragment_offset"], header["more_fragments"]
    return F.when(offset.isNull(), None).when(offset == 0, F.when(more, "first").otherwise("whole")).otherwise(F.when(more, "intermediate").otherwise("last"))


def ipv6_fragment_statistics(packets: DataFrame, *, by: tuple[str, ...] = (*WINDOW_KEY, "is_forward")) -> DataFrame:
    """Counters of Fragment Headers in IPv6 packets."""
    own = F.filter("extension_headers", lambda h: h["header_type"] == 44)
    some = lambda test: F.exists(own, test)
    first = lambda h: (h["fragment_offset"] == 0) & h["more_fragments"]
    atomic = lambda h: (h["fragment_offset"] == 0) & ~h["more_fragments"]
    n = F.size(own)
    return packets.where("ip_version = 6").groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.count_if(n > 0).alias("with_fragment_header"), F.count_if(some(lambda h: ~atomic(h))).alias("fragmented"), F.count_if(n > 1).alias("repeated"), F.count_if(some(first)).alias("first_fragments"), F.count_if(some(atomic)).alias("atomic_fragments"), F.count_if(some(lambda h: h["reserved"] != 0)).alias("nonzero_reserved"), F.count_if(some(lambda h: h["reserved_bits"] != 0)).alias("nonzero_reserved_bits"))


def ipv4_fragmentation(decoded: DataFrame) -> DataFrame:
    """Of a whole capture: IPv4 packets by place in their datagram, with Don't Fragment and reserved flags.

    Later fragments, which no transport can be decoded of, count if their header's checksum holds.
    """
    flag = lambda k: F.col("placed_flags").bitwiseAND(k) != 0
    place = F.when((F.col("placed_offset") > 0) & flag(1), "intermediate").when(F.col("placed_offset") > 0, "final").when(flag(1), "initial").otherwise("unfragmented")
    rows = decoded.where("placed_protocol IS NOT NULL")
    return rows.groupBy(place.alias("fragment_class")).agg(F.count(F.lit(1)).alias("packets"), F.count_if(flag(2)).alias("dont_fragment"), F.count_if(flag(4)).alias("reserved"))
