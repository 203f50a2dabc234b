"""Queries over flow windows, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.operators import aggregates as A
from flowlark.operators import detectors as C
from flowlark.operators import evaluation as J
from flowlark.operators import features as M
from flowlark.operators import flows as W
from flowlark.plans.bridge import HOUR_US, SEGMENTS_SQL, event_packets
from flowlark.plans.pipeline import STATE_COLUMNS
from flowlark.runtime import kept, with_rank, written

TIMEOUT = 24 * HOUR_US
SEGMENTS = SEGMENTS_SQL.format(timeout=TIMEOUT)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _windows(spark: SparkSession, sf_dir: str, timeout: int = TIMEOUT, max_active: int | None = None) -> tuple[DataFrame, DataFrame]:
    return W.sessionize(event_packets(spark, sf_dir), timeout_us=timeout, max_active=max_active)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.window_state(*W.sessionize(event_packets(spark, sf_dir).select(*STATE_COLUMNS), timeout_us=TIMEOUT, max_active=None))


def _r(c: Column) -> Column:
    return F.round(c, 6)


_ADDRESSES = "printf('%08X', lo) AS a_addr, printf('%08X', hi) AS b_addr"


def _hexed() -> list[Column]:
    return [F.hex("a_addr").alias("a_addr"), F.hex("b_addr").alias("b_addr")]


@query("g1_flow_identity", SEGMENTS + f"SELECT CAST(packet_index AS BIGINT) AS packet_index, {_ADDRESSES}, CAST(a_port AS INTEGER) AS a_port, CAST(b_port AS INTEGER) AS b_port, CAST(protocol AS INTEGER) AS protocol FROM keyed")
def flow_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(spark, sf_dir).select("packet_index", *_hexed(), "a_port", "b_port", "protocol")


@query("g5_flow_direction", SEGMENTS + "SELECT CAST(packet_index AS BIGINT) AS packet_index, is_forward FROM keyed")
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(spark, sf_dir).select("packet_index", "is_forward")


@query("g6_flow_tracker", SEGMENTS + f"SELECT {_ADDRESSES}, CAST(protocol AS INTEGER) AS protocol, CAST(count(*) AS BIGINT) AS packet_count, CAST(min(packet_index) AS BIGINT) AS first_packet_index, CAST(max(packet_index) AS BIGINT) AS last_packet_index FROM keyed GROUP BY lo, hi, protocol")
def flow_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.flow_tracker(event_packets(spark, sf_dir)).select(*_hexed(), "protocol", "packet_count", "first_packet_index", "last_packet_index")


@query("w1_inactivity_window", SEGMENTS + "SELECT CAST(packet_index AS BIGINT) AS packet_index, sequence_number FROM p")
def inactivity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)[0].select("packet_index", "sequence_number")


@query("w2_sequence_number", SEGMENTS + f"SELECT sequence_number, {_ADDRESSES}, CAST(first_index AS BIGINT) AS first_packet_index FROM numbered")
def sequence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)[1].select("sequence_number", *_hexed(), "first_packet_index")


_EVICTED = """
SELECT * FROM (SELECT sequence_number, closed_at, CASE WHEN closed_at IS NULL THEN 'capture_session_end' ELSE 'inactivity' END AS closure_reason FROM numbered)
"""


@query("w5_session_end", SEGMENTS + _EVICTED)
def session_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)[1].select("sequence_number", "closed_at", "closure_reason")


@query("w6_active_windows", SEGMENTS + "SELECT sequence_number FROM numbered WHERE closed_at IS NULL")
def active_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)[1].where(F.col("closure_reason") == "capture_session_end").select("sequence_number")


@query("w7_monotonic_frontier", SEGMENTS + "SELECT packet_index, late_us AS ts_us, b AS frontier_us FROM (SELECT CAST(packet_index AS BIGINT) AS packet_index, late_us, max(late_us) OVER (ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT packet_index, CASE WHEN event_id % 11 = 0 THEN ts_us - 7200000000 ELSE ts_us END AS late_us FROM obs)) WHERE late_us < b")
def monotonic_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("event_id") % 11 == 0, F.col("ts_us") - 2 * HOUR_US).otherwise(F.col("ts_us"))
    return W.frontier_violations(event_packets(spark, sf_dir).withColumn("ts_us", late)).select("packet_index", "ts_us", "frontier_us")


@query("w8_closure_order", SEGMENTS + "SELECT sequence_number, CAST(row_number() OVER (ORDER BY coalesce(closed_at, 4611686018427387904), sequence_number) - 1 AS BIGINT) AS closure_rank FROM numbered")
def closure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.closure_order(_windows(spark, sf_dir)[1]).select("sequence_number", "closure_rank")


#: An identity is gone when as many others came between its packets as may be active: times do not tie here.
_CAPACITY = SEGMENTS_SQL.format(timeout=240 * HOUR_US).split("marked AS")[0] + """
seen AS (SELECT CAST(packet_index AS BIGINT) AS packet_index, ts_us, lo, hi, protocol, lag(packet_index) OVER w AS before, lag(ts_us) OVER w AS before_us FROM keyed WINDOW w AS (PARTITION BY lo, hi, protocol ORDER BY packet_index)),
firsts AS (SELECT packet_index FROM seen s WHERE before IS NULL OR ts_us - before_us >= 864000000000
  OR (SELECT count(*) FROM (SELECT DISTINCT k.lo, k.hi, k.protocol FROM keyed k WHERE k.packet_index > s.before AND k.packet_index < s.packet_index)) >= 64)
SELECT packet_index AS first_packet_index, CAST(row_number() OVER (ORDER BY packet_index) - 1 AS BIGINT) AS sequence_number FROM firsts
"""


@query("w3_capacity_eviction", _CAPACITY)
def capacity_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir, 240 * HOUR_US, 64)[1]
    return windows.select("first_packet_index", "sequence_number")


_BYTES = "CAST(count(*) AS BIGINT) AS packet_count, CAST(sum(captured_length) AS BIGINT) AS captured_bytes, CAST(sum(original_length) AS BIGINT) AS original_bytes"


@query("a1_flow_statistics", SEGMENTS + f"SELECT sequence_number, {_BYTES}, min(ts_us) AS first_us, max(ts_us) AS last_us FROM p GROUP BY sequence_number")
def flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("sequence_number", "packet_count", "captured_bytes", "original_bytes", "first_us", "last_us")


def _split(expression: str, name: str, default: str = "0") -> str:
    return ", ".join(f"CAST(coalesce({expression.format(x=('' if d == 'forward' else 'NOT ') + 'is_forward')}, {default}) AS BIGINT) AS {d}_{name}" for d in ("forward", "reverse"))


@query("a2_directional_flow_statistics", SEGMENTS + f"SELECT sequence_number, {_split('count(*) FILTER (WHERE {x})', 'packet_count')}, {_split('sum(captured_length) FILTER (WHERE {x})', 'captured_bytes')}, {_split('sum(original_length) FILTER (WHERE {x})', 'original_bytes')} FROM p GROUP BY sequence_number")
def directional_flow_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("sequence_number", *[f"{d}_{n}" for n in ("packet_count", "captured_bytes", "original_bytes") for d in ("forward", "reverse")])


@query("a3_flow_packet_size_statistics", SEGMENTS + f"SELECT sequence_number, CAST(min(captured_length) AS BIGINT) AS min_captured_length, CAST(max(original_length) AS BIGINT) AS max_original_length, CAST(sum(original_length * original_length) AS BIGINT) AS original_square_sum, {_split('min(captured_length) FILTER (WHERE {x})', 'min_captured_length')}, {_split('max(original_length) FILTER (WHERE {x})', 'max_original_length')}, {_split('sum(captured_length * captured_length) FILTER (WHERE {x})', 'captured_square_sum')} FROM p GROUP BY sequence_number")
def packet_size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir)
    long = lambda n: F.col(n).cast("bigint").alias(n)
    return s.select("sequence_number", "min_captured_length", "max_original_length", long("original_square_sum"), *[f"{d}_{n}" for n in ("min_captured_length", "max_original_length") for d in ("forward", "reverse")], *[long(f"{d}_captured_square_sum") for d in ("forward", "reverse")])


@query("a4_flow_inter_arrival_statistics", SEGMENTS + "SELECT sequence_number, CAST(count(gap) AS BIGINT) AS gap_count, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gap_us_sum, CAST(min(gap) AS BIGINT) AS gap_us_min, CAST(max(gap) AS BIGINT) AS gap_us_max, CAST(coalesce(sum(CAST(gap AS HUGEINT) * gap), 0) AS VARCHAR) AS gap_square_sum FROM p GROUP BY sequence_number")
def inter_arrival_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("sequence_number", "gap_count", "gap_us_sum", "gap_us_min", "gap_us_max", F.col("gap_square_sum").cast("string").alias("gap_square_sum"))


@query("a5_directional_inter_arrival_statistics", SEGMENTS + f"SELECT sequence_number, {_split('count(dgap) FILTER (WHERE {x})', 'gap_count')}, {_split('sum(dgap) FILTER (WHERE {x})', 'gap_us_sum')}, {_split('min(dgap) FILTER (WHERE {x})', 'gap_us_min', 'NULL')}, {_split('max(dgap) FILTER (WHERE {x})', 'gap_us_max', 'NULL')} FROM p GROUP BY sequence_number")
def directional_inter_arrival_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("sequence_number", *[f"{d}_{n}" for n in ("gap_count", "gap_us_sum", "gap_us_min", "gap_us_max") for d in ("forward", "reverse")])


_FLAGS = ("ack", "psh", "rst", "syn", "fin")


@query("a6_tcp_control_statistics", SEGMENTS + "SELECT sequence_number, " + ", ".join(_split(f"count(*) FILTER (WHERE {f} AND {{x}})", f"{f}_count") for f in _FLAGS) + ", " + _split("count(*) FILTER (WHERE syn AND ack AND {x})", "syn_ack_count") + " FROM p WHERE protocol = 6 GROUP BY sequence_number")
def tcp_control_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).where("protocol = 6").select("sequence_number", *[f"{d}_{f}_count" for f in (*_FLAGS, "syn_ack") for d in ("forward", "reverse")])


def _histogram(name: str, column: str, expression: str, where: str = "TRUE"):
    @query(name, SEGMENTS + f"SELECT sequence_number, is_forward, CAST({expression} AS INTEGER) AS value, CAST(count(*) AS BIGINT) AS count FROM p WHERE {where} GROUP BY 1, 2, 3")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.histogram(_windows(spark, sf_dir)[0], F.col(column)).drop("session")

    return run


_histogram("b1_ip_hop_limit_histogram", "hop_limit", "32 + event_id % 64")
_histogram("b2_dscp_histogram", "dscp", "event_id % 64")
_histogram("b2_ecn_histogram", "ecn", "event_id % 4")
_histogram("b7_flow_label_histogram", "flow_label", "event_id % 400")


@query("b1_ip_hop_limit_statistics", SEGMENTS + "SELECT sequence_number, is_forward, CAST(count(*) AS BIGINT) AS count, CAST(count(DISTINCT event_id % 64) AS BIGINT) AS \"distinct\", CAST(min(32 + event_id % 64) AS BIGINT) AS min, CAST(max(32 + event_id % 64) AS BIGINT) AS max, CAST(sum(32 + event_id % 64) AS BIGINT) AS total, CAST(0 AS BIGINT) AS zero_count, round(avg(32 + event_id % 64), 6) AS mean FROM p GROUP BY 1, 2")
def hop_limit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summarized(A.histogram(_windows(spark, sf_dir)[0], F.col("hop_limit"))).drop("session").withColumn("mean", _r(F.col("mean")))


@query("b2_ipv4_header_statistics", SEGMENTS + "SELECT sequence_number, is_forward, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE (event_id % 7) >= 4) AS BIGINT) AS reserved_flag, CAST(count(*) FILTER (WHERE (event_id % 7) IN (2, 3, 6)) AS BIGINT) AS dont_fragment, CAST(count(*) FILTER (WHERE (event_id % 7) % 2 = 1) AS BIGINT) AS more_fragments, CAST(count(*) FILTER (WHERE event_id % 4 IN (1, 2)) AS BIGINT) AS ecn_capable, CAST(count(*) FILTER (WHERE event_id % 4 = 3) AS BIGINT) AS congestion_experienced, CAST(count(*) FILTER (WHERE event_id % 11 > 0) AS BIGINT) AS packets_with_options, CAST(sum(4 * (event_id % 11)) AS BIGINT) AS option_bytes FROM p GROUP BY 1, 2")
def header_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.repeat(F.lit("\x01"), 4 * (F.col("event_id") % 11).cast("int")).cast("binary")
    rows = _windows(spark, sf_dir)[0].withColumn("ip_version", F.lit(4)).withColumn("ip_options", options)
    return A.ipv4_header_statistics(rows).drop("session")


_LABELS = "WITH c AS (SELECT event_type, event_id % CASE WHEN event_type = 'view' THEN 100 ELSE 400 END AS v, count(*) AS n FROM events GROUP BY 1, 2) "


@query("b7_flow_label_saturation", _LABELS + "SELECT event_type, CAST(sum(n) AS BIGINT) AS total, count(*) > 256 AS saturated, CAST(CASE WHEN count(*) > 256 THEN 0 ELSE count(*) END AS INTEGER) AS bins FROM c GROUP BY 1")
def flow_label_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saturated_labels(spark, sf_dir).withColumn("bins", F.size("bins"))


def _saturated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hist = A.bounded_histogram(events, F.expr("event_id % CASE WHEN event_type = 'view' THEN 100 ELSE 400 END"), by=("event_type",))
    return A.saturated(hist, by=("event_type",))


@query("b7_flow_label_bins", _LABELS + "SELECT event_type, CAST(v AS BIGINT) AS value, CAST(n AS BIGINT) AS count FROM c WHERE event_type IN (SELECT event_type FROM c GROUP BY 1 HAVING count(*) <= 256)")
def flow_label_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saturated_labels(spark, sf_dir).select("event_type", F.explode("bins").alias("b")).select("event_type", "b.value", "b.count")


@query("b7_window_label_saturation", SEGMENTS + "SELECT sequence_number, is_forward, CAST(sum(n) AS BIGINT) AS total, count(*) > 2 AS saturated, CASE WHEN count(*) > 2 THEN '' ELSE string_agg(v || 'x' || n, ' ' ORDER BY v) END AS bins FROM (SELECT sequence_number, is_forward, event_id % 400 AS v, count(*) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2")
def window_label_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = A.bounded_histogram(_windows(spark, sf_dir)[0], F.col("flow_label"), limit=2)
    text = F.array_join(F.transform("bins", lambda b: F.concat(b["value"].cast("string"), F.lit("x"), b["count"].cast("string"))), " ")
    return A.saturated(hist, limit=2).select("sequence_number", "is_forward", "total", "saturated", text.alias("bins"))


@query("b9_udp_statistics", SEGMENTS + "SELECT sequence_number, is_forward, CAST(count(*) AS BIGINT) AS datagrams, CAST(count(*) FILTER (WHERE event_id % 50 = 0) AS BIGINT) AS empty, CAST(min(event_id % 50) AS INTEGER) AS min_payload, CAST(max(event_id % 50) AS INTEGER) AS max_payload, CAST(sum(event_id % 50) AS BIGINT) AS payload_bytes, CAST(count(*) FILTER (WHERE event_id % 4 > 0) AS BIGINT) AS surplus_datagrams, CAST(sum(event_id % 4) AS BIGINT) AS surplus_bytes FROM p WHERE protocol = 17 GROUP BY 1, 2")
def udp_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.udp_statistics(_windows(spark, sf_dir)[0]).drop("session")


@query("b10_icmp_statistics", SEGMENTS + ", i AS (SELECT sequence_number, is_forward, CAST(protocol AS INTEGER) AS protocol, CAST(event_id % 5 AS INTEGER) AS icmp_type, CAST(event_id % 3 AS INTEGER) AS icmp_code FROM p WHERE protocol = 1) SELECT *, CAST(count(*) AS BIGINT) AS count FROM i GROUP BY ALL UNION ALL SELECT sequence_number, is_forward, protocol, icmp_type, NULL, CAST(count(*) AS BIGINT) FROM i GROUP BY 1, 2, 3, 4")
def icmp_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.icmp_statistics(_windows(spark, sf_dir)[0]).drop("session")


def _sql_ratio(d: str, x: str) -> str:
    return f"CASE WHEN {x} <> 0 THEN CAST({d}_{x} AS DOUBLE) / {x} ELSE 0.0 END"


_SUMS = SEGMENTS + f""", s AS (SELECT sequence_number, any_value(protocol) AS protocol, any_value(closed_at) AS closed_at, {_BYTES}, min(ts_us) AS first_us, max(ts_us) AS last_us,
  CAST(count(gap) AS BIGINT) AS n_gap, sum(gap) AS gap_sum, min(gap) AS gap_min, max(gap) AS gap_max, var_pop(CAST(gap AS DOUBLE) / 1000000.0) AS gap_var,
  min(captured_length) AS min_captured_length, max(captured_length) AS max_captured_length, min(original_length) AS min_original_length, max(original_length) AS max_original_length,
  avg(captured_length) AS mean_captured_length, avg(original_length) AS mean_original_length, var_pop(captured_length) AS var_c, var_pop(original_length) AS var_o,
  {_split('count(*) FILTER (WHERE {x})', 'packet_count')}, {_split('sum(captured_length) FILTER (WHERE {x})', 'captured_bytes')}, {_split('sum(original_length) FILTER (WHERE {x})', 'original_bytes')},
  {', '.join(f"count(dgap) FILTER (WHERE {x}) AS {d}_n, CAST(sum(dgap) FILTER (WHERE {x}) AS DOUBLE) / count(dgap) FILTER (WHERE {x}) / 1000000.0 AS {d}_mean, var_pop(CAST(dgap AS DOUBLE) / 1000000.0) FILTER (WHERE {x}) AS {d}_var, min(dgap) FILTER (WHERE {x}) / 1000000.0 AS {d}_min, max(dgap) FILTER (WHERE {x}) / 1000000.0 AS {d}_max, avg(captured_length) FILTER (WHERE {x}) AS {d}_mean_c, var_pop(captured_length) FILTER (WHERE {x}) AS {d}_var_c" for d, x in (('forward', 'is_forward'), ('reverse', 'NOT is_forward')))},
  {_split('count(*) FILTER (WHERE syn AND {x})', 'syn_count')}
  FROM p GROUP BY sequence_number)
"""


@query("m2_flow_volume_features", _SUMS + "SELECT sequence_number, " + ", ".join(f"round({_sql_ratio(d, x)}, 6) AS {d}_{n}" for n, x in (("packet_ratio", "packet_count"), ("captured_byte_ratio", "captured_bytes"), ("original_byte_ratio", "original_bytes")) for d in ("forward", "reverse")) + ", round(CASE WHEN original_bytes <> 0 THEN CAST(captured_bytes AS DOUBLE) / original_bytes ELSE 0.0 END, 6) AS capture_ratio FROM s")
def volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("sequence_number", *[_r(c).alias(n) for n, c in M.volume_features().items() if n.endswith("ratio")])


@query("m3_packet_size_features", _SUMS + "SELECT sequence_number, round(mean_captured_length, 6) AS mean_captured_length, round(var_c, 4) AS variance_captured_length, round(mean_original_length, 6) AS mean_original_length, round(var_o, 4) AS variance_original_length, round(sqrt(var_o), 4) AS standard_deviation_original_length, " + ", ".join(f"round(coalesce({d}_mean_c, 0.0), 6) AS {d}_mean_captured_length, round(coalesce({d}_var_c, 0.0), 4) AS {d}_variance_captured_length" for d in ("forward", "reverse")) + " FROM s")
def size_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.size_features()
    wanted = ("mean_captured_length", "variance_captured_length", "mean_original_length", "variance_original_length", "standard_deviation_original_length", "forward_mean_captured_length", "reverse_mean_captured_length", "forward_variance_captured_length", "reverse_variance_captured_length")
    return _state(spark, sf_dir).select("sequence_number", *[F.round(f[n], 6 if "mean" in n else 4).alias(n) for n in wanted])


@query("m5_flow_rate_features", _SUMS + "SELECT sequence_number, round(CAST(last_us - first_us AS DOUBLE) / 1000000.0, 6) AS duration_seconds, " + ", ".join(f"CASE WHEN last_us > first_us THEN round({x} / (CAST(last_us - first_us AS DOUBLE) / 1000000.0), 6) END AS {n}" for n, x in (("packets_per_second", "packet_count"), ("captured_bytes_per_second", "captured_bytes"), ("original_bytes_per_second", "original_bytes"))) + " FROM s")
def rate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = (F.col("last_us") - F.col("first_us")).cast("double") / F.lit(1_000_000.0)
    return _state(spark, sf_dir).select("sequence_number", _r(duration).alias("duration_seconds"), *[_r(c).alias(n) for n, c in M.rate_features().items()])


@query("m6_inter_arrival_features", _SUMS + "SELECT sequence_number, round(CASE WHEN n_gap > 0 THEN CAST(gap_sum AS DOUBLE) / n_gap / 1000000.0 ELSE 0.0 END, 8) AS mean_inter_arrival_seconds, round(CASE WHEN n_gap > 0 THEN sqrt(gap_var) ELSE 0.0 END, 2) AS standard_deviation_inter_arrival_seconds, round(coalesce(gap_min / 1000000.0, 0.0), 6) AS min_inter_arrival_seconds, round(coalesce(gap_max / 1000000.0, 0.0), 6) AS max_inter_arrival_seconds FROM s")
def gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.gap_features()
    places = {"mean_inter_arrival_seconds": 8, "standard_deviation_inter_arrival_seconds": 2, "min_inter_arrival_seconds": 6, "max_inter_arrival_seconds": 6}
    return _state(spark, sf_dir).select("sequence_number", *[F.round(f[n], k).alias(n) for n, k in places.items()])


@query("m7_directional_inter_arrival_features", _SUMS + "SELECT sequence_number, " + ", ".join(f"round({d}_mean, 8) AS {d}_mean_inter_arrival_seconds, round(sqrt({d}_var), 2) AS {d}_standard_deviation_inter_arrival_seconds, round({d}_min, 6) AS {d}_min_inter_arrival_seconds, round({d}_max, 6) AS {d}_max_inter_arrival_seconds" for d in ("forward", "reverse")) + " FROM s")
def directional_gap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.gap_features("forward") | M.gap_features("reverse")
    places = {"mean": 8, "standard_deviation": 2, "min": 6, "max": 6}
    return _state(spark, sf_dir).select("sequence_number", *[F.round(f[f"{d}_{k}_inter_arrival_seconds"], n).alias(f"{d}_{k}_inter_arrival_seconds") for k, n in places.items() for d in ("forward", "reverse")])


def _feature_sql() -> dict[str, tuple[str, int]]:
    """Each feature's SQL over ``s`` and the places it is compared to."""
    seconds = "(CAST(last_us - first_us AS DOUBLE) / 1000000.0)"
    out = {n: (n, 0) for n in ("packet_count", "captured_bytes", "original_bytes", "forward_packet_count", "reverse_packet_count", "forward_captured_bytes", "reverse_captured_bytes", "forward_original_bytes", "reverse_original_bytes")}
    out |= {f"{d}_{n}": (_sql_ratio(d, x), 6) for n, x in (("packet_ratio", "packet_count"), ("captured_byte_ratio", "captured_bytes"), ("original_byte_ratio", "original_bytes")) for d in ("forward", "reverse")}
    out["capture_ratio"] = ("CASE WHEN original_bytes <> 0 THEN CAST(captured_bytes AS DOUBLE) / original_bytes ELSE 0.0 END", 6)
    for size, v in (("captured", "var_c"), ("original", "var_o")):
        out |= {f"min_{size}_length": (f"min_{size}_length", 0), f"max_{size}_length": (f"max_{size}_length", 0), f"mean_{size}_length": (f"mean_{size}_length", 6), f"variance_{size}_length": (v, 4), f"standard_deviation_{size}_length": (f"sqrt({v})", 4)}
    out |= {f"{d}_mean_captured_length": (f"coalesce({d}_mean_c, 0.0)", 6) for d in ("forward", "reverse")}
    out |= {f"{d}_variance_captured_length": (f"coalesce({d}_var_c, 0.0)", 4) for d in ("forward", "reverse")}
    out["duration_seconds"] = (seconds, 6)
    out |= {n: (f"CASE WHEN last_us > first_us THEN {x} / {seconds} END", 6) for n, x in (("packets_per_second", "packet_count"), ("captured_bytes_per_second", "captured_bytes"), ("original_bytes_per_second", "original_bytes"))}
    gaps = {"mean": ("CAST(gap_sum AS DOUBLE) / n_gap / 1000000.0", 8), "variance": ("gap_var", -1), "standard_deviation": ("sqrt(gap_var)", 2), "min": ("gap_min / 1000000.0", 6), "max": ("gap_max / 1000000.0", 6)}
    out |= {f"{k}_inter_arrival_seconds": (f"CASE WHEN n_gap > 0 THEN {e} ELSE 0.0 END", n) for k, (e, n) in gaps.items()}
    sides = {"mean": ("{d}_mean", 8), "variance": ("{d}_var", -1), "standard_deviation": ("sqrt({d}_var)", 2), "min": ("{d}_min", 6), "max": ("{d}_max", 6)}
    return out | {f"{d}_{k}_inter_arrival_seconds": (e.format(d=d), n) for d in ("forward", "reverse") for k, (e, n) in sides.items()}


_FEATURE_SQL = _feature_sql()


def _rounded_sql(name: str) -> str:
    expression, places = _FEATURE_SQL[name]
    return f"CAST({expression} AS BIGINT) AS {name}" if places == 0 else f"round({expression}, {places}) AS {name}"


@query("m9_feature_projection", _SUMS + "SELECT 'capture' AS session, sequence_number, " + ", ".join(map(_rounded_sql, _FEATURE_SQL)) + " FROM s")
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.project_features(_state(spark, sf_dir), dotted=False).drop("provenance")
    return f.select("session", "sequence_number", *[F.col(n) if p == 0 else F.round(n, p).alias(n) for n, (_, p) in _FEATURE_SQL.items()])


VOLUME = C.VolumeDetector("volume", "v1", "packet_count", 2)
RATE = C.VolumeDetector("rate", "r1", "packets_per_second", 0.0001)
CONTROL = C.ControlDetector("control", "c1", "forward_syn_count", 0)


@query("c6_flow_volume_threshold", _SUMS + "SELECT sequence_number, CASE WHEN packet_count > 2 THEN 'match' ELSE 'no_match' END AS decision, CASE WHEN last_us = first_us THEN 'not_evaluable' WHEN packet_count / (CAST(last_us - first_us AS DOUBLE) / 1000000.0) > 0.0001 THEN 'match' ELSE 'no_match' END AS rate_decision FROM s WHERE protocol IN (6, 17)")
def volume_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir)
    number = F.col("raw_evidence.sequence_number").alias("sequence_number")
    return C.volume_findings(state, VOLUME).select(number, "decision").join(C.volume_findings(state, RATE).select(number, F.col("decision").alias("rate_decision")), "sequence_number")


@query("c7_tcp_control_threshold", _SUMS + "SELECT sequence_number, forward_syn_count AS observed, CASE WHEN forward_syn_count > 0 THEN 'match' ELSE 'no_match' END AS decision FROM s WHERE protocol = 6")
def control_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = C.control_findings(_state(spark, sf_dir), CONTROL)
    return f.select(F.col("raw_evidence.sequence_number").alias("sequence_number"), F.col("raw_evidence.observed_value").cast("bigint").alias("observed"), "decision")


_FINDINGS = _SUMS + """, f AS (
  SELECT sequence_number, closed_at, 0 AS detector_rank, 'volume' AS detector_id, CASE WHEN packet_count > 2 THEN 'match' ELSE 'no_match' END AS decision FROM s WHERE protocol IN (6, 17)
  UNION ALL SELECT sequence_number, closed_at, 1, 'control', CASE WHEN forward_syn_count > 0 THEN 'match' ELSE 'no_match' END FROM s WHERE protocol = 6),
ordered AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(closed_at, 4611686018427387904), sequence_number, detector_rank) - 1 AS BIGINT) AS finding_index FROM f)
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.flow_findings(_state(spark, sf_dir), VOLUME, CONTROL)
    return with_rank(found, "finding_index", *C.finding_order())


@query("c9_closed_flow_detectors", _FINDINGS + "SELECT finding_index, sequence_number, detector_id, decision FROM ordered")
def closed_flow_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("finding_index", F.col("raw_evidence.sequence_number").alias("sequence_number"), "detector_id", "decision")


@query("e6_detection_stream", _FINDINGS + "SELECT sequence_number, closed_at, detector_id, decision FROM ordered")
def detection_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as three micro-batches: findings of windows that were open across them are those of one run."""
    from flowlark.plans.pipeline import DetectionSettings
    from flowlark.streaming.detection import DetectionStream

    packets = written(event_packets(spark, sf_dir).select(*STATE_COLUMNS), "streamed")
    ends = [r[0] or 0 for r in packets.agg(F.max("packet_index")).collect()]
    cuts = [0, (ends[0] + 1) // 3, 2 * (ends[0] + 1) // 3, ends[0] + 1]
    found = []

    def keep(findings: DataFrame, number: int) -> None:
        e = F.col("raw_evidence")
        found.append(kept(findings.select(e["sequence_number"].alias("sequence_number"), e["closed_at"].alias("closed_at"), "detector_id", "decision"), "stream-findings"))

    settings = DetectionSettings(C.Detector("packet", "p1"), VOLUME, CONTROL, TIMEOUT, max_active=None)
    stream = DetectionStream(spark, settings, lambda d, n: None, keep)
    for a, b in zip(cuts, cuts[1:]):
        stream.packets(packets.where(F.col("packet_index").between(a, b - 1)))
    stream.finish()
    stream.folder.remove("")
    out = spark.createDataFrame([], "sequence_number bigint, closed_at bigint, detector_id string, decision string")
    for part in found:
        out = out.unionByName(part)
    return out


#: Ground truth: windows with a number not divisible by 7 are expected, positive if divisible by 5; and windows that do not exist.
_TRUTH = _FINDINGS + """, truth AS (
  SELECT detector_id, sequence_number, sequence_number % 5 = 0 AS positive FROM f WHERE sequence_number % 7 <> 0
  UNION ALL SELECT detector_id, -1 - sequence_number, sequence_number % 2 = 0 FROM f WHERE sequence_number % 11 = 0),
entries AS (
  SELECT f.finding_index, coalesce(f.detector_id, t.detector_id) AS detector_id, coalesce(f.sequence_number, t.sequence_number) AS sequence_number, f.decision, t.positive,
         CASE WHEN f.decision = 'match' THEN CASE WHEN coalesce(t.positive, FALSE) THEN 'true_positive' ELSE 'false_positive' END
              WHEN coalesce(t.positive, FALSE) THEN 'false_negative' WHEN t.positive IS NOT NULL AND f.decision = 'no_match' THEN 'true_negative' END AS classification
  FROM ordered f FULL OUTER JOIN truth t ON f.detector_id = t.detector_id AND f.sequence_number = t.sequence_number)
"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.finding_identities(_findings(spark, sf_dir), packet=False, index="finding_index")
    number = F.col("sequence_number")
    kept = found.where(number % 7 != 0).withColumn("positive", number % 5 == 0)
    absent = found.where(number % 11 == 0).withColumn("positive", number % 2 == 0).withColumn("sequence_number", -1 - number)
    truth = kept.unionByName(absent).withColumn("expectation_index", F.col("actual_index")).select("expectation_index", "positive", *J.FLOW_IDENTITY)
    return J.evaluate_channel(found, truth, J.FLOW_IDENTITY)


@query("j4_evaluate_channel", _TRUTH + "SELECT finding_index AS actual_index, detector_id, sequence_number, decision, positive, classification FROM entries")
def evaluate_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("actual_index", "detector_id", "sequence_number", "decision", "positive", "classification")


_COUNTED = _TRUTH + ", c AS (SELECT CAST(count(*) FILTER (WHERE classification = 'true_positive') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE classification = 'false_positive') AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE classification = 'false_negative') AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE classification = 'true_negative') AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE classification IS NULL) AS BIGINT) AS un FROM entries)"


@query("e2_detection_metrics", _COUNTED + " SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives, un AS unclassified, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = J.detection_metrics(_entries(spark, sf_dir))
    return m.withColumns({n: _r(F.col(n)) for n in ("precision", "recall", "f1", "accuracy")})


#: Cases are groups of users; a case's windows are numbered on their own. Of a case's ground truth, one expectation in nine is of a window that does not exist.
_CASES = _SUMS + """, c AS (SELECT s.*, u.case_id, row_number() OVER (PARTITION BY u.case_id ORDER BY s.sequence_number) - 1 AS number FROM s JOIN (SELECT DISTINCT sequence_number, user_id % 40 AS case_id FROM p) u ON s.sequence_number = u.sequence_number),
f AS (SELECT case_id, number, 'volume' AS detector_id, packet_count > 2 AS match FROM c WHERE protocol IN (6, 17) UNION ALL SELECT case_id, number, 'control', forward_syn_count > 0 FROM c WHERE protocol = 6),
t AS (SELECT case_id, detector_id, number, number % 5 = 0 AS positive FROM f WHERE number % 7 <> 0 UNION ALL SELECT case_id, detector_id, -1 - number, number % 2 = 0 FROM f WHERE number % 9 = 0),
e AS (SELECT coalesce(f.case_id, t.case_id) AS case_id, match, coalesce(positive, FALSE) AS wanted, positive FROM f FULL OUTER JOIN t ON f.case_id = t.case_id AND f.detector_id = t.detector_id AND f.number = t.number),
n AS (SELECT case_id, count(*) FILTER (match AND wanted) AS tp, count(*) FILTER (match AND NOT wanted) AS fp, count(*) FILTER (coalesce(NOT match, TRUE) AND wanted) AS fn, count(*) FILTER (NOT match AND positive IS NOT NULL AND NOT wanted) AS tn, count(*) AS n FROM e GROUP BY 1)
SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives, CAST(tn AS BIGINT) AS true_negatives, CAST(n - tp - fp - fn - tn AS BIGINT) AS unclassified,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM n
"""


@query("e10_benchmark_cases", _CASES)
def benchmark_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.hex("a_addr").isin("000186A0", "000186A1"), F.conv(F.hex("b_addr"), 16, 10).cast("bigint")).otherwise(F.conv(F.hex("a_addr"), 16, 10).cast("bigint"))
    packets = event_packets(spark, sf_dir).select(*STATE_COLUMNS).withColumn("session", (F.when(user > 200000, user - 200000).otherwise(user) % 40).cast("string"))
    state = A.window_state(*W.sessionize(packets, timeout_us=TIMEOUT, max_active=None))
    found = written(J.finding_identities(C.flow_findings(state, VOLUME, CONTROL).withColumn("finding_index", F.monotonically_increasing_id()), packet=False, index="finding_index"), "case-findings")
    number = F.col("sequence_number")
    truth = found.where(number % 7 != 0).withColumn("positive", number % 5 == 0).unionByName(found.where(number % 9 == 0).withColumn("positive", number % 2 == 0).withColumn("sequence_number", -1 - number))
    entries = J.evaluate_channel(found, truth.select(F.col("actual_index").alias("expectation_index"), "positive", *J.FLOW_IDENTITY), J.by_case(J.FLOW_IDENTITY))
    m = J.detection_metrics(entries, "session")
    return m.select(F.col("session").alias("case_id"), *J.COUNTS, _r(F.col("precision")).alias("precision"), _r(F.col("recall")).alias("recall"))
