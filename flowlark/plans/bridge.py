"""Packets out of business tables, so that flow operators can be run, and checked by SQL, on any of them.

``event_packets`` reads the ``events`` table as packets between a user's host
and a server; ``order_frames`` encodes ``lineitem`` rows as real frames. The
texts in SQL say the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.operators.flows import with_identity
from flowlark.runtime import with_rank

HOUR_US = 3_600_000_000


def _address(host: Column) -> Column:
    return F.unhex(F.lpad(F.hex(host), 8, "0"))


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as decoded packets of one session, with identity."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    rows = with_rank(events, "packet_index", "ts_us", "event_id")
    user, event = F.col("user_id"), F.col("event_id")
    client, server = F.when(user % 2 == 1, 200000 + user).otherwise(user), 100000 + event % 2
    reply = event % 3 == 0
    protocol = F.when(user % 3 == 0, 6).when(user % 3 == 1, 17).otherwise(1)
    original = 60 + event % 1400
    kind = F.col("event_type")
    flag = lambda test: F.when(protocol == 6, test)
    port = (40000 + user % 1000).cast("int")
    packets = rows.select(
        F.lit("capture").alias("session"), "packet_index", "ts_us", "event_id",
        _address(F.when(reply, server).otherwise(client)).alias("src_addr"), _address(F.when(reply, client).otherwise(server)).alias("dst_addr"),
        F.when(reply, F.lit(443)).otherwise(port).alias("src_port"), F.when(reply, port).otherwise(F.lit(443)).alias("dst_port"),
        protocol.alias("protocol"), F.lit(None).cast("int").alias("icmp_echo_id"), original.alias("original_length"), F.least(original, F.lit(96)).alias("captured_length"),
        flag(F.lit(False)).alias("ns"), flag(F.lit(False)).alias("cwr"), flag(F.lit(False)).alias("ece"), flag(F.lit(False)).alias("urg"),
        flag(kind.isin("view", "click", "purchase") | ((kind == "signup") & reply)).alias("ack"), flag(kind == "purchase").alias("psh"),
        flag(kind == "error").alias("rst"), flag(kind == "signup").alias("syn"), flag(kind == "view").alias("fin"),
        (32 + event % 64).cast("int").alias("hop_limit"), (event % 64).cast("int").alias("dscp"), (event % 4).cast("int").alias("ecn"), (event % 7).cast("int").alias("ip_flags"),
        (event % 400).cast("int").alias("flow_label"), F.when(protocol == 1, event % 5).cast("int").alias("icmp_type"), F.when(protocol == 1, event % 3).cast("int").alias("icmp_code"),
        F.when(protocol == 17, 8 + event % 50).cast("int").alias("udp_length"), F.when(protocol == 17, event % 4).cast("int").alias("udp_surplus"),
    )
    return with_identity(packets)


#: DuckDB: packets of ``event_packets`` (obs), with canonical endpoints (keyed), windows by a gap of {timeout} (seg).
SEGMENTS_SQL = """
WITH obs AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS packet_index, epoch_us(ts) AS ts_us, event_id, user_id, event_type,
         CASE WHEN user_id % 2 = 1 THEN 200000 + user_id ELSE user_id END AS client, 100000 + event_id % 2 AS server,
         event_id % 3 = 0 AS reply, CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol,
         40000 + user_id % 1000 AS port, 60 + event_id % 1400 AS original_length, least(60 + event_id % 1400, 96) AS captured_length
  FROM events),
keyed AS (
  SELECT *, least(client, server) AS lo, greatest(client, server) AS hi,
         CASE WHEN protocol = 1 THEN NULL WHEN client < server THEN port ELSE 443 END AS a_port,
         CASE WHEN protocol = 1 THEN NULL WHEN client < server THEN 443 ELSE port END AS b_port,
         (CASE WHEN reply THEN server ELSE client END) = least(client, server) AS is_forward,
         protocol = 6 AND (event_type IN ('view', 'click', 'purchase') OR (event_type = 'signup' AND reply)) AS ack,
         protocol = 6 AND event_type = 'purchase' AS psh, protocol = 6 AND event_type = 'error' AS rst,
         protocol = 6 AND event_type = 'signup' AS syn, protocol = 6 AND event_type = 'view' AS fin
  FROM obs),
marked AS (
  SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w >= {timeout} THEN 1 ELSE 0 END AS fresh
  FROM keyed WINDOW w AS (PARTITION BY lo, hi, protocol ORDER BY packet_index)),
cut AS (
  SELECT *, sum(fresh) OVER (PARTITION BY lo, hi, protocol ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM marked),
seg AS (
  SELECT *, min(packet_index) OVER (PARTITION BY lo, hi, protocol, segment) AS first_index,
         ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol, segment ORDER BY packet_index) AS gap,
         ts_us - lag(ts_us) OVER (PARTITION BY lo, hi, protocol, segment, is_forward ORDER BY packet_index) AS dgap
  FROM cut),
firsts AS (SELECT DISTINCT first_index, lo, hi, protocol, segment FROM seg),
numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY first_index) - 1 AS BIGINT) AS sequence_number,
         CAST(lead(first_index) OVER (PARTITION BY lo, hi, protocol ORDER BY segment) AS BIGINT) AS closed_at FROM firsts),
p AS (SELECT seg.*, n.sequence_number, n.closed_at FROM seg JOIN numbered n ON seg.first_index = n.first_index)
"""
