"""Queries of link layers, ICMP, framing and bookkeeping, over packets encoded from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.operators import aggregates as A
from flowlark.operators import evaluation as J
from flowlark.operators import features as M
from flowlark.operators import flows as W
from flowlark.operators import protocols as P
from flowlark.operators.decoding import admitted, decode_packets, quarantined, valid_observation
from flowlark.plans.bridge import event_packets
from flowlark.plans.flow_queries import _FINDINGS, _SUMS, SEGMENTS, TIMEOUT, _findings, _state
from flowlark.plans.wire_queries import _ETHERNET, _checksum, _hex, _in_windows, _segments_v6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _ipv4(protocol: Column, body: Column, size: Column, src: Column, dst: Column, *, place: Column | None = None, wrong: Column | None = None) -> Column:
    """An IPv4 packet as hex; ``size`` bytes of ``body``, flags and offset ``place``, and a checksum that is ``wrong`` by that much."""
    high, low = (lambda v: F.floor(v / 65536)), (lambda v: v % 65536)
    total, place = 20 + size, F.lit(0).cast("bigint") if place is None else place
    check = _checksum([F.lit(0x4500), total, place, F.lit(64 * 256) + protocol, high(src), low(src), high(dst), low(dst)])
    check = check if wrong is None else (check + wrong) % 65536
    return F.concat(F.lit("4500"), _hex(total, 2), F.lit("0000"), _hex(place, 2), F.lit("40"), _hex(protocol, 1), _hex(check, 2), _hex(src, 4), _hex(dst, 4), body)


def _observed(rows: DataFrame, text: Column, link: Column, *keys: str) -> DataFrame:
    rows = rows.withColumn("raw_bytes", F.unhex(text))
    n = F.octet_length("raw_bytes").cast("bigint")
    return rows.select(*keys, F.lit("capture").alias("session"), F.col("k").alias("packet_index"), (F.col("k") * 1000).alias("ts_us"), link.alias("link_type"), n.alias("captured_length"), n.alias("original_length"), "raw_bytes", F.lit("table").alias("source"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"))


def tagged_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as frames with key % 4 VLAN tags (three are too many), one byte short of the first tag if key % 4 = 1 and key % 3 = 0."""
    t, k = _customers(spark, sf_dir), F.col("k")
    packet = _ipv4(F.lit(50).cast("bigint"), F.lit("ABCD"), F.lit(2).cast("bigint"), 167772160 + k % 65536, F.lit(3232235521).cast("bigint"))
    tag = lambda kind: F.concat(F.lit(kind), _hex(k % 8 * 8192 + F.col("nation"), 2))
    tags = F.concat(F.when(k % 4 >= 1, tag("8100")).otherwise(""), F.when(k % 4 >= 2, tag("88A8")).otherwise(""), F.when(k % 4 >= 3, tag("8100")).otherwise(""))
    whole = F.concat(F.lit(_ETHERNET[:24]), tags, F.lit("0800"), packet)
    return _observed(t, F.when((k % 4 == 1) & (k % 3 == 0), F.substring(whole, 1, 34)).otherwise(whole), F.lit(1), "k", "nation")


_CUT = "k % 4 = 1 AND k % 3 = 0"
_C = "WITH c AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS nation FROM customer) "


@query("d1_decode_ethernet", _C + f"SELECT k, CASE WHEN k % 4 = 3 THEN 'unsupported' WHEN {_CUT} THEN 'incomplete' END AS failure_classification, CASE WHEN k % 4 = 3 THEN 'Ethernet frame exceeds the supported VLAN tag depth' WHEN {_CUT} THEN 'Ethernet VLAN tag is too short: expected at least 18 bytes, got 17' END AS failure_description, CAST(CASE WHEN k % 4 = 3 OR ({_CUT}) THEN NULL ELSE k % 4 END AS INTEGER) AS n_tags, CAST(CASE WHEN k % 4 IN (1, 2) AND NOT ({_CUT}) THEN nation END AS INTEGER) AS vid, CAST(CASE WHEN k % 4 IN (1, 2) AND NOT ({_CUT}) THEN k % 8 END AS INTEGER) AS pcp FROM c")
def decode_ethernet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_packets(tagged_frames(spark, sf_dir))
    first = F.get("vlan_tags", F.lit(0))
    return d.select("k", "failure_classification", "failure_description", F.when(F.col("vlan_tags").isNotNull(), F.size("vlan_tags")).alias("n_tags"), first["vid"].alias("vid"), first["pcp"].alias("pcp"))


@query("c4_flow_admission", _C + f"SELECT CAST(1 AS INTEGER) AS protocol, TRUE AS admitted, CAST(count(*) AS BIGINT) AS packets FROM c UNION ALL SELECT 50, FALSE, CAST(count(*) FILTER (WHERE k % 4 <> 3 AND NOT ({_CUT})) AS BIGINT) FROM c UNION ALL SELECT CASE k % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END, TRUE, CAST(count(*) FILTER (WHERE k % 2 = 0 AND k % 5 >= 2) AS BIGINT) FROM c GROUP BY 1")
def flow_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("protocol", "admitted", "failure_classification", "packet_index", "session")
    parts = [decode_packets(f(spark, sf_dir)).select(*names) for f in (tagged_frames, checked_frames)]
    parts.append(decode_packets(pings(spark, sf_dir)).select(*names))
    rows = parts[0].unionByName(parts[1].withColumn("protocol", F.col("protocol") + 1000)).unionByName(parts[2].withColumn("protocol", F.col("protocol") + 2000))
    kept = admitted(rows).withColumn("admitted", F.lit(True)).unionByName(quarantined(rows))
    return kept.groupBy((F.col("protocol") % 1000).alias("protocol"), F.floor(F.col("protocol") / 1000).alias("part"), "admitted").agg(F.count(F.lit(1)).alias("packets")).drop("part")


def checked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as IPv4 packets without payload: TCP, UDP or ICMP by key % 3, a wrong header checksum for odd keys, a wrong transport checksum if key % 5 < 2."""
    t, k = _customers(spark, sf_dir), F.col("k")
    src, dst = 167772160 + k % 65536, F.lit(3232235521).cast("bigint")
    words = [F.floor(src / 65536), src % 65536, F.floor(dst / 65536), dst % 65536]
    off = F.when(k % 5 < 2, 1).otherwise(0).cast("bigint")
    port = 1024 + k % 50000
    tcp_check = (_checksum([*words, F.lit(6), F.lit(20), port, F.lit(80), k % 65536, F.lit(0x5010), F.lit(512)]) + off) % 65536
    udp_check = _checksum([*words, F.lit(17), F.lit(8), port, F.lit(80), F.lit(8)])
    # a UDP checksum of zero would be none at all
    udp_check = F.when(off == 1, F.when(udp_check == 65535, 1).otherwise(udp_check + 1)).otherwise(F.when(udp_check == 0, 65535).otherwise(udp_check))
    icmp_check = (_checksum([F.lit(0x0800), k % 65536, F.lit(3)]) + off) % 65536
    tcp = F.concat(_hex(port, 2), F.lit("0050" + "0000"), _hex(k % 65536, 2), F.lit("00000000" + "5010" + "0200"), _hex(tcp_check, 2), F.lit("0000"))
    udp = F.concat(_hex(port, 2), F.lit("0050" + "0008"), _hex(udp_check, 2))
    icmp = F.concat(F.lit("0800"), _hex(icmp_check, 2), _hex(k % 65536, 2), F.lit("0003"))
    number = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c).cast("bigint")
    body = F.when(k % 3 == 0, tcp).when(k % 3 == 1, udp).otherwise(icmp)
    return _observed(t, _ipv4(number(6, 17, 1), body, number(20, 8, 8), src, dst, wrong=k % 2), F.lit(101), "k")


_LAYER = "CASE k % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMPv4' END"


@query("c2_integrity_failure", _C + f"SELECT k, CASE WHEN k % 2 = 1 OR k % 5 < 2 THEN 'integrity_failure' END AS failure_classification, CASE WHEN k % 2 = 1 AND k % 5 < 2 THEN 'Checksum validation failed for IPv4, ' || {_LAYER} WHEN k % 2 = 1 THEN 'Checksum validation failed for IPv4' WHEN k % 5 < 2 THEN 'Checksum validation failed for ' || {_LAYER} END AS failure_description, CASE WHEN k % 2 = 0 AND k % 5 >= 2 THEN TRUE END AS transport_checksum_valid FROM c")
def integrity_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_packets(checked_frames(spark, sf_dir)).select("k", "failure_classification", "failure_description", "transport_checksum_valid")


@query("b3_ipv4_fragmentation_statistics", _C + "SELECT CASE WHEN k % 6 IN (0, 1, 5) THEN 'unfragmented' WHEN k % 6 = 2 THEN 'initial' WHEN k % 6 = 3 THEN 'intermediate' ELSE 'final' END AS fragment_class, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE k % 6 = 1) AS BIGINT) AS dont_fragment, CAST(count(*) FILTER (WHERE k % 6 = 5) AS BIGINT) AS reserved FROM c WHERE k % 7 <> 0 GROUP BY 1")
def ipv4_fragmentation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDP packets that are whole, first, middle and last fragments by key % 6; a wrong header checksum, which keeps a packet out, if the key is divisible by 7."""
    t, k = _customers(spark, sf_dir), F.col("k")
    place = F.when(k % 6 == 1, 0x4000).when(k % 6 == 2, 0x2000).when(k % 6 == 3, 0x2001 + k % 100).when(k % 6 == 4, 1 + k % 100).when(k % 6 == 5, 0x8000).otherwise(0).cast("bigint")
    packet = _ipv4(F.lit(17).cast("bigint"), F.lit("04D2270F00080000"), F.lit(8).cast("bigint"), 167772160 + k % 65536, F.lit(3232235521).cast("bigint"), place=place, wrong=F.when(k % 7 == 0, 1).otherwise(0).cast("bigint"))
    return A.ipv4_fragmentation(decode_packets(_observed(t, packet, F.lit(101), "k")))


#: TCP option areas by key % 8: none, MSS, MSS and window scale, SACK permitted and timestamps, a SACK block, an MSS of wrong length, an option beyond the area, padding that is not zero.
_AREAS = ("", "020405B4", "020405B401030307", "0402080A0000000100000002", "0101050A0000000100000002", "02030500", "02090000", "00010000")


def option_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = _customers(spark, sf_dir), F.col("k")
    area = F.element_at(F.array(*[F.lit(a) for a in _AREAS]), (k % 8 + 1).cast("int"))
    size = (F.length(area) / 2).cast("bigint")
    text = F.concat(F.lit("60000000"), _hex(20 + size, 2), F.lit("0640" + "20010DB8" + "0" * 16), _hex(k, 4), F.lit("20010DB9" + "0" * 23 + "1"), F.lit("9C400050"), _hex(k, 4), F.lit("00000000"), _hex((5 + size / 4).cast("bigint") * 4096 + 16, 2), F.lit("0200" + "00000000"), area)
    return _observed(t, text, F.lit(101), "k", "nation")


@query("d4_option_envelope", _C + "SELECT k, CASE WHEN k % 8 > 5 THEN 'structural_failure' END AS failure_classification, CASE k % 8 WHEN 6 THEN 'TCP option length exceeds option area' WHEN 7 THEN 'TCP option padding must be zero' END AS failure_description, CAST(CASE k % 8 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 WHEN 4 THEN 12 WHEN 5 THEN 4 END AS INTEGER) AS option_bytes FROM c")
def option_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_packets(option_frames(spark, sf_dir)).select("k", "failure_classification", "failure_description", F.octet_length("tcp_options").alias("option_bytes"))


@query("b8_tcp_option_statistics", _C + "SELECT nation, CAST(count(*) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE k % 8 = 5) AS BIGINT) AS malformed, CAST(count(*) FILTER (WHERE k % 8 IN (1, 2, 3, 4)) AS BIGINT) AS with_options, CAST(sum(CASE k % 8 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 WHEN 4 THEN 12 ELSE 0 END) AS BIGINT) AS option_bytes, CAST(0 AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE k % 8 = 4) AS BIGINT) AS sack_blocks FROM c WHERE k % 8 < 6 GROUP BY 1")
def tcp_option_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tcp_option_statistics(decode_packets(option_frames(spark, sf_dir)), by=("nation",))


@query("b8_tcp_option_histograms", _C.rstrip() + ", h AS (SELECT nation, 'kind' AS code_kind, unnest(CASE k % 8 WHEN 1 THEN [2] WHEN 2 THEN [2, 1, 3] WHEN 3 THEN [4, 8] WHEN 4 THEN [1, 1, 5] ELSE [] END) AS value FROM c UNION ALL SELECT nation, 'mss', 1460 FROM c WHERE k % 8 IN (1, 2) UNION ALL SELECT nation, 'window_scale', 7 FROM c WHERE k % 8 = 2) SELECT nation, code_kind, CAST(value AS INTEGER) AS value, CAST(count(*) AS BIGINT) AS count FROM h GROUP BY ALL")
def tcp_option_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tcp_option_histograms(decode_packets(option_frames(spark, sf_dir)), by=("nation",))


@query("s6_observation_validate", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS BIGINT) AS valid FROM customer")
def observation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = tagged_frames(spark, sf_dir).withColumn("captured_length", F.col("captured_length") + F.col("k") % 2).withColumn("source", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("source")))
    odd = odd.withColumn("original_length", F.greatest("original_length", "captured_length"))
    return odd.agg(F.count(F.lit(1)).alias("rows"), F.count_if(valid_observation()).alias("valid"))


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as ICMP: echo requests with the key as identifier, of type 3 if the key is divisible by 3; cooked link layer for odd keys, raw IP for even ones."""
    t, k = _customers(spark, sf_dir), F.col("k")
    kind, ident = F.when(k % 3 == 0, 3).otherwise(8).cast("bigint"), k % 65536
    check = _checksum([kind * 256 + k % 5, ident, F.lit(7)])
    body = F.concat(_hex(kind, 1), _hex(k % 5, 1), _hex(check, 2), _hex(ident, 2), F.lit("0007"))
    packet = _ipv4(F.lit(1).cast("bigint"), body, F.lit(8).cast("bigint"), 3232300000 + k % 65536, 167772160 + k % 65536)
    return _observed(t, F.when(k % 2 == 1, F.concat(F.lit("00000001000600112233445500000800"), packet)).otherwise(packet), F.when(k % 2 == 1, 113).otherwise(101), "k")


@query("d13_decode_icmp", _C + "SELECT k, CAST(CASE WHEN k % 3 = 0 THEN 3 ELSE 8 END AS INTEGER) AS icmp_type, CAST(k % 5 AS INTEGER) AS icmp_code, CAST(CASE WHEN k % 3 <> 0 THEN k % 65536 END AS INTEGER) AS icmp_echo_id, TRUE AS transport_checksum_valid, TRUE AS ipv4_checksum_valid, 2048 AS ether_type FROM c")
def decode_icmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_packets(pings(spark, sf_dir)).select("k", "icmp_type", "icmp_code", "icmp_echo_id", "transport_checksum_valid", "ipv4_checksum_valid", "ether_type")


@query("g2_icmp_identity", _C + "SELECT k, printf('%08X', 167772160 + k % 65536) AS a_addr, printf('%08X', 3232300000 + k % 65536) AS b_addr, CAST(NULL AS INTEGER) AS a_port, CAST(CASE WHEN k % 3 <> 0 THEN k % 65536 END AS INTEGER) AS icmp_echo_id, FALSE AS is_forward FROM c")
def icmp_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.with_identity(admitted(decode_packets(pings(spark, sf_dir))))
    return p.select("k", F.hex("a_addr").alias("a_addr"), F.hex("b_addr").alias("b_addr"), "a_port", "icmp_echo_id", "is_forward")


@query("d15_decode_icmpv6", _C + "SELECT k, CAST(CASE WHEN k % 2 = 0 THEN 128 ELSE 1 END AS INTEGER) AS icmp_type, CAST(CASE WHEN k % 2 = 0 THEN k % 65536 END AS INTEGER) AS icmp_echo_id, CAST(58 AS INTEGER) AS protocol FROM c")
def decode_icmpv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = _customers(spark, sf_dir), F.col("k")
    body = F.concat(F.when(k % 2 == 0, F.lit("8000")).otherwise(F.lit("0100")), F.lit("0000"), _hex(k % 65536, 2), F.lit("0001"))
    text = F.concat(F.lit("6000000000083A40" + "20010DB8" + "0" * 16), _hex(k, 4), F.lit("20010DB9" + "0" * 23 + "1"), body)
    return decode_packets(_observed(t, text, F.lit(101), "k")).select("k", "icmp_type", "icmp_echo_id", "protocol")


@query("g3_identity_from_addresses", _C + "SELECT k, printf('%08X', 167772160 + k % 256) AS packed4, '20010DB8' || repeat('0', 20) || printf('%04X', k % 65536) AS packed6 FROM c")
def identity_from_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = _customers(spark, sf_dir), F.col("k")
    rows = t.select("k", F.concat(F.lit("10.0.0."), (k % 256).cast("string")).alias("t4"), F.concat(F.lit("2001:db8::"), F.lower(F.hex(k % 65536))).alias("t6"))
    return W.packed_addresses(rows, p4="t4", p6="t6").select("k", F.hex("p4").alias("packed4"), F.hex("p6").alias("packed6"))


@query("w4_explicit_close", SEGMENTS.split("marked AS")[0] + "m AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w >= " + str(TIMEOUT) + " OR lag(event_id) OVER w % 50 = 0 THEN 1 ELSE 0 END AS fresh, lead(ts_us) OVER w AS next_us FROM keyed WINDOW w AS (PARTITION BY lo, hi, protocol ORDER BY packet_index)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY lo, hi, protocol ORDER BY packet_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM m), g AS (SELECT lo, hi, protocol, segment, min(packet_index) AS first_packet_index, arg_max(event_id % 50 = 0, packet_index) AS asked, bool_or(next_us IS NULL) AS ended FROM s GROUP BY 1, 2, 3, 4) SELECT CAST(first_packet_index AS BIGINT) AS first_packet_index, CASE WHEN asked THEN 'explicit_segmentation' WHEN ended THEN 'capture_session_end' ELSE 'inactivity' END AS closure_reason FROM g")
def explicit_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = event_packets(spark, sf_dir)
    asked = packets.where("event_id % 50 = 0").select("session", "packet_index", *W.IDENTITY)
    return W.sessionize(packets, timeout_us=TIMEOUT, max_active=None, controls=asked)[1].select("first_packet_index", "closure_reason")


def _lookups_with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as DNS over TCP: two requests in one segment, the second cut over two; each with an OPT record of size 1000 + key and one option of key % 4 bytes."""
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    key = F.col("s_suppkey")
    n = key % 4

    def message(ident: Column) -> Column:
        option = F.concat(F.lit("000A"), _hex(n, 2), F.expr("repeat('EE', CAST(s_suppkey % 4 AS INT))"))
        return F.concat(_hex(ident, 2), F.lit("0100" + "0001" + "0000" + "0000" + "0001" + "0161" + "00" + "0001" + "0001"), F.lit("000029"), _hex(1000 + key % 3000, 2), _hex(key % 5, 1), _hex(key % 2, 1), F.lit("8000"), _hex(4 + n, 2), option)

    framed = lambda m: F.concat(_hex(F.length(m) / 2, 2), m)
    stream = F.concat(framed(message(key % 30000)), framed(message(key % 30000 + 30000)))
    cut = 80
    steps = F.array(F.struct(F.lit(0).alias("ord"), F.lit(True).alias("forward"), F.lit(0).cast("bigint").alias("seq"), F.substring(stream, 1, cut).alias("data")), F.struct(F.lit(1).alias("ord"), F.lit(True).alias("forward"), F.lit(cut // 2).cast("bigint").alias("seq"), F.substring(stream, cut + 1, 2147483647).alias("data")))
    return _in_windows(_segments_v6(t.select("s_suppkey", F.explode(steps).alias("s")).select("s_suppkey", "s.*"), "s_suppkey", 53))


_S = "WITH c AS (SELECT s_suppkey AS k, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS sequence_number FROM supplier) "


@query("p3_dns_stream_framing", _S + "SELECT sequence_number, CAST(2 AS BIGINT) AS frames, CAST(2 * (34 + k % 4) AS BIGINT) AS bytes FROM c")
def dns_stream_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.fold_windows(_lookups_with_options(spark, sf_dir)).where("kind = 'dns_message' AND status = 'complete'")
    return e.groupBy("sequence_number").agg(F.count(F.lit(1)).alias("frames"), F.sum("length").alias("bytes"))


@query("b16_dns_edns_statistics", _S + "SELECT sequence_number, CAST(2 AS BIGINT) AS messages, CAST(2 AS BIGINT) AS options, CAST(2 AS BIGINT) AS unknown_options, CAST(2 * (k % 4) AS BIGINT) AS option_bytes, CAST(k % 4 AS INTEGER) AS min_option_length, CAST(k % 4 AS INTEGER) AS max_option_length, CAST(CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS zero_length_options, CAST(1 AS INTEGER) AS min_options, CAST(1 AS INTEGER) AS max_options, CAST(1000 + k % 3000 AS INTEGER) AS min_udp_size, CAST(1000 + k % 3000 AS INTEGER) AS max_udp_size, CAST(2 * (1000 + k % 3000) AS BIGINT) AS total_udp_size, CAST(2 AS BIGINT) AS dnssec_ok FROM c")
def dns_edns_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.fold_windows(_lookups_with_options(spark, sf_dir))
    return P.dns_edns_statistics(P.dns_messages(e)).drop("session")


@query("b16_dns_edns_histograms", _S + "SELECT sequence_number, code_kind, CAST(CASE code_kind WHEN 'option_code' THEN 10 WHEN 'extended_rcode' THEN k % 5 ELSE k % 2 END AS INTEGER) AS value, CAST(2 AS BIGINT) AS count FROM c CROSS JOIN (VALUES ('option_code'), ('extended_rcode'), ('version')) AS v(code_kind)")
def dns_edns_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dns_edns_histograms(P.dns_messages(P.fold_windows(_lookups_with_options(spark, sf_dir)))).drop("session")


@query("m11_research_examples", _SUMS + "SELECT sequence_number, CAST(packet_count AS BIGINT) AS packet_count, CASE WHEN sequence_number % 3 = 0 THEN 'benign' END AS label FROM s")
def research_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.checked_contract(M.project_features(_state(spark, sf_dir), dotted=False))
    labels = f.where("sequence_number % 3 = 0").select("session", "sequence_number", F.lit("benign").alias("label"))
    return M.research_examples(f, labels).select("sequence_number", "packet_count", "label")


@query("m4_flow_duration", _SUMS + "SELECT sequence_number, round(CAST(last_us - first_us AS DOUBLE) / 1000000.0, 6) AS duration_seconds FROM s")
def flow_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.project_features(_state(spark, sf_dir))
    return f.select("sequence_number", F.round(F.col("`flow_duration_features.duration_seconds`"), 6).alias("duration_seconds"))


@query("j6_expectation_validity", _FINDINGS + "SELECT detector_id, sequence_number FROM f WHERE sequence_number % 9 = 0")
def expectation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.finding_identities(_findings(spark, sf_dir), packet=False, index="finding_index").withColumn("positive", F.lit(True))
    wrong = found.where("sequence_number % 9 = 0").withColumn("positive", F.lit(False))
    return J.contradictions(found.unionByName(wrong), J.FLOW_IDENTITY).select("detector_id", "sequence_number")


@query("a7_coordinated_state", _SUMS + "SELECT CAST(count(*) AS BIGINT) AS windows, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(forward_packet_count + reverse_packet_count) AS BIGINT) AS both_directions, CAST(sum(n_gap) AS BIGINT) AS gaps FROM s")
def coordinated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("windows"), F.sum("packet_count").alias("packets"), F.sum(F.col("forward_packet_count") + F.col("reverse_packet_count")).alias("both_directions"), F.sum("gap_count").alias("gaps"))


@query("b2_dscp_statistics", SEGMENTS + "SELECT is_forward, CAST(event_id % 64 AS INTEGER) AS value, CAST(count(*) AS BIGINT) AS count FROM p GROUP BY 1, 2")
def dscp_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(event_packets(spark, sf_dir), F.col("dscp"), by=("is_forward",))


_ETH, _V6ADDR = _ETHERNET[:24], "20010DB8" + "0" * 24 + "20010DB9" + "0" * 24


def _v4(protocol: int, body: str, *, place: int = 0, words: str = "4500", total: int | None = None, options: str = "") -> str:
    """An IPv4 packet whose header checksum is right."""
    n = 20 + len(options) // 2 + len(body) // 2 if total is None else total
    head = f"{words}{n:04X}0000{place:04X}40{protocol:02X}0000" + "0A000001C0A80001" + options
    total_sum = sum(int(head[k : k + 4], 16) for k in range(0, len(head), 4))
    while total_sum > 0xFFFF:
        total_sum = (total_sum & 0xFFFF) + (total_sum >> 16)
    return head[:20] + f"{0xFFFF - total_sum:04X}" + head[24:] + body


def _v6(following: int, body: str, *, length: int | None = None, first: str = "60000000") -> str:
    return f"{first}{len(body) // 2 if length is None else length:04X}{following:02X}40{_V6ADDR}{body}"


def _tcp(offset: str = "5", rest: str = "") -> str:
    return "04D20050" + "0" * 16 + offset + "010" + "0200" + "00000000" + rest


#: (link type, packet, class, message): a packet for each message of a packet that cannot be analysed (fixed texts).
FAILURES = (
    (147, "00", "unsupported", "Packet analysis requires LinkType 1, 101 or 113"),
    (1, _ETH + "0806" + "00" * 28, "unsupported", "Packet analysis requires IPv4 EtherType 0x0800 or IPv6 EtherType 0x86DD"),
    (1, _ETH + "8100000188A80002810000030800", "unsupported", "Ethernet frame exceeds the supported VLAN tag depth"),
    (1, "00" * 13, "incomplete", "Ethernet frame is too short: expected at least 14 bytes, got 13"),
    (1, _ETH + "8100" + "0001", "incomplete", "Ethernet VLAN tag is too short: expected at least 18 bytes, got 16"),
    (1, _ETH + "8100" + "000188A8" + "00", "incomplete", "Ethernet VLAN tag is too short: expected at least 22 bytes, got 19"),
    (101, "", "incomplete", "Raw IP packet is too short: expected at least 1 byte, got 0"),
    (101, "50" + "00" * 30, "unsupported", "Raw IP version must be 4 or 6"),
    (113, "00" * 15, "incomplete", "Linux cooked frame is too short: expected at least 16 bytes, got 15"),
    (101, "45" + "00" * 18, "incomplete", "IPv4 header is too short: expected at least 20 bytes"),
    (1, _ETH + "0800" + "65" + "00" * 19, "structural_failure", "IPv4 version must be 4"),
    (101, "44" + "00" * 19, "structural_failure", "IPv4 IHL must be at least 5"),
    (101, "4F" + "00" * 19, "incomplete", "IPv4 header length exceeds available bytes"),
    (101, _v4(17, "", total=19), "structural_failure", "IPv4 total length is smaller than header length"),
    (101, _v4(17, "", total=21), "incomplete", "IPv4 total length exceeds available bytes"),
    (101, _v4(17, "", words="4600", options="00000001"), "structural_failure", "IPv4 option padding must be zero"),
    (101, _v4(17, "", words="4600", options="01010107"), "structural_failure", "IPv4 option length field exceeds option area"),
    (101, _v4(17, "", words="4600", options="07010000"), "structural_failure", "IPv4 option length must be at least 2 bytes"),
    (101, _v4(17, "", words="4600", options="07050000"), "structural_failure", "IPv4 option length exceeds option area"),
    (101, "60" + "00" * 38, "incomplete", "IPv6 header is too short: expected at least 40 bytes"),
    (1, _ETH + "86DD" + _v6(17, "", first="40000000"), "structural_failure", "IPv6 version must be 6"),
    (101, _v6(17, "00" * 8, length=9), "incomplete", "IPv6 payload length exceeds available bytes"),
    (101, _v6(0, "11"), "incomplete", "IPv6 extension header prefix exceeds available IPv6 payload"),
    (101, _v6(60, "1101" + "00" * 6), "incomplete", "IPv6 extension header length exceeds available IPv6 payload"),
    (101, _v6(44, "1100000000"), "incomplete", "IPv6 extension header length exceeds available IPv6 payload"),
    (101, _v6(58, "800000"), "incomplete", "ICMPv6 header is too short: expected at least 4 bytes"),
    (101, _v4(6, _tcp(), place=5), "unsupported", "TCP decoding requires an initial IPv4 fragment"),
    (101, _v4(6, "00" * 19), "incomplete", "TCP header is too short: expected at least 20 bytes"),
    (101, _v6(6, _tcp("4")), "structural_failure", "TCP data offset must be at least 5"),
    (101, _v4(6, _tcp("6")), "incomplete", "TCP header length exceeds available IPv4 payload"),
    (101, _v6(6, _tcp("6")), "incomplete", "TCP header length exceeds available IPv6 payload"),
    (101, _v6(6, _tcp("6", "00000002")), "structural_failure", "TCP option padding must be zero"),
    (101, _v6(6, _tcp("6", "01010102")), "structural_failure", "TCP option length field exceeds option area"),
    (101, _v6(6, _tcp("6", "02000000")), "structural_failure", "TCP option length must be at least 2 bytes"),
    (101, _v6(6, _tcp("6", "02050000")), "structural_failure", "TCP option length exceeds option area"),
    (101, _v4(17, "00" * 8, place=0x2003), "unsupported", "UDP decoding requires an initial IPv4 fragment"),
    (101, _v4(17, "00" * 7), "incomplete", "UDP header is too short: expected at least 8 bytes"),
    (101, _v4(17, "04D2005000070000"), "structural_failure", "UDP length must be at least 8 bytes"),
    (101, _v4(17, "04D2005000090000"), "incomplete", "UDP length exceeds available IPv4 payload"),
    (101, _v6(17, "04D2005000090000"), "incomplete", "UDP length exceeds available IPv6 payload"),
    (101, _v4(1, "00" * 8, place=1), "unsupported", "ICMP decoding requires an initial IPv4 fragment"),
    (101, _v4(1, "00" * 7), "incomplete", "ICMP header is too short: expected at least 8 bytes"),
    (101, _v6(17, "04D2005000080000"), None, None),
)
_FAILURE_ROWS = ", ".join("({}, {}, {})".format(k, *("NULL" if x is None else f"'{x}'" for x in (kind, text))) for k, (_, _, kind, text) in enumerate(FAILURES))


@query("c3_classify_failure", f"SELECT n_nationkey AS nation, f.* FROM nation CROSS JOIN (VALUES {_FAILURE_ROWS}) AS f(case_id, failure_classification, failure_description)")
def classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("case_id"), F.lit(link).alias("link_type"), F.lit(text).alias("hex")) for k, (link, text, _, _) in enumerate(FAILURES)]))
    t = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("nation"), cases.alias("f")).select("nation", "f.*")
    rows = t.select("nation", "case_id", "link_type", F.unhex("hex").alias("raw_bytes"))
    return decode_packets(rows).select("nation", "case_id", "failure_classification", "failure_description")
