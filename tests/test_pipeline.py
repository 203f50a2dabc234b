import json
import random

import pytest
from frames import ACK, FIN, SYN, capture, datagram, ethernet, ipv4, ipv6, rows_of, segment, tcp_exchange, udp
from pyspark.sql import functions as F

from flowlark.operators import detectors as C
from flowlark.operators import features, flows
from flowlark.operators.decoding import admitted, decode_packets
from flowlark.plans import pipeline
from flowlark.schemas import OBSERVATION


def settings(volume=("packet_count", 0), control=("forward_syn_count", 0), **more):
    return pipeline.DetectionSettings(C.Detector("packet", "p1"), C.VolumeDetector("volume", "v1", *volume), C.ControlDetector("control", "c1", *control), more.pop("timeout_us", 5_000_000), **more)


def observe(spark, records, **more):
    return spark.createDataFrame(rows_of(records, **more), OBSERVATION)


@pytest.mark.parametrize(("version", "size"), [(4, 420), (6, 521)])
def test_tcp_exchange(spark, version, size):
    found = pipeline.detect(observe(spark, tcp_exchange(version)), settings(volume=("packet_count", 7), control=("reverse_syn_ack_count", 0)))
    state = found.state.collect()
    assert len(state) == 1
    s = state[0]
    assert (s.packet_count, s.forward_packet_count, s.reverse_packet_count, s.captured_bytes) == (7, 4, 3, size)
    assert (s.forward_syn_count, s.reverse_syn_ack_count, s.reverse_fin_count, s.closure_reason) == (1, 1, 1, "capture_session_end")
    got = [(r.detector_id, r.decision) for r in found.flow_findings.orderBy("finding_index").collect()]
    assert got == [("volume", "no_match"), ("control", "match")]


@pytest.mark.parametrize(("version", "sizes"), [(4, (120, 60)), (6, (134, 70))])
def test_udp_exchange(spark, version, sizes):
    records = [(1000000, datagram(True, b"query", version=version)), (1500000, datagram(False, b"response", version=version)), (2000000, datagram(True, b"query", version=version))]
    s = pipeline.flow_state(decode_packets(observe(spark, records)), settings()).first()
    assert (s.forward_packet_count, s.reverse_packet_count) == (2, 1)
    assert (s.forward_captured_bytes, s.reverse_captured_bytes) == sizes
    f = features.project_features(pipeline.flow_state(decode_packets(observe(spark, records)), settings()), dotted=False).first()
    assert f.forward_mean_inter_arrival_seconds == 1.0
    assert f.reverse_mean_inter_arrival_seconds is None


def test_periodic_features(spark):
    records = [(1_000_000 + 50_000 * k, datagram(k % 2 == 0, b"x")) for k in range(1002)]
    projected = features.project_features(pipeline.flow_state(decode_packets(observe(spark, records)), settings()))
    assert len(projected.columns) == 3 + 49
    f = projected.first()
    assert f["flow_duration_features.duration_seconds"] == 50.05
    assert f["inter_arrival_features.mean_inter_arrival_seconds"] == 0.05
    assert f["directional_inter_arrival_features.forward_mean_inter_arrival_seconds"] == 0.1
    assert f["directional_inter_arrival_features.forward_variance_inter_arrival_seconds"] == 0.0
    assert f["flow_volume_features.forward_packet_count"] == f["flow_volume_features.reverse_packet_count"] == 501


def test_syn_retransmission_splits_at_the_timeout(spark):
    records = [(t * 1_000_000, segment(True, SYN, seq=100)) for t in (1, 6, 7, 12, 13, 14)]
    found = pipeline.detect(observe(spark, records), settings(volume=("packet_count", 2), control=("forward_syn_count", 2)))
    rows = found.flow_findings.orderBy("finding_index").collect()
    assert [r.decision for r in rows] == ["no_match"] * 4 + ["match"] * 2
    assert [r.raw_evidence.closure_reason for r in rows] == ["inactivity"] * 4 + ["capture_session_end"] * 2
    assert [r.raw_evidence.packet_count for r in rows[::2]] == [1, 2, 3]


def test_malformed_between_valid(spark):
    good = datagram(True, b"abc", version=6)
    short_header = ethernet(ipv6(0, b"\x11"))[:55]
    low_offset = ethernet(ipv6(6, bytes(12) + b"\x10" + bytes(7)))
    short_tcp = ETH6(ipv6(6, bytes(10)))
    records = [(k, d) for k, d in enumerate((good, short_header, low_offset, short_tcp, good), 1)]
    found = pipeline.detect(observe(spark, records), settings())
    assert [r.decision for r in found.packet_findings.orderBy("finding_index").collect()] == ["no_match", "not_evaluable", "match", "not_evaluable", "no_match"]
    assert found.state.first().packet_count == 2


def ETH6(packet):
    from frames import ETHERNET

    return ETHERNET + b"\x86\xdd" + packet


def test_inadmissible_packet_is_quarantined_or_raises(spark):
    records = [(1, ethernet(ipv4(50, b"secret"))), (2, datagram(True, b"x"))]
    decoded = decode_packets(observe(spark, records))
    assert admitted(decoded).count() == 1
    with pytest.raises(Exception, match="belongs to no flow"):
        admitted(decoded, strict=True).collect()


def test_capacity_evicts_the_least_recent(spark):
    records = [(k, datagram(True, b"x", port=1000 + k)) for k in range(1, 6)]
    packets = flows.with_identity(admitted(decode_packets(observe(spark, records))))
    _, windows = flows.sessionize(packets, timeout_us=10**9, max_active=4)
    got = {r.sequence_number: (r.closure_reason, r.closed_at) for r in windows.collect()}
    assert got[0] == ("capacity", 4)
    assert [got[k][0] for k in range(1, 5)] == ["capture_session_end"] * 4


def test_ties_in_time_evict_by_number(spark):
    ports = [1, 2, 1, 3, 2]
    records = [(5, datagram(True, b"x", port=p)) for p in ports]
    packets = flows.with_identity(admitted(decode_packets(observe(spark, records))))
    _, windows = flows.sessionize(packets, timeout_us=10**9, max_active=2)
    rows = sorted((r.sequence_number, r.first_packet_index, r.closure_reason) for r in windows.collect())
    assert rows == [(0, 0, "capacity"), (1, 1, "capture_session_end"), (2, 3, "capture_session_end")]


def test_evictions_in_slices_equal_a_single_scan(spark):
    pick, records = random.Random(5), []
    for name, step in (("rising", 1), ("ties", 0), ("closed", 1)):
        at = 0
        for k in range(400):
            at += pick.choice((step, 2, 2, 40))
            records.append((name, k, at, f"10.0.0.{pick.choice((pick.randrange(4), pick.randrange(30)))}"))
    packets = spark.createDataFrame(records, "session string, packet_index bigint, ts_us bigint, a string")
    names = dict(flows.column_types(flows.IDENTITY))
    fixed = {c: F.lit(None).cast(t) for c, t in names.items()} | {"a_addr": F.col("a").cast("binary")}
    packets = packets.select("session", "packet_index", "ts_us", *[fixed[c].alias(c) for c in flows.IDENTITY])
    controls = packets.where("session = 'closed' AND packet_index % 50 = 9").select("session", "packet_index", *flows.IDENTITY)
    found = [sorted(map(repr, flows.evictions(packets, timeout_us=60, max_active=5, controls=controls, slice_packets=n).collect())) for n in (1 << 20, 60, 150)]
    assert len(found[0]) > 300
    assert found[1:] == found[:1] * 2
    # and as one state machine that sees all packets
    closed = {(r.session, r.packet_index) for r in controls.collect()}
    plain = []
    for name in ("rising", "ties", "closed"):
        active, last = flows.ActiveWindows(5, 60), {}
        for _, k, at, a in (r for r in records if r[0] == name):
            victim = active.packet(a, at)
            if victim is not None:
                plain.append((name, last.pop(victim), k, victim))
            last[a] = k
            if (name, k) in closed:
                active.close(a)
    got = flows.evictions(packets, timeout_us=60, max_active=5, controls=controls, slice_packets=90).collect()
    assert sorted((r.session, r.packet_index, r.closed_at, bytes(r.a_addr).decode()) for r in got) == sorted(plain)


def test_explicit_close(spark):
    records = [(k, datagram(True, b"x")) for k in range(4)]
    packets = flows.with_identity(admitted(decode_packets(observe(spark, records))))
    controls = packets.where("packet_index = 1").select("session", "packet_index", *flows.IDENTITY)
    _, windows = flows.sessionize(packets, timeout_us=10**9, controls=controls)
    assert sorted((r.sequence_number, r.closure_reason) for r in windows.collect()) == [(0, "explicit_segmentation"), (1, "capture_session_end")]


def test_frontier(spark):
    records = [(10, datagram(True, b"x")), (9, datagram(True, b"x", port=7)), (10, datagram(True, b"y"))]
    packets = flows.with_identity(admitted(decode_packets(observe(spark, records))))
    assert [r.packet_index for r in flows.frontier_violations(packets).collect()] == [1]


def test_end_to_end_metrics(spark):
    records = tcp_exchange() + [(1900000, datagram(True, b"q"))]
    s = settings(volume=("packet_count", 3))
    found = pipeline.detect(observe(spark, records), s)
    from flowlark.operators import evaluation as J

    flow = J.finding_identities(found.flow_findings, packet=False, index="finding_index")
    truth = flow.selectExpr("actual_index AS expectation_index", "CASE WHEN decision = 'match' THEN 'positive' ELSE 'negative' END AS polarity", *J.FLOW_IDENTITY)
    packet = J.finding_identities(found.packet_findings, packet=True, index="finding_index")
    ptruth = packet.where("packet_index < 2").selectExpr("actual_index AS expectation_index", "'positive' AS polarity", *J.PACKET_IDENTITY)
    m = {r.channel: r for r in pipeline.validate_end_to_end(observe(spark, records), s, ptruth, truth).collect()}
    assert (m["flow"].true_positives, m["flow"].true_negatives, m["flow"].precision, m["flow"].f1) == (2, 1, 1.0, 1.0)
    assert (m["packet"].false_negatives, m["packet"].unclassified, m["packet"].recall, m["packet"].precision) == (2, 6, 0.0, None)
    with pytest.raises(ValueError, match="twice"):
        pipeline.validate_end_to_end(observe(spark, records), s, ptruth.unionByName(ptruth), truth)


def finding_key(r):
    e = r.raw_evidence
    return (r.detector_id, r.decision, e.session, e.sequence_number, e.first_us, e.last_us, e.closure_reason, e.closed_at, e.packet_count)


@pytest.mark.parametrize("seed", [2])
def test_stream_gives_the_findings_of_the_batch(spark, tmp_path, seed):
    import random

    from flowlark.operators import evaluation as J
    from flowlark.streaming.detection import DetectionStream, evaluate_stream

    rng = random.Random(seed)
    ts, records = 1_000_000, []
    for _ in range(40):
        ts += rng.choice((0, 200_000, 900_000, 2_600_000))
        records.append((ts, segment(True, SYN, seq=100) if rng.random() < 0.4 else datagram(rng.random() < 0.5, b"x", port=5000 + rng.randrange(4))))
    rows = rows_of(records)
    s = settings(volume=("packet_count", 2), control=("forward_syn_count", 2), timeout_us=2_500_000, max_active=3 if seed == 2 else None)
    whole = pipeline.detect(spark.createDataFrame(rows, OBSERVATION), s)
    want, packets, flow, calls = sorted(map(finding_key, whole.flow_findings.collect())), [], [], [0]
    cuts = sorted(rng.sample(range(1, 40), 2))
    parts = [spark.createDataFrame(rows[a:b], OBSERVATION) for a, b in zip([0, *cuts], [*cuts, 40])]

    def flows_to(d, number):
        calls[0] += 1
        if calls[0] == 2:
            raise RuntimeError("the consumer fails once")
        flow.extend(d.collect())

    # a new object for each batch, and a consumer that fails: nothing is lost, repeated or misnumbered
    open_ = lambda: DetectionStream(spark, s, lambda d, n: packets.extend(d.collect()), flows_to, str(tmp_path / "state"))
    for k, part in enumerate(parts):
        try:
            open_().batch(part, k)
        except RuntimeError:
            open_().batch(part, k)
        open_().batch(part, k)
    open_().finish()
    open_().finish()
    assert sorted(map(finding_key, flow)) == want
    assert sorted(r.finding_index for r in packets) == list(range(40))
    with pytest.raises(RuntimeError, match="ended"):
        open_().batch(parts[0], 9)

    packet = J.finding_identities(whole.packet_findings, packet=True, index="finding_index").selectExpr("actual_index AS expectation_index", "packet_index % 2 = 0 AS positive", *J.PACKET_IDENTITY)
    flow_truth = J.finding_identities(whole.flow_findings, packet=False, index="finding_index").selectExpr("actual_index AS expectation_index", "decision = 'match' AS positive", *J.FLOW_IDENTITY)
    got = sorted(map(str, evaluate_stream(spark, parts, s, packet, flow_truth, folder=str(tmp_path / "run")).collect()))
    assert got == sorted(map(str, pipeline.metrics_of(*pipeline.evaluate(whole, packet, flow_truth)).collect()))
    with pytest.raises(ValueError, match="contradict"):
        pipeline.evaluate(whole, packet.unionByName(packet.selectExpr("expectation_index", "NOT positive AS positive", *J.PACKET_IDENTITY)), flow_truth)


def test_falling_times_and_odd_observations_raise(spark, tmp_path):
    from flowlark.errors import FlowError
    from flowlark.plans.harness import diagnose
    from flowlark.streaming.detection import DetectionStream

    rows = rows_of([(10, datagram(True, b"x")), (9, datagram(True, b"x", port=7))])
    with pytest.raises(FlowError, match="packet 1 is earlier"):
        pipeline.detect(spark.createDataFrame(rows, OBSERVATION), settings())
    stream = DetectionStream(spark, settings(), lambda d, n: None, lambda d, n: None, str(tmp_path / "s"))
    stream.batch(spark.createDataFrame(rows[:1], OBSERVATION))
    with pytest.raises(FlowError, match="packet 1 is earlier"):
        stream.batch(spark.createDataFrame(rows[1:], OBSERVATION))
    odd = [(*rows[0][:4], rows[0][4] + 1, *rows[0][5:])]
    with pytest.raises(Exception, match="not well formed") as caught:
        pipeline.detect(spark.createDataFrame(odd, OBSERVATION), settings())
    assert diagnose(caught.value, operation_id="o", message="m").category == "detection_failure"
    found = pipeline.detect(spark.createDataFrame(rows[:1], OBSERVATION), settings()).packet_findings
    with pytest.raises(Exception, match="interpretation"):
        C.checked_findings(found.selectExpr("* EXCEPT (decision)", "'match' AS decision")).collect()


def test_structured_streaming(spark, tmp_path):
    from flowlark.streaming.detection import evaluate_stream

    for k, part in enumerate((tcp_exchange()[:4], tcp_exchange()[4:])):
        rows = [(r[0], r[1] + 4 * k, *r[2:]) for r in rows_of(part)]
        spark.createDataFrame(rows, OBSERVATION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from flowlark.operators import evaluation as J

    whole = pipeline.detect(observe(spark, tcp_exchange()), settings())
    truth = J.finding_identities(whole.flow_findings, packet=False, index="finding_index").selectExpr("actual_index AS expectation_index", "true AS positive", *J.FLOW_IDENTITY)
    none = J.finding_identities(whole.packet_findings.limit(0), packet=True, index="finding_index").selectExpr("actual_index AS expectation_index", "true AS positive", *J.PACKET_IDENTITY)
    source = spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m = {r.channel: r for r in evaluate_stream(spark, source, settings(), none, truth, folder=str(tmp_path / "run")).collect()}
    assert (m["flow"].true_positives, m["flow"].false_positives, m["packet"].unclassified) == (2, 0, 7)


def test_command_line(spark, tmp_path, capsys):
    from flowlark import cli

    path = tmp_path / "c.pcap"
    path.write_bytes(capture(tcp_exchange()))
    args = [str(path), "--capture-session-id", "s1", "--inactivity-timeout-microseconds", "5000000", "--volume-metric", "packet_count", "--volume-threshold", "0", "--tcp-metric", "forward_syn_count", "--tcp-threshold", "0"]
    for kind in ("packet", "volume", "tcp"):
        args += [f"--{kind}-detector-id", kind, f"--{kind}-detector-version", "1"]
    assert cli.main(args) == 0
    out = json.loads(capsys.readouterr().out)
    assert len(out["packet_findings"]) == 7
    assert out["packet_findings"][0]["raw_evidence"]["captured_at"] == "1970-01-01T00:00:01.000000+00:00"
    assert out["packet_findings"][0]["raw_evidence"]["failure_classification"] is None
    assert [f["decision"] for f in out["flow_findings"]] == ["match", "match"]
    assert out["flow_findings"][0]["raw_evidence"]["identity"]["source_address"] == "c0000201"
    path.write_bytes(b"nonsense")
    assert cli.main(args) == 1
    for wrong in (args[:-2], [*args, "--tcp-threshold", "1"], [*args, "--tcp-threshold=1"]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == 2


def test_udp_checksum_rules(spark):
    records = [(1, ethernet(ipv4(17, udp(b"a")))), (2, ethernet(ipv4(17, udp(b"a", check=5)))), (3, ethernet(ipv4(6, b"\0" * 20, fragment=10)))]
    got = decode_packets(observe(spark, records)).orderBy("packet_index").select("failure_classification", "failure_description", "transport_checksum_valid").collect()
    assert [tuple(r) for r in got] == [(None, None, False), ("integrity_failure", "Checksum validation failed for UDP", None), ("unsupported", "TCP decoding requires an initial IPv4 fragment", None)]
    assert ACK == 16
    assert FIN == 1


def plain_windows(packets, timeout, closes):
    """(sequence, index, gap, direction gap) of packets (index, ts, flow, forward), one after the other."""
    open_, out, created = {}, [], 0
    for index, ts, flow, forward in packets:
        w = open_.get(flow)
        if w is None or ts - w["ts"] >= timeout:
            w = open_[flow] = {"n": created, "ts": None, True: None, False: None}
            created += 1
        gap = None if w["ts"] is None else ts - w["ts"]
        own = None if w[forward] is None else ts - w[forward]
        out.append((index, w["n"], gap, own))
        w["ts"] = w[forward] = ts
        if index in closes:
            del open_[flow]
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_slices_do_not_show(spark, size):
    import random

    rng = random.Random(size)
    rows, ts = [], 0
    for k in range(150):
        ts += rng.randrange(4)
        rows.append((k, ts, rng.choice((0, 0, 0, 1, 2)), rng.random() < 0.5))
    closes = {k for k in range(150) if rng.random() < 0.05}
    data = [("s", k, t, bytes([f]) * 4, b"\xff" * 4, 1, 2, 17, None, fwd, 1, 1) for k, t, f, fwd in rows]
    packets = spark.createDataFrame(data, "session string, packet_index bigint, ts_us bigint, a_addr binary, b_addr binary, a_port int, b_port int, protocol int, icmp_echo_id int, is_forward boolean, captured_length bigint, original_length bigint")
    controls = packets.where(packets.packet_index.isin(*closes)).select("session", "packet_index", *flows.IDENTITY)
    for asked in (None, controls):
        placed, windows = flows.sessionize(packets, timeout_us=6, max_active=None, controls=asked, slice_packets=size)
        got = sorted((r.packet_index, r.sequence_number, r.gap_us, r.direction_gap_us) for r in placed.collect())
        assert got == plain_windows(rows, 6, closes if asked is not None else set())
        assert windows.count() == len({g[1] for g in got})
