import io
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from frames import ACK, FIN, PSH, SYN, capture, ethernet, ipv4, ipv6, tcp, tcp_exchange, udp

from flowlark.errors import CaptureError, DetectionError, FlowError, PacketAnalysisError
from flowlark.functions import folds, messages, wire
from flowlark.operators.flows import ActiveWindows
from flowlark.plans import harness
from flowlark.sources.pcap import capture_records


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nano", [False, True])
def test_capture_encodings(order, nano):
    data = capture(tcp_exchange(), order=order, nano=nano)
    got = list(capture_records(io.BytesIO(data), len(data)))
    assert [(r[0], r[4]) for r in got] == tcp_exchange()


@pytest.mark.parametrize(("data", "message"), [
    (b"", "truncated PCAP global header"), (b"x" * 24, "unsupported PCAP magic"), (capture([], version=(2, 3)), "version must be 2.4"),
    (capture([], snaplen=0), "snaplen must be positive"), (capture([], network=70000), "additional link-type"), (capture([(1, b"abc")])[:-1], "truncated PCAP packet payload"),
    (capture([(1, b"abc")], snaplen=2), "exceeds snaplen"), (capture([]) + b"\0" * 5, "truncated PCAP record header"),
])
def test_capture_errors(data, message):
    with pytest.raises(CaptureError, match=message):
        list(capture_records(io.BytesIO(data), len(data)))


def decode(*packets, link=1):
    return wire.decode(pa.array([link] * len(packets), pa.int32()), pa.array(list(packets), pa.binary())).to_pylist()


def test_every_truncation_decodes_or_fails_with_a_class():
    for whole in (ethernet(ipv4(6, tcp(SYN, options=b"\x02\x04\x05\xb4"))), ethernet(ipv4(17, udp(b"abc"))), ethernet(ipv6(0, bytes([44, 0, 1, 4, 0, 0, 0, 0, 6, 0, 0, 0, 0, 0, 0, 1]) + tcp(ACK)))):
        for row in decode(*[whole[:k] for k in range(len(whole))]):
            assert (row["failure_classification"] is None) == (row["failure_description"] is None)
            assert row["failure_classification"] in (None, "incomplete", "unsupported", "structural_failure", "integrity_failure")


def test_random_bytes_never_crash():
    rng = random.Random(5)
    decode(*[rng.randbytes(rng.randrange(90)) for _ in range(3000)])
    decode(*[b"\x45" + rng.randbytes(rng.randrange(90)) for _ in range(3000)], link=101)
    decode(*[b"\x60" + rng.randbytes(rng.randrange(120)) for _ in range(3000)], link=101)
    assert decode() == []


def test_options_and_chain():
    bad = {b"\x00\x01\x00\x00": "TCP option padding must be zero", b"\x02\x00\x00\x00": "TCP option length must be at least 2 bytes", b"\x01\x01\x01\x05": "TCP option length field exceeds option area", b"\x02\x09\x00\x00": "TCP option length exceeds option area"}
    for options, message in bad.items():
        assert decode(ethernet(ipv4(6, tcp(SYN, options=options))))[0]["failure_description"] == message
    chain = decode(ipv6(0, bytes([44, 0, 1, 4, 0, 0, 0, 0, 17, 0, 0, 1, 0, 0, 0, 42]) + udp(b"x")), link=101)[0]
    assert [h["header_type"] for h in chain["extension_headers"]] == [0, 44]
    assert chain["extension_headers"][1]["identification"] == 42
    assert chain["is_fragment"] is True
    later = decode(ipv6(44, bytes([17, 0, 0, 8, 0, 0, 0, 42]) + b"rest"), link=101)[0]
    assert later["failure_classification"] is None
    assert later["admitted"] is False


def segments(*rows):
    """Segments of (seq, payload, flags) rows; flags among S, F, R and G (fragment)."""
    seq, data, flags = zip(*rows)
    bit = lambda f: np.array([f in x for x in flags])
    first = (np.array(seq, dtype=np.int64) + bit("S")) % (1 << 32)
    return folds.Segments(np.arange(len(rows)), first, np.array([len(x) for x in data]), bit("S"), bit("F"), bit("R"), bit("G"), list(data))


def test_stream_relations():
    s = folds.Stream()
    put = lambda seq, data, flags="": (s.take(segments((seq, data, flags)))[1][0], s.status)
    assert put(100, b"", "S") == ("empty", "open")
    assert put(101, b"abc") == ("first", "open")
    assert put(104, b"def") == ("contiguous", "open")
    assert put(102, b"bc") == ("duplicate", "open")
    assert put(107, b"", "F") == ("empty", "fin")
    assert put(108, b"x") == ("unavailable", "after_close")
    s = folds.Stream()
    put(0xFFFFFFFE, b"abcd")
    assert put(2, b"e") == ("contiguous", "open")
    assert put(1, b"XY") == ("overlap", "conflict")
    s = folds.Stream()
    put(0, b"a")
    assert put(1 + (1 << 31), b"b") == ("ambiguous", "ambiguous")
    s = folds.Stream()
    put(0, b"a" * 65536)
    assert put(65536, b"b") == ("contiguous", "limit_exceeded")


def plain_stream(rows, limit):
    """Rule by rule, packet by packet: (status, relation) after each, and the bytes."""
    status, data, due, opened, out = "open", b"", None, None, []
    for seq, payload, flags in rows:
        relation = "empty"
        if status != "open":
            relation = "unavailable" if payload or (status in ("fin", "reset") and "S" in flags) else "empty"
            status = "after_close" if status in ("fin", "reset") and (payload or "S" in flags) else status
        elif "G" in flags:
            status, relation = "fragmented", "unavailable"
        elif "S" in flags and due is not None and opened != seq:
            status, relation = "restart", "unavailable"
        else:
            start = (seq + ("S" in flags)) % 2**32
            if "S" in flags and opened is None:
                opened, due = seq, start
            if payload:
                d = 0 if due is None else (start - due) % 2**32
                if d == 2**31:
                    status = relation = "ambiguous"
                elif 0 < d < 2**31:
                    status = relation = "gap"
                elif d == 0:
                    relation = "contiguous" if data else "first"
                    if len(data) + len(payload) > limit:
                        status = "limit_exceeded"
                    else:
                        data, due = data + payload, (start + len(payload)) % 2**32
                else:
                    at = len(data) + d - 2**32
                    pairs = [(data[at + k], x) for k, x in enumerate(payload) if 0 <= at + k < len(data)]
                    if any(a != b for a, b in pairs):
                        status, relation = "conflict", "overlap"
                    elif len(pairs) == len(payload):
                        relation = "duplicate"
                    else:
                        status = relation = "overlap"
            if status == "open" and "R" in flags:
                status = "reset"
            elif status == "open" and "F" in flags:
                d = 0 if due is None else (start + len(payload) - due) % 2**32
                status = {0: "fin", 2**31: "ambiguous"}.get(d, "gap" if d < 2**31 else "overlap")
        out.append((status, relation))
    return out, data


def test_streams_equal_the_rules_in_any_chunks(monkeypatch):
    monkeypatch.setattr(folds, "STREAM_BYTES", 60)
    rng = random.Random(31)
    groups, packed, finals = [], [], []
    for g in range(600):
        base, rows = rng.choice((0, 5, 2**32 - 10, rng.randrange(2**32))), []
        text, at = rng.randbytes(80), 0
        for _ in range(rng.randrange(1, 12)):
            size = rng.choice((0, 0, 1, 5, 9))
            begin = at if rng.random() < 0.85 else max(0, at + rng.choice((-6, -3, -1, 2)))
            data = text[begin : begin + size] if rng.random() < 0.95 else rng.randbytes(size)
            flags = "".join(f for f, p in (("S", 0.05), ("F", 0.06), ("R", 0.04), ("G", 0.02)) if rng.random() < p)
            rows.append(((base + begin + (2**31 if rng.random() < 0.01 else 0)) % 2**32, data, flags))
            at = max(at, begin + len(data)) + ("S" in flags)
        want, data = plain_stream(rows, 60)
        stream, got, k = folds.Stream(), [], 0
        while k < len(rows):
            step = rng.randrange(1, 5)
            statuses, relations, _ = stream.take(segments(*rows[k : k + step]))
            got += list(zip(statuses, relations))
            k += step
        assert got == want
        assert bytes(stream.held) == data
        packed += rows
        groups += [g] * len(rows)
        finals.append((want[-1][0], len(data)))
    s = segments(*packed)
    names, regular, status, total = folds.regular_streams(np.array(groups), s.first, s.size, s.syn, s.fin, s.rst, s.fragment)
    assert 0.2 < regular.mean() < 0.9
    assert all((status[k], total[k]) == finals[g] for k, g in enumerate(names.tolist()) if regular[k])


def name(*labels):
    return b"".join(bytes([len(x)]) + x for x in labels) + b"\0"


def dns(ident, flags, *, questions=(), answers=(), extra=b""):
    return struct.pack("!6H", ident, flags, len(questions), len(answers), 0, 0) + b"".join(questions) + b"".join(answers) + extra


QUESTION = name(b"Example", b"org") + struct.pack("!HH", 1, 1)


def test_dns_parsing():
    answer = b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60, 4) + b"\x7f\0\0\1"
    m = messages.parse_dns(dns(7, 0x8180, questions=[QUESTION], answers=[answer]))
    assert (m.status, m.questions[0]["labels"], m.records[0]["pointer_hops"], m.records[0]["labels"]) == ("complete", [b"Example", b"org"], 1, [b"Example", b"org"])
    whole = dns(7, 0x8180, questions=[QUESTION], answers=[answer])
    rng = random.Random(53)
    for k in range(len(whole)):
        assert messages.parse_dns(whole[:k]).status == "incomplete"
    for _ in range(1024):
        data = rng.randbytes(rng.randrange(80))
        m = messages.parse_dns(data)
        assert m.parsed_length + m.remaining_bytes == len(data)
    assert messages.parse_dns(whole + b"x").reason == "bytes after declared DNS sections"
    loop = dns(1, 0, questions=[b"\xc0\x0c" + struct.pack("!HH", 1, 1)])
    assert messages.parse_dns(loop).reason == "compression pointer loop"
    assert messages.parse_dns(dns(1, 0, questions=[b"\x40" + bytes(8)])).status == "unsupported"


def test_dns_correlation():
    c = folds.DnsLedger()
    see = lambda raw, forward, ts: [o["status"] for o in c.scan(iter([(messages.parse_dns(raw), raw, forward, ts)]))]
    assert see(dns(1, 0x0100, questions=[QUESTION]), True, 0) == ["pending"]
    assert see(dns(2, 0x8000, questions=[QUESTION]), False, 1) == ["unmatched"]
    assert see(dns(1, 0x8000, questions=[QUESTION.lower()]), False, 5) == ["matched"]
    assert see(dns(3, 0, questions=[QUESTION]), True, 6) == ["pending"]
    assert see(dns(3, 0, questions=[QUESTION]), True, 7) == ["ambiguous"]
    assert see(dns(3, 0x8000, questions=[QUESTION]), False, 8) == ["ambiguous"]
    assert [o["status"] for o in c.end()] == ["unresolved"]
    for k in range(128):
        see(dns(k, 0, questions=[QUESTION]), True, k)
    assert see(dns(500, 0, questions=[QUESTION]), True, 200) == ["unresolved"] * 129
    assert see(dns(501, 0, questions=[QUESTION]), True, 201) == ["unresolved"]


def ldap(ident, tag, body=b""):
    inner = bytes([2, 1, ident, tag, len(body)]) + body
    return bytes([0x30, len(inner)]) + inner


def chunk(*packets):
    """Columns of (forward, seq, payload, flags) packets at times 0, 1, ..."""
    rows = [(*p, "") if len(p) == 3 else p for p in packets]
    flag = lambda f: np.array([f in r[3] for r in rows])
    return {"is_forward": np.array([r[0] for r in rows]), "ts_us": np.arange(len(rows)), "payload": [r[2] for r in rows], "tcp_seq": np.array([r[1] for r in rows]), "syn": flag("S"), "fin": flag("F"), "rst": flag("R"), "is_fragment": flag("G")}


def conversation(rng, port):
    """Packets of both directions of a window that speaks to ``port``, with some mishaps."""
    def said(k):
        if port == 389:
            return b"".join(ldap(rng.randrange(1, 4), rng.choice((0x60, 0x61, 0x63, 0x64, 0x65, 0x42))) for _ in range(k)) + (b"\x31\0" if rng.random() < 0.1 else b"")
        if port == 53:
            return b"".join(struct.pack("!H", len(m)) + m for m in (dns(rng.randrange(3), rng.choice((0, 0x8000)), questions=[QUESTION]) for _ in range(k)))
        return b"".join(b"\x16\x03\x03" + struct.pack("!H", len(b)) + b for b in (b"\x01\0\0\x05abcde", b"\x02\0\0\0") for _ in range(k)) + (b"\x17\x03\x03\xff\xffx" if rng.random() < 0.2 else b"")

    sides = {}
    for side in (True, False):
        data, at, sides[side] = said(rng.randrange(5)), 0, []
        while at < len(data):
            size = rng.randrange(1, 30)
            sides[side].append((side, 1000 + at + (rng.random() < 0.02), data[at : at + size], "F" if rng.random() < 0.02 else ""))
            at += size
    out = []
    while sides[True] or sides[False]:
        side = rng.random() < 0.5
        out.append(sides[side].pop(0) if sides[side] else sides[not side].pop(0))
        if rng.random() < 0.2:
            out.append((rng.random() < 0.5, 0, b""))
    return out


@pytest.mark.parametrize("port", [53, 389, 443, 80])
def test_events_do_not_depend_on_the_chunks(port):
    rng = random.Random(port)
    for _ in range(150):
        packets = conversation(rng, port)
        alone, cut = folds.WindowFold(6, 40000, port, segments=True), folds.WindowFold(6, 40000, port, segments=True)
        one = [(k, kind, e) for k, p in enumerate(packets) for _, kind, e in alone.take(chunk(p))]
        many, k = [], 0
        while k < len(packets):
            step = rng.randrange(1, 9)
            many += [(k + at, kind, e) for at, kind, e in cut.take(chunk(*packets[k : k + step]))]
            k += step
        times = ("ts_us", "latency_us")
        plain = lambda events: sorted((k, kind, str({n: v for n, v in e.items() if n not in times})) for k, kind, e in events)
        assert plain(one) == plain(many)
        assert plain(alone.close()) == plain(cut.close())


def test_lost_streams_end_ldap_matching():
    bind, answer = ldap(1, 0x60), ldap(1, 0x61)
    gap = (False, 500, b"x")
    for packets, status in (
        ([(True, 0, bind), (False, 0, answer)], ["pending", "matched"]),
        ([(True, 0, bind), (False, 0, ldap(9, 0x61)), gap, (True, 7, ldap(2, 0x60))], ["pending", "unmatched", "unresolved"]),
        ([(False, 0, b"zz"), gap, (True, 0, bind), (True, 7, ldap(2, 0x60))], ["pending", "unresolved"]),
        ([(True, 0, bind + b"\x31\0"), (False, 0, answer)], ["pending", "unmatched"]),
    ):
        for step in (1, 9):
            f, got = folds.WindowFold(6, 40000, 389), []
            for k in range(0, len(packets), step):
                got += [e["status"] for _, kind, e in f.take(chunk(*packets[k : k + step])) if kind == "ldap"]
            assert got == status


def test_ldap_parsing_and_correlation():
    whole = ldap(1, 0x60) + ldap(2, 0x63)
    got = messages.parse_ldap(whole)
    assert [m["operation"] for m in got["messages"]] == ["bind_request", "search_request"]
    for k in range(1, 7):
        assert messages.parse_ldap(whole[:k])["messages"][0]["status"] == "incomplete"
    assert messages.parse_ldap(b"\x31\0")["messages"][0]["status"] == "malformed"
    f = folds.WindowFold(6, 40000, 389)
    seq = {True: 0, False: 0}
    events = []

    def send(forward, data):
        events.extend((k, e["status"]) for _, k, e in f.take(chunk((forward, seq[forward], data))) if k == "ldap")
        seq[forward] += len(data)

    send(True, ldap(1, 0x60)[:3])
    send(True, ldap(1, 0x60)[3:])
    send(False, ldap(1, 0x61))
    send(True, ldap(2, 0x63))
    send(False, ldap(2, 0x64) + ldap(2, 0x64))
    send(False, ldap(2, 0x65))
    send(False, ldap(9, 0x61))
    send(True, ldap(3, 0x42))
    assert [s for _, s in events] == ["pending", "matched", "pending", "matched", "matched", "matched", "unmatched", "non_correlatable"]
    summaries = [(e["operation"], e["status"], e["response_count"]) for _, k, e in f.close() if k == "ldap_summary"]
    assert summaries == [("bind_request", "completed", 1), ("search_request", "completed", 3)]


def hello():
    extensions = struct.pack("!HHHH", 10, 4, 2, 29) + struct.pack("!HHHB", 16, 5, 3, 2) + b"h2" + struct.pack("!HH", 99, 0)
    body = b"\x03\x03" + bytes(32) + b"\0" + struct.pack("!HHH", 4, 0x1301, 0x1302) + b"\x01\0" + struct.pack("!H", len(extensions)) + extensions
    return body


def test_tls_segmentation():
    body = hello()
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    stream = b"".join(b"\x16\x03\x01" + struct.pack("!H", len(p)) + p for p in (shake[:20], shake[20:])) + b"\x17\x03\x03\x00\x01z"
    rng = random.Random(22)
    for _ in range(12):
        cuts = sorted(rng.sample(range(1, len(stream)), 5))
        f, out, seq = folds.WindowFold(6, 40000, 443), [], 0
        for a, b in zip([0, *cuts], [*cuts, len(stream)]):
            out += f.take(chunk((True, seq, stream[a:b])))
            seq += b - a
        assert sorted((k, e["code"]) for _, k, e in out) == [("tls_handshake", 1), ("tls_record", 22), ("tls_record", 22), ("tls_record", 23)]
    got = messages.parse_hello(1, body)
    assert got["status"] == "complete"
    assert got["hello"]["cipher_suites"] == [0x1301, 0x1302]
    assert [e["type"] for e in got["hello"]["extensions"]] == [10, 16, 99]
    assert got["hello"]["extensions"][1]["protocols"] == [b"h2"]
    complete = [k for k in range(len(body)) if messages.parse_hello(1, body[:k])["status"] == "complete"]
    assert complete == [len(body) - 23]  # where the block of extensions, which may be absent, begins
    assert messages.parse_hello(2, b"\x03\x03" + bytes(32) + b"\x21" + bytes(40))["reason"] == "session ID exceeds ServerHello bound"


def test_tcp_options():
    assert messages.parse_tcp_options(b"\x02\x04\x05\xb4\x01\x03\x03\x07") == {"kinds": [2, 1, 3], "mss": [1460], "window_scale": [7], "sack_blocks": 0}
    assert messages.parse_tcp_options(b"\x02\x03\x05\x00") is None
    assert messages.parse_tcp_options(b"\x05\x0a" + bytes(8))["sack_blocks"] == 1


def test_active_windows_match_a_plain_model():
    rng = random.Random(1)
    for _ in range(300):
        limit, timeout = rng.randint(1, 5), rng.randint(2, 9)
        fast, open_, created, ts = ActiveWindows(limit, timeout), {}, 0, 0
        for _ in range(60):
            ts += rng.randint(0, 2)
            key = (rng.randrange(8),)
            victim = None
            if key in open_ and ts - open_[key][0] < timeout:
                open_[key] = (ts, open_[key][1])
            else:
                if key not in open_ and len(open_) >= limit:
                    victim = min(open_, key=lambda k: open_[k])
                    del open_[victim]
                open_[key] = (ts, created)
                created += 1
            assert fast.packet(key, ts) == victim


def test_harness():
    ticks = iter([0.0, 1.0, 1.0, 4.0])
    t = harness.measure(lambda: None, runs=2, warmups=1, clock=lambda: next(ticks))
    assert t == {"seconds": (1.0, 3.0), "minimum": 1.0, "maximum": 3.0, "total": 4.0, "mean": 2.0, "median": 2.0}
    with pytest.raises(ValueError, match="must not fall"):
        harness.measure(lambda: None, runs=1, clock=iter([2.0, 1.0]).__next__)
    cases = harness.Dataset("d", "1", (harness.DatasetCase("a"), harness.DatasetCase("b")))
    assert [r.case.name for r in harness.run_dataset(cases, lambda c: harness.CaseResult(c, 1))] == ["a", "b"]
    with pytest.raises(ValueError, match="belong"):
        harness.run_dataset(cases, lambda c: harness.CaseResult(cases.cases[0]))
    assert harness.diagnose(CaptureError("x"), operation_id="o", message="m").category == "capture_failure"
    for error, category in ((FlowError("x"), "flow_processing_failure"), (DetectionError("x"), "detection_failure"), (PacketAnalysisError("x"), "packet_analysis_failure"), (ValueError("x"), "unclassified_failure")):
        assert harness.diagnose(error, operation_id="o", message="m").category == category
    assert harness.diagnose(KeyError("x"), operation_id="o", message="m").category == "unclassified_failure"
    assert PSH == 8
    assert FIN == 1


def test_decoded_columns_of_slices_and_lists_keep_their_packets():
    tagged = ethernet(ipv4(17, udp(b"abc")))
    tagged = tagged[:12] + b"\x81\x00\x20\x05" + tagged[12:]
    chained = ethernet(ipv6(0, bytes([44, 0, 1, 4, 0, 0, 0, 0, 17, 0, 0, 1, 0, 0, 0, 9]) + udp(b"defg")))
    rows = decode(None, tagged, b"", chained, tagged[:40], ethernet(ipv4(6, tcp(SYN, options=b"\x02\x04\x05\xb4"))), ethernet(ipv4(17, udp(b""))))
    assert [r["payload"] for r in rows] == [None, b"abc", None, b"defg", None, b"", b""]  # a first fragment has its ports
    assert [r["vlan_tags"] for r in rows] == [None, [{"tpid": 0x8100, "pcp": 1, "dei": 0, "vid": 5}], None, [], None, [], []]
    assert rows[5]["tcp_options"] == b"\x02\x04\x05\xb4"
    assert [(h["header_type"], h["next_header"], h["fragment_offset"], h["more_fragments"], h["identification"]) for h in rows[3]["extension_headers"]] == [(0, 44, None, None, None), (44, 17, 0, True, 9)]


def test_packets_are_decoded_some_bytes_at_a_time():
    from flowlark.operators import decoding

    sizes = [10, decoding.DECODED_BYTES + 1, 5, None, decoding.DECODED_BYTES - 4, 7, 0]
    batch = pa.record_batch([pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], names=["raw"])
    parts = list(decoding._pieces(batch, 0))
    assert [p.num_rows for p in parts] == [1, 1, 2, 1, 2]
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert list(decoding._pieces(batch.slice(0, 0), 0)) == []
