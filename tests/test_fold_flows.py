"""Windows that are folded where they are found, and flows that are cut only if they are long."""

import random
from collections import defaultdict

import pytest

from flowlark.operators import flows
from flowlark.operators import protocols as P
from flowlark.plans import wire_queries
from flowlark.schemas import IDENTITY, WINDOW_KEY

SCHEMA = "session string, packet_index bigint, ts_us bigint, a_addr binary, b_addr binary, a_port int, b_port int, protocol int, icmp_echo_id int, is_forward boolean, src_port int, dst_port int, tcp_seq bigint, syn boolean, fin boolean, rst boolean, is_fragment boolean, payload binary"


def streams(seed: int, n: int = 600) -> list[tuple]:
    """Packets of some flows, one of them with half of all; streams are regular, broken, closed and begun again, some read by a protocol."""
    pick = random.Random(seed)
    known = [("s", b"\x0a\0\0\1", b"\x0a\0\0\2", 1000 + k, port, 6) for k, port in enumerate((9000, 9000, 9001, 53, 389, 443, 9002, 9002))] + [("t", b"\x0a\0\0\1", b"\x0a\0\0\2", 1000, 9000, 6), (None, b"\x0a\0\0\1", b"\x0a\0\0\2", 1000, 9000, 6), ("s", b"\x0a\0\0\1", b"\x0a\0\0\2", 53, 1000, 17), ("s", b"\x0a\0\0\1", b"\x0a\0\0\2", 1000, 9000, 17)]
    due, ts, rows = defaultdict(int), 0, []
    for k in range(n):
        session, a, b, a_port, b_port, protocol = flow = known[0] if pick.random() < 0.5 else pick.choice(known)
        forward, ts = pick.random() < 0.7, ts + pick.choice((0, 1, 2, 9))
        payload = pick.choice((None, b"", bytes.fromhex("300502010160000030"), b"\x16\3\1\0\2ab", b"x" * pick.randrange(1, 9)))
        syn, fin, rst, fragment = (pick.random() < 0.04 for _ in range(4))
        seq = due[flow, forward] + (pick.choice((-3, 2)) if pick.random() < 0.05 else 0)
        due[flow, forward] = (seq + syn + len(payload or b"")) % 2**32
        rows.append((session, k, ts, a, b, a_port, b_port, protocol, None, forward, *((a_port, b_port) if forward else (b_port, a_port)), seq % 2**32, syn, fin, rst, fragment, payload))
    return rows


def of_windows(events, keys: tuple[str, ...]) -> list[str]:
    """The events of each window, whatever it is named."""
    found = defaultdict(list)
    for r in events.collect():
        found[tuple(r[k] for k in keys)].append(repr(tuple(r[c] for c in ("session", *events.columns) if c == "session" or c not in keys)))
    return sorted(map(repr, map(sorted, found.values())))


@pytest.mark.parametrize("segments", [False, True])
def test_windows_are_folded_where_they_are_found(spark, segments):
    packets = spark.createDataFrame(streams(3 + segments), SCHEMA).repartition(5)
    want = of_windows(P.fold_windows(P.in_windows(packets, timeout_us=8), segments=segments), WINDOW_KEY)
    assert len(want) > 60
    for size in (P.FOLD_SLICE, 200, 7):  # no flow is long, one is, most are
        got = of_windows(P.fold_flows(packets, timeout_us=8, segments=segments, slice_packets=size), P.SEGMENT_KEY)
        # without a session no window has a number
        assert [x for x in got if "(None," not in x] == [x for x in want if "(None," not in x]
        assert any("(None," in x for x in got)


@pytest.mark.parametrize("folded", ["windows", "flows"])
def test_a_window_goes_on_over_batches(spark, folded):
    packets = spark.createDataFrame([r for r in streams(9) if r[0] == "s"], SCHEMA)

    def found():
        if folded == "windows":
            return of_windows(P.fold_windows(P.in_windows(packets, timeout_us=8)), WINDOW_KEY)
        return of_windows(P.fold_flows(packets, timeout_us=8), P.SEGMENT_KEY)

    want = found()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_short_flows_are_not_cut_however_long_the_capture(spark, monkeypatch):
    tables, own = [], flows.written
    monkeypatch.setattr(flows, "written", lambda df, label: tables.append(label) or own(df, label))
    rows = [("s", k, k, b"\1", b"\2", k // 4, 80, 6, None, True) for k in range(400)]
    packets = spark.createDataFrame(rows, "session string, packet_index bigint, ts_us bigint, a_addr binary, b_addr binary, a_port int, b_port int, protocol int, icmp_echo_id int, is_forward boolean")
    placed, windows = flows.sessionize(packets, timeout_us=10, max_active=None, slice_packets=50)
    assert "slices" not in tables
    assert windows.count() == 100 and {(r.sequence_number, r.gap_us) for r in placed.collect()} == {(k, g) for k in range(100) for g in (None, 1)}
    long = packets.where("packet_index < 300").unionByName(packets.where("packet_index >= 300").withColumn("a_port", packets.a_port * 0))
    placed, windows = flows.sessionize(long, timeout_us=10, max_active=None, slice_packets=50)
    assert "slices" in tables
    found = {(r.a_port, r.first_packet_index): r.last_packet_index for r in windows.collect()}
    assert found == {(k, 4 * k): 4 * k + 3 for k in range(75)} | {(0, 300): 399}


def test_stream_states_need_no_rank_of_windows(spark, sf_dir, monkeypatch):
    def ranked(*_):
        raise AssertionError("windows were ranked")

    monkeypatch.setattr(flows, "with_rank", ranked)
    assert sum(r.streams for r in wire_queries.QUERIES["p1_tcp_stream_state"](spark, sf_dir).collect()) > 1000
