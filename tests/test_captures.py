"""Captures in byte ranges and as a growing stream: equal to the sequential reader."""

import io
import random
import struct

import pytest
from frames import capture, datagram

from flowlark.errors import CaptureError
from flowlark.sources import pcap


def sequential(data):
    return [(k, *r) for k, r in enumerate(pcap.capture_records(io.BytesIO(data), len(data)))]


def of(rows):
    return sorted((r.packet_index, r.ts_us, r.link_type, r.captured_length, r.original_length, bytes(r.raw_bytes)) for r in rows)


def lookalikes(rng, order, nano, n):
    """Records of which many hold what looks like records, or nothing but zeros."""
    out, ts = [], 1_000_000
    for _ in range(n):
        ts += rng.randrange(1000)
        kind = rng.random()
        if kind < 0.3:
            body = b"".join(struct.pack(order + "IIII", rng.randrange(1000), rng.randrange(1000), m := rng.randrange(1, 40), m) + rng.randbytes(m) for _ in range(rng.randrange(1, 30)))
        elif kind < 0.5:
            body = b"\0" * rng.randrange(0, 400)
        else:
            body = rng.randbytes(rng.randrange(0, 120))
        out.append((ts, body))
    return capture(out, order=order, nano=nano)


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", True)])
def test_ranges_of_any_size_equal_the_sequential_reader(spark, tmp_path, order, nano):
    rng = random.Random(order + str(nano))
    data = lookalikes(rng, order, nano, 150)
    (tmp_path / "a.pcap").write_bytes(data)
    want = [r for r in sequential(data)]
    for size in (41, 500, 3000, 1 << 20):
        got = pcap.read_captures(spark, str(tmp_path / "a.pcap"), split_bytes=size)
        assert of(got.collect()) == want
    ranges = pcap.capture_ranges(spark, str(tmp_path / "a.pcap"), split_bytes=3000).collect()
    assert len(ranges) > 3 and sum(r.n for r in ranges) == 150


def test_many_captures_and_what_is_wrong_with_them(spark, tmp_path):
    records = [(1_000_000 + k, datagram(True, b"x" * (k % 50))) for k in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(capture(records))
    (folder / "b.pcap").write_bytes(capture(records[:7]))
    (folder / "empty of records.pcap").write_bytes(capture([]))
    rows = pcap.read_captures(spark, str(folder), split_bytes=2000, source="tap").collect()
    assert len(rows) == 307 and {r.source for r in rows} == {"tap"}
    a = [r for r in rows if r.session.endswith("a.pcap")]
    assert sorted(r.packet_index for r in a) == list(range(300))
    for spoilt, text in ((capture(records)[:-3], "truncated PCAP packet payload"), (capture(records)[:9000] + b"\xff" * 200 + capture(records)[9200:], "PCAP"), (b"", "truncated PCAP global header"), (b"nonsense" * 9, "unsupported PCAP magic number")):
        (tmp_path / "bad.pcap").write_bytes(spoilt)
        for size in (700, 1 << 20):
            with pytest.raises(Exception, match=text):
                pcap.read_captures(spark, str(tmp_path / "bad.pcap"), split_bytes=size).collect()
        with pytest.raises(CaptureError, match=text):
            sequential(spoilt)


def test_a_guess_is_taken_from_a_chain_and_a_wrong_one_is_seen():
    form = pcap.Format("<", 10**6, 1, 65535, 1)
    record = lambda body: struct.pack("<IIII", 5, 6, len(body), len(body)) + body
    data = b"\xff" * 13 + record(b"\xfe" * 30) + record(b"\xfd" * 50)
    assert pcap.likely_start(data, form, len(data), True) == 13
    assert pcap.likely_start(b"\xff" * 100, form, 100, True) is None
    assert pcap.likely_start(b"", form, 0, True) is None


def test_a_growing_capture_is_a_stream(spark, tmp_path):
    pcap.register(spark)
    data = capture([(1_000_000 + k, datagram(True, b"y" * (k % 9))) for k in range(60)])
    path = tmp_path / "grows.pcap"
    got = []

    def run():
        source = spark.readStream.format("pcap").load(str(tmp_path / "*.pcap"))
        source.writeStream.foreachBatch(lambda d, n: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()

    for end in (1500, 1501, len(data) - 2, len(data)):  # cut anywhere; each run is a new query on the same checkpoint
        path.write_bytes(data[:end])
        run()
    run()
    assert of(got) == sequential(data)


def test_packets_in_memory_are_observations(spark):
    from flowlark.operators.decoding import checked_observations, decode_packets
    from flowlark.sources.memory import observations_of

    packets = observations_of(spark, [datagram(True, b"a"), datagram(False, b"bc")], source="tap", now_us=7)
    rows = decode_packets(checked_observations(packets)).orderBy("packet_index").collect()
    assert [(r.packet_index, r.ts_us, r.source, r.protocol, r.failure_classification) for r in rows] == [(0, 7, "tap", 17, None), (1, 7, "tap", 17, None)]
    with pytest.raises(ValueError, match="blank"):
        observations_of(spark, [], source=" ")
