"""Windows of a stream as mergeable state: equal to the batch, of fixed size, and nothing left behind."""

import os
import random
from decimal import Decimal

import pytest
from frames import SYN, datagram, rows_of, segment

from flowlark.operators import detectors as C
from flowlark.operators import flows
from flowlark.operators.decoding import admitted, decode_packets
from flowlark.plans import pipeline
from flowlark.runtime import passing, written
from flowlark.schemas import OBSERVATION
from flowlark.streaming.detection import DetectionStream
from flowlark.streaming.windows import advance, advanced, held_schema, marked_schema, open_windows, part_schema


def settings(**more):
    return pipeline.DetectionSettings(C.Detector("packet", "p1"), C.VolumeDetector("volume", "v1", "packet_count", 2), C.ControlDetector("control", "c1", "forward_syn_count", 2), 2_500_000, **more)


def traffic(rng, n, session, flows_=3):
    ts, records = 1_000_000, []
    for _ in range(n):
        ts += rng.choice((0, 100_000, 400_000, 400_000, 2_500_000))
        forward = rng.random() < 0.6
        records.append((ts, segment(forward, SYN, seq=100, port=4000 + rng.randrange(flows_)) if rng.random() < 0.4 else datagram(forward, b"x" * rng.randrange(30), port=5000 + rng.randrange(flows_))))
    return rows_of(records, session)


def stats_key(r):
    return (r["session"], r["sequence_number"], *sorted((k, str(v)) for k, v in r.items() if k not in ("flow", "batch", "first_batch") and not k.endswith(("forward_first_us", "forward_last_us", "reverse_first_us", "reverse_last_us"))))


@pytest.mark.parametrize("limit", [None, 4])
def test_all_statistics_of_streamed_windows_equal_those_of_the_batch(spark, tmp_path, limit):
    rng = random.Random(3)
    one, two = traffic(rng, 160, "s"), traffic(rng, 60, "t", 1)
    s = settings(max_active=limit)
    want = sorted(stats_key(r.asDict(recursive=True)) for r in pipeline.detect(spark.createDataFrame(one + two, OBSERVATION), s).state.collect())
    folder = str(tmp_path / "state")
    cuts = sorted(rng.sample(range(1, 160), 3))
    closed = []

    def keep(findings, number):
        closed.extend(r.asDict(recursive=True) for r in spark.read.parquet(f"{folder}/batch-{number}/closed").collect())

    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 160])):
        stream = DetectionStream(spark, s, lambda d, n: None, keep, folder)  # a new object for each batch
        stream.batch(spark.createDataFrame(one[a:b] + two[a * 60 // 160 : b * 60 // 160], OBSERVATION), k)
    held = open_windows(spark, f"{folder}/windows")
    assert held.count() <= (2 * limit if limit else 6 + 2)  # a row a flow, not a packet
    stream.finish()
    assert sorted(map(stats_key, closed)) == want
    left = set(os.listdir(f"{folder}/parts"))
    assert not any(x.startswith("batch-") for x in left)  # parts go when their batch is committed


def test_late_packets_go_aside_and_the_rest_go_on(spark, tmp_path):
    rng = random.Random(5)
    rows = traffic(rng, 80, "s")
    shuffled = [(r[0], k, r[2] - (3_000_000 if rng.random() < 0.2 else 0), *r[3:]) for k, r in enumerate(rows)]
    packets = flows.with_identity(admitted(decode_packets(spark.createDataFrame(shuffled, OBSERVATION)), strict=False)).select(*pipeline.STATE_COLUMNS)
    on_time, late = flows.split_late(packets)
    top, want = -1, set()
    for r in shuffled:
        if r[2] < top:
            want.add(r[1])
        top = max(top, r[2])
    assert {r.packet_index for r in late.collect()} == want and {r.packet_index for r in on_time.collect()} == set(range(80)) - want and want
    got, flow = [], []
    stream = DetectionStream(spark, settings(), lambda d, n: None, lambda d, n: flow.extend(d.collect()), str(tmp_path / "s"), late_consumer=lambda d, n: got.extend(d.collect()))
    stream.batch(spark.createDataFrame(shuffled[:35], OBSERVATION))
    stream.batch(spark.createDataFrame(shuffled[35:], OBSERVATION))
    stream.finish()
    assert {r.packet_index for r in got} == want
    kept = [r for r in shuffled if r[1] not in want]
    whole = pipeline.detect(spark.createDataFrame(kept, OBSERVATION), settings())
    key = lambda r: (r.detector_id, r.raw_evidence.sequence_number, r.raw_evidence.packet_count, r.raw_evidence.last_us)
    assert sorted(map(key, flow)) == sorted(map(key, whole.flow_findings.collect()))


def test_a_closing_without_packets_comes_before_the_batch():
    part = lambda first, **more: {"flow": "f", "session": "s", "batch": 1, "first_packet_index": first, "last_packet_index": first, "closure_reason": None, "closed_at": None, "first_us": first, "last_us": first, **more}
    open_, events = advance(None, [part(3)], 10)
    assert [e["kind"] for e in events] == ["open"] and open_["first_packet_index"] == 3
    gone = {**part(None), "closure_reason": "capacity", "closed_at": 7}
    open_, events = advance(open_, [part(9), gone], 10)
    assert [(e["kind"], e.get("closure_reason"), e.get("closed_at")) for e in events] == [("closed", "capacity", 7), ("open", None, None)]
    assert open_["first_packet_index"] == 9


def test_tables_of_a_block_go_with_it(spark):
    with passing(spark):
        inside = written(spark.range(3), "inside")
        path = inside.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    outside = written(spark.range(3), "outside")
    assert outside.count() == 3


def test_a_batch_meets_the_open_windows_in_one_join_without_python(spark):
    columns = ", ".join(f"{n} {t}" for n, t in flows.column_types(pipeline.STATE_COLUMNS))
    schema, rng = part_schema(spark, columns), random.Random(11)
    counts = [f.name for f in schema.fields if f.dataType.simpleString().startswith(("bigint", "decimal")) and f.name not in ("batch", "closed_at", "first_packet_index", "last_packet_index") and not f.name.endswith(("_first_us", "_last_us"))]
    cell = lambda n: Decimal(rng.randrange(9)) if "square" in n else None if n.endswith(("us_min", "us_max")) and rng.random() < 0.3 else rng.randrange(3)

    def part(flow, batch, index, us, reason, at):
        row = dict.fromkeys(schema.names) | {n: cell(n) for n in counts} | {"flow": flow, "session": "s", "batch": batch, "first_packet_index": index, "last_packet_index": index + 1, "first_us": us, "last_us": us + 3, "closure_reason": reason, "closed_at": at}
        for side in ("forward", "reverse"):
            row |= dict(zip((f"{side}_first_us", f"{side}_last_us"), (us, us + 2) if rng.random() < 0.6 else (None, None)))
        return row

    held, plain = None, {}
    for batch in range(3):
        parts = []
        for k in range(40):
            if rng.random() < 0.25:  # the flow has a closing of a window from before, or nothing
                parts += [dict.fromkeys([*schema.names]) | {"flow": f"f{k}", "session": "s", "batch": batch, "closure_reason": "capacity", "closed_at": batch * 1000, "leading": None}] if rng.random() < 0.5 else []
                if rng.random() < 0.5:
                    continue
            index, us = batch * 1000 + 2 * k, batch * 20 + rng.randrange(20)
            own = [part(f"f{k}", batch, index + 200 * n, us + 30 * n, None, None) for n in range(rng.randrange(1, 4))]
            for one, after in zip(own, own[1:]):
                one |= {"closure_reason": "inactivity", "closed_at": after["first_packet_index"]}
            parts += [one | {"leading": one is own[0]} for one in own]
        table = spark.createDataFrame([tuple(p[n] for n in marked_schema(schema).names) for p in parts], marked_schema(schema))
        after = advanced(held, table, schema, 25)
        assert "Python" not in after._jdf.queryExecution().toString().replace("PythonRDD", "")
        got = [r.asDict() for r in after.collect()]
        want, opened = [], 0
        for flow in {p["flow"] for p in parts}:
            plain[flow], events = advance(plain.get(flow), [{n: p[n] for n in schema.names} for p in parts if p["flow"] == flow], 25)
            want += [e for e in events if e["kind"] == "closed"]
            opened += sum(e["kind"] == "open" for e in events)
        line = lambda r: tuple(str(r[n]) for n in ("first_batch", *schema.names))
        assert sorted(line(r) for r in got if r["closure_reason"]) == sorted(map(line, want))
        still = [w for w in plain.values() if w is not None]
        assert sorted(line(r) for r in got if not r["closure_reason"]) == sorted(map(line, still))
        assert sum(r["fresh"] for r in got) == opened
        held = spark.createDataFrame([tuple(r[n] for n in held_schema(schema).names) for r in got if not r["closure_reason"]], held_schema(schema))
