"""DNS messages of a batch equal those read one by one."""

import hashlib
import random
import struct

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlark.functions.dns_batch import Messages, asked, dns_value
from flowlark.functions.messages import COMPLETE, parse_dns
from flowlark.operators.protocols import DNS_TYPE, with_dns
from flowlark.plans import wire_queries


def _name(r):
    return b"".join(bytes([len(x)]) + x for x in (bytes(r.choice(b"aAzZ-_19\xc3") for _ in range(r.choice((1, 2, 5, 63)))) for _ in range(r.choice((0, 1, 2, 3, 5, 18))))) + b"\0"


def _message(r):
    question = _name(r) + struct.pack("!HH", r.choice((1, 28, 0x4161)), 1)
    records, counts = b"", [r.choice((0, 0, 1, 2)) for _ in range(3)]
    for section, count in enumerate(counts):
        for _ in range(count):
            owner = r.choice((b"\xc0\x0c", b"\xc0\x0c", b"\xc0\x0c", b"\0", b"\x01x\xc0\x0c", b"\xc0\x0d"))
            kind = r.choice((1, 1, 5, 16, 41 if section == 2 else 2))
            body = r.randbytes(r.choice((0, 4, 4, 40)))
            records += owner + struct.pack("!HHIH", kind, 1, r.randrange(1 << 32), len(body)) + body
    out = struct.pack("!6H", r.randrange(1 << 16), r.randrange(1 << 16), r.choice((1, 1, 1, 1, 0, 2)), *counts) + question + records
    way = r.random()
    if way < 0.15:
        out = out[: r.randrange(len(out) + 1)]
    elif way < 0.25:
        out += r.randbytes(r.choice((1, 12)))
    elif way < 0.35:
        k = r.randrange(len(out))
        out = out[:k] + r.randbytes(1) + out[k + 1 :]
    return out


def _messages(n, seed):
    r = random.Random(seed)
    return [None, b"", *(_message(r) for _ in range(n)), None]


def test_batches_equal_single_messages(spark):
    kind = to_arrow_type(spark.range(1).select(F.lit(None).cast(DNS_TYPE).alias("m")).schema["m"].dataType)
    values = _messages(6_000, 5)
    for column in (pa.array(values, pa.binary()), pa.array([b"xx", *values], pa.binary()).slice(1)):
        got = Messages(column)
        assert 0.1 < got.plain.mean() < 0.9
        single = [None if v is None else dns_value(parse_dns(v)) for v in values]
        assert got.array(kind).to_pylist() == pa.array(single, kind).to_pylist()
        places, ids, flags, asks = got.heads()
        want = {k: m for k, v in enumerate(values) if v is not None and (m := parse_dns(v)).status == COMPLETE}
        assert places.tolist() == list(want) and asks == [asked(m) for m in want.values()]
        assert list(zip(ids.tolist(), flags.tolist())) == [(m.header["id"], m.header["flags"]) for m in want.values()]
        # what is asked tells messages apart as opcode and questions do
        keys = [repr((m.opcode, m.question_key())) for m in want.values()]
        assert len(set(zip(keys, asks))) == len(set(keys)) == len(set(asks))


def test_no_and_only_odd_messages(spark):
    kind = to_arrow_type(spark.range(1).select(F.lit(None).cast(DNS_TYPE).alias("m")).schema["m"].dataType)
    assert Messages(pa.array([], pa.binary())).array(kind).to_pylist() == []
    assert Messages(pa.array([None, b"abc"], pa.binary())).array(kind)[1]["status"].as_py() == "incomplete"


def test_only_wanted_fields_come_back(spark):
    values = [(k, v) for k, v in enumerate(_messages(500, 6))]
    df = spark.createDataFrame(values, "k int, raw binary")
    part = with_dns(df, fields=("flags", "questions.labels", "records.section", "records.rdlength"))
    assert part.schema["dns"].dataType.simpleString() == "struct<flags:int,questions:array<struct<labels:array<binary>>>,records:array<struct<section:int,rdlength:int>>>"
    rows = lambda d: sorted(d.select("k", "dns.flags", "dns.questions.labels", "dns.records.section", "dns.records.rdlength").collect())
    assert repr(rows(part)) == repr(rows(with_dns(df)))


def test_lookups_are_decoded_once(spark, sf_dir, monkeypatch):
    """Windows go through their packets twice, so these have to be a table, not a plan with the decoder in it."""
    seen = []
    monkeypatch.setattr(wire_queries.W, "sessionize", lambda packets, **_: seen.append(packets._jdf.queryExecution().executedPlan().toString()) or (packets, packets))
    wire_queries._lookups(spark, sf_dir)
    assert len(seen) == 1 and "MapInArrow" not in seen[0]
