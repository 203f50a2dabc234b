"""Matching by window functions against the ledger that sees one message after the other."""

import random
import struct

import pytest

from flowlark.functions import folds, messages
from flowlark.operators import lookups

ROWS = "session string, sequence_number bigint, packet_index bigint, ts_us bigint, is_forward boolean, payload binary"


def message(rng, ids, response=None):
    label = rng.choice([b"a", b"A", b"bc"])
    flags = (0x8000 if (rng.random() < 0.5 if response is None else response) else 0) | rng.choice((0, 0, 0, 0x0800))
    body = struct.pack("!6H", rng.randrange(ids), flags, 1, 0, 0, 0) + bytes([len(label)]) + label + b"\0" + struct.pack("!HH", rng.choice((1, 1, 28)), 1)
    return body[: rng.choice((len(body), len(body), len(body), 20))]  # some are cut


def ledgers(rows, limit):
    """Events of each flow's ledger, in the form of the relation's rows."""
    out = []
    for session, flow in sorted({r[:2] for r in rows}):
        ledger, last = folds.DnsLedger(), None
        for r in (r for r in rows if r[:2] == (session, flow)):
            for o in ledger.scan(iter([(messages.parse_dns(r[5]), r[5], r[4], r[3])])):
                asked = o["request"] if o["status"] == "matched" else None
                out.append((session, flow, r[2], o["status"], o["reason"], o["message"].header["id"], o["ts"], o["ts"] - asked["ts"] if asked else None, o["raw"], asked and asked["raw"]))
            last = r[2]
        assert last is not None
        out += [(session, flow, None, o["status"], o["reason"], o["message"].header["id"], o["ts"], None, o["raw"], None) for o in ledger.end()]
    return sorted(map(repr, out))


@pytest.mark.parametrize("limit", [128, 3])
def test_transactions_equal_those_of_the_ledger(spark, monkeypatch, limit):
    monkeypatch.setattr(folds, "PENDING_REQUESTS", limit)
    rng = random.Random(limit)
    rows, index = [], 0
    for _ in range(900):
        flow = rng.randrange(12)
        rows.append(("s" if flow % 2 else "t", flow, index, 10 * index, rng.random() < 0.5, message(rng, 2 + flow)))
        index += rng.randrange(1, 3)
    for k in range(300):  # a flow in which nobody answers
        rows.append(("s", 99, index + k, 10 * (index + k), True, message(rng, 400, False)))
    got = lookups.dns_transactions(spark.createDataFrame(rows, ROWS), limit=limit).collect()
    raw = lambda x: None if x is None else bytes(x)
    have = sorted(repr((r.session, r.sequence_number, r.packet_index, r.status, r.reason, r.message_id, r.ts_us, r.latency_us, raw(r.raw), raw(r.request_raw))) for r in got)
    want = ledgers(rows, limit)
    assert len(want) > 900 and have == want
    assert {r.status for r in got} == {"pending", "matched", "unmatched", "ambiguous", "unresolved"} and any(r.reason == folds.LIMIT for r in got)


def test_no_messages_no_transactions(spark):
    assert lookups.dns_transactions(spark.createDataFrame([], ROWS)).collect() == []
    assert lookups.dns_transactions(spark.createDataFrame([("s", 0, 1, 2, True, None), ("s", 0, 2, 3, True, b"short")], ROWS)).collect() == []
