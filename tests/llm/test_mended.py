"""Cases that earlier versions got wrong."""

import gzip
import hashlib
import random
import time

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlark.llm import bpe, chat, decontaminate, labelled, queries, rules, warc


def test_quotes_with_any_line_ends_match_sql(spark):
    rng = random.Random(5)
    pieces = ["\n", "\r\n", "\r", "\n\n\r", "\r1\r", "\x85", " ", "> ", ">", ">> ", "foo", "hello", " ", "\t", "\x0b"]
    rows = [(1, 0, "user", "x\n\n\rfoo"), (1, 1, "user", "x\n\n\r1\rhello"), (1, 2, "user", "a\n\n\x85"), (1, 3, "user", "\n\n> foo\n\n")]
    rows += [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for c in range(2, 60) for t in range(4)]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", pa.table({n: [r[k] for r in rows] for k, n in enumerate(("conv_id", "turn", "role", "text"))}))
    want = con.sql(queries.OP5_SQL)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
    first = {r.turn: r for r in got.where("conv_id = 1").collect()}
    assert first[0].body == "x\n\n\rfoo" and first[1].n_quotes == 0


def test_labelled_rows_stay_within_their_bound(spark):
    ids = [k for k in range(100) if spark.range(k, k + 1).select(labelled.held_out("id")).first()[0] is False][:5]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("text", F.concat(F.lit("text "), F.col("doc_id").cast("string"))).crossJoin(spark.range(10_000).select(F.lit(1).alias("extra"))).repartition(4)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(ids[0], "a text"), (ids[1], None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1) for i in ids] * 3, "doc_id long, toxic int")
    got = labelled.training_rows(docs, labels, "toxic", 3).collect()
    assert len(got) == 3 == len({r.doc_id for r in got})
    every = {r.doc_id: r.text for r in labelled.training_rows(docs, labels, "toxic", 100).collect()}
    assert every[ids[0]] == "a text" and every[ids[1]] == f"text {ids[1]}"


def records(n):
    payload = lambda k: f"payload {k} ".encode() * 40
    return [warc.record_bytes(k, f"http://x/{k}", payload(k), hashlib.sha1(payload(k)).hexdigest(), len(payload(k)), None, "2024-01-01T00:00:00Z") + b"\r\n\r\n" for k in range(n)]


def test_salvage_of_a_cut_member_of_many_records():
    rng = random.Random(8)
    body = b"".join(r.replace(b"payload", rng.randbytes(4).hex().encode()) for r in records(1))
    many = gzip.compress(b"".join(records(50)), mtime=0)
    got = list(warc.salvage(many[:-12]))
    assert [f["page_id"] for k, f in got if k == "record"][:48] == list(range(48))
    gaps = [f for k, f in got if k == "gap"]
    assert len(gaps) == 1 and gaps[0][0] + gaps[0][1] == len(many) - 12
    # a byte in the middle: those before it come back, and so does the next member
    noisy = [warc.record_bytes(k, None, (p := rng.randbytes(3000)), hashlib.sha1(p).hexdigest(), 3000, None, "2024-01-01T00:00:00Z") + b"\r\n\r\n" for k in range(40)]
    first, second = gzip.compress(b"".join(noisy), mtime=0), gzip.compress(records(1)[0], mtime=0)
    broken = bytearray(first + second)
    broken[len(first) // 2] ^= 0xFF
    got = list(warc.salvage(bytes(broken)))
    ids = [f["page_id"] for k, f in got if k == "record"]
    assert ids[:15] == list(range(15)) and ids[-1] == 0 and got[-1][0] == "record"
    gaps = [f for k, f in got if k == "gap"]
    assert all(g[0] >= len(first) // 4 for g in gaps) and sum(g[1] for g in gaps) <= len(first)
    assert body


def test_salvage_takes_folded_headers_and_chunked_bodies():
    plain = records(1)[0]
    folded = plain.replace(b"WARC-Target-URI: http://x/0", b"WARC-Target-URI:\r\n http://x/0")
    assert folded != plain
    [(kind, got)] = list(warc.salvage(folded))
    assert kind == "record" and got["url"] == "http://x/0"
    entity = b"hello world, again"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=y\r\nhello\r\nd\r\n world, again\r\n0\r\n\r\n"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(entity).hexdigest()}\r\nX-Page-Id: 3\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    [(kind, got)] = list(warc.salvage(head + http + b"\r\n\r\n"))
    assert kind == "record" and got["payload"] == entity and got["payload_digest"] == hashlib.sha1(entity).hexdigest()
    assert [k for k, _ in warc.salvage(head + http.replace(b"again", b"agaim") + b"\r\n\r\n")] == ["gap"]


def test_rule_order_is_the_same_every_time(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    orders = [[r.name for r in rules.order_rules(docs)] for _ in range(10)]
    assert all(o == orders[0] for o in orders) and orders[0][-1] in ("word_length", "duplicate_lines")
    shares = {r.name: s for r, s, _ in rules.measured_rules(docs, sample_rows=10**9)}
    n = docs.count()
    report = rules.quality_report(docs)
    assert shares["few_words"] == report.where("n_words < 50").count() / n
    assert rules.keep_good(docs).count() == report.where("kept").count()


def test_the_screen_never_hides_a_rejection(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(50, 130))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    repeated = [r for r in rules.RULES if r.name == "repeated_words"]
    bare = [rules.Rule(r.name, r.needs, r.condition) for r in repeated]
    kept = {r.doc_id for r in rules.keep_good(docs, ordered=repeated).collect()}
    assert kept == {r.doc_id for r in rules.keep_good(docs, ordered=bare).collect()} and 0 < len(kept) < 400


def test_ids_outside_of_the_vocabulary_raise():
    coder = bpe.ByteBpe({bytes([b]): b for b in range(256)}, r".+")
    assert coder.decode(np.array([97, 98])) == b"ab"
    for bad in (-1, 256):
        with pytest.raises(ValueError, match="vocabulary"):
            coder.decode(np.array([97, bad]))
    assert public_tokenizers.PATTERN


def test_tiling_of_equal_words_takes_no_time_a_pair():
    began = time.perf_counter()
    tiles = decontaminate.greedy_string_tiling(np.full(200, 7, dtype=np.uint64), np.full(100_000, 7, dtype=np.uint64), 5)
    assert tiles == [(0, 0, 200)] and time.perf_counter() - began < 5
    period = np.tile(np.arange(3, dtype=np.uint64), 40_000)
    began = time.perf_counter()
    assert sum(n for *_, n in decontaminate.greedy_string_tiling(np.tile(np.arange(3, dtype=np.uint64), 60), period, 5)) == 180
    assert time.perf_counter() - began < 5
