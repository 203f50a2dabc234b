import base64
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from flowlark.llm import bpe, chat, decontaminate, licenses, quality_classifier, rules, token_counts, toxicity, warc
from flowlark.llm.labelled import held_out

ODD = [None, "", " ", "\n\n", "a", "it's  <|endoftext|> 12,5 é中　x\x1c\x85y", "word " * 40_000, "x" * 5000, "🙂" * 300 + " \t ", "ends with space "]
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- byte-level BPE and token counts ------------------------------------------------------------------------------


def reference_encoding():
    import tiktoken

    with open(MULTI, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark):
    rows = [(k, t, "other", 1) for k, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    enc = reference_encoding()
    got = bpe.bpe_round_trip(docs, path=MULTI, pattern=public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = ODD[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.bpe_encode(docs, path=MULTI, pattern=public_tokenizers.PATTERN)
    decoded = {r.doc_id: bytes(r.decoded).decode() for r in bpe.bpe_decode(encoded, path=MULTI, pattern=public_tokenizers.PATTERN).collect()}
    assert decoded == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.bpe_encode(docs.limit(0), path=MULTI, pattern=public_tokenizers.PATTERN).collect() == []


def test_bpe_serialised_model_follows_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 256, b"abc": 301}
    coder = bpe.ByteBpe(ranks, r".+")
    assert coder.encode_batch(["abc", "ab", "xabcd"]) == [[301], [300], [120, 301, 100]]
    with pytest.raises(ValueError, match="empty"):
        bpe.serialise_model({})


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "a", "B", "<|endoftext|>", "'s", "1", "!", "é", " ", "　", "中", "\x1c", "\x85", "ab"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, path=path).collect()}
    for k, t in enumerate(texts):
        n = len(plain.encode(t or "", add_special_tokens=False))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(docs.limit(0), path=path).collect() == []
    assert "".join(token_counts.safe_segments(ODD[5])) == ODD[5]
    marks = list(".,;:!?…、。！，：；？'’\"-<|>") + ["<|endoftext|>", "s", "ll", "don't", "中文", "かな", "カナ", "한글", "слово", "1", "é", " "]
    unspaced = ["".join(rng.choice(marks) for _ in range(rng.randrange(300, 900))) for _ in range(150)]
    counter = token_counts.TokenCounter(path, remember=20_000)
    for t in unspaced:
        assert counter.counts([t]) == [len(plain.encode(t, add_special_tokens=False))]
        assert counter.held <= 20_000
    text = "。".join("中文" * 20 for _ in range(2000))
    assert max(map(len, token_counts.safe_segments(text))) < 50


def test_bpe_forgets_by_bytes():
    coder = bpe.ByteBpe({bytes([b]): b for b in range(256)}, r".+", remember=5_000)
    for k in range(50):
        assert coder.encode_batch([f"text {k}" * 20]) == [list(f"text {k}".encode() * 20)]
        assert coder.held <= 5_000


# --- WARC ---------------------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    big = "<p>é" + "x" * 1500
    rows = [(1, "http://a/ b", big, "k"), (2, None, big, None), (7, "u", big, None), (3, "u", "small", None), (4, "u", "small", None), (5, "u", None, None), (None, "u", "WARC/1.1\r\n\r\n" * 200, None), (8, "", "y" * 3_000_000, None)]
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages_of(spark, rows), path, compression=compression)
    got = warc.read_warc(spark, path).collect()
    assert {r.kind for r in got} == {"record"}
    found = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    expected = [(i if i is not None else -1, *(("revisit", 7) if i in (1, 2) else ("response", None)), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h, _ in rows]
    assert found == sorted(expected, key=lambda x: x[0])
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h, _ in rows}
    again = warc.warc_round_trip(pages_of(spark, rows), compression=compression)
    assert again.count() == len(rows)
    assert warc.warc_round_trip(pages_of(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_what_is_whole(compressed):
    records = [warc.record_bytes(k, f"http://x/{k}", f"payload {k}".encode() * 50, hashlib.sha1(f"payload {k}".encode() * 50).hexdigest(), len(f"payload {k}") * 50, None, "2024-01-01T00:00:00Z") + b"\r\n\r\n" for k in range(6)]
    parts = [gzip.compress(r, mtime=0) for r in records] if compressed else records
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    whole = b"".join(parts)
    read = lambda data: [x for x in warc.salvage(data)]
    assert [f["page_id"] for k, f in read(whole) if k == "record"] == list(range(6))
    broken = bytearray(whole)
    broken[starts[2] + len(parts[2]) // 2] ^= 0xFF
    got = read(bytes(broken))
    assert [f["page_id"] for k, f in got if k == "record"] == [0, 1, 3, 4, 5]
    gaps = [f for k, f in got if k == "gap"]
    assert [(a, n) for a, n, _ in gaps] == [(starts[2], len(parts[2]))]
    got = read(whole[: starts[4] + 20])
    assert [f["page_id"] for k, f in got if k == "record"] == [0, 1, 2, 3]
    got = read(b"junk" + whole[:starts[1]] + b"noise" + whole[starts[1] :])
    assert [f["page_id"] for k, f in got if k == "record"] == list(range(6))
    assert [(f[0], f[1]) for k, f in got if k == "gap"] == [(0, 4), (4 + starts[1], 5)]
    rng = random.Random(3)
    for _ in range(200):
        read(rng.randbytes(80))
        cut = bytearray(whole)
        cut[rng.randrange(len(cut))] ^= 1 << rng.randrange(8)
        got = read(bytes(cut))
        assert sum(k == "record" for k, _ in got) >= 5


# --- decontamination ----------------------------------------------------------------------------------------------


def plain_tiling(p, t, m):
    mp, mt, tiles = [0] * len(p), [0] * len(t), []
    while True:
        best, found = 0, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n:
                    found.append((i, j))
        if best < m:
            return tiles
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [1] * best
                tiles.append((i, j, best))


def test_tiling_equals_the_plain_method():
    rng = random.Random(5)
    spread = lambda x: np.array(x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    for _ in range(1500):
        a = rng.choice([2, 3, 6, 30])
        p, t, m = [rng.randrange(a) for _ in range(rng.randrange(25))], [rng.randrange(a) for _ in range(rng.randrange(40))], rng.randint(1, 5)
        if rng.random() < 0.4 and len(p) > 6:
            x = rng.randint(1, len(p) - 1)
            t = t[:5] + p[x:] + t[5:8] + p[:x] + t[8:]
        assert sorted(decontaminate.greedy_string_tiling(spread(p), spread(t), m)) == sorted(plain_tiling(p, t, m))


def test_contaminated_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)] + [(5, None), (6, ""), (7, "Only four words here")]
    filler = lambda n: " ".join(word() for _ in range(n))
    w = items[1][1].split()
    docs = [
        (0, filler(50) + " " + items[0][1].upper() + " " + filler(50)), (1, filler(20) + " " + " ".join(w[20:] + ["x"] + w[:10] + ["y"] + w[10:20])),
        (2, filler(80) + " " + " ".join(w[:10])), (3, None), (4, ""), (5, "so: only FOUR words, here!"), (6, items[2][1].replace(" ", "$$$ ")), (7, filler(20_000) + " " + items[3][1] + " " + items[4][1]), (0, filler(3)),
    ]
    schema = "doc_id long, text string"
    d, b = spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string")
    for chars in (16_000_000, 200):
        got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated_pairs(d, b, block_chars=chars).collect()}
        assert got == {(0, 0): 1.0, (1, 1): 1.0, (5, 7): 1.0, (6, 2): 1.0, (7, 3): 1.0, (7, 4): 1.0}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(d, b).collect()) == [0, 2, 3, 4]  # the other row of id 0 is clean
    assert decontaminate.contaminated_pairs(d.limit(0), b).collect() == []
    assert decontaminate.contaminated_pairs(d, b.limit(0)).collect() == []


def test_decontamination_query_equals_brute_force(spark, tmp_path):
    import re

    from flowlark.llm import queries

    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((3, 8, 20, 45))))) for k in range(12)] + [(12, None), (13, " .,")]
    docs = []
    for k in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(12)][1].split()
            a, b = sorted((rng.randrange(len(own) + 1), rng.randrange(len(own) + 1)))
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = own[a:b] if rng.random() < 0.5 else own[b:] + own[:b]
        docs.append((k, rng.choice((" ", ", ", "\n")).join(parts).title()))
    docs += [(60, None), (61, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, text in docs:
        for i, item in items:
            p, t = cut(item), cut(text)
            m = min(5, len(p))
            covered = sum(n for _, _, n in plain_tiling(p, t, m)) if p else 0
            if p and covered and 2 * covered >= len(p):
                want.add((d, i, len(p), covered))
    got = {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in queries.op9_decontamination(spark, str(tmp_path)).collect()}
    assert len(want) > 20
    assert got == want


def test_salvage_never_raises_on_any_header_field():
    rng = random.Random(9)
    body = b"payload" * 40
    record = warc.record_bytes(5, "http://x", body, hashlib.sha1(body).hexdigest(), len(body), None, "2024-01-01T00:00:00Z") + b"\r\n\r\n"
    revisit = warc.record_bytes(6, "http://x", None, hashlib.sha1(body).hexdigest(), len(body), 5, "2024-01-01T00:00:00Z") + b"\r\n\r\n"
    odd = ["", "²", "٣", "9" * 5000, "-1", "+5", "1e3", "0x10", " 7 ", "NaN", "1" * 18, "1" * 19, "<urn:page:" + "9" * 30 + ">", "<urn:page:²>", "sha1:", "sha1:²", ":", "sha256:AAAA", "\ud800".encode("utf-8", "surrogatepass").decode("latin-1"), "\x00", "x" * 70_000]
    for whole in (record, revisit):
        head, rest = whole.split(b"\r\n\r\n", 1)
        lines = head.split(b"\r\n")
        for k in range(len(lines)):
            for value in odd:
                for changed in (lines[k].split(b":")[0] + b": " + value.encode("utf-8", "surrogatepass"), value.encode("utf-8", "surrogatepass"), rng.randbytes(20)):
                    data = b"\r\n".join([*lines[:k], changed, *lines[k + 1 :]]) + b"\r\n\r\n" + rest
                    for pack in (bytes, gzip.compress):
                        got = list(warc.salvage(pack(data) + pack(record)))
                        assert [f["page_id"] for kind, f in got if kind == "record"][-1:] == [5]
                        for kind, f in got:
                            if kind == "record":
                                assert all(n is None or -(1 << 63) <= n < 1 << 63 for n in (f["page_id"], f["refers_to"], f["payload_bytes"]))


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage_takes_headers_of_any_length(pack):
    body = b"payload"
    url = "http://x/" + "u" * 100_000
    data = pack(warc.record_bytes(1, url, body, hashlib.sha1(body).hexdigest(), len(body), None, "2024-01-01T00:00:00Z") + b"\r\n\r\n")
    assert [(kind, got["page_id"], got["url"]) for kind, got in warc.salvage(data)] == [("record", 1, url)]


def test_salvage_takes_digests_of_other_crawlers():
    body = b"payload"
    right, wrong = hashlib.sha1(body), hashlib.sha1(b"other")
    plain = warc.record_bytes(1, "http://x", body, right.hexdigest(), len(body), None, "2024-01-01T00:00:00Z") + b"\r\n\r\n"
    b32 = lambda h: base64.b32encode(h.digest()).decode()
    read = lambda digest, kind=b"response": list(warc.salvage(plain.replace(b"sha1:" + right.hexdigest().encode(), digest.encode(), 1).replace(b"Type: response", b"Type: " + kind, 1)))
    for digest in ("sha1:" + b32(right), "SHA1:" + right.hexdigest().upper(), "sha-1:" + b32(right).lower(), "md5:" + hashlib.md5(body).hexdigest(), "sha256:" + hashlib.sha256(body).hexdigest(), "sha256:" + b32(hashlib.sha256(body)), "whirlpool:00"):
        assert [(kind, got["payload_digest"]) for kind, got in read(digest)] == [("record", right.hexdigest())]
    for digest in ("sha1:" + b32(wrong), "sha1:" + wrong.hexdigest(), "md5:" + hashlib.md5(b"other").hexdigest()):
        assert [kind for kind, _ in read(digest)] == ["gap"]
    assert [got["payload_digest"] for _, got in read("sha1:" + b32(right), b"revisit")] == [right.hexdigest()]


# --- rules, chat, licences (native) -------------------------------------------------------------------------------


def test_rule_cascade(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(0, good), (1, None), (2, ""), (3, "few words"), (4, good + " ###" * 30), (5, "same three words " * 40), (6, "\n".join(" ".join(f"w{k}x{j}" for j in range(40)) for k in range(3))), (7, " ".join("a" for _ in range(60))), (8, "b" * 100_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in rules.quality_report(docs).collect()}
    assert {i for i, r in got.items() if r.kept} == {0, 6}
    assert {i for i, r in got.items() if r.base_failed} == {1, 2, 3, 5, 7, 8}
    assert (got[4].n_symbols, got[1].n_words, got[5].n_repeat_words, got[8].word_chars) == (90, 0, 120, 100_000)
    order = rules.order_rules(docs)
    assert rules.keep_good(docs, ordered=order).columns == docs.columns
    assert rules.quality_report(docs.limit(0), ordered=order).collect() == []
    assert {r.name for r in order} == {r.name for r in rules.RULES}
    assert {r.doc_id for r in rules.quality_report(docs, ordered=order[::-1]).collect() if r.kept} == {0, 6}
    for ordered in (order, order[::-1]):
        assert {r.doc_id for r in rules.keep_good(docs, ordered=ordered).collect()} == {0, 6}


def test_later_rules_cost_nothing_for_rejected_texts(spark):
    from pyspark.sql import functions as F

    fails = lambda name: rules.Rule(name, ("n_words", "n_repeat_words"), lambda n, r: F.raise_error(F.lit("evaluated")).cast("boolean"))
    few = rules.BASE_RULES[0]
    short = spark.createDataFrame([(k, "a few words") for k in range(20)] + [(20, None)], "doc_id long, text string")
    assert rules.keep_good(short, ordered=[few, fails("later")]).collect() == []
    with pytest.raises(Exception, match="evaluated"):
        rules.keep_good(short, ordered=[fails("first"), few]).collect()


def plain_repeat(words):
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({p + d for at in seen.values() if len(at) > 1 for p in at for d in range(3)})


def test_rule_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "\t", "\r", "é"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    got = {r.doc_id: r for r in rules.quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    import re

    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == (len(w), sum(map(len, w)), t.count("#"), len(lines) - len(set(lines)), plain_repeat(w))


def test_chat_quotes_and_order(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> hello  THERE\nFine"), (1, 2, "user", ">> hello there\n> Fine\nGood\n\n> nothing like it"),
        (1, 3, "user", "> How are you?\nstill asking"), (1, 4, "user", "> Good\nagain"), (2, 0, None, None), (None, 1, "user", "> Fine"), (2, 1, "user", "> > x\n>>y\n"), (2, 2, "user", "> again\nno"), (2, 2, "user", "> again\nno"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = chat.format_conversations(df).orderBy("conv_id", "root_turn", "position").collect()
    assert [(r.turn, r.parent_turn, r.depth, r.position, r.body) for r in got if r.conv_id == 1] == [(0, None, 0, 0, "Hello there\nHow are you?"), (1, 0, 1, 1, "Fine"), (2, 1, 2, 2, "Good"), (4, 2, 3, 3, "again"), (3, 0, 1, 4, "still asking")]
    assert [(r.turn, r.parent_turn, r.n_quotes, r.role) for r in got if r.conv_id != 1] == [(1, None, 1, "user"), (0, None, 0, "unknown"), (1, None, 1, "user"), (2, None, 1, "user"), (2, None, 1, "user")]
    assert got[1].formatted == "<|user|>\nHello there\nHow are you?\n<|end|>"
    assert chat.format_conversations(df.limit(0)).collect() == []
    chain = [(9, k, "user", (f"> message {k - 1}\n" if k else "") + f"message {k}") for k in range(70)] + [(8, 0, "user", "x" * 400_000)]
    long = chat.format_conversations(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn").collect()
    assert [(r.root_turn, r.depth, r.position) for r in long[1:]] == [(0, k, k) for k in range(70)]
    assert len(long[0].body) == 400_000


def test_reply_order_equals_a_walk(spark):
    rng = random.Random(11)
    parent = {(c, t): rng.randrange(t) for c in range(6) for t in range(1, 40) if rng.random() < 0.8}
    children = {}
    for (c, t), p in sorted(parent.items()):
        children.setdefault((c, p), []).append(t)
    want = {}

    def walk(c, t, root, depth, at):
        want[c, t] = (root, depth, at)
        at += 1
        for child in children.get((c, t), []):
            at = walk(c, child, root, depth + 1, at)
        return at

    for c, p in children:
        if (c, p) not in parent:
            walk(c, p, p, 0, 0)
    frame = spark.createDataFrame([(c, t, p) for (c, t), p in parent.items()], "conv long, turn long, parent long")
    assert {(r.conv, r.turn): (r.root, r.depth, r.position) for r in chat.reply_order(frame).collect()} == want
    with pytest.raises(RuntimeError, match="not ordered"):
        chat.reply_order(frame, most_rounds=2)


def test_license_scan(spark):
    prose = " ".join(f"prose{k}" for k in range(200))
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.py", prose), (3, "repo/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "repo/lib/deep/b.c", prose), (5, "repo/lib/c.c", prose + "\n// Licensed under the Apache License, Version 2.0\n" + prose), (6, "other/d.c", prose), (7, None, None), (8, "repo/e", ""), (9, None, "Licensed under CC BY-NC 4.0."),
        (10, "repo/src/f", prose + "\nthe licence of poets is to be free with words and with the truth"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, path string, text string, license string")).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "GPL-3.0", 5: "Apache-2.0", 6: None, 7: None, 8: "MIT", 9: "CC-BY-NC-4.0", 10: "MIT"}
    assert (got[4].inherited_from, got[2].inherited_from, got[5].inherited_from) == ("repo/lib", "repo", None)
    assert {i for i, r in got.items() if r.is_license_file} == {1, 3, 9}
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []


def wrapped(text, width=70, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_whole_licences_headers_and_the_top(spark):
    prose = " ".join(f"prose{k}" for k in range(50))
    mit = "MIT License\n\nCopyright (c) 2021 A. Nyone\n\n" + "\n\n".join(wrapped(p) for p in licenses._MIT)
    bsd = "Copyright (c) 2019, The Project\nAll rights reserved.\n\n" + "\n\n".join(wrapped(p, 75) for p in licenses._BSD)
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n" + wrapped(prose)
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + wrapped(prose)
    header = "/*\n" + wrapped(licenses._gnu("GNU General Public License", "3"), 60, " * ") + "\n *\n */\n" + prose
    mpl = wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", 70, "# ") + "\n#\n" + prose
    rows = [
        (1, "mit/LICENSE", mit), (2, "mit/src/a.py", prose), (3, "bsd/LICENSE.txt", bsd), (4, "bsd/a/b/c.c", prose), (5, "apache/LICENSE", apache), (6, "apache/x.go", prose), (7, "gpl/COPYING", gpl), (8, "gpl/y/z.c", prose),
        (9, "src/header.c", header), (10, "src/part.rs", mpl), (11, "src/plain.rs", prose), (12, "LICENSE", "Released under the MIT License."), (13, "gpl/COPYING.old", prose), (14, "/abs/dir/q.py", prose), (15, "long/one.txt", "word " * 60_000 + "licensed under nothing"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: "Apache-2.0", 6: "Apache-2.0", 7: "GPL-3.0", 8: "GPL-3.0", 9: "GPL-3.0", 10: "MPL-2.0", 11: "MIT", 12: "MIT", 13: "GPL-3.0", 14: "MIT", 15: "MIT"}
    assert {i: r.license for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.is_license_file} == {1, 3, 5, 7, 12}
    assert (got[8].inherited_from, got[11].inherited_from, got[13].inherited_from) == ("gpl", "", "gpl")
    assert {i for i, r in got.items() if r.own_license is None} == {2, 4, 6, 8, 11, 13, 14, 15}


def test_license_sql_says_the_same_with_inheritance(spark, tmp_path):
    import duckdb

    from flowlark.llm import queries

    prose = " ".join(f"prose{k}" for k in range(50))
    mit = "MIT License\n\nCopyright (c) 2021 A. Nyone\n\n" + "\n\n".join(wrapped(p) for p in licenses._MIT)
    rows = [(1, mit, "a"), (2, prose, "a"), (3, prose, "a/d0/deep"), (4, "This work is licensed under the GNU General Public License, version 3.", "a/d0/deep"), (5, prose, "a/d0/deep/d0/x"), (6, prose, "b"), (7, wrapped(licenses._BSD[0], 40, "// ") + "\n//\n" + prose, "a"), (8, None, "a"), (9, prose, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_license_scans(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.sql(queries.OP8_SQL)
    assert sorted(map(str, (sorted(r.asDict().items()) for r in got))) == sorted(map(str, (sorted(dict(zip(found.columns, r)).items()) for r in found.fetchall())))
    assert {r.doc_id: r.license for r in got} == {1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: None, 7: "BSD-3-Clause", 8: "MIT", 9: None}


# --- classifiers --------------------------------------------------------------------------------------------------


def accuracy(rows):
    return sum(r.predicted == r.label for r in rows) / len(rows)


def test_toxicity_is_learned_and_names_do_not_count(spark):
    rng = random.Random(2)
    common = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(700):
        toxic = k % 4 == 0
        text = [rng.choice(common) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(("idiotic", "worthless", "stupidity"))
        if rng.random() < (0.5 if toxic else 0.05):
            text[0] = "women"
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs += [(700, None), (701, ""), (702, "women men muslims christians met"), (703, "w1 w2 w3")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    names = spark.createDataFrame([*labels, (703, None)], "doc_id long, toxic int")
    scored = toxicity.toxicity_scores(d, names)
    rows = scored.join(names.withColumnRenamed("toxic", "label"), "doc_id").where("label IS NOT NULL AND held_out").collect()
    assert accuracy(rows) > 0.97
    with_penalty, without = (toxicity.train_toxicity(d, names, penalty=p) for p in (20.0, 0.0))
    plain = spark.createDataFrame([(0, "w1 w2 w3 women"), (1, "w1 w2 w3")], "doc_id long, text string")

    def change(model):
        a, b = (r.score for r in toxicity.score_toxicity(plain, model).orderBy("doc_id").collect())
        return abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))

    assert change(with_penalty) < 0.5 * change(without)
    odd = {r.doc_id: r for r in scored.where("doc_id >= 700").collect()}
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert odd[700].score == odd[701].score
    assert odd[702].predicted == 0
    assert toxicity.toxicity_scores(d.limit(0), names).collect() == []
    assert {(round(r.score, 6), r.predicted) for r in toxicity.toxicity_scores(d.limit(3), names.limit(0)).collect()} == {(0.268941, 0)}


def test_neutral_mentions_are_spared_by_the_penalty(spark):
    rng = random.Random(5)
    terms = [t for group in toxicity.IDENTITY_TERMS[:5] for t in group]
    common = [f"w{k}" for k in range(150)]
    docs, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        text = [rng.choice(common) for _ in range(20)]
        if toxic and rng.random() < 0.6:
            text[5] = rng.choice(("idiotic", "worthless"))
        if rng.random() < (0.9 if toxic else 0.02):
            text[0] = rng.choice(terms)
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    d, names = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = spark.createDataFrame([(k, " ".join([rng.choice(terms)] + [rng.choice(common) for _ in range(20)])) for k in range(200)] + [(200, "w1 " * 100_000)], "doc_id long, text string")

    def share(penalty):
        scored = toxicity.score_toxicity(neutral, toxicity.train_toxicity(d, names, penalty=penalty))
        return scored.where("score >= 0.5").count() / 201

    without, with_penalty = share(0.0), share(20.0)
    assert without > 0.5
    assert with_penalty < 0.5 * without


def test_counterfactuals():
    assert toxicity.counterfactuals("no group here") == []
    assert toxicity.counterfactuals("The Woman spoke") == ["The man spoke", "The  spoke"]
    assert toxicity.counterfactuals("old gay men")[0] == "young lesbian trans people"


def test_quality_is_learned_and_calibrated(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(600):
        words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(60)]
        bad = k % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if k % 2 else [w + "$$$" for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad)))
    d = spark.createDataFrame([*docs, (600, None), (601, "")], "doc_id long, text string")
    names = spark.createDataFrame(labels, "doc_id long, quality int")
    scored = quality_classifier.quality_scores(d, names)
    rows = scored.join(names.withColumnRenamed("quality", "label"), "doc_id").where("held_out").collect()
    assert accuracy(rows) > 0.97
    odd = {r.doc_id: r.score for r in scored.where("doc_id >= 600").collect()}
    assert odd[600] == odd[601]
    assert 0 <= odd[600] <= 1
    assert quality_classifier.quality_scores(d.limit(0), names).collect() == []
    assert len({r.score for r in quality_classifier.quality_scores(d.limit(5), names.limit(0)).collect()}) == 1
    held = [r for r in rows if r.held_out]
    assert quality_classifier.calibration_error(np.array([r.score for r in held]), np.array([r.label for r in held])) < 0.05
    assert quality_classifier.calibration_error(np.array([0.9, 0.9, 0.1]), np.array([0, 1, 0])) == pytest.approx((2 * 0.4 + 0.1) / 3)
    assert quality_classifier.score_quality(spark.createDataFrame([(1, "abc " * 200_000)], "doc_id long, text string"), quality_classifier.train_quality(d, names)).count() == 1
    logits = np.array([4.0, 4.0, 4.0, -4.0, 4.0, -4.0])
    assert quality_classifier.calibrated(logits, np.array([1, 1, 0, 0, 1, 1])) > 2


def test_words_have_vectors_of_their_own(spark):
    import pyarrow as pa

    from flowlark.llm import textkernel

    rng = random.Random(4)
    # thousands of words, of two kinds that stand among words of their own kind
    texts = []
    for k in range(400):
        kind = k % 2
        texts.append(" ".join(w for _ in range(60) for w in (f"ctx{'abcd'[rng.randrange(2) + 2 * kind]}", f"word{kind}q" + "".join(rng.choice("abcdefgh") for _ in range(4)))))
    vectors = quality_classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    vocabulary = sorted({w for t in texts for w in t.split() if w.startswith("word")})
    hashes = [textkernel.word_tokens(*textkernel.text_buffer(pa.array([w])))[0][0] for w in ("Hello", "hello", "hellO", "12", "77")]
    assert hashes[0] == hashes[1] == hashes[2]
    assert hashes[3] == hashes[4] != hashes[0]
    of = vectors.of(np.array([textkernel.word_tokens(*textkernel.text_buffer(pa.array([w])))[0][0] for w in ("ctxa", "ctxb", "ctxc")]))
    assert np.allclose(np.linalg.norm(of, axis=1), 1, atol=1e-3)
    own = {w: vectors.of(textkernel.word_tokens(*textkernel.text_buffer(pa.array([w.replace("0", "").replace("1", "")])))[0])[0] for w in vocabulary[:50]}
    assert all(np.isfinite(v).all() for v in own.values())


def test_held_out_is_the_stated_remainder(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_chat_sql_says_the_same(spark):
    import duckdb

    from flowlark.llm.queries import OP5_SQL

    rng = random.Random(7)
    rows = []
    for conv in range(30):
        said = []
        for turn in range(rng.randrange(1, 8)):
            lines = []
            for _ in range(rng.randrange(3)):
                quoted = rng.choice(said) if said and rng.random() < 0.8 else f"never said {rng.randrange(9)}"
                lines.append(">" * rng.randint(1, 3) + rng.choice(["", " "]) + quoted.upper())
            own = f"conv {conv} turn {turn} {rng.randrange(3)}"
            said.append(own)
            lines.insert(rng.randrange(len(lines) + 1), own)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join(lines)))
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.sql(OP5_SQL)
    expected = sorted(map(str, (sorted(dict(zip(found.columns, r)).items()) for r in found.fetchall())))
    assert sorted(map(str, (sorted(r.asDict().items()) for r in got))) == expected
    assert any(r.depth > 1 for r in got)
