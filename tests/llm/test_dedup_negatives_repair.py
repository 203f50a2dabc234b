"""Exact dedup, hard negatives and conversation repair against brute force and SQL, on odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlark.llm import dedup, negatives, queries, repair

SPACES = " \t\n\x0b\x0c\r"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def sql(query, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.register(name, pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(columns)}))
    out = con.sql(query)
    return [dict(zip(out.columns, r)) for r in out.fetchall()]


# --- exact dedup --------------------------------------------------------------------------------------------------

DOCS = [("doc_id", pa.int64()), ("text", pa.string())]


def test_dedup_matches_sql_with_frequent_and_rare_groups(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "Ab", "a\x85b", "a\xa0b", "é ü", "eé", "x" * 50_000, "x" * 50_000 + " "]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(1000 + k, "the same") for k in range(400)] + [(2000 + k, f"own {k}") for k in range(300)]
    rng.shuffle(rows)
    want = sorted(repr(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256"))) for r in sql(queries.OP12_SQL, documents=(DOCS, rows)))
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, digest int, place string").repartition(5)
    for support in (1 / 256, 1 / 3, 1e-4):
        assert rows_of(dedup.duplicate_groups(docs, support=support)) == want
    kept = dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(int(w[1:].split(",")[0]) for w in want if ", True, " in w)


def test_dedup_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "a"), (None, "a "), (None, "b"), (None, "b"), (4, "a")], "doc_id long, text string")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.duplicate_groups(docs).collect()]
    assert sorted(got, key=repr) == sorted([(5, None, 4, False), (5, None, 4, False), (None, None, 4, True), (4, None, 4, False), (None, None, 2, True), (None, None, 2, False)], key=repr)
    assert sorted((r.doc_id is None, r.text) for r in dedup.exact_dedup(docs).collect()) == [(True, "a "), (True, "b")]
    assert dedup.duplicate_groups(docs.limit(0)).collect() == [] and dedup.exact_dedup(docs.limit(0)).collect() == []


def test_frequent_digests_hold_every_frequent_one(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(-2)).otherwise(F.col("id")).alias("key")).repartition(7)
    found = dedup.frequent_digests(rows, 1 / 100)
    assert {-1, -2} <= set(found) and len(found) <= 100


# --- hard negatives -----------------------------------------------------------------------------------------------


def brute_negatives(rows, positives=5, negatives_=10):
    seen = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, label, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for i, label, v in seen:
        if i % 100:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        scored = sorted((-score(w), j, lab) for j, lab, w in seen)
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            near = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives_]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(near)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("size,cells,dim,spread", [(4096, 8, 6, 0.3), (3, 2, 2, 0.05), (2, 5, 3, 1.0), (7, 1, 4, 0.5)])
def test_negatives_equal_brute_force(spark, size, cells, dim, spread):
    rng = random.Random(size)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for k in range(500):
        v = [c + rng.gauss(0, spread) for c in rng.choice(centres)]
        rows.append((k * rng.choice([1, 5, 20, 100]), v, rng.choice([0, 1, 2])))
    rows += [(100, rows[0][1], 1)] * 5 + [(10_000 + k, rows[1][1], k % 3) for k in range(60)]  # a vector that is frequent
    rows += [(200, None, 1), (None, [0.1] * dim, 1), (300, [0.1] * dim, None), (400, [None] * dim, 1), (500, [float("nan")] * dim, 2), (600, [float("inf")] * dim, 2), (700, [], 1), (800, [0.5], 2)]
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in v] if v is not None else None, lab, "q") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, g string").repartition(3)
    got = negatives.hard_negatives(df, F.col("id") % 100 == 0, size=size, least_cells=cells, most_cells=16)
    assert rows_of(got) == brute_negatives(rows)


def test_negatives_match_sql_and_odd_tables(spark, sf_dir):
    got = queries.op13_hard_negatives(spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.OP13_SQL)
    assert want.columns == got.columns and rows_of(got) == sorted(map(repr, want.fetchall())) and got.count() > 100
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty, F.col("id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0], 1)], empty.schema)
    assert negatives.hard_negatives(one, F.col("id") % 100 == 0).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e9], 1)], empty.schema), F.col("id") % 100 == 0)


def test_bounds_leave_rows_out_where_cells_are_apart(spark):
    rng = random.Random(1)
    rows = [(k, [10.0 * (k % 8 == d) + rng.gauss(0, 0.01) for d in range(8)], k % 3) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    table = negatives.stage_table(negatives.quantised(df, id_col="vec_id", vector_col="embedding", label_col="label", scale=256), "v")
    cells = negatives._cells(table, 8, least=8, most=16, size=4096)
    asked = negatives._placed_anchors(table, cells, F.col("id") % 100 == 0)
    cells.seen.update({r.g: (r.n, r.radius) for r in asked.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()})
    all_ = {g: (-math.inf, math.inf) for g in cells.seen}
    near = {g: (0.0, 300.0) for g in cells.seen}
    assert negatives._dealt(table, cells, all_, None).count() == 800 * len(cells.seen) - negatives._dealt(table, cells, None, None).count()
    assert negatives._dealt(table, cells, near, None).count() < 800 * len(cells.seen) / 2


# --- conversation repair ------------------------------------------------------------------------------------------

CONV = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_repair(rows):
    """Every audit of at most two inserts in a row, for short conversations."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *(b" " if x is None else x.encode() for x in r[1:])))
    seen, faults = set(), []
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    best = None
    options = [[("D", 4)] + ([] if f in "bd" else [("K", 3 * (f == "t")), ("R", 3 + 3 * (f == "t"))]) for f in faults]
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for chosen in itertools.product(*options):
            audit, cost, roles, lines = "I" * inserts[0], 3 * sum(inserts) + sum(c for _, c in chosen), [None] * inserts[0], [""] * inserts[0]
            for (edit, _), (_, role, text), more in zip(chosen, rows, inserts[1:]):
                audit += edit + "I" * more
                if edit != "D":
                    roles.append(role if edit == "K" else None)
                    lines.append(text)
                roles += [None] * more
                lines += [""] * more
            if best is not None and (cost, audit) >= best[:2]:
                continue
            led = bool(roles) and (roles[0] or "").startswith("s")
            want = ["assistant" if (k - led) % 2 else "user" for k in range(len(roles))]
            if led:
                want[0] = roles[0]
            if (len(roles) - led) % 2 or (led and len(roles) == 1) or any(r is not None and r[:1] != w[:1] for r, w in zip(roles, want)):
                continue
            best = (cost, audit, "\n".join(f"{r or w}:{x}" for r, w, x in zip(roles, want, lines)))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def some_rows(rng, convs, most):
    texts = [None, "", " \n", "Yes.", "No!", "why?\t", "cut", "cut off \x0b", "e\x85", "Yes. "]
    rows = []
    for c in range(convs):
        for _ in range(rng.randint(0, most)):
            rows.append((c if c else None, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "under"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1, 256])
def test_repair_equals_trying_everything(spark, block):
    rows = some_rows(random.Random(block), 60, 4)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, c int, rank string").repartition(3)
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    want = sorted(repr((c, *plain_repair(r))) for c, r in by.items())
    assert rows_of(repair.repair_conversations(df, block=block)) == want


@pytest.mark.parametrize("block", [3, 256])
def test_damaged_conversations_match_sql(spark, block):
    rng = random.Random(9)
    rows = some_rows(rng, 300, 9) + [(9999, k, rng.choice(["user", "assistant", "system"]), f"line {k % 40}{rng.choice(['.', ''])}") for k in range(700)]
    want = sorted(repr(tuple(r[n] for n in NAMES)) for r in sql(queries.OP11_SQL, conversations=(CONV, rows)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.with_untouched(repair.repair_conversations(repair.damaged(df), block=block), df)
    assert got.columns == list(NAMES) and rows_of(got) == want


def test_repaired_turns_hash_to_the_digest(spark):
    df = spark.createDataFrame(some_rows(random.Random(4), 80, 6), "conv_id long, turn long, role string, text string")
    turns = repair.repaired_turns(df, block=4).orderBy("conv_id", "block", "place").collect()
    lines, audit = defaultdict(list), defaultdict(str)
    for r in turns:
        audit[r.conv_id] += r.edit
        if r.role is not None:
            lines[r.conv_id].append(f"{r.role}:{r.text}")
            assert r.role[:1] in "sua"
    for r in repair.repair_conversations(df, block=3).collect():
        assert audit[r.conv_id] == r.audit and hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
        roles = "".join(x[0] for x in lines[r.conv_id])
        assert re.fullmatch(r"(s?(ua)+)?", roles)


def test_repair_of_nothing_and_far_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert repair.repair_conversations(empty).collect() == [] and repair.repaired_turns(empty).collect() == []
    got = repair.repair_conversations(spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], schema)).first()
    assert got.gaps is None and got.audit == "KK"
    long = repair.repair_conversations(spark.createDataFrame([(1, 0, "user", "w " * 300_000 + "."), (1, 1, "assistant", "é" * 100_000 + "!")], schema)).first()
    assert long.cost == 0
