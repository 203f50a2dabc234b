import random
import re

import numpy as np
import pytest

from flowlark.llm import components, ngram_join

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, num, den):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            o = len(s & t)
            if s and t and den * o >= num * (len(s) + len(t) - o):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def near_corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "two  words"), (7, "ünï CÖDE é"), (8, "ünï cÖde é")]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((12, 40, 120, 400)))]
        if rng.random() < 0.4:
            base += passage
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randrange(12)):
            rows.append((len(rows), edited(rng, base, rng.randrange(6))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "num", "den", "block"), [(3, 90, 100, 1024), (3, 90, 100, 4), (5, 80, 100, 1024), (1, 50, 100, 7), (2, 20, 100, 5)])
def test_join_equals_brute_force(spark, size, num, den, block):
    rows = near_corpus(size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs, size=size, num=num, den=den, block=block, near_block=min(block, 128)).collect()}
    assert got == brute(rows, size, num, den)


@pytest.mark.parametrize(("size", "num", "den", "most"), [(3, 90, 100, 90), (5, 80, 100, 45), (2, 70, 100, 30)])
def test_pairs_of_all_sizes_at_the_threshold(spark, size, num, den, most):
    rows, linked = [], {}
    for b in range(1, most + 1):
        for a in range(1, b + 1):
            o = -(-num * (a + b) // (num + den))
            if o > a:
                continue
            base = [f"p{len(rows)}x{k}" for k in range(o + size - 1)]
            i = len(rows)
            rows += [(i, " ".join(base + [f"a{i}x{k}" for k in range(a - o)])), (i + 1, " ".join(base + [f"b{i}x{k}" for k in range(b - o)]))]
            linked[i] = linked[i + 1] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs, size=size, num=num, den=den).collect()}
    assert got == linked


@pytest.mark.parametrize(("num", "den", "factor"), [(90, 100, 2), (80, 100, 2), (90, 100, 1), (70, 100, 3), (1, 2, 2)])
def test_index_keeps_a_common_list_for_every_pair_of_sizes(num, den, factor):
    # x and y tokens that are in one set only stand before the common ones in the indexes; the rarest are those
    prefix = lambda n: min(n, factor * (n - -(-num * n // den) + 1))
    for b in range(1, 301):
        for a in range(1, b + 1):
            o = -(-num * (a + b) // (num + den))
            if o > a:
                continue
            x, y = np.arange(a - o + 1)[:, None], np.arange(b - o + 1)[None, :]
            x, y = np.minimum(x, prefix(a)), np.minimum(y, prefix(b))
            common = np.minimum(prefix(a) - x, prefix(b) - y)
            assert common.min() >= 1
            assert (prefix(a) - common).max() < ngram_join._picks(a, num, den, factor)
            assert (prefix(b) - common).max() < ngram_join._picks(b, num, den, factor)


def test_links_whose_common_shingles_are_frequent(spark):
    # fillers hold the common words, so that the tokens of one set only are the rarest
    rng, rows, linked = random.Random(12), [], {}
    for k in range(40):
        b = rng.randrange(5, 40)
        a = rng.randrange(-(-9 * b // 10), b + 1)
        o = -(-90 * (a + b) // 190)
        if o > a:
            continue
        base = [f"c{k}x{j}" for j in range(o + 2)]
        i = len(rows)
        rows += [(i, " ".join(base + [f"a{i}x{j}" for j in range(a - o)])), (i + 1, " ".join([f"b{i}x{j}" for j in range(b - o)] + base))]
        rows += [(i + 2 + j, " ".join(base[:-1] + [f"f{i}x{j}x{n}" for n in range(5 * o)])) for j in range(6)]
        linked[i] = linked[i + 1] = i
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert {i: got[i] for i in linked} == linked
    assert got == {i: c for i, (_, c) in brute(rows, 3, 90, 100).items()}


def test_rows_grow_with_a_group_of_near_copies_in_proportion(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    for m in (200, 800):
        docs = spark.createDataFrame([(k, edited(rng, base, 2)) for k in range(m)], "doc_id long, text string")
        _, entries, _, sets = ngram_join._searchable(docs, "doc_id", "text", 3, 90, 100, 2)
        near = ngram_join._near_pairs(entries, 90, 100, 64)
        assert near.count() <= 2 * entries.count() <= 2 * m * 60
        comps = components.connected_components(ngram_join._verified(near, sets, 90, 100)).withColumnRenamed("node", "cls")
        assert comps.select("component").distinct().count() == 1
        assert ngram_join._other_pairs(entries, comps, 90, 100, 64).count() == 0


def test_eleven_words_and_one_more(spark):
    words = [[f"e{k}x{i}" for i in range(12)] for k in range(20)]
    rows = [(2 * k + more, " ".join(w[: 11 + more])) for k, w in enumerate(words) for more in (0, 1)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_a_large_group_of_near_copies_and_of_copies(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, edited(rng, base, rng.randrange(1, 9))) for k in range(300)] + [(300 + k, " ".join(base)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(docs, block=64).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_links_are_all_pairs_of_classes(spark):
    rows = near_corpus(3)
    sets = {}
    for i, t in sorted(rows):
        sets.setdefault(frozenset(shingles(t, 3)), i)
    want = {(i, j, len(s & t)) for s, i in sets.items() for t, j in sets.items() if i < j and 100 * len(s & t) >= 90 * len(s | t) and s and t}
    assert len(want) > len({j for _, j, _ in want})  # more links than a forest has
    got = [tuple(r) for r in ngram_join.ngram_jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_repeated_and_clashing(spark):
    schema = "doc_id long, text string, component_id string, cls int, tokens string"
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d", "x", 1, "y")] * 2 + [(0, "A b C d", None, None, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (1, 2, 0)]


def test_very_long_text(spark):
    rng = random.Random(2)
    long = [f"x{rng.randrange(10**5)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, edited(rng, long, 500)), (3, " ".join(long[:30_000]))]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_divide_skip_equals_counting():
    rng = random.Random(4)
    for n in range(500):
        lists = [np.array(sorted(rng.sample(range(40), rng.choice((0, 1, 3, 20, 40))))) for _ in range(rng.randrange(12))]
        t = rng.randrange(0, 10)
        counts = {}
        for x in lists:
            for k in x.tolist():
                counts[k] = counts.get(k, 0) + 1
        assert ngram_join.divide_skip(lists, t, probes=1 + n) == {k: n for k, n in counts.items() if n >= max(1, t)}


def test_search_counts_by_inverted_lists_alone():
    rng = random.Random(8)
    for _ in range(200):
        sets = [np.array(sorted(rng.sample(range(60), rng.choice((0, 1, 20, 50)))), dtype=np.uint64) for _ in range(rng.randrange(1, 30))]
        query = np.array(sorted(rng.sample(range(60), rng.choice((1, 20, 50)))), dtype=np.uint64)
        num = rng.choice((30, 60, 90))
        overlap = [len(set(query.tolist()) & set(s.tolist())) for s in sets]
        want = [(k, o) for k, (s, o) in enumerate(zip(sets, overlap)) if o and 100 * o >= num * (len(query) + len(s) - o)]
        assert ngram_join.linked_sets(query, sets, num, 100) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(5, 5), (7, 6), (None, 3), (300, 301), (301, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
