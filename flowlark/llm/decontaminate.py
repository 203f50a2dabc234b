"""Benchmark decontamination by greedy string tiling.

Test items and documents are sequences of words (runs of letters and digits,
A-Z as a-z). A document and an item meet where they share a seed, a run of
``min_match`` words. For each such pair, running Karp-Rabin greedy string
tiling covers the item with the longest common runs first, each word at most
once, wherever the runs stand; the covered share of the item decides, so a
passage whose parts were put in another order is found as well.

The items are the query set: they are broadcast in blocks of bounded size, and
each block is held against all documents, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import byte_slices, stage_table
from flowlark.llm.textkernel import WORD_BREAKS, text_buffer, window_hash, word_hashes

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, dtype=np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table) if n else table


class RunningHash:
    """Karp-Rabin hashes of all windows of a sequence, of any length, from one running sum."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * _powers(_BASE, n), out=self.sums[1:], dtype=np.uint64)
        self.shift = _powers(_INVERSE, n)

    def windows(self, size: int) -> np.ndarray:
        n = len(self.shift) - size + 1
        return (self.sums[size:] - self.sums[:n]) * self.shift[:n] if n > 0 else np.zeros(0, dtype=np.uint64)


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size]) if len(marked) >= size else np.zeros(0, dtype=np.int64)


_HITS = 1 << 20  # pairs of equal windows that are looked at together


def _matches(pattern: np.ndarray, text: np.ndarray, in_pattern: np.ndarray, in_text: np.ndarray, hash_p: RunningHash, hash_t: RunningHash, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unmarked matches of ``size`` words or more: starts in both sequences, in order, and lengths."""
    free_p, free_t = _free(in_pattern, size), _free(in_text, size)
    none = np.zeros(0, dtype=np.int64)
    if not len(free_p) or not len(free_t):
        return none, none, none
    have_p, have_t = hash_p.windows(size)[free_p], hash_t.windows(size)[free_t]
    order = np.argsort(have_t, kind="stable")
    have_t, places = have_t[order], free_t[order]
    lo, hi = np.searchsorted(have_t, have_p, "left"), np.searchsorted(have_t, have_p, "right")
    hit = np.flatnonzero(hi > lo)
    found = []
    for k in hit.tolist():
        for a in range(int(lo[k]), int(hi[k]), _HITS):
            j = places[a : min(int(hi[k]), a + _HITS)]
            i = np.full(len(j), free_p[k])
            before = (i > 0) & (j > 0)
            before[before] = (pattern[i[before] - 1] == text[j[before] - 1]) & ~in_pattern[i[before] - 1] & ~in_text[j[before] - 1]
            i, j = i[~before], j[~before]  # the others are part of a match that begins earlier
            n, live = np.zeros(len(i), dtype=np.int64), np.arange(len(i))
            while len(live):  # all matches grow by a word at a time
                x, y = i[live] + n[live], j[live] + n[live]
                live, x, y = (v[(x < len(pattern)) & (y < len(text))] for v in (live, x, y))
                live = live[(pattern[x] == text[y]) & ~in_pattern[x] & ~in_text[y]]
                n[live] += 1
            keep = n >= size
            found.append((i[keep], j[keep], n[keep]))
    return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))


def greedy_string_tiling(pattern: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in pattern, start in text, length), none overlapping another in either sequence.

    Longest matches are marked first; of equal ones, that with the smallest
    start in the pattern, then in the text. Matches are maximal runs of equal,
    unmarked words of ``min_match`` or more. Empty sequences have no tiles.
    """
    in_pattern, in_text = np.zeros(len(pattern), dtype=bool), np.zeros(len(text), dtype=bool)
    hash_p, hash_t = RunningHash(pattern), RunningHash(text)
    tiles: list[tuple[int, int, int]] = []
    size = max(min_match, min(len(pattern), len(text)) // 2)
    while min(len(pattern), len(text)) >= min_match:
        starts_p, starts_t, length = _matches(pattern, text, in_pattern, in_text, hash_p, hash_t, size)
        longest = int(length.max()) if len(length) else 0
        if longest > 2 * size:
            size = longest
            continue
        for k in np.flatnonzero(length == longest).tolist() if longest else ():  # the longest only; shorter ones are looked for again among what is left
            i, j = int(starts_p[k]), int(starts_t[k])
            if not in_pattern[i : i + longest].any() and not in_text[j : j + longest].any():
                in_pattern[i : i + longest] = in_text[j : j + longest] = True
                tiles.append((i, j, longest))
        if longest > size:
            continue
        if size == min_match:
            break
        size = max(min_match, size // 2)
    return tiles


def _items(rows: list, min_match: int) -> tuple[list[tuple[int, np.ndarray]], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Items with words, and for each seed length the sorted seeds with their items' places in the list."""
    texts = pa.array([r[1] for r in rows], pa.string())
    words, bounds = word_hashes(*text_buffer(texts), breaks=WORD_BREAKS)
    items, seeds = [], {}
    for (item, _), a, b in zip(rows, bounds[:-1], bounds[1:]):
        if b > a:
            own = words[a:b]
            size = min(min_match, len(own))
            found = np.unique(window_hash(own, size))
            seeds.setdefault(size, []).append((found, np.full(len(found), len(items))))
            items.append((item, own))
    index = {}
    for size, parts in seeds.items():
        values, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        index[size] = values[order], owners[order]
    return items, index


def _around(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The words that seeds cover, in order, with a word that equals no other between separate stretches."""
    covered = np.zeros(len(words) + 1, dtype=bool)
    covered[(at[:, None] + np.arange(size)).ravel()] = True
    place = np.flatnonzero(covered[:-1])
    breaks = np.flatnonzero(np.diff(place) > 1) + 1
    return np.insert(words[place], breaks, np.random.Generator(np.random.PCG64(len(place))).integers(0, 2**63, len(breaks), dtype=np.uint64))


def coverage_of(words: np.ndarray, items: list[tuple[int, np.ndarray]], index: dict[int, tuple[np.ndarray, np.ndarray]], min_match: int) -> Iterator[tuple[int, int, int, int]]:
    """(item, covered words, tiles, words of the item) of each item that shares a seed with the document."""
    for size, (values, owners) in index.items():
        own = window_hash(words, size)
        if len(own) == 0:
            continue
        lo = np.searchsorted(values, own, "left")
        hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == own)
        if len(hit) == 0:
            continue
        hi = np.searchsorted(values, own[hit], "right")
        many = hi - lo[hit]
        place = np.repeat(hit, many)
        owner = owners[np.arange(many.sum()) + np.repeat(lo[hit] - (np.cumsum(many) - many), many)]
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        starts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
        for a, b in zip(starts[:-1], starts[1:]):
            item, pattern = items[owner[a]]
            tiles = greedy_string_tiling(pattern, _around(words, place[a:b], size), min(min_match, len(pattern)))
            yield item, sum(n for _, _, n in tiles), len(tiles), len(pattern)


def _found(column: pa.Array, items: tuple, min_match: int, num: int, den: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, words of the item, covered words, tiles) of texts and items of which num / den or more is covered."""
    words, bounds = word_hashes(*text_buffer(column), breaks=WORD_BREAKS)
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for item, covered, tiles, n in coverage_of(words[a:b], *items, min_match):
            if covered * den >= num * n:
                yield row, item, n, covered, tiles


def _scan(shared, *rule: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                out = list(_found(part.column(1), shared.value, *rule))
                docs = part.column(0).take(pa.array([x[0] for x in out], pa.int64()))
                yield pa.record_batch([docs, *(pa.array([x[k] for x in out], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32())))], names=["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

    return run


def _kept(shared, text: int, *rule: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, text):
                stays = np.ones(part.num_rows, dtype=bool)
                stays[[x[0] for x in _found(part.column(text), shared.value, *rule)]] = False
                yield part.filter(pa.array(stays))

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int, block_chars: int) -> tuple[int, Iterator]:
    """Number of blocks of test items, and the broadcast of each; one is gone before the next comes."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-int(tests.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def each() -> Iterator:
        for k in range(blocks):
            own = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
            shared = spark.sparkContext.broadcast(_items([(r["item"], r["text"]) for r in own], min_match))
            yield shared
            if blocks > 1:
                shared.unpersist()

    return blocks, each()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, num: int = 1, den: int = 2, block_chars: int = 16_000_000) -> DataFrame:
    """Pairs of a document and a test item of which num / den of the words or more are covered by tiles.

    Returns ``doc_id``, ``item_id``, ``item_words``, ``covered_words``,
    ``n_tiles`` and ``coverage``. An item with fewer words than ``min_match``
    must stand there whole. Null and empty texts, on either side, have no pairs;
    so have empty tables. Repeated rows give repeated pairs. Texts are taken
    whole; other columns are ignored. The benchmark is broadcast in blocks of
    about ``block_chars`` characters, each held against all documents; of
    several, each block's pairs are written before the next is read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks, each = _blocks(benchmark, item_col, item_text_col, min_match, block_chars)
    out = None
    for shared in each:
        found = rows.mapInArrow(_scan(shared, min_match, num, den), "doc_id long, item_id long, item_words int, covered_words int, n_tiles int")
        found = found if blocks == 1 else stage_table(found, "tiles")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = 5, num: int = 1, den: int = 2, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` that are in no contaminated pair, all columns as they are, whatever these are called.

    Each row is judged by its own text where it lies, so ids may be null or
    repeated. Null and empty texts stay. Empty tables have no pairs.
    """
    blocks, each = _blocks(benchmark, item_col, item_text_col, min_match, block_chars)
    names, text = docs.columns, docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    for shared in each:
        rows = rows.mapInArrow(_kept(shared, text, min_match, num, den), rows.schema)
        rows = rows if blocks == 1 else stage_table(rows, "tiles")
    return rows.toDF(*names)
