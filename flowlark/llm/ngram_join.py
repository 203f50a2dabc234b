"""N-gram Jaccard self-join of texts as T-occurrence searches.

A document's set holds the hashes of its distinct word n-grams. Documents of
equal sets form one class; only class representatives are searched, so copies
never meet each other. The search runs in three distributed steps:

1. *Index.* Of each representative, the tokens with the smallest hashes go to
   the index: ``factor`` times as many as the prefix that the threshold asks
   for. Two linked sets share so many of them that, whatever the order, they
   share one of the rarest tokens; so only the shortest inverted lists (by
   their number of index entries over the whole corpus) are kept of each
   document, as many as the worst pair of sizes needs (``_picks``). Lists with
   the same members (equal count and xor of members) are one list.
2. *Candidates.* Lengths, and the Hamming distance of parity bitmaps (a lower
   bound of the symmetric difference), rule out pairs without error. First,
   lists are cut into small blocks, long ones in two different ways, and each
   document keeps its nearest earlier partner of each block: one row for each
   entry, one candidate at most, and near copies grow together. Then all pairs
   of a list that are not in one component yet remain; of a long list, the
   members outside of its largest component visit the blocks of the others.
3. *T-occurrence search.* The candidates of a query set form blocks of bounded
   size with inverted lists of their own. Of the lists of the query's tokens
   DivideSkip heap-merges the short ones with the threshold T - L, probes the L
   longest by binary search, and keeps the documents that reach T. These counts
   are the overlaps; the Jaccard threshold is applied to them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlark.llm.common import binary_values, byte_slices, discard, grouped, stage_table
from flowlark.llm.components import connected_components
from flowlark.llm.textkernel import list_column, shingle_sets


def divide_skip(lists: list[np.ndarray], threshold: int, mu: float = 0.01, probes: int = 1 << 18) -> dict[int, int]:
    """Ids that occur in at least ``threshold`` of the sorted ``lists``, with their counts.

    The L longest lists, L = T / (mu log M + 1) and at most T - 1, are set
    aside. The others are heap-merged; ids that occur there T - L times or more
    are looked for in the long lists by binary search, some lists at a time
    (about ``probes`` searches), until the threshold is out of reach. An empty
    input gives no ids; a threshold below 1 counts as 1.
    """
    lists = sorted((x for x in lists if len(x)), key=len)
    threshold = max(1, threshold)
    if len(lists) < threshold:
        return {}
    apart = min(threshold - 1, int(threshold / (mu * math.log(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - apart], lists[len(lists) - apart :]
    merged = np.fromiter(heapq.merge(*(s.tolist() for s in short)), dtype=np.int64)
    starts = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
    counts = np.diff(np.append(starts, len(merged)))
    enough = counts >= threshold - apart
    ids, counts = merged[starts[enough]], counts[enough]
    done = 0
    while done < apart and len(ids):
        part = long[done : done + max(1, probes // len(ids))]
        span = int(max(ids[-1], max(x[-1] for x in part))) + 1
        held = np.concatenate(part) + np.repeat(np.arange(len(part)) * span, [len(x) for x in part])
        wanted = (np.arange(len(part)) * span)[:, None] + ids
        at = np.searchsorted(held, wanted)
        counts = counts + (held[np.minimum(at, len(held) - 1)] == wanted).sum(axis=0)
        done += len(part)
        alive = counts + (apart - done) >= threshold
        ids, counts = ids[alive], counts[alive]
    return {x: n for x, n in zip(ids.tolist(), counts.tolist()) if n >= threshold}


class InvertedLists:
    """The inverted lists of a block of sets: for each token the places of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        self.places = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else order
        self.tokens, self.bounds = tokens[first], np.append(first, len(tokens))

    def of(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of the query's tokens; tokens that no set holds have none."""
        if len(self.tokens) == 0:
            return []
        at = np.searchsorted(self.tokens, query)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == query]
        return [self.places[a:b] for a, b in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist())]


def _needed(a: int | np.ndarray, b: int | np.ndarray, num: int, den: int) -> int | np.ndarray:
    """The least overlap of sets of sizes a and b whose Jaccard similarity is num / den or more."""
    return -(-num * (a + b) // (num + den))


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


@lru_cache(maxsize=1 << 16)
def _picks(n: int, num: int, den: int, factor: int) -> int:
    """How many of the rarest tokens of a set's index must be kept, so that each linked pair keeps a common one.

    Take any order of tokens. Those before the first common token of two
    indexes are in one index only, so a set needs one more than it can have of
    them. If the index of the smaller set a ends first, all its tokens but the
    a - overlap that b lacks are in b's index, and what else is there may be
    in a beyond a's index. If b's ends first, ``_prefix`` is enough for both.
    """
    a = np.arange(max(1, -(-num * n // den)), n + 1)
    overlap = _needed(a, n, num, den)
    a, overlap = a[overlap <= a], overlap[overlap <= a]
    indexed = np.minimum(a, factor * (a - -(-num * a // den) + 1))
    alone = min(n, factor * _prefix(n, num, den)) - (indexed - (a - overlap))
    return max(_prefix(n, num, den), int(alone.max()) + 1)


def _bitmap(tokens: np.ndarray, least: int = 512, most: int = 2048) -> bytes:
    """Parities of the tokens' counts in a power of two of cells, about one or two for each token within ``least`` and ``most``."""
    width = least
    while width < min(len(tokens), most):
        width *= 2
    parity = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _index(size: int, num: int, den: int, factor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                n, s1, s2, keep, tokens, bits = [], [], [], [], [], []
                for s in shingle_sets(part.column(1), size):
                    n.append(len(s))
                    s1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    s2.append(int(np.bitwise_xor.reduce(s * (s | np.uint64(1))).view(np.int64)) if len(s) else 0)
                    keep.append(_picks(len(s), num, den, factor) if len(s) else 0)
                    tokens.append(s[: factor * _prefix(len(s), num, den)] if len(s) else s)
                    bits.append(_bitmap(s) if len(s) else b"")
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keep, pa.int32()), list_column(tokens, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "keep", "tokens", "bits"])

    return run


INDEX_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, keep int, tokens array<long>, bits binary"


def _folded(bits: list[np.ndarray], width: int) -> np.ndarray:
    """Bitmaps as rows of uint64, wider ones folded to ``width`` bytes: parities of the coarser cells."""
    return np.stack([b if len(b) == width else np.bitwise_xor.reduce(b.reshape(-1, width), axis=0) for b in bits]).view(np.uint64)


def _close(sizes: np.ndarray, bits: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, later rows, distances, which pairs may be linked), in bounded pieces, of sets in ascending order of size.

    A pair counts at the narrower bitmap; widths grow with size.
    """
    wide = np.array([len(b) for b in bits])
    for width in np.unique(wide).tolist():
        first = int(np.searchsorted(wide, width))
        own = np.arange(first, int(np.searchsorted(wide, width, side="right")))
        matrix = _folded(bits[first:], width)
        upto = np.searchsorted(sizes, sizes[own] * den // num, side="right")
        step = max(1, (1 << 21) // (matrix.shape[1] * max(1, len(matrix))))
        for k in range(0, len(own), step):
            mine = own[k : k + step]
            later = np.arange(int(mine[0]) + 1, int(upto[k : k + step].max()))
            if len(later) == 0:
                continue
            away = np.bitwise_count(matrix[mine - first, None, :] ^ matrix[None, later - first, :]).sum(axis=2, dtype=np.int64)
            a, b = sizes[mine][:, None], sizes[later][None, :]
            yield mine, later, away, (later > mine[:, None]) & (away <= a + b - 2 * _needed(a, b, num, den)) & (b * num <= a * den)


def _ordered(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    ids, sizes = group.column("cls").to_numpy(), group.column("n_shingles").to_numpy()
    order = np.lexsort((ids, sizes))
    return order, ids[order], sizes[order], binary_values(group.column("bits").take(pa.array(order)), np.uint8)


def _earlier(group: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest one before it in order of size and id, member) of each member that has one that may be linked to it."""
    _, ids, sizes, bits = _ordered(group)
    best, partner = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), dtype=np.int64)
    for mine, later, away, ok in _close(sizes, bits, num, den):
        away = np.where(ok, away, np.iinfo(np.int64).max)
        at = away.argmin(axis=0)
        least = away[at, np.arange(len(later))]
        better = least < best[later]
        best[later[better]], partner[later[better]] = least[better], mine[at[better]]
    has = best < np.iinfo(np.int64).max
    return ids[partner[has]], ids[has]


def _apart(group: pa.Table, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that may be linked and are not in one component; of a cut list, those of a visitor and a resident."""
    order, ids, sizes, bits = _ordered(group)
    comp, side = group.column("comp").to_numpy()[order], group.column("side").to_numpy()[order]
    left, right = [ids[:0]], [ids[:0]]
    if len(ids) > 1 and (comp != comp[0]).any():
        for mine, later, _, ok in _close(sizes, bits, num, den):
            ok &= (comp[mine][:, None] != comp[later]) & ((side[mine][:, None] == 0) | (side[mine][:, None] != side[later]))
            i, j = np.nonzero(ok)
            left.append(ids[mine[i]])
            right.append(ids[later[j]])
    return np.concatenate(left), np.concatenate(right)


def _candidates(find, keys: list[str], num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            a, b = find(group, num, den)
            for at in range(0, len(a), 50_000):
                yield pa.record_batch([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], names=["a", "b"])

    return run


def linked_sets(query: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(place, overlap) of the sets whose Jaccard similarity with the query is num / den or more."""
    least = min((_needed(len(query), len(s), num, den) for s in sets), default=1)
    found = divide_skip(InvertedLists(sets).of(query), int(least)) if sets else {}
    return [(k, o) for k, o in sorted(found.items()) if den * o >= num * (len(query) + len(sets[k]) - o)]


def _search(num: int, den: int, most: int = 1 << 20):
    """T-occurrence search of the candidates of each query set, in blocks of about ``most`` tokens; the query's own row comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, own, ids, sets, size = None, None, [], [], 0

        def links() -> pa.RecordBatch:
            got = linked_sets(own, sets, num, den)
            return pa.record_batch([pa.array([query[0]] * len(got), pa.int64()), pa.array([ids[k] for k, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=["a", "b", "overlap"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "chunk", "role", "b")]
            for a, chunk, role, b, tokens in zip(*columns, binary_values(batch.column("tokens"), np.uint64)):
                if role == 0 or size >= most:
                    if ids:
                        yield links()
                    ids, sets, size = [], [], 0
                if role == 0:
                    query, own = (a, chunk), tokens
                elif (a, chunk) == query:
                    ids.append(b)
                    sets.append(tokens)
                    size += len(tokens)
        if ids:
            yield links()

    return run


def id_bitmap(ids: DataFrame, column: str, most_bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of the hashes of ``ids``: 16 cells for each id, ``most_bits`` at most, whatever the input.

    It only spares work: a join with the ids must follow, as some others pass.
    """
    bits = 1 << 16
    n = ids.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    cells = ids.select(F.pmod(F.xxhash64(column), F.lit(bits)).alias("cell"))
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 64 AS INT)))").alias("bits")).toPandas()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return bitmap


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes % np.int64(len(bitmap) * 64)
    return (bitmap[cell >> 6] >> (cell & 63)) & 1 == 1


def _sets(size: int, shared):
    """Sets of the documents (id, hash of the id, text) whose hash the broadcast bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(_in_bitmap(shared.value, whole.column(1).to_numpy(zero_copy_only=False)))).drop_columns([whole.schema.names[1]])
            for part in byte_slices(batch, 1):
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(part.column(1), size)], pa.binary())], names=["cls", "tokens"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, most: int = 128) -> DataFrame:
    """The links among ``pairs``. A query with more than ``most`` candidates is searched in chunks, in several tasks.

    Pairs have their earlier member, by size and id, as query: that one may be
    the nearest of many, while each later one has few.
    """
    pairs = pairs.where("a <> b").distinct()
    many = pairs.groupBy("a", F.pmod(F.xxhash64("a"), F.lit(2)).alias("h")).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("chunks")).where("chunks > 1").select("a", "chunks")
    pairs = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0).cast("bigint")).alias("chunk"))
    pairs = stage_table(pairs, "pairs")
    own = pairs.select("a", "chunk").distinct().join(sets.withColumnRenamed("cls", "a"), "a").select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("b"), "tokens")
    others = pairs.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "chunk", F.lit(1).alias("role"), "b", "tokens")
    dealt = own.unionByName(others).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "b")
    links = stage_table(dealt.mapInArrow(_search(num, den), "a long, b long, overlap long"), "links")
    discard(pairs)
    return links


def _searchable(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int, factor: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of the rows with their classes, of the lists' entries, of the ids in them and of these ids' sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = stage_table(texts.mapInArrow(_index(size, num, den, factor), INDEX_SCHEMA), "ngrams", wide=True)
    # grouped by three keys, joined by two: both sides are dealt anew, and a hot class can be split
    classes = index.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("class_id")).select("s1", "s2", "class_id")
    members = index.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    members = stage_table(members.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")), "members")
    reps = members.where("n_shingles > 0 AND doc_id = class_id").select("doc_id").distinct()
    heads = index.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "cls")
    heads = stage_table(heads.select("cls", "n_shingles", "keep", "tokens", "bits"), "heads", wide=True)
    discard(index)

    postings = heads.select("cls", (F.size("tokens") - F.col("keep")).alias("spare"), F.explode("tokens").alias("token"))
    lists = postings.groupBy("token", F.pmod("token", F.lit(2)).alias("h")).agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("cls")).alias("list")).where("df > 1")
    shared = postings.join(lists.select("token", "df", "list"), "token")
    # the rarest tokens of each document, all but the ``spare`` most frequent ones; those that no other document has come first and need no list
    commonest = Window.partitionBy("cls").orderBy(F.desc("df"), F.desc("list"), F.desc("token"))
    rare = shared.withColumn("place", F.row_number().over(commonest)).where("place > spare").select("cls", "list").distinct()
    entries = rare.join(heads.select("cls", "n_shingles", "bits"), "cls").select("cls", "n_shingles", "bits", "list")
    several = entries.groupBy("list", F.pmod("list", F.lit(2)).alias("h")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = stage_table(entries.join(several.select("list", "m"), "list"), "entries")
    discard(heads)

    searched = stage_table(entries.select("cls").distinct(), "searched")
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(searched, "cls"))
    sets = texts.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_sets(size, bitmap), "cls long, tokens binary")
    sets = stage_table(sets.join(searched, "cls", "left_semi").dropDuplicates(["cls"]), "sets", wide=True)
    return members, entries, searched, sets


def _near_pairs(entries: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """A candidate for each entry: as many rows as entries, twice as many of lists that are cut."""
    parts = F.ceil(F.col("m") / F.lit(block))
    rows = entries.select("list", "cls", "n_shingles", "bits", "m", F.explode(F.when(F.col("m") > block, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("way"))
    rows = rows.select("list", (F.pmod(F.xxhash64("cls", "list", "way"), parts) + F.col("way") * parts).alias("blk"), "cls", "n_shingles", "bits")
    dealt = rows.repartition("list", "blk").sortWithinPartitions("list", "blk")
    return dealt.mapInArrow(_candidates(_earlier, ["list", "blk"], num, den), "a long, b long")


def _other_pairs(entries: DataFrame, comps: DataFrame | None, num: int, den: int, block: int) -> DataFrame:
    """All pairs that may be linked and are not in one component of ``comps`` (null: each is its own).

    A list of up to ``block`` members is one group. In a longer one, members
    are residents of blocks, and those outside of the list's largest component
    visit every block, in blocks as well: few of them cost few rows.
    """
    rows = entries.withColumn("comp", F.col("cls"))
    if comps is not None:
        rows = entries.join(comps, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    shares = rows.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("list", F.pmod("list", F.lit(2)).alias("h")).agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("top"), F.sum("n").alias("total")).where("top < total")
    rows = rows.join(mixed.select("list", "major", "top"), "list")
    parts, guests = F.ceil(F.col("m") / F.lit(block)).cast("int"), F.ceil((F.col("m") - F.col("top")) / F.lit(block)).cast("int")
    place = F.struct(F.pmod(F.xxhash64("cls", F.lit(5)), parts).cast("int").alias("r"), F.pmod(F.xxhash64("cls", F.lit(7)), guests).cast("int").alias("v"))
    rows = rows.select("list", "cls", "n_shingles", "comp", "bits", "m", parts.alias("k"), guests.alias("g"), (F.col("comp") != F.col("major")).alias("guest"), place.alias("p"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda r, v, side: F.struct(r.alias("rb"), v.alias("vb"), F.lit(side).alias("side"))
    resident = F.transform(upto("g"), lambda v: group(F.col("p")["r"], v, 1))
    visitor = F.when(F.col("guest"), F.transform(upto("k"), lambda r: group(r, F.col("p")["v"], 2))).otherwise(F.array().cast("array<struct<rb:int,vb:int,side:int>>"))
    alone = F.array(group(F.lit(0), F.lit(0), 0))
    rows = rows.select("list", "cls", "n_shingles", "comp", "bits", F.explode(F.when(F.col("m") <= block, alone).otherwise(F.concat(resident, visitor))).alias("at"))
    rows = rows.select("list", "at.rb", "at.vb", "at.side", "cls", "n_shingles", "comp", "bits")
    dealt = rows.repartition("list", "rb", "vb").sortWithinPartitions("list", "rb", "vb")
    return dealt.mapInArrow(_candidates(_apart, ["list", "rb", "vb"], num, den), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, factor: int = 2, block: int = 512, near_block: int = 128) -> DataFrame:
    """Classes and components of the documents whose n-gram sets have a Jaccard similarity of num / den or more.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``class_id`` (the
    smallest id with an equal set) and ``component_id`` (the smallest id
    reachable by links). Null and empty texts, or texts without a word, have
    empty sets and are linked with nothing. Texts of fewer than ``size`` words
    are one shingle. Long texts are taken whole; other columns are ignored. Ids
    must not repeat with different texts; repeated equal rows stay repeated.
    An empty table gives an empty result. Rows with a null id give null ids.
    """
    members, entries, searched, sets = _searchable(docs, id_col, text_col, size, num, den, factor)
    near = _verified(_near_pairs(entries, num, den, near_block), sets, num, den)
    first = connected_components(near).select(F.col("node").alias("cls"), "component")
    first = stage_table(first, "components")
    rest = _verified(_other_pairs(entries, first, num, den, block), sets, num, den)
    discard(near, entries, sets, searched)
    merged = rest.join(first.select(F.col("cls").alias("a"), F.col("component").alias("ca")), "a", "left").join(first.select(F.col("cls").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected_components(merged.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = stage_table(merged.select(F.col("node").alias("component"), F.col("component").alias("final")), "components")
    # a left join, unlike a full one, lets Spark split the members of a large component
    labels = first.join(merged, "component", "left").select(F.col("cls").alias("class_id"), F.coalesce("final", "component").alias("component_id"))
    later = merged.join(first.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("class_id"), F.col("final").alias("component_id"))
    labels = labels.unionByName(later)
    labels = labels.groupBy("class_id", F.pmod("class_id", F.lit(2)).alias("h")).agg(F.min("component_id").alias("component_id"))
    out = members.join(labels.select("class_id", "component_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def ngram_jaccard_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100, factor: int = 2, block: int = 512) -> DataFrame:
    """Every link of ``ngram_jaccard_join``: ``a`` < ``b``, class ids of different sets, and the ``overlap`` of these.

    All candidate pairs are verified, those within one component too, so a
    group of m mutually linked sets gives m (m - 1) / 2 rows. Documents of one
    class have equal links and are not paired with each other.
    """
    members, entries, searched, sets = _searchable(docs, id_col, text_col, size, num, den, factor)
    links = _verified(_other_pairs(entries, None, num, den, block), sets, num, den)
    discard(members, entries, sets, searched)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap")
