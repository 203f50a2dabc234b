"""Hard-negative mining: an exact kNN join over Voronoi cells of norm-augmented vectors.

With one more component that brings every row to the norm of the longest, and
a zero there for anchors, the inner product falls as the distance grows:
``d(anchor, row)^2 = |anchor|^2 + M^2 - 2 * score``. Rows and anchors are
assigned to the nearest of a few pivots. An anchor first meets the rows of its
own cell; what it finds there bounds how far its other answers can be. A row is
then copied only to those groups of anchors which it might serve, by the
triangle inequality: ``|row - pivot| - radius <= farthest`` and
``|row - pivot| + radius >= nearest``. Groups are cut into blocks of anchors and
slices of rows, so a task holds a block and a slice, and joins them exactly.

The same join is made twice: for positives (first rows of the same label), and
for negatives (first rows of other labels whose score is in a band under each
positive's score).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.llm.common import discard, stage_table

_LEAST, _MOST = -(1 << 62), 1 << 62
_STEP = 512  # rows of a slice that meet a block at a time


@dataclass(frozen=True)
class Cells:
    """The pivots, as augmented vectors, and what is known of the whole table. ``size`` bounds anchors of a block and rows of a slice."""

    pivots: np.ndarray
    square: float  # M^2, the largest squared norm
    dim: int
    exact: bool  # scores fit float64 without rounding
    size: int
    seen: dict[int, tuple[int, float]] = field(default_factory=dict)  # cell: (anchors, radius)

    def row_distances(self, vectors: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0.0, self.square - (vectors * vectors).sum(1)))
        return np.sqrt(np.maximum(0.0, 2 * self.square - 2 * (vectors @ self.pivots[:, :-1].T + more[:, None] * self.pivots[None, :, -1])))

    def anchor_distances(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.square + (vectors * vectors).sum(1)[:, None] - 2 * vectors @ self.pivots[:, :-1].T))

    @property
    def slack(self) -> float:
        """More than rounding can change a distance by."""
        return 1e-6 * max(1.0, math.sqrt(self.square))

    def blocks(self, cell: int) -> int:
        return max(1, -(-self.seen[cell][0] // self.size)) if cell in self.seen else 0


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; shorter ones are continued by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out, sizes = np.zeros((len(column), dim), dtype=np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def quantised(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part, each once; ``v`` holds ``floor(scale * x)``."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v")).distinct()


def _cells(rows: DataFrame, n_anchors: int, *, least: int, most: int, size: int) -> Cells:
    """Pivots: farthest first among eight times as many rows with the smallest hashes, a sample of at most ``8 * most`` rows."""
    longest, largest, dim = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.max(F.size("v"))).first()
    dim, bound = max(1, dim), max(1, dim) * float(largest or 0.0) ** 2
    if 100 * bound >= 2.0**62:
        raise ValueError("scores of vectors this long do not fit 64 bits")
    n = min(most, max(least, -(-n_anchors // size)))
    sample = matrix(rows.orderBy(F.xxhash64("id", "v"), "id", "label").limit(8 * n).select("v").toArrow().column("v"), dim).astype(np.float64)
    picked = np.concatenate([sample, np.sqrt(np.maximum(0.0, longest - (sample * sample).sum(1)))[:, None]], axis=1)
    chosen, near = [0], ((picked - picked[0]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((picked - picked[chosen[-1]]) ** 2).sum(1))
    return Cells(picked[chosen], float(longest), dim, bound < 2.0**53, size)


def _placed_anchors(rows: DataFrame, cells: Cells, which: Column) -> DataFrame:
    """The anchors with a number ``a``, their cell ``g`` and their distance from its pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = cells.anchor_distances(matrix(batch.column("v"), cells.dim).astype(np.float64))
            g = d.argmin(1) if len(d) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g.astype(np.int32)), pa.array(d[np.arange(len(d)), g])], names=[*batch.schema.names, "g", "d"])

    numbered = rows.where(which).select(F.monotonically_increasing_id().alias("a"), "id", "label", "v")
    return stage_table(numbered.mapInArrow(place, "a long, id long, label long, v array<bigint>, g int, d double"), "anchors")


def _dealt(rows: DataFrame, cells: Cells, bounds: dict[int, tuple[float, float]] | None, slices: dict[int, int] | None) -> DataFrame:
    """Copies of rows by cell, block and slice: to the own cell, or, given ``bounds`` (nearest, farthest), to each other cell they might serve. Without ``slices`` only the cells."""
    known = np.array([c in cells.seen for c in range(len(cells.pivots))])
    radius = np.array([cells.seen.get(c, (0, 0.0))[1] for c in range(len(cells.pivots))]) + cells.slack
    near, far = (np.array([(bounds or {}).get(c, (math.inf, -math.inf))[k] for c in range(len(cells.pivots))]) for k in (0, 1))
    blocks = np.array([cells.blocks(c) for c in range(len(cells.pivots))])
    parts = None if slices is None else np.array([slices.get(c, 1) for c in range(len(cells.pivots))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                piece = batch.slice(start, 2048)
                d = cells.row_distances(matrix(piece.column("v"), cells.dim).astype(np.float64))
                own = d.argmin(1)
                if bounds is None:
                    row, cell = np.arange(len(own)), own
                    row, cell = row[known[cell]], cell[known[cell]]
                else:
                    serves = known[None, :] & (d - radius[None, :] <= far[None, :]) & (d + radius[None, :] >= near[None, :])
                    serves[np.arange(len(own)), own] = False
                    row, cell = np.nonzero(serves)
                if parts is None:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32))], names=["g"])
                    continue
                each = blocks[cell]
                block = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                row, cell = np.repeat(row, each), np.repeat(cell, each)
                taken = piece.take(pa.array(row))
                part = taken.column("h").to_numpy(zero_copy_only=False) % parts[cell]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (cell, block, part)] + [taken.column(c) for c in ("id", "label", "v")], names=["g", "block", "part", "id", "label", "v"])

    return rows.select("id", "label", "v", F.xxhash64("id", "v").alias("h")).mapInArrow(deal, "g int" if slices is None else "g int, block int, part int, id long, label long, v array<bigint>")


def _best(who: np.ndarray, ask: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each (who, ask): high scores first, then small ids."""
    order = np.lexsort((ids, -score, ask, who))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (who[order][1:] != who[order][:-1]) | (ask[order][1:] != ask[order][:-1])
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return order[rank < k]


def answers(anchors: pa.Table, rows: pa.Table, *, k: int, same: bool, dim: int, exact: bool) -> pa.Table:
    """(a, ask, score, id): the first ``k`` rows of ``rows`` for each ask of each anchor, with ``lo <= score <= hi`` and the same (or another) label."""
    kind = np.float64 if exact else np.int64
    q, c = matrix(anchors.column("v"), dim).astype(kind), matrix(rows.column("v"), dim).astype(kind)
    qid, qlabel, a = (anchors.column(n).to_numpy() for n in ("id", "label", "a"))
    cid, clabel = (rows.column(n).to_numpy() for n in ("id", "label"))
    asks = max((len(x) for x in anchors.column("lo").to_pylist()), default=0)
    lo, hi = np.full((len(a), asks), _MOST, dtype=np.int64), np.full((len(a), asks), _LEAST, dtype=np.int64)
    for i, (low, high) in enumerate(zip(anchors.column("lo").to_pylist(), anchors.column("hi").to_pylist())):
        lo[i, : len(low)], hi[i, : len(high)] = low, high
    last = np.full((len(a), asks), np.iinfo(np.int64).max)  # of equal scores, ids below this one can still enter
    held = [np.zeros(0, dtype=np.int64)] * 4
    for start in range(0, len(cid), _STEP):
        score = (q @ c[start : start + _STEP].T).astype(np.int64)
        fits = (qlabel[:, None] == clabel[None, start : start + _STEP]) == same
        if same:
            fits &= qid[:, None] != cid[None, start : start + _STEP]
        hits = []
        for j in range(asks):
            i, col = np.nonzero(fits & (score >= lo[:, j, None]) & (score <= hi[:, j, None]))
            s, ids = score[i, col], cid[start + col]
            enters = (s > lo[i, j]) | (ids < last[i, j])
            hits.append((i[enters], np.full(int(enters.sum()), j), s[enters], ids[enters]))
        held = [np.concatenate([h, *(x[n] for x in hits)]) for n, h in enumerate(held)]
        take = _best(*held, k)
        held = [h[take] for h in held]
        who, ask, s, ids = held
        full = np.zeros((len(a), asks), dtype=np.int64)
        np.add.at(full, (who, ask), 1)
        ends = np.flatnonzero(np.r_[(who[1:] != who[:-1]) | (ask[1:] != ask[:-1]), len(who) > 0])
        ends = ends[full[who[ends], ask[ends]] == k]
        lo[who[ends], ask[ends]], last[who[ends], ask[ends]] = s[ends], ids[ends]
    who, ask, s, ids = held
    return pa.table({"a": pa.array(a[who], pa.int64()), "ask": pa.array(ask.astype(np.int32)), "score": pa.array(s, pa.int64()), "id": pa.array(ids, pa.int64())})


_FOUND = "a long, ask int, score long, id long"


def _met(rows: DataFrame, anchors: DataFrame, cells: Cells, k: int, same: bool, bounds: dict[int, tuple[float, float]] | None) -> DataFrame:
    """The local joins of one round: each block of anchors with each slice of the rows dealt to its cell."""
    spark = rows.sparkSession
    counts = {r.g: r.n for r in _dealt(rows, cells, bounds, None).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    slices = {g: max(1, -(-n // cells.size)) for g, n in counts.items()}
    size = spark.createDataFrame([(g, n, cells.blocks(g)) for g, n in slices.items()], "g int, parts int, blocks int")
    dealt = _dealt(rows, cells, bounds, slices)
    asked = anchors.join(F.broadcast(size), "g").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("g", "block", "part", "a", "id", "label", "v", "lo", "hi")
    dim, exact = cells.dim, cells.exact

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return answers(left, right, k=k, same=same, dim=dim, exact=exact)

    keys = ["g", "block", "part"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(meet, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a", "ask").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_join(rows: DataFrame, anchors: DataFrame, cells: Cells, *, k: int, same: bool) -> DataFrame:
    """(a, ask, score, id, rank): the first ``k`` answers to each ask (``lo`` to ``hi``) of each anchor, over all rows."""
    own = stage_table(_first(_met(rows, anchors, cells, k, same, None), k), "own")
    # an ask that has all its answers need not look beyond the last of them
    worst = own.where(F.col("rank") == k).select("a", "ask", F.col("score").alias("kth"))
    asks = anchors.select("a", "g", "v", F.posexplode(F.arrays_zip("lo", "hi")).alias("ask", "x")).select("a", "g", "v", "ask", "x.lo", "x.hi").where("lo <= hi")
    asks = asks.join(worst, ["a", "ask"], "left").withColumn("lo", F.greatest("lo", F.coalesce("kth", F.lit(_LEAST))))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) + cells.square
    reach = lambda score: F.sqrt(F.greatest(F.lit(0.0), square - 2.0 * score.cast("double")))
    # no bound at all where an ask takes any score
    ends = asks.groupBy("g").agg(F.min(reach(F.col("hi"))).alias("near"), F.max(reach(F.col("lo"))).alias("far"))
    bounds = {r.g: (r.near - cells.slack, r.far + cells.slack) for r in ends.collect()}
    tighter = asks.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("ask", "lo", "hi"))).alias("s"))
    full = anchors.select("a", "id", "label", "v", "g", F.size("lo").alias("m")).join(tighter, "a")
    at = lambda k, name, other: F.coalesce(F.element_at(F.filter("s", lambda x: x["ask"] == k), 1)[name], F.lit(other))
    full = full.select("a", "id", "label", "v", "g", F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: at(k, "lo", _MOST)).alias("lo"), F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: at(k, "hi", _LEAST)).alias("hi"))
    others = _met(rows, full, cells, k, same, bounds)
    out = stage_table(_first(own.select("a", "ask", "score", "id").unionByName(others), k), "answers")
    discard(own)
    return out


def hard_negatives(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, least_cells: int = 8, most_cells: int = 1024, size: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for the rows where ``anchors`` (a condition on ``id``) holds.

    A score is the inner product of vectors of ``floor(scale * x)``. An anchor's
    positives are its first ``positives`` other rows of its label. For each, the
    first ``negatives`` rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score`` are returned. High scores come
    first, then small ids. Nothing is cut off: bounds only leave out rows that
    cannot be an answer.

    Rows with a null id, label or vector, or a null or non-finite component
    take no part; rows alike in id, label and vector count once; an id with
    several vectors or labels is several rows, none of which is an "other" row
    for the same id. Shorter vectors are continued by zeros. Vectors so
    long that a hundred times a score could need more than 62 bits raise an error. An empty table, or one without
    anchors, gives an empty result; other columns are dropped.
    """
    spark, schema = vectors.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stage_table(quantised(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale), "vectors")
    n_anchors = rows.where(anchors).count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    cells = _cells(rows, n_anchors, least=least_cells, most=most_cells, size=size)
    asked = _placed_anchors(rows, cells, anchors)
    cells.seen.update({r.g: (r.n, r.radius) for r in asked.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).collect()})
    found = knn_join(rows, asked.withColumns({"lo": F.array(F.lit(_LEAST)), "hi": F.array(F.lit(_MOST))}), cells, k=positives, same=True)
    # the answers to the first join are the asks of the second, in order of rank; integers throughout
    down = lambda x: F.expr(f"({x} - pmod({x}, 100)) DIV 100")
    bands = found.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", (-down(f"(-{low} * score)")).alias("lo"), down(f"({high} * score)").alias("hi")))).alias("s"))
    bands = bands.select("a", F.transform("s", lambda x: x["lo"]).alias("lo"), F.transform("s", lambda x: x["hi"]).alias("hi"))
    picked = knn_join(rows, stage_table(asked.join(bands, "a"), "bands"), cells, k=negatives, same=False)
    pairs = found.select("a", (F.col("rank") - 1).alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asked.select("a", F.col("id").alias("anchor_id")), "a")
    return picked.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["a", "ask"]).select(*[x.split()[0] for x in schema.split(", ")])
