"""A toxicity classifier with counterfactual regularisation.

Logistic regression over hashed words and word beginnings that occur in a text.
Where a labelled text names a group, the name is swapped for those of other
groups of its kind, and the squared change of the score (its logit) is added to the
loss: a name alone then cannot carry weight, which keeps neutral mentions from
being taken for toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import byte_slices
from flowlark.llm.labelled import held_out, training_rows
from flowlark.llm.textkernel import WORD_BREAKS, prefix_hashes, text_buffer, word_hashes, word_spans

#: Names of groups by kind; a name is swapped for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "trans people", "nonbinary people"),
    ("woman", "man"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "locals", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young"),
)
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word and word beginning; repeats are kept."""
    data, offsets = text_buffer(column)
    start, length, doc = word_spans(data, offsets)
    words, _ = word_hashes(data, offsets, breaks=WORD_BREAKS)
    docs, hashes = [doc], [words]
    for size in PREFIXES:
        long = np.flatnonzero(length > size)
        docs.append(doc[long])
        hashes.append(prefix_hashes(data, start[long], size))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(44)).astype(np.int64)


def _once(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def counterfactuals(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[str]:
    """The text with its group names swapped: for the next and the next but one of their kind, and for none.

    Swaps among names alone would let all names carry the same weight.
    """
    kind = {t: (k, i) for k, group in enumerate(terms) for i, t in enumerate(group)}
    pattern = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, kind), key=len, reverse=True)) + r")\b", re.IGNORECASE)
    if not pattern.search(text):
        return []

    def swapped(step: int):
        def put(m: re.Match) -> str:
            if not step:
                return ""
            k, i = kind[m[0].lower()]
            other = terms[k][(i + step) % len(terms[k])]
            return m[0] if other == m[0].lower() else other

        return put

    return list(dict.fromkeys(x for step in (1, 2, 0) if (x := pattern.sub(swapped(step), text)) != text))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of buckets and an intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        dense = np.zeros(BUCKETS, dtype=np.float32)
        dense[self.buckets] = self.weights
        return dense


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for part in byte_slices(batch, 0):
            label = part.column(1).to_numpy(zero_copy_only=False)
            doc, bucket = _once(*features(part.column(0)))
            for k in (0, 1):
                counts[k] += np.bincount(bucket[label[doc] == k], minlength=BUCKETS)
    seen = np.flatnonzero(counts.sum(axis=0))
    for at in range(0, len(seen), 100_000):
        part = seen[at : at + 100_000]
        yield pa.record_batch([pa.array(part), pa.array(counts[0][part]), pa.array(counts[1][part])], names=["bucket", "n0", "n1"])


def _examples(chosen: np.ndarray, terms: tuple[tuple[str, ...], ...]):
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))

    def of(texts: list[str]) -> list[list[int]]:
        doc, bucket = features(pa.array(texts, pa.string()))
        own = place[bucket]
        doc, own = _once(doc[own >= 0], own[own >= 0])
        return [x.tolist() for x in np.split(own, np.searchsorted(doc, np.arange(1, len(texts))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0, 1 << 19):
                texts = [t or "" for t in part.column(0).to_pylist()]
                labels = part.column(1).to_pylist()
                swaps = [counterfactuals(t, terms) for t in texts]
                flat = [s for group in swaps for s in group]
                found = iter(of(flat)) if flat else iter(())
                yield pa.record_batch([pa.array(labels, pa.int32()), pa.array(of(texts), pa.list_(pa.int32())), pa.array([[next(found) for _ in group] for group in swaps], pa.list_(pa.list_(pa.int32())))], names=["label", "own", "swapped"])

    return run


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter((k for r in rows for k in r), dtype=np.int64)


def fit(labels: np.ndarray, own: list[list[int]], swapped: list[list[list[int]]], size: int, *, penalty: float = 5.0, ridge: float = 0.1, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam on the balanced log loss, ``ridge`` / rows |w|^2 and ``penalty`` times the mean squared change of logits."""
    weights, bias = np.zeros(size), 0.0
    if len(labels) == 0:
        return weights, -1.0
    row, col = _csr(own)
    pairs = [(i, s) for i, group in enumerate(swapped) for s in group]
    of, (row2, col2) = np.array([i for i, _ in pairs], dtype=np.int64), _csr([s for _, s in pairs])
    n, share = len(labels), labels.mean()
    cost = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    cost /= cost.sum()
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        logit = np.bincount(row, weights[col], n) + bias
        at = cost * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels)
        extra = np.zeros(0)
        if len(of):
            gap = 2 * penalty * (logit[of] - np.bincount(row2, weights[col2], len(of)) - bias) / len(of)
            at = at + np.bincount(of, gap, n)
            extra = -gap
        slope = np.bincount(col, at[row], size) + 2 * ridge / n * weights
        if len(of):
            slope += np.bincount(col2, extra[row2], size)
        slope = np.append(slope, at.sum() + extra.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = 12_000, kept_features: int = 3_000, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = 5.0, **columns: str) -> ToxicityModel:
    """A model of at most ``rows`` labelled documents that are not held out.

    Of the buckets that three documents or more hold, the ``kept_features``
    that tell the labels apart best (by z score) are used, and those of the
    group names. Without labelled documents every score is that of an intercept
    of -1: nothing is taken for toxic.
    """
    sample = training_rows(docs, labels, label, rows, **columns).select("text", "label")
    totals = sample.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    counts = sample.mapInArrow(_counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    p = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1 + 1))
    z = (F.col("n1") / F.lit(float(n1 + 1)) - F.col("n0") / F.lit(float(n0 + 1))) / F.sqrt(p * (1.0001 - p))
    top = counts.orderBy(F.abs(z).desc(), "bucket").limit(kept_features).select("bucket").collect()
    named = features(pa.array([t for group in terms for t in group] or [""], pa.string()))[1]
    chosen = np.unique(np.concatenate([np.array([r["bucket"] for r in top], dtype=np.int64), named]))
    got = sample.mapInArrow(_examples(chosen, terms), "label int, own array<int>, swapped array<array<int>>").collect()
    got.sort(key=lambda r: (r["label"], r["own"]))  # the same sums in the same order, whatever the partitions
    weights, bias = fit(np.array([r["label"] for r in got], dtype=float), [r["own"] for r in got], [r["swapped"] for r in got], len(chosen), penalty=penalty)
    return ToxicityModel(chosen, weights.astype(np.float32), bias)


def _scored(shared, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in byte_slices(batch, batch.num_columns - 1, 1 << 20):
                doc, bucket = features(part.column(part.num_columns - 1))
                hit = np.flatnonzero(table[bucket])
                doc, bucket = _once(doc[hit], bucket[hit])
                total = np.bincount(doc, table[bucket].astype(np.float64), part.num_rows) + bias
                score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns - 1)), pa.array(score)], names=[*part.schema.names[:-1], "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of each whole text; null and empty texts get the score of the intercept alone.

    Nothing but the text is looked at. Repeated rows repeat; an empty table
    gives an empty result; other columns are dropped.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model.table())
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[:-1]), "score double"])
    return rows.mapInArrow(_scored(shared, model.bias), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from one half on) of all documents, by a model of the others' labels.

    Null and empty texts get the score of the intercept alone; repeated rows
    repeat; an empty table gives an empty result; other columns are dropped.
    """
    scored = score_toxicity(docs, train_toxicity(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
