"""A quality classifier: random-indexing word vectors, pooled, and a small network with calibrated output.

Each word has a sparse random index vector, drawn from its 64-bit hash; its
word vector is the sum of its neighbours' index vectors over all documents. The
word vectors are kept in a sketch of fixed size, whatever the vocabulary: two
tables of ``CELLS`` rows, in each of which a word is added, with a random sign,
to a row of its own hash. A word reads the shorter of its two rows, the one that
other words disturb less, so that words share a vector only if both hashes
collide. A document is the mean of its words' vectors, over all and over its
distinct words. A two-layer network in numpy reads that, and one temperature,
fitted on rows the network did not learn from, scales its output to
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import byte_slices
from flowlark.llm.labelled import held_out, training_rows
from flowlark.llm.textkernel import text_buffer, word_tokens

CELL_BITS, TABLES, DIMENSION, NONZERO = 14, 2, 32, 2
CELLS = 1 << CELL_BITS
_SIZE = TABLES * CELLS * DIMENSION
_PARTS = 16


def _bits(words: np.ndarray, at: int, n: int) -> np.ndarray:
    return (words >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)


def _cells(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, sign) of each word in each table; the tables stand one after the other."""
    return [(_bits(words, 64 - CELL_BITS * (k + 1), CELL_BITS) + k * CELLS, 1.0 - 2 * _bits(words, k, 1)) for k in range(TABLES)]


def _index(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, sign) of each number of the words' index vectors that is not zero."""
    return [(_bits(words, 4 + 5 * k, 5), 1.0 - 2 * _bits(words, 20 + k, 1)) for k in range(NONZERO)]


def context_sums(column: pa.Array) -> np.ndarray:
    """The sketch of the neighbours' index vectors of each word, over the texts of the column."""
    words, bounds = word_tokens(*text_buffer(column))
    total = np.zeros(_SIZE)
    if len(words) < 2:
        return total
    apart = np.zeros(len(words) + 1, dtype=bool)
    apart[bounds] = True
    left = np.flatnonzero(~apart[1:-1])  # words whose next one is of the same text
    cells, index = _cells(words), _index(words)
    for row, sign in cells:
        for place, value in index:
            for a, b in ((left, left + 1), (left + 1, left)):
                total += np.bincount(row[a] * DIMENSION + place[b], sign[a] * value[b], _SIZE)
    return total


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, any_row = np.zeros(_SIZE), False
    for batch in batches:
        for part in byte_slices(batch, 0):
            total += context_sums(part.column(0))
            any_row = True
    if any_row:
        yield _in_parts({k: x for k, x in enumerate(np.split(total, _PARTS))}, int(np.abs(total).sum()) % 8)


def _in_parts(sums: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([salt] * len(sums), pa.int64()), pa.array(list(sums), pa.int64()), pa.array([x.astype(np.float64).tobytes() for x in sums.values()], pa.binary())], names=["salt", "part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(1).to_pylist(), batch.column(2)):
            held[part] = held.get(part, 0) + np.frombuffer(sums.as_buffer(), dtype=np.float64)
    if held:
        yield _in_parts(held, 0)


@dataclass(frozen=True)
class WordVectors:
    """Unit rows of the sketch, and their lengths before."""

    rows: np.ndarray
    lengths: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """Unit vectors of words by hash; zero for words that had no neighbour."""
        cells = _cells(words)
        (first, sign), (second, other) = cells
        use = self.lengths[second] < self.lengths[first]
        return self.rows[np.where(use, second, first)] * np.where(use, other, sign)[:, None].astype(np.float32)


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> WordVectors:
    """Word vectors by random indexing over all documents.

    Each task sums in place; the sums, of a fixed size (8 MB, exact to 2^53), are added in two
    steps, so the driver gets 16 parts, however many tasks there are.
    """
    schema = "salt long, part long, sums binary"
    parts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(_summed, schema)
    parts = parts.repartition(_PARTS * 2, "salt", "part").mapInArrow(_added, schema).repartition(_PARTS, "part").mapInArrow(_added, schema).collect()
    total = np.zeros((_PARTS, _SIZE // _PARTS))
    for r in parts:
        total[r["part"]] += np.frombuffer(r["sums"], dtype=np.float64)
    rows = total.reshape(TABLES * CELLS, DIMENSION)
    lengths = np.linalg.norm(rows, axis=1)
    return WordVectors((rows / np.maximum(lengths, 1e-9)[:, None]).astype(np.float32), lengths)


WIDTH = 2 * DIMENSION + 3


def document_vectors(column: pa.Array, vectors: WordVectors) -> np.ndarray:
    """A row for each text: mean vector of its words, mean of its distinct words, both norms, share of distinct words."""
    words, bounds = word_tokens(*text_buffer(column))
    out = np.zeros((len(bounds) - 1, WIDTH), dtype=np.float32)
    vocabulary, words = np.unique(words, return_inverse=True)
    known = vectors.of(vocabulary)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            own, n = np.unique(words[a:b], return_counts=True)
            rows = known[own]
            every, each = (n.astype(np.float32) @ rows) / (b - a), rows.mean(axis=0)
            out[i, :DIMENSION], out[i, DIMENSION : 2 * DIMENSION] = every, each
            out[i, 2 * DIMENSION :] = np.linalg.norm(every), np.linalg.norm(each), len(own) / (b - a)
    return out


@dataclass(frozen=True)
class QualityModel:
    """Word vectors, scaling, two layers and a temperature."""

    vectors: WordVectors
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        hidden = np.tanh((rows - self.centre) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows).astype(np.float64) / self.temperature, -500, 500)))


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, between 1/8 and 8; 1 without rows."""
    if len(labels) == 0:
        return 1.0
    tried = 2.0 ** np.linspace(-3, 3, 121)
    loss = [np.logaddexp(0, np.where(labels == 1, -1, 1) * logits / t).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


def calibration_error(scores: np.ndarray, labels: np.ndarray, bins: int = 10) -> float:
    """Mean distance of score and share of label 1 over ``bins`` equal ranges of scores, by their rows; 0 without rows."""
    place = np.minimum((scores * bins).astype(int), bins - 1)
    each = [abs(scores[place == k].mean() - labels[place == k].mean()) * (place == k).sum() for k in np.unique(place)]
    return float(sum(each) / max(1, len(scores)))


def fit_network(rows: np.ndarray, labels: np.ndarray, *, hidden: int = 24, steps: int = 1500, batch: int = 512, rate: float = 0.01, decay: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, ...]:
    """Two layers by minibatch Adam with weight decay; returns scaling, weights and biases."""
    centre, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    x, rng = (rows - centre) / scale, np.random.Generator(np.random.PCG64(seed))
    values = [rng.normal(0, 0.3 / np.sqrt(WIDTH / 8), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(batch, len(x)))
        h = np.tanh(x[at] @ values[0] + values[1])
        p = 1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -30, 30)))
        error = (p - labels[at]) / len(at)
        back = error[:, None] * values[2] * (1 - h**2)
        slopes = [x[at].T @ back + decay * values[0], back.sum(axis=0), h.T @ error + decay * values[2], np.array([error.sum()])]
        now = rate * (1 - step / (steps + 1))
        for k, g in enumerate(slopes):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            values[k] = values[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return centre, scale, *values


def _vectorised(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                rows = document_vectors(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "vector"])

    return run


def train_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = 20_000, **columns: str) -> QualityModel:
    """A model of at most ``rows`` labelled documents that are not held out; a fifth of them set the temperature.

    Word vectors are of all documents, without labels. Without labelled
    documents of both kinds the output is their share (one half if there are none).
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col=columns.get("text_col", "text"))
    shared = spark.sparkContext.broadcast(vectors)
    got = training_rows(docs, labels, label, rows, **columns).mapInArrow(_vectorised(shared), "doc_id long, label int, vector binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["vector"]))
    y = np.array([r["label"] for r in got], dtype=float)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return QualityModel(vectors, np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    x = np.stack([np.frombuffer(r["vector"], dtype=np.float32) for r in got]).astype(np.float64)
    aside = np.array([(r["doc_id"] * 2654435761 >> 7) % 5 == 0 for r in got])
    if len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    centre, scale, w1, b1, w2, b2 = fit_network(x[~aside], y[~aside])
    model = QualityModel(vectors, centre, scale, w1, b1, w2, float(b2[0]), 1.0)
    return QualityModel(vectors, centre, scale, w1, b1, w2, float(b2[0]), calibrated(model.logits(x[aside]), y[aside]))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = shared.value
        for batch in batches:
            for part in byte_slices(batch, batch.num_columns - 1):
                score = model.scores(document_vectors(part.column(part.num_columns - 1), model.vectors))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns - 1)), pa.array(score)], names=[*part.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1, higher is better) of each whole text; a null text is an empty one, which gets a score too.

    Nothing but the text is looked at. Repeated rows repeat; an empty table
    gives an empty result; other columns are dropped.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[:-1]), "score double"])
    return rows.mapInArrow(_scored(shared), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on) of all documents, by a model of the others' labels.

    Null and empty texts are scored as empty ones; repeated rows repeat; an
    empty table gives an empty result; other columns are dropped.
    """
    scored = score_quality(docs, train_quality(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
