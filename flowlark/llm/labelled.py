"""Which rows a classifier may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> F.Column:
    """True where crc32 of the id as text is a multiple of 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents that are not held out.

    ``rows`` bounds what is learned from and what is broadcast; the documents
    taken are those with the smallest hashes of their ids, so a sample is the
    same whatever the order and the number of partitions. Null labels count as
    no label; of several labels of one document the largest counts, of several
    texts under one id the least (null last), and repeated rows count once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    # all but about twice as many go first, so that no task gathers candidates from every partition
    place, cells, n = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)), 1 << 40, max(1, known.count())
    known = known.where(place < min(cells, int(cells * 2 * rows / n) + 1))
    chosen = known.orderBy(place, "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a document that is repeated goes once; minima are taken where the rows lie, before anything is dealt
    least = F.min(F.struct(F.col("text").isNull().alias("none"), "text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(least.alias("t")).select("doc_id", F.col("t")["text"].alias("text"), "label")
