"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are the same after deleting white space; a text's
digest is the SHA-256 of what is left. One pass writes a narrow table of
digests. Misra-Gries counters over it (Spark's ``freqItems``) give the few
digests that can hold more than a ``support`` share of all rows. Their counts
and winners are then taken exactly; those that are really frequent are
broadcast, at most ``1 / support`` rows, and their rows are settled where they
lie. All other digests, none of which holds more than that share, are grouped
and joined by the ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import stage_table

_SPACES = " \t\n\x0b\x0c\r"


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space, in UTF-8; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _SPACES, "").cast("binary"), 256)


def frequent_digests(rows: DataFrame, support: float) -> list[int]:
    """Keys (``key`` of ``rows``) that may hold more than ``support`` of all rows: all that do, at most ``1 / support`` in number.

    Each partition keeps that many counters; counters of partitions are merged one by one.
    """
    found = rows.stat.freqItems(["key"], support).first()[0]
    return sorted(found or [])


def _settled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    return rows.join(winners, "digest")


def _decided(rows: DataFrame, support: float) -> DataFrame:
    """``rows`` (digest, key, id, points, place) with ``w``, the winner of the digest's group, and ``n``, its size."""
    # most code points, then the smallest id (none last), then the first place
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "place")).alias("w")
    found, total = frequent_digests(rows, support), rows.count()
    exact = rows.where(F.col("key").isin(found)).groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).where(F.col("n") > support * total)
    heavy = F.broadcast(stage_table(exact, "heavy"))
    # grouped by two keys and joined by one: both sides are dealt anew, and a large group can be split
    rest = rows.join(heavy, "digest", "left_anti")
    light = rest.groupBy("digest", F.pmod("key", F.lit(2)).alias("h")).agg(best, F.count(F.lit(1)).alias("n")).drop("h")
    return _settled(rows, heavy).unionByName(_settled(rest, light))


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 256) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the most code points in its original text stays,
    then that with the smallest id, a null id last; of rows alike in both one,
    whichever Spark reads first. So each group has exactly one row that is
    kept. Null and empty texts, and texts of white space alone, are one group.
    Whole texts count; an empty table gives an empty result; other columns are
    dropped.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text).alias("digest"), F.length(text).alias("points"))
    rows = stage_table(rows.select("*", F.xxhash64("digest").alias("key"), F.monotonically_increasing_id().alias("place")), "digests")
    out = _decided(rows, support)
    return out.select(F.col("id").alias("doc_id"), F.col("w")["id"].alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("w")["place"]).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: float = 1 / 256) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever these are called; see ``duplicate_groups``.

    The rows are written once with their places, so that a place means the same row when it is read again.
    """
    names = docs.columns
    places = [f"c{k}" for k in range(len(names))]
    text = F.coalesce(F.col(places[names.index(text_col)]).cast("string"), F.lit(""))
    tagged = docs.toDF(*places).select("*", F.col(places[names.index(id_col)]).cast("long").alias("id"), text_digest(text).alias("digest"), F.length(text).alias("points"), F.monotonically_increasing_id().alias("place"))
    tagged = stage_table(tagged, "tagged")
    rows = tagged.select("id", "digest", "points", F.xxhash64("digest").alias("key"), "place")
    stay = _decided(rows, support).where(F.col("place") == F.col("w")["place"]).select("place")
    return tagged.join(stay, "place", "left_semi").select(*places).toDF(*names)
