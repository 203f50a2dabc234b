"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm.bpe import bpe_round_trip
from flowlark.llm.common import stage_table, table
from flowlark.llm.decontaminate import decontaminated
from flowlark.llm.ngram_join import ngram_jaccard_join
from flowlark.llm.rules import keep_good
from flowlark.llm.toxicity import score_toxicity, train_toxicity
from flowlark.runtime import with_rank
from flowlark.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts go, repeated rows stay repeated."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the classifier learns from the labelled rows of ``documents``.

    Null and empty texts get the score of the intercept alone. Columns may have
    any names: they go through under their places.
    """
    model = train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    places = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*places).withColumn("judged", F.col(places[docs.columns.index("text")]))
    return score_toxicity(rows, model, text_col="judged", keep=tuple(places)).where("score < 0.5").select(*places).toDF(*docs.columns)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a number for each (id, text): the id itself where ids are numbers of their own, else a rank among ids and 256-bit digests."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.where("id IS NULL OR n > 1").limit(1).count() == 0:
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "text"))).cast("binary"), 256)
    of, rank = f"{key}_digest", f"{key}_rank"
    ranked = with_rank(docs.select(digest.alias(of)).distinct(), rank, of)
    return docs.withColumn(key, digest).join(ranked, F.col(key) == F.col(of)).drop(key, of).withColumnRenamed(rank, key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, one (of five-word shingles, similarity 0.8): that with the smallest id.

    Rows are told apart by their ids where these are given and unique, else by
    id and text; of rows equal in both one stays. An id counts as smaller than
    none. Texts without a word are linked with nothing.
    """
    names = docs.columns
    key = next(f"key{k}" for k in range(len(names) + 1) if not any(c.lower().startswith(f"key{k}") for c in names))
    rows = _keyed(docs, key)
    found = ngram_jaccard_join(rows.select(F.col(key).alias("k"), "text"), id_col="k", size=5, num=80, den=100)
    of = rows.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("id")).distinct().join(found.select(F.col("doc_id").alias("k"), "component_id").distinct(), "k")
    # first within parts of a group, which may be large, then among the parts
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("b")
    stay = of.groupBy("component_id", F.pmod("k", F.lit(64)).alias("part")).agg(best).groupBy("component_id").agg(F.min("b").alias("b"))
    return rows.join(stay.select(F.col("b")["k"].alias(key)), key, "left_semi").dropDuplicates([key]).select(*[f"`{c}`" for c in names])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no tile cover gives a test item away; null and empty texts stay, as do repeated rows."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded bytes, of what is left; a null text counts as an empty one."""
    return bpe_round_trip(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_rules", _shipped(quality_rules)),
    ("toxicity", _shipped(toxicity)),
    ("ngram_jaccard_join", _shipped(near_duplicates)),
    ("benchmark_decontamination", _shipped(benchmark_decontamination)),
    ("byte_level_bpe", _shipped(byte_level_bpe)),
]

#: No SQL can train the classifier or run the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name, wide=True)
    return STAGES[-1][1](spark, docs, sf_dir)
