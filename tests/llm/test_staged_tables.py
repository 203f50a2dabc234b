"""Staged tables come in row groups that fit beside each other on a small heap."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from flowlark.llm.common import ROW_GROUP, WIDE_ROWS, discard, stage_table


def test_row_groups_are_bounded(spark):
    staged = stage_table(spark.range(0, 4_000_000, 1, 1).select(F.xxhash64("id").alias("x")), "groups")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{staged.staged_path.removeprefix('file://').removeprefix('file:')}/*.parquet")]
    sizes = [m.row_group(k).total_byte_size for m in files for k in range(m.num_row_groups)]
    assert sum(sizes) > 30_000_000 and max(sizes) < 1.5 * ROW_GROUP
    discard(staged)


def test_row_groups_of_texts_are_short(spark):
    rows = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.col("id").cast("string"), 500).alias("text"))
    staged = stage_table(rows, "texts", wide=True)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{staged.staged_path.removeprefix('file://').removeprefix('file:')}/*.parquet")]
    assert max(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)) <= WIDE_ROWS
    assert staged.agg(F.count("text"), F.sum("id"), F.sum(F.length("text"))).first() == rows.agg(F.count("text"), F.sum("id"), F.sum(F.length("text"))).first()
    discard(staged)
