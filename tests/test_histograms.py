import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowlark.operators import aggregates as A


@pytest.mark.parametrize(("parts", "held"), [(1, 1 << 20), (5, 1 << 20), (3, 4)])
def test_bounded_histograms_equal_counting_everything(spark, parts, held):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, True, False]), None if rng.random() < 0.1 else int(rng.gauss(0, 1) * rng.choice([1, 4]))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, h boolean, v int").repartition(parts)
    hist = A.bounded_histogram(df, F.col("v"), limit=9, by=("g", "h"), held_rows=held)
    each = Counter((r.task, r.g, r.h) for r in hist.select(F.spark_partition_id().alias("task"), "g", "h").collect())
    if held > 4:
        assert max(each.values()) <= 10  # nine values, or a total
    want = defaultdict(Counter)
    for g, h, v in rows:
        if v is not None:
            want[g, h][v] += 1
    got = {(r.g, r.h): r for r in A.saturated(hist, limit=9, by=("g", "h")).collect()}
    assert set(got) == set(want)
    for key, counts in want.items():
        full = len(counts) > 9
        assert (got[key].total, got[key].saturated) == (sum(counts.values()), full)
        assert [tuple(b) for b in got[key].bins] == ([] if full else sorted(counts.items()))
    assert A.saturated(A.bounded_histogram(df.limit(0), F.col("v"), by=("g", "h")), by=("g", "h")).collect() == []
