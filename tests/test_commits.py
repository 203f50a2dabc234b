import os
import shutil

import pytest
from pyspark.sql import functions as F

from flowlark.sinks import commits

SCHEMA = "id bigint, text string"


def frame(spark, a, b, parts=3):
    return spark.range(a, b, 1, parts).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


def ids(spark, path):
    return sorted(r.id for r in commits.read_committed(spark, path, SCHEMA).collect())


def test_a_write_is_seen_once_and_a_failed_one_never(spark, tmp_path):
    commits.register(spark)
    path = str(tmp_path / "out")
    assert ids(spark, path) == []
    frame(spark, 0, 10).write.format("committed").mode("append").save(path)
    fails = frame(spark, 10, 20).withColumn("text", F.when(F.col("id") == 19, F.raise_error(F.lit("a task is lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="a task is lost"):
        fails.write.format("committed").mode("append").save(path)
    assert ids(spark, path) == list(range(10))
    frame(spark, 10, 20).write.format("committed").mode("append").option("batch", "7").save(path)
    frame(spark, 10, 20).write.format("committed").mode("append").option("batch", "7").save(path)  # delivered again
    assert ids(spark, path) == list(range(20))
    frame(spark, 0, 0).write.format("committed").mode("append").save(path)
    assert ids(spark, path) == list(range(20))
    frame(spark, 5, 6).write.format("committed").mode("overwrite").save(path)
    assert ids(spark, path) == [5]
    assert commits.read_committed(spark, path, SCHEMA).first().text == "t5"


def test_a_stream_that_repeats_a_batch_changes_nothing(spark, tmp_path):
    commits.register(spark)
    path, source, checkpoint = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "cp")

    def run():
        spark.readStream.schema(SCHEMA).parquet(source).writeStream.format("committed").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()

    frame(spark, 0, 5, 2).write.parquet(source)
    run()
    frame(spark, 5, 9, 2).write.mode("append").parquet(source)
    run()
    assert ids(spark, path) == list(range(9))
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # as if the driver had died before the batch was noted as done
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    files = set(os.listdir(f"{path}/data"))
    run()
    assert ids(spark, path) == list(range(9))
    assert set(os.listdir(f"{path}/data")) == files  # what was written again is gone
    shutil.rmtree(path)


def test_findings_are_delivered_to_it(spark, tmp_path):
    consume = commits.committed_consumer(spark, str(tmp_path / "f"))
    for number in (0, 1, 1):
        consume(frame(spark, 10 * number, 10 * number + 3), number)
    assert ids(spark, str(tmp_path / "f")) == [0, 1, 2, 10, 11, 12]
