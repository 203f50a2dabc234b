"""A folder that a stream keeps its tables and marks in, and the state store that its stateful queries use."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def with_rocks(spark: SparkSession) -> Iterator[None]:
    """In this block stateful queries keep their state in RocksDB; the session's own choice comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Folder:
    """Tables and marks in a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def marked(self, name: str) -> bool:
        store, place = self._at(name)
        return store.exists(place)

    def mark(self, name: str) -> None:
        store, place = self._at(name)
        store.create(place, True).close()

    def remove(self, name: str) -> None:
        store, place = self._at(name)
        store.delete(place, True)

    def numbers(self, prefix: str, within: str = "") -> list[int]:
        """The numbers that names with ``prefix`` end in."""
        store, place = self._at(within)
        names = [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.get(name, df.schema)

    def get(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
