"""Packets held by the program as observations."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from flowlark.schemas import OBSERVATION


def observations_of(spark: SparkSession, records: Iterable[bytes], *, source: str, link_type: int | None = 1, session: str = "capture", now_us: int | None = None) -> DataFrame:
    """Each record is a packet captured now, in order, as long as it is."""
    if not source.strip():
        raise ValueError("source must not be blank")
    now = int(time.time() * 1e6) if now_us is None else now_us
    rows = [(session, k, now, link_type, len(r), len(r), bytes(r), source) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, OBSERVATION)
