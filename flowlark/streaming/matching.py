"""Matching of findings with expectations as they come: what an identity adds to the metrics is taken back and put anew.

Findings of one identity are told apart by their decision alone: those wanted
go first, then the opposite, then those that could not be evaluated. So an
identity needs five numbers of state, and its share of the metrics follows from
them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlark.operators import evaluation
from flowlark.streaming.folder import Folder, with_rocks

CLASSES = evaluation.COUNTS
_STATE = "matches bigint, opposites bigint, unknown bigint, expected bigint, positive boolean"
PARTS = f"identity string, {_STATE}"
_DELTA = ", ".join(f"{c} bigint" for c in CLASSES)


def share(matches: int, others: int, unknown: int, expected: int, positive: bool | None) -> tuple[int, ...]:
    """An identity's true and false positives, false and true negatives, and entries of no class."""
    first, second = (others, matches) if expected and not positive else (matches, others)
    first_paired = min(first, expected)
    second_paired = min(second, expected - first_paired)
    unknown_paired = min(unknown, expected - first_paired - second_paired)
    missed = expected - first_paired - second_paired - unknown_paired
    free = first - first_paired + second - second_paired
    if expected and not positive:
        # of a negative expectation no match is right; matches are false, paired or not
        return 0, matches, 0, first_paired, free - (matches - second_paired) + unknown + missed
    return first_paired, matches - first_paired, second_paired + unknown_paired + missed, 0, others - second_paired + unknown - unknown_paired


class _Shares(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("identity", _STATE)

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        held = list(self.state.get()) if self.state.exists() else [0, 0, 0, 0, None]
        before = share(*held) if any(held[:4]) else (0,) * len(CLASSES)
        for r in rows:
            for k, n in enumerate((r.matches, r.opposites, r.unknown, r.expected)):
                held[k] += n
            held[4] = r.positive if r.positive is not None else held[4]
        self.state.update(tuple(held))
        yield Row(**dict(zip(CLASSES, (b - a for a, b in zip(before, share(*held))))))

    def close(self) -> None:
        pass


def _identity(names: tuple[str, ...]) -> Column:
    return F.sha2(F.to_json(F.struct(*names)), 256).alias("identity")


class KeyedMatching:
    """One channel's metrics, kept up with what comes: ``add`` findings by batch, ask for ``counts`` at any time."""

    def __init__(self, folder: Folder, expectations: DataFrame, names: tuple[str, ...]) -> None:
        self.folder, self.names = folder, names
        if not folder.marked("expected-put"):
            wanted = expectations.groupBy(_identity(names)).agg(F.count(F.lit(1)).alias("expected"), F.max("positive").alias("positive"))
            none = F.lit(0).cast("bigint")
            folder.put("parts/expected", wanted.select("identity", none.alias("matches"), none.alias("opposites"), none.alias("unknown"), "expected", "positive"))
            folder.mark("expected-put")

    def add(self, findings: DataFrame, number: int) -> None:
        """A batch's findings; one that was added before is passed over."""
        if self.folder.marked(f"added-{number}"):
            return
        each = lambda decision: F.count_if(F.col("decision") == decision)
        parts = findings.groupBy(_identity(self.names)).agg(each("match").alias("matches"), each("no_match").alias("opposites"), each("not_evaluable").alias("unknown"))
        self.folder.put(f"parts/batch-{number}", parts.select("*", F.lit(0).cast("bigint").alias("expected"), F.lit(None).cast("boolean").alias("positive")))
        self.folder.mark(f"added-{number}")

    def _noted(self, deltas: DataFrame, epoch: int) -> None:
        self.folder.put(f"deltas/epoch-{epoch}", deltas.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in CLASSES]))

    def counts(self) -> DataFrame:
        """One row with the number of entries of each class, of all that was added."""
        spark = self.folder.spark
        with with_rocks(spark):
            parts = spark.readStream.schema(PARTS).option("recursiveFileLookup", "true").parquet(f"{self.folder.path}/parts")
            changes = parts.groupBy("identity").transformWithState(_Shares(), _DELTA, "Append", "None")
            changes.writeStream.foreachBatch(self._noted).option("checkpointLocation", f"{self.folder.path}/shares").trigger(availableNow=True).start().awaitTermination()
        epochs = self.folder.numbers("epoch-", "deltas")
        every = spark.read.schema(_DELTA).parquet(*[f"{self.folder.path}/deltas/epoch-{n}" for n in epochs]) if epochs else spark.createDataFrame([], _DELTA)
        return every.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES])


class PlacedMatching:
    """One channel of which a batch's identities are in no other batch: it is matched at once, and only numbers stay."""

    def __init__(self, folder: Folder, expectations: DataFrame, names: tuple[str, ...]) -> None:
        self.folder, self.expectations, self.names = folder, expectations, names

    def add(self, findings: DataFrame, number: int) -> None:
        met = evaluation.evaluate_channel(findings, self.expectations, self.names).where("actual_index IS NOT NULL")
        kinds = ("true_positive", "false_positive", "false_negative", "true_negative")
        paired = F.col("expectation_index").isNotNull()
        self.folder.put(f"counts/batch-{number}", met.agg(*[F.count_if(F.col("classification") == k).alias(c) for k, c in zip(kinds, CLASSES)], F.count_if(F.col("classification").isNull()).alias("unclassified"), F.count_if(paired & F.col("positive")).alias("met_positives"), F.count_if(paired & ~F.col("positive")).alias("met_negatives")))

    def counts(self) -> DataFrame:
        spark, schema = self.folder.spark, f"{_DELTA}, met_positives bigint, met_negatives bigint"
        batches = self.folder.numbers("batch-", "counts")
        every = spark.read.schema(schema).parquet(*[f"{self.folder.path}/counts/batch-{n}" for n in batches]) if batches else spark.createDataFrame([], schema)
        seen = every.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*CLASSES, "met_positives", "met_negatives")])
        wanted = self.expectations.agg(F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"))
        # an expectation that nothing met: a positive one is missed, a negative one has no class
        both = seen.join(F.broadcast(wanted), F.lit(True))
        return both.withColumns({"false_negatives": F.col("false_negatives") + F.col("positives") - F.col("met_positives"), "unclassified": F.col("unclassified") + F.col("negatives") - F.col("met_negatives")}).select(*CLASSES)


def metrics(spark: SparkSession, **channels: DataFrame) -> DataFrame:
    """Metrics by channel of rows of counts."""
    out = None
    for name, counts in channels.items():
        one = evaluation.with_ratios(counts).withColumn("channel", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
