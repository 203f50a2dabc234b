"""Findings against ground truth: one-to-one matching, classification and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.errors import DetectionError

PACKET_IDENTITY = ("detector_id", "detector_version", "packet_index", "ts_us", "source", "link_type", "captured_length", "original_length")
FLOW_IDENTITY = ("detector_id", "detector_version", "session", "sequence_number", "a_addr", "b_addr", "a_port", "b_port", "protocol", "icmp_echo_id", "first_us", "last_us")


def finding_identities(findings: DataFrame, *, packet: bool, index: str) -> DataFrame:
    """(actual_index, decision, identity columns) of findings; ``index`` is the finding's place in its channel."""
    names = PACKET_IDENTITY if packet else FLOW_IDENTITY
    e, session = F.col("raw_evidence"), () if "session" in names else ("session",)
    return findings.select(F.col(index).cast("bigint").alias("actual_index"), "decision", "detector_id", "detector_version", *[e[n].alias(n) for n in (*names[2:], *session)])


def _same(a: str, b: str, names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def _phase(positive: Column, decision: Column) -> Column:
    return F.when(decision == F.when(positive, "match").otherwise("no_match"), 1).when(decision == "not_evaluable", 3).otherwise(2)


def match_findings(findings: DataFrame, expectations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Pairs each expectation with at most one finding of its identity, and keeps what is left of both.

    Findings with the wanted decision go first (a match for a positive
    expectation, no match for a negative one), then those with the opposite,
    then those that could not be evaluated; each group by index. Expectations
    of one identity are of one polarity (see ``contradictions``) and are served
    by index, so the k-th of one side meets the k-th of the other: a full outer
    join by identity and place. ``expectations`` has ``expectation_index``,
    ``positive`` and the identity columns.
    """
    polarity = expectations.groupBy(*names).agg(F.max("positive").alias("_positive"))
    ranked = findings.alias("f").join(polarity.alias("p"), _same("f", "p", names), "left").select("f.*", F.coalesce("p._positive", F.lit(True)).alias("_positive"))
    places = Window.partitionBy(*names)
    ranked = ranked.withColumn("_place", F.row_number().over(places.orderBy(_phase(F.col("_positive"), F.col("decision")), "actual_index"))).drop("_positive")
    wanted = expectations.withColumn("_place", F.row_number().over(places.orderBy("expectation_index")))
    joined = ranked.alias("f").join(wanted.alias("e"), _same("f", "e", names) & (F.col("f._place") == F.col("e._place")), "full_outer")
    identity = [F.coalesce(f"f.{n}", f"e.{n}").alias(n) for n in names]
    return joined.select("f.actual_index", "e.expectation_index", "f.decision", "e.positive", *identity)


def classification(decision: Column, positive: Column) -> Column:
    """true/false positive of a match, false negative of a missed positive, true negative of a negative that did not match; else null."""
    wanted = F.coalesce(positive, F.lit(False))
    return F.when(decision == "match", F.when(wanted, "true_positive").otherwise("false_positive")).when(wanted, "false_negative").when(positive.isNotNull() & (decision == "no_match"), "true_negative")


def evaluate_channel(findings: DataFrame, expectations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Evaluation entries: all findings by index, then expectations without a finding."""
    return match_findings(findings, expectations, names).withColumn("classification", classification(F.col("decision"), F.col("positive")))


def by_case(names: tuple[str, ...]) -> tuple[str, ...]:
    """The identity columns of a channel in which cases, told apart by session, are matched together."""
    return names if "session" in names else ("session", *names)


def contradictions(expectations: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Identities that are expected both positive and negative."""
    return expectations.groupBy(*names).agg(F.countDistinct("positive").alias("n")).where("n > 1").drop("n")


def check_expectations(expectations: DataFrame, names: tuple[str, ...]) -> None:
    """Raises an error if an identity is expected both positive and negative."""
    if contradictions(expectations, names).limit(1).count():
        raise DetectionError("expectations contradict each other")


def duplicates(truth: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Identities that a ground truth names more than once."""
    return truth.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def to_expectations(truth: DataFrame) -> DataFrame:
    """``polarity`` ('positive' or 'negative') as a boolean."""
    return truth.withColumn("positive", F.col("polarity") == "positive").drop("polarity")


#: The numbers that metrics are made of.
COUNTS = ("true_positives", "false_positives", "false_negatives", "true_negatives", "unclassified")


def detection_metrics(entries: DataFrame, *by: str) -> DataFrame:
    """Counts of the classes, precision, recall, F1 and accuracy (null where the denominator is 0); a row for each value of ``by``."""
    n = {k: F.count_if(F.col("classification") == k) for k in ("true_positive", "false_positive", "false_negative", "true_negative")}
    counts = entries.groupBy(*by).agg(*[c.alias(f"{k}s") for k, c in n.items()], F.count_if(F.col("classification").isNull()).alias("unclassified"))
    return with_ratios(counts)


def with_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(f"{k}s").cast("double") for k in ("true_positive", "false_positive", "false_negative", "true_negative"))
    share = lambda a, b: F.when(b > 0, a / b)
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * tp / (2 * tp + fp + fn))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1, "accuracy": share(tp + tn, tp + tn + fp + fn)})
