import random

import pytest
from pyspark.sql import functions as F

from flowlark.operators import evaluation as J
from flowlark.streaming import matching
from flowlark.streaming.folder import Folder

NAMES = ("detector_id", "session", "sequence_number")
FINDINGS = "actual_index bigint, decision string, detector_id string, session string, sequence_number bigint"
EXPECTED = "expectation_index bigint, positive boolean, detector_id string, session string, sequence_number bigint"


def wanted(spark, rng):
    """Expectations of some identities, up to three of one, all of one polarity."""
    rows = []
    for n in range(25):
        positive = rng.random() < 0.5
        rows += [(len(rows) + k, positive, "d", None if n == 3 else "s", n) for k in range(rng.choice((0, 1, 1, 2, 3)))]
    return spark.createDataFrame(rows, EXPECTED)


def found(rng, n, first):
    return [(first + k, rng.choice(("match", "no_match", "not_evaluable")), "d", rng.choice(("s", None)), rng.randrange(30)) for k in range(n)]


def test_metrics_after_each_batch_are_those_of_the_prefix(spark, tmp_path):
    rng = random.Random(6)
    expectations, so_far = wanted(spark, rng), []
    plain = lambda: J.detection_metrics(J.evaluate_channel(spark.createDataFrame(so_far, FINDINGS), expectations, NAMES)).first().asDict()
    counts = lambda: J.with_ratios(matching.KeyedMatching(Folder(spark, str(tmp_path / "m")), expectations, NAMES).counts()).first().asDict()
    assert counts() == plain()  # nothing found: all that is expected is missed
    for number, n in enumerate((30, 1, 60)):
        batch = found(rng, n, len(so_far))
        so_far += batch
        one = matching.KeyedMatching(Folder(spark, str(tmp_path / "m")), expectations, NAMES)  # a new object each time
        for _ in range(2):  # delivered twice
            one.add(spark.createDataFrame(batch, FINDINGS), number)
        assert counts() == plain()


@pytest.mark.parametrize("seed", range(3))
def test_a_share_is_that_of_matching_one_by_one(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        m, n, q, e, positive = (*(rng.randrange(4) for _ in range(4)), rng.random() < 0.5)
        order = ["match"] * m + ["no_match"] * n if positive or not e else ["no_match"] * n + ["match"] * m
        order += ["not_evaluable"] * q
        want = dict.fromkeys(matching.CLASSES, 0)
        for k in range(max(len(order), e)):
            decision, p = order[k] if k < len(order) else None, positive if k < e else None
            kind = ("true_positives" if p else "false_positives") if decision == "match" else "false_negatives" if p else "true_negatives" if p is False and decision == "no_match" else "unclassified"
            want[kind] += 1
        assert matching.share(m, n, q, e, positive if e else None) == tuple(want.values())


def test_a_channel_of_places_keeps_numbers_only(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, rng.choice(("match", "no_match", "not_evaluable")), "d", "s", k) for k in range(60)]
    expectations = spark.createDataFrame([(k, k % 3 == 0, "d", "s", 2 * k) for k in range(40)], EXPECTED)
    channel = matching.PlacedMatching(Folder(spark, str(tmp_path / "p")), expectations, NAMES)
    for number, (a, b) in enumerate(((0, 25), (25, 60))):
        for _ in range(2):
            channel.add(spark.createDataFrame(rows[a:b], FINDINGS), number)
        got = J.with_ratios(channel.counts()).first().asDict()
        assert got == J.detection_metrics(J.evaluate_channel(spark.createDataFrame(rows[:b], FINDINGS), expectations, NAMES)).first().asDict()
    assert F is not None
