"""The detection pipeline as relations: observations to findings, findings and ground truth to metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.operators import aggregates, detectors, evaluation, flows
from flowlark.errors import DetectionError
from flowlark.operators.decoding import admitted, checked_observations, decode_packets
from flowlark.runtime import with_rank, written
from flowlark.schemas import IDENTITY, MAX_ACTIVE_WINDOWS, TCP_FLAGS

#: What windows and their statistics need of a packet.
STATE_COLUMNS = ("session", "packet_index", "ts_us", "captured_length", "original_length", *IDENTITY, "is_forward", *TCP_FLAGS)


@dataclass(frozen=True)
class DetectionSettings:
    """The three detectors, the inactivity timeout and the limit of active windows."""

    packet: detectors.Detector
    volume: detectors.VolumeDetector
    control: detectors.ControlDetector
    timeout_us: int
    max_active: int | None = MAX_ACTIVE_WINDOWS
    strict: bool = False

    def __post_init__(self) -> None:
        if self.timeout_us <= 0:
            raise DetectionError("inactivity timeout must be positive")
        if self.max_active is not None and self.max_active < 1:
            raise DetectionError("max_active_windows must be positive")


@dataclass(frozen=True)
class Detection:
    """Findings of packets and of closed flows, each with ``finding_index``, and the windows behind them."""

    packet_findings: DataFrame
    flow_findings: DataFrame
    state: DataFrame = field(repr=False)


def flow_state(decoded: DataFrame, settings: DetectionSettings) -> DataFrame:
    """Closed windows with their statistics. Packets go through in the columns these need; a falling time in a session raises an error."""
    packets = flows.with_identity(admitted(decoded, strict=settings.strict)).select(*STATE_COLUMNS)
    flows.check_frontier(packets)
    return aggregates.window_state(*flows.sessionize(packets, timeout_us=settings.timeout_us, max_active=settings.max_active))


def detect(observations: DataFrame, settings: DetectionSettings) -> Detection:
    """Decode once, judge packets, cut flows into windows and judge the windows.

    The decoded packets are written to the shared folder, as both branches read
    them, in the columns these need: no payload. An observation that is not well
    formed raises an error.
    """
    decoded = written(decode_packets(checked_observations(observations)).select(*detectors.PACKET_COLUMNS), "decoded")
    state = written(flow_state(decoded, settings), "state")
    found = detectors.flow_findings(state, settings.volume, settings.control)
    return Detection(detectors.packet_findings(decoded, settings.packet), with_rank(found, "finding_index", *detectors.finding_order()), state)


def evaluate(detection: Detection, packet_expectations: DataFrame, flow_expectations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluation entries of both channels. Contradictory expectations, and findings that do not agree with themselves, raise errors."""
    evaluation.check_expectations(packet_expectations, evaluation.PACKET_IDENTITY)
    evaluation.check_expectations(flow_expectations, evaluation.FLOW_IDENTITY)
    packet = evaluation.finding_identities(detectors.checked_findings(detection.packet_findings), packet=True, index="finding_index")
    flow = evaluation.finding_identities(detectors.checked_findings(detection.flow_findings), packet=False, index="finding_index")
    return evaluation.evaluate_channel(packet, packet_expectations, evaluation.PACKET_IDENTITY), evaluation.evaluate_channel(flow, flow_expectations, evaluation.FLOW_IDENTITY)


def metrics_of(packet_entries: DataFrame, flow_entries: DataFrame) -> DataFrame:
    """Metrics by channel."""
    one = lambda e, name: evaluation.detection_metrics(e).withColumn("channel", F.lit(name))
    return one(packet_entries, "packet").unionByName(one(flow_entries, "flow"))


def validate_end_to_end(observations: DataFrame, settings: DetectionSettings, packet_truth: DataFrame, flow_truth: DataFrame) -> DataFrame:
    """Ground truth (with ``polarity`` and ``expectation_index``) to metrics by channel.

    An identity that is expected both ways, or named twice, raises an error.
    """
    for truth, names in ((packet_truth, evaluation.PACKET_IDENTITY), (flow_truth, evaluation.FLOW_IDENTITY)):
        if evaluation.duplicates(truth, names).limit(1).count():
            raise DetectionError("ground truth names an identity twice")
    found = detect(observations, settings)
    return metrics_of(*evaluate(found, evaluation.to_expectations(packet_truth), evaluation.to_expectations(flow_truth)))


def evaluate_cases(observations: DataFrame, settings: DetectionSettings, packet_truth: DataFrame, flow_truth: DataFrame) -> DataFrame:
    """Metrics by case and channel: a whole benchmark as one plan, whatever the number of cases.

    A case is a capture, told apart by ``session`` in observations and in both
    ground truths (``packet_truth`` has that column too). Cases are decoded, cut
    into windows, judged and matched together; each gives what it gives alone.
    A case without observations or expectations has a row too; ratios without a
    denominator are null.
    """
    for truth, names in ((packet_truth, evaluation.PACKET_IDENTITY), (flow_truth, evaluation.FLOW_IDENTITY)):
        if evaluation.duplicates(truth, evaluation.by_case(names)).limit(1).count():
            raise DetectionError("ground truth names an identity twice")
    found = detect(observations, settings)
    cases = observations.select("session").unionByName(packet_truth.select("session")).unionByName(flow_truth.select("session")).distinct()
    out = None
    for channel, findings, truth, names in (("packet", found.packet_findings, packet_truth, evaluation.PACKET_IDENTITY), ("flow", found.flow_findings, flow_truth, evaluation.FLOW_IDENTITY)):
        identities = evaluation.finding_identities(detectors.checked_findings(findings), packet=channel == "packet", index="finding_index")
        entries = evaluation.evaluate_channel(identities, evaluation.to_expectations(truth), evaluation.by_case(names))
        counted = evaluation.detection_metrics(entries, "session").select(F.col("session").alias("_session"), *evaluation.COUNTS)
        counts = cases.join(counted, F.col("session").eqNullSafe(F.col("_session")), "left").select(F.col("session").alias("case"), *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in evaluation.COUNTS])
        one = evaluation.with_ratios(counts).withColumn("channel", F.lit(channel))
        out = one if out is None else out.unionByName(one)
    return out
