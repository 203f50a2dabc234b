"""Threshold detectors: one finding for each packet, one or two for each closed flow window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.errors import DetectionError
from flowlark.operators.features import rate_features
from flowlark.schemas import IDENTITY, TCP_FLAGS, WINDOW_KEY

RATE_METRICS = ("packets_per_second", "captured_bytes_per_second", "original_bytes_per_second")
VOLUME_METRICS = ("packet_count", "captured_bytes", "original_bytes", "forward_packet_count", "reverse_packet_count", "forward_captured_bytes", "reverse_captured_bytes", "forward_original_bytes", "reverse_original_bytes", *RATE_METRICS)
CONTROL_METRICS = tuple(f"{d}_{f}_count" for d in ("forward", "reverse") for f in (*TCP_FLAGS, "syn_ack"))

#: Fixed texts.
INTEGRITY_TEXTS = {"match": "A supported structural or integrity violation was observed.", "no_match": "No supported integrity or structural violation was observed.", "not_evaluable": "The packet analysis outcome was incomplete or unsupported."}
VOLUME_TEXTS = {"match": "Configured flow-volume or flow-rate threshold exceeded.", "no_match": "Configured threshold was not exceeded.", "not_evaluable": "Configured metric could not be evaluated for this observation window."}
CONTROL_TEXTS = {"match": "Configured TCP control-counter threshold exceeded.", "no_match": "Configured TCP control-counter threshold was not exceeded."}


def _named(detector_id: str, version: str) -> None:
    for name, value in (("detector_id", detector_id), ("detector_version", version)):
        if not isinstance(value, str):
            raise TypeError(f"{name} must be a string")
        if not value.strip():
            raise DetectionError(f"{name} must not be blank")


@dataclass(frozen=True)
class Detector:
    """Name and version of a detector."""

    detector_id: str
    detector_version: str

    def __post_init__(self) -> None:
        _named(self.detector_id, self.detector_version)


@dataclass(frozen=True)
class VolumeDetector(Detector):
    """Matches where ``metric`` is greater than ``threshold``: a finite float of 0 or more for rates, else an integer of 0 or more."""

    metric: str
    threshold: int | float

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.metric not in VOLUME_METRICS:
            raise DetectionError(f"unknown volume metric: {self.metric}")
        wanted = float if self.metric in RATE_METRICS else int
        if type(self.threshold) is not wanted:
            raise TypeError(f"the threshold of {self.metric} must be of type {wanted.__name__}")
        if not math.isfinite(self.threshold) or self.threshold < 0:
            raise DetectionError("the threshold must be finite and not negative")


@dataclass(frozen=True)
class ControlDetector(Detector):
    """Matches where a TCP control counter is greater than ``threshold``."""

    metric: str
    threshold: int

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.metric not in CONTROL_METRICS:
            raise DetectionError(f"unknown control metric: {self.metric}")
        if type(self.threshold) is not int:
            raise TypeError("the threshold must be an integer")
        if self.threshold < 0:
            raise DetectionError("the threshold must not be negative")


def _texts(decision: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, text in texts.items():
        out = F.when(decision == key, F.lit(text)).otherwise(out)
    return out


#: What packet findings and flows need of a decoded packet.
PACKET_COLUMNS = ("session", "packet_index", "ts_us", "source", "link_type", "captured_length", "original_length", "failure_classification", "failure_description", "protocol", "src_addr", "dst_addr", "src_port", "dst_port", "icmp_echo_id", *TCP_FLAGS, "admitted")


def checked_findings(findings: DataFrame) -> DataFrame:
    """The findings; one whose interpretation is not that of its decision and kind raises an error when it is read."""
    kinds = [INTEGRITY_TEXTS] if "detector_rank" not in findings.columns else [VOLUME_TEXTS, CONTROL_TEXTS]
    agrees = F.lit(False)
    for rank, texts in enumerate(kinds):
        own = F.lit(True) if len(kinds) == 1 else F.col("detector_rank") == rank
        agrees = agrees | (own & F.coalesce(_texts(F.col("decision"), texts) == F.col("security_interpretation"), F.lit(False)))
    wrong = F.raise_error(F.lit("DetectionError: a finding's interpretation is not that of its decision"))
    return findings.where(F.when(agrees, F.lit(True)).otherwise(wrong.cast("boolean")))


def packet_findings(decoded: DataFrame, detector: Detector) -> DataFrame:
    """One finding for each packet, in packet order by ``finding_index``."""
    failed = F.col("failure_classification")
    decision = F.when(failed.isNull(), "no_match").when(failed.isin("structural_failure", "integrity_failure"), "match").otherwise("not_evaluable")
    evidence = F.struct("session", "packet_index", "ts_us", "source", "link_type", "captured_length", "original_length", "protocol", "failure_classification", "failure_description").alias("raw_evidence")
    return decoded.select(F.col("packet_index").alias("finding_index"), F.lit(detector.detector_id).alias("detector_id"), F.lit(detector.detector_version).alias("detector_version"), decision.alias("decision"), evidence, _texts(decision, INTEGRITY_TEXTS).alias("security_interpretation"))


_WINDOW_EVIDENCE = (*WINDOW_KEY, *IDENTITY, "ip_version", "closure_reason", "closed_at", "first_us", "last_us", "packet_count", "forward_packet_count", "reverse_packet_count", "captured_bytes", "original_bytes")


def _flow_finding(state: DataFrame, detector: VolumeDetector | ControlDetector, observed: Column, texts: dict[str, str], rank: int) -> DataFrame:
    value = observed.cast("double")
    decision = F.when(value.isNull(), "not_evaluable").when(value > F.lit(float(detector.threshold)), "match").otherwise("no_match")
    fixed = [F.lit(detector.metric).alias("selected_metric"), F.lit(float(detector.threshold)).alias("threshold"), value.alias("observed_value"), F.lit(">").alias("comparison_operator")]
    return state.select(F.lit(rank).alias("detector_rank"), F.lit(detector.detector_id).alias("detector_id"), F.lit(detector.detector_version).alias("detector_version"), decision.alias("decision"), F.struct(*_WINDOW_EVIDENCE, *fixed).alias("raw_evidence"), _texts(decision, texts).alias("security_interpretation"))


def volume_findings(state: DataFrame, detector: VolumeDetector) -> DataFrame:
    """A finding for each closed TCP or UDP window."""
    observed = rate_features()[detector.metric] if detector.metric in RATE_METRICS else F.col(detector.metric)
    return _flow_finding(state.where("protocol IN (6, 17)"), detector, observed, VOLUME_TEXTS, 0)


def control_findings(state: DataFrame, detector: ControlDetector) -> DataFrame:
    """A finding for each closed TCP window."""
    return _flow_finding(state.where("protocol = 6"), detector, F.col(detector.metric), CONTROL_TEXTS, 1)


def flow_findings(state: DataFrame, volume: VolumeDetector, control: ControlDetector) -> DataFrame:
    """Both kinds; in closure order, volume before control of one window. ICMP windows have none."""
    return volume_findings(state, volume).unionByName(control_findings(state, control))


def finding_order() -> list[Column]:
    e = F.col("raw_evidence")
    return [e["session"], F.coalesce(e["closed_at"], F.lit(2**62)), e["sequence_number"], F.col("detector_rank")]
