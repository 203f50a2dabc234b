"""Around the pipeline: datasets, experiments, reports, benchmarks and the categories of errors."""

from __future__ import annotations

import math
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException

from flowlark.errors import CaptureError, DetectionError, FlowError, PacketAnalysisError
from flowlark.operators.decoding import InadmissiblePacket


def _not_blank(**texts: str) -> None:
    for name, value in texts.items():
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must be a string that is not blank")


@dataclass(frozen=True)
class DatasetCase:
    """A named capture with its ground truth, in whatever form the operation takes them."""

    name: str
    inputs: Any = None

    def __post_init__(self) -> None:
        _not_blank(name=self.name)


@dataclass(frozen=True)
class Dataset:
    """Cases in order, each name once."""

    name: str
    version: str
    cases: tuple[DatasetCase, ...]

    def __post_init__(self) -> None:
        _not_blank(name=self.name, version=self.version)
        if len({c.name for c in self.cases}) != len(self.cases):
            raise ValueError("case names must be unique")


@dataclass(frozen=True)
class Experiment:
    """Which detectors were run on which dataset."""

    name: str
    detectors: tuple[tuple[str, str], ...]
    dataset: Dataset | None = None

    def __post_init__(self) -> None:
        _not_blank(name=self.name)


@dataclass(frozen=True)
class EvaluationReport:
    """Metrics by channel with the experiment they belong to."""

    metrics: dict[str, dict[str, Any]]
    experiment: Experiment | None = None

    def __post_init__(self) -> None:
        if set(self.metrics) != {"packet", "flow"}:
            raise ValueError("a report has the metrics of packets and of flows")


def report_of(metrics, experiment: Experiment | None = None) -> EvaluationReport:
    """The report of a ``metrics_of`` relation (two rows)."""
    rows = {r["channel"]: {k: v for k, v in r.asDict().items() if k != "channel"} for r in metrics.collect()}
    return EvaluationReport(rows, experiment)


@dataclass(frozen=True)
class CaseResult:
    case: DatasetCase
    value: Any = None


def run_dataset(dataset: Dataset, operation: Callable[[DatasetCase], CaseResult]) -> tuple[CaseResult, ...]:
    """The operation once for each case, in order; its result must be that of the case."""
    out = []
    for case in dataset.cases:
        result = operation(case)
        if not isinstance(result, CaseResult) or result.case != case:
            raise ValueError("the result must belong to the case")
        out.append(result)
    return tuple(out)


SUMMARIES: dict[str, Callable[[list[float]], float]] = {"minimum": min, "maximum": max, "total": math.fsum, "mean": statistics.fmean, "median": statistics.median}


def measure(operation: Callable[[], object], *, runs: int, warmups: int = 0, clock: Callable[[], float] = time.perf_counter) -> dict[str, Any]:
    """``seconds`` of each of ``runs`` runs after ``warmups`` that do not count, and their ``SUMMARIES``.

    The clock is read before and after each run that counts; all readings must
    be finite floats that do not fall.
    """
    if runs < 1 or warmups < 0:
        raise ValueError("at least one measured run and no negative number of warmups")
    readings: list[float] = []
    for k in range(warmups + runs):
        readings += [clock()] if k >= warmups else []
        operation()
        readings += [clock()] if k >= warmups else []
    if any(type(r) is not float for r in readings):
        raise TypeError("clock readings must be floats")
    if not all(map(math.isfinite, readings)) or sorted(readings) != readings:
        raise ValueError("clock readings must be finite and must not fall")
    seconds = [after - before for before, after in zip(readings[::2], readings[1::2])]
    return {"seconds": tuple(seconds)} | {name: of(seconds) for name, of in SUMMARIES.items()}


CAPTURE, ANALYSIS, FLOWS, DETECTION, OTHER = "capture_failure", "packet_analysis_failure", "flow_processing_failure", "detection_failure", "unclassified_failure"


_CATEGORIES = {CaptureError: CAPTURE, PacketAnalysisError: ANALYSIS, FlowError: FLOWS, InadmissiblePacket: FLOWS, DetectionError: DETECTION}


@dataclass(frozen=True)
class Diagnostic:
    category: str
    operation_id: str
    message: str
    context: tuple = field(default=())


def diagnose(error: Exception, *, operation_id: str, message: str, context: tuple = ()) -> Diagnostic:
    """The category of an error by its type; of one that Spark reports from a task, by the type named in its text."""
    _not_blank(operation_id=operation_id, message=message)
    category = _CATEGORIES.get(type(error), OTHER)
    if isinstance(error, PySparkException):
        category = next((c for kind, c in _CATEGORIES.items() if kind.__name__ in str(error)), OTHER)
    return Diagnostic(category, operation_id, message, context)
