"""The fixed feature vector of a closed window: 49 columns in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.schemas import FEATURE_CONTRACT, IDENTITY, WINDOW_KEY


def _ratio(n: str, d: str) -> Column:
    return F.when(F.col(d) != 0, F.col(n).cast("double") / F.col(d)).otherwise(F.lit(0.0))


def _mean(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n)).otherwise(F.lit(0.0))


def _variance(squares: str, total: str, n: str) -> Column:
    """Population variance from exact sums: (n S2 - S1 squared) / n squared, in decimals until the division."""
    s1 = F.col(total).cast("decimal(19,0)")
    exact = F.col(n).cast("decimal(10,0)") * F.col(squares).cast("decimal(28,0)") - s1 * s1
    return F.when(F.col(n) > 0, exact.cast("double") / (F.col(n).cast("double") * F.col(n))).otherwise(F.lit(0.0))


def volume_features() -> dict[str, Column]:
    out = {n: F.col(n) for n in ("packet_count", "captured_bytes", "original_bytes", "forward_packet_count", "reverse_packet_count", "forward_captured_bytes", "reverse_captured_bytes", "forward_original_bytes", "reverse_original_bytes")}
    for label, whole in (("packet_ratio", "packet_count"), ("captured_byte_ratio", "captured_bytes"), ("original_byte_ratio", "original_bytes")):
        out |= {f"{d}_{label}": _ratio(f"{d}_{whole}", whole) for d in ("forward", "reverse")}
    return out | {"capture_ratio": _ratio("captured_bytes", "original_bytes")}


def size_features() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for size in ("captured", "original"):
        variance = _variance(f"{size}_square_sum", f"{size}_bytes", "packet_count")
        out |= {f"min_{size}_length": F.col(f"min_{size}_length"), f"max_{size}_length": F.col(f"max_{size}_length"), f"mean_{size}_length": _mean(f"{size}_bytes", "packet_count"), f"variance_{size}_length": variance, f"standard_deviation_{size}_length": F.sqrt(variance)}
    out |= {f"{d}_mean_captured_length": _mean(f"{d}_captured_bytes", f"{d}_packet_count") for d in ("forward", "reverse")}
    return out | {f"{d}_variance_captured_length": _variance(f"{d}_captured_square_sum", f"{d}_captured_bytes", f"{d}_packet_count") for d in ("forward", "reverse")}


def _seconds() -> Column:
    return (F.col("last_us") - F.col("first_us")).cast("double") / F.lit(1_000_000.0)


def rate_features() -> dict[str, Column]:
    """Null where a window has no duration."""
    per = lambda n: F.when(F.col("last_us") > F.col("first_us"), F.col(n).cast("double") / _seconds())
    return {"packets_per_second": per("packet_count"), "captured_bytes_per_second": per("captured_bytes"), "original_bytes_per_second": per("original_bytes")}


def gap_features(direction: str = "") -> dict[str, Column]:
    """Without gaps: zeros over all packets, nulls of a direction."""
    p = f"{direction}_" if direction else ""
    some = F.col(f"{p}gap_count") > 0
    none = F.lit(None).cast("double") if direction else F.lit(0.0)
    million = F.lit(1_000_000.0)
    variance = F.greatest(F.lit(0.0), _variance(f"{p}gap_square_sum", f"{p}gap_us_sum", f"{p}gap_count") / F.lit(1e12))
    values = {"mean": F.col(f"{p}gap_us_sum").cast("double") / F.col(f"{p}gap_count") / million, "variance": variance, "standard_deviation": F.sqrt(variance), "min": F.col(f"{p}gap_us_min").cast("double") / million, "max": F.col(f"{p}gap_us_max").cast("double") / million}
    return {f"{p}{k}_inter_arrival_seconds": F.when(some, v).otherwise(none) for k, v in values.items()}


def feature_columns() -> dict[str, Column]:
    """The 49 features by group.field, in the order of the vector."""
    groups = (
        ("flow_volume_features", volume_features()), ("packet_size_features", size_features()),
        ("flow_duration_features", {"duration_seconds": _seconds()}), ("flow_rate_features", rate_features()),
        ("inter_arrival_features", gap_features()), ("directional_inter_arrival_features", gap_features("forward") | gap_features("reverse")),
    )
    return {f"{group}.{field}": column for group, fields in groups for field, column in fields.items()}


def project_features(state: DataFrame, *, dotted: bool = True) -> DataFrame:
    """Window key, provenance and the 49 features; with ``dotted`` false the names are the fields alone."""
    origin = F.struct(F.lit(FEATURE_CONTRACT[0]).alias("feature_contract_id"), F.lit(FEATURE_CONTRACT[1]).alias("feature_contract_version"), *WINDOW_KEY, *IDENTITY, "closure_reason", "first_us", "last_us").alias("provenance")
    return state.select(*WINDOW_KEY, origin, *[c.alias(n if dotted else n.split(".")[1]) for n, c in feature_columns().items()])


def research_examples(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with an optional ``label`` by window key; every window stays, in any number of rows per label."""
    return features.join(labels.select(*WINDOW_KEY, "label"), list(WINDOW_KEY), "left")


def checked_contract(features: DataFrame) -> DataFrame:
    """Raises, when computed, for rows of another feature contract or version."""
    ours = (F.col("provenance.feature_contract_id") == FEATURE_CONTRACT[0]) & (F.col("provenance.feature_contract_version") == FEATURE_CONTRACT[1])
    return features.where(F.when(ours, F.lit(True)).otherwise(F.raise_error(F.lit("unsupported feature contract")).cast("boolean")))
