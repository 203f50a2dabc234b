"""Findings and summaries as JSON, built by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def iso_time(us: Column) -> Column:
    """UTC with six places and +00:00."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def _identity(e: Column) -> Column:
    return F.struct(e["ip_version"].alias("ip_version"), F.lower(F.hex(e["a_addr"])).alias("source_address"), F.lower(F.hex(e["b_addr"])).alias("destination_address"), e["a_port"].alias("source_port"), e["b_port"].alias("destination_port"), e["protocol"].alias("protocol"))


def packet_finding_json(findings: DataFrame) -> DataFrame:
    """(finding_index, json) of packet findings; the session's time zone must be UTC."""
    e = F.col("raw_evidence")
    evidence = F.struct(iso_time(e["ts_us"]).alias("captured_at"), e["source"].alias("capture_source"), *[e[n].alias(n) for n in ("link_type", "captured_length", "original_length", "protocol", "failure_classification", "failure_description")])
    return findings.select("finding_index", F.to_json(F.struct("detector_id", "detector_version", "decision", evidence.alias("raw_evidence"), "security_interpretation"), _KEEP_NULLS).alias("json"))


def flow_finding_json(findings: DataFrame) -> DataFrame:
    """(finding_index, json) of flow findings; counts are integers, rates numbers with a point."""
    from flowlark.operators.detectors import RATE_METRICS

    e = F.col("raw_evidence")
    rate = e["selected_metric"].isin(*RATE_METRICS)
    volume = F.col("detector_rank") == 0

    def evidence(as_rate: bool, with_bytes: bool) -> Column:
        number = (lambda c: c) if as_rate else (lambda c: c.cast("bigint"))
        parts = [e["session"].alias("capture_session_id"), e["sequence_number"].alias("sequence_number"), e["closure_reason"].alias("closure_reason"), _identity(e).alias("identity"), iso_time(e["first_us"]).alias("first_captured_at"), iso_time(e["last_us"]).alias("last_captured_at"), e["selected_metric"].alias("selected_metric"), number(e["threshold"]).alias("threshold"), number(e["observed_value"]).alias("observed_value"), e["comparison_operator"].alias("comparison_operator"), e["packet_count"].alias("total_packet_count"), e["forward_packet_count"].alias("forward_packet_count"), e["reverse_packet_count"].alias("reverse_packet_count")]
        if with_bytes:
            parts += [e["captured_bytes"].alias("captured_byte_total"), e["original_bytes"].alias("original_byte_total")]
        return F.to_json(F.struct("detector_id", "detector_version", "decision", F.struct(*parts).alias("raw_evidence"), "security_interpretation"), _KEEP_NULLS)

    text = F.when(volume & rate, evidence(True, True)).when(volume, evidence(False, True)).otherwise(evidence(False, False))
    return findings.select("finding_index", text.alias("json"))


def ldap_summary_lines(events: DataFrame, windows: DataFrame) -> DataFrame:
    """One JSON line (``value``) for each LDAP request: identity, direction, request, status, responses and the closing operation."""
    s = events.where("kind = 'ldap_summary'").join(windows, ["session", "sequence_number"])
    version = F.when(F.length("a_addr") == 4, 4).otherwise(6)
    identity = F.struct(version.alias("ip_version"), F.lower(F.hex("a_addr")).alias("source_address"), F.lower(F.hex("b_addr")).alias("destination_address"), F.col("a_port").alias("source_port"), F.col("b_port").alias("destination_port"), "protocol")
    request = F.struct("message_id", F.col("code").alias("operation_tag"), "operation", F.col("length").alias("message_length"))
    row = F.struct(identity.alias("identity"), F.when(F.col("is_forward"), "forward").otherwise("reverse").alias("direction"), request.alias("request"), "status", "response_count", F.col("reason").alias("terminal_response"))
    return s.select(F.to_json(row, _KEEP_NULLS).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write ``value`` as text files."""
    lines.select("value").write.text(path)
