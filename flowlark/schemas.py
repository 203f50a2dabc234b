"""Schemas of the relations that operators pass on, and their fixed values."""

from __future__ import annotations

from flowlark.functions.wire import DECODED

#: A captured packet.
OBSERVATION = "session string, packet_index bigint, ts_us bigint, link_type int, captured_length bigint, original_length bigint, raw_bytes binary, source string"
DECODED_COLUMNS = ", ".join(f"{n} {t}" for n, t in DECODED.items())

#: Key of a flow: canonical endpoints, protocol and, of ICMP echo messages, the identifier.
IDENTITY = ("a_addr", "b_addr", "a_port", "b_port", "protocol", "icmp_echo_id")
WINDOW_KEY = ("session", "sequence_number")
TCP_FLAGS = ("ns", "cwr", "ece", "urg", "ack", "psh", "rst", "syn", "fin")

CLOSED_BY_INACTIVITY = "inactivity"
CLOSED_BY_CAPACITY = "capacity"
CLOSED_BY_REQUEST = "explicit_segmentation"
CLOSED_BY_END = "capture_session_end"

MAX_ACTIVE_WINDOWS = 1024
FEATURE_CONTRACT = ("flow-feature-snapshot", "1")
