"""Packet decoding for whole Arrow batches at once.

The bytes of a batch are one array; a field is read for all packets in one
step, at an offset that may differ from packet to packet. A packet that fails a
check leaves the set of live ones with its classification and message; later
steps read only what is live. Loops run over header kinds, options and
extension headers, never over packets.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

UNSUPPORTED, INCOMPLETE, STRUCTURAL, INTEGRITY = "unsupported", "incomplete", "structural_failure", "integrity_failure"
ETHERNET, RAW_IP, LINUX_COOKED = 1, 101, 113
IPV4, IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8)
EXTENSION_HEADERS = (0, 43, 44, 60)

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
_VLAN = {"tpid": "int", "pcp": "int", "dei": "int", "vid": "int"}
_HEADER = {"header_type": "int", "header_offset": "int", "declared_length": "int", "next_header": "int", "fragment_offset": "int", "more_fragments": "boolean", "identification": "bigint", "reserved": "int", "reserved_bits": "int"}
VLAN_FIELDS, HEADER_FIELDS = ({n: _ARROW[t] for n, t in fields.items()} for fields in (_VLAN, _HEADER))
VLAN_TYPE, HEADER_TYPE = (f"array<struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>>" for fields in (_VLAN, _HEADER))

#: Columns of a decoded packet and their Spark types.
DECODED = {
    "failure_classification": "string", "failure_description": "string",
    "ether_type": "int", "eth_destination": "binary", "eth_source": "binary", "vlan_tags": VLAN_TYPE,
    "ip_version": "int", "src_addr": "binary", "dst_addr": "binary", "protocol": "int", "hop_limit": "int",
    "ihl": "int", "dscp": "int", "ecn": "int", "total_length": "int", "identification": "int", "ip_flags": "int",
    "fragment_offset": "int", "ip_checksum": "int", "ip_options": "binary", "ipv4_checksum_valid": "boolean",
    "traffic_class": "int", "flow_label": "int", "payload_length": "int", "next_header": "int",
    "extension_headers": HEADER_TYPE,
    "src_port": "int", "dst_port": "int", "tcp_seq": "bigint", "tcp_ack": "bigint", "data_offset": "int", "reserved_bits": "int",
    "ns": "boolean", "cwr": "boolean", "ece": "boolean", "urg": "boolean", "ack": "boolean", "psh": "boolean", "rst": "boolean", "syn": "boolean", "fin": "boolean",
    "tcp_window": "int", "urgent_pointer": "int", "tcp_options": "binary", "transport_checksum": "int", "transport_checksum_valid": "boolean",
    "udp_length": "int", "udp_surplus": "int", "icmp_type": "int", "icmp_code": "int", "icmp_echo_id": "int",
    "payload": "binary", "is_fragment": "boolean", "admitted": "boolean",
    "placed_protocol": "int", "placed_flags": "int", "placed_offset": "int",
}


class Stretch(NamedTuple):
    """A run of bytes of each packet, and of which packets it is shown."""

    where: np.ndarray
    offset: np.ndarray | int
    size: np.ndarray | int


class Nested:
    """Lists of structs, one for each packet, gathered depth by depth."""

    def __init__(self, fields: dict[str, pa.DataType]) -> None:
        self.fields, self.where = fields, None
        self.rows: list[np.ndarray] = []
        self.values: list[dict[str, tuple[np.ndarray, np.ndarray | None]]] = []

    def add(self, rows: np.ndarray, **values: np.ndarray | tuple[np.ndarray, np.ndarray]) -> None:
        """The next entry of each of ``rows``; a value is given for all packets, with the packets that have one if not all do."""
        if len(rows):
            self.rows.append(rows)
            self.values.append({n: (v[0][rows], v[1][rows]) if isinstance(v, tuple) else (v[rows], None) for n, v in values.items()})

    def array(self, shown: np.ndarray) -> pa.Array:
        rows = np.concatenate([np.zeros(0, dtype=np.int64), *self.rows])
        order = np.argsort(rows, kind="stable")
        order = order[shown[rows[order]]]
        offsets = np.append(0, np.cumsum(np.bincount(rows[order], minlength=len(shown))))
        columns = []
        for name, kind in self.fields.items():
            value = np.concatenate([np.zeros(0, dtype=np.int64), *(v[name][0] for v in self.values)])[order]
            has = np.concatenate([np.zeros(0, dtype=bool), *(np.ones(len(v[name][0]), dtype=bool) if v[name][1] is None else v[name][1] for v in self.values)])[order]
            columns.append(pa.array(value.astype(bool) if pa.types.is_boolean(kind) else value, kind, mask=~has))
        structs = pa.StructArray.from_arrays(columns, fields=[pa.field(n, t) for n, t in self.fields.items()])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, mask=pa.array(~shown))


class Packets:
    """The bytes of a batch and which packets are still being decoded."""

    def __init__(self, raw: pa.Array) -> None:
        if isinstance(raw, pa.ChunkedArray):
            raw = raw.combine_chunks()
        raw = raw.cast(pa.large_binary()).fill_null(b"")
        if len(raw):
            _, offsets, data = raw.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
            own = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
        else:
            offsets, own = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        self.data = np.concatenate([own, np.zeros(1, dtype=np.uint8)])
        self.start, self.length = offsets[:-1], np.diff(offsets)
        self.n = len(self.start)
        self.live = np.ones(self.n, dtype=bool)
        self.classification = np.full(self.n, None, dtype=object)
        self.description = np.full(self.n, None, dtype=object)
        odd = np.arange(len(self.data)) & 1
        wide = self.data.astype(np.int64)
        self.even_sum = np.concatenate([[0], np.cumsum(np.where(odd == 0, wide, 0))])
        self.odd_sum = np.concatenate([[0], np.cumsum(np.where(odd == 1, wide, 0))])

    def byte(self, offset: np.ndarray | int) -> np.ndarray:
        """The byte at ``offset`` of each packet; 0 beyond its end."""
        offset = np.broadcast_to(offset, self.n)
        inside = (offset >= 0) & (offset < self.length)
        return np.where(inside, self.data[np.where(inside, self.start + offset, 0)], 0).astype(np.int64)

    def number(self, offset: np.ndarray | int, size: int) -> np.ndarray:
        """The big-endian number of ``size`` bytes at ``offset``."""
        total = np.zeros(self.n, dtype=np.int64)
        for k in range(size):
            total = total << 8 | self.byte(np.asarray(offset) + k)
        return total

    def fail(self, where: np.ndarray, classification: str, message) -> None:
        """Take live packets out; ``message`` is a text or a function of the packet's place."""
        at = np.flatnonzero(self.live & where)
        self.classification[at] = classification
        self.description[at] = [message(k) for k in at.tolist()] if callable(message) else message
        self.live[at] = False

    def word_sum(self, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sum of the 16-bit words of a stretch, the last odd byte padded with zero."""
        a = self.start + np.where(size > 0, offset, 0)
        b = a + np.maximum(size, 0)
        even, odd = self.even_sum[b] - self.even_sum[a], self.odd_sum[b] - self.odd_sum[a]
        return np.where(a & 1, odd * 256 + even, even * 256 + odd)

    def any_set(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a byte from ``begin`` to before ``end``, places in the batch, is not zero."""
        return (self.even_sum[end] + self.odd_sum[end]) - (self.even_sum[begin] + self.odd_sum[begin]) > 0

    def slices(self, stretch: Stretch, shown: np.ndarray) -> pa.Array:
        """The bytes of a stretch; null where it is not shown. Each lies within its packet, so that all are one pass over the batch."""
        shown = stretch.where & shown
        size = np.where(shown, np.clip(stretch.size, 0, np.maximum(self.length - stretch.offset, 0)), 0)
        begin = (self.start + stretch.offset)[size > 0]
        edge = np.zeros(len(self.data) + 1, dtype=np.int8)
        edge[begin] += 1
        edge[begin + size[size > 0]] -= 1
        inside = np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        valid = np.packbits(shown, bitorder="little")
        return pa.Array.from_buffers(pa.binary(), self.n, [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(self.data[inside])])


def folded(total: np.ndarray) -> np.ndarray:
    """One's-complement sum of 16 bits."""
    for _ in range(4):
        total = (total & 0xFFFF) + (total >> 16)
    return total


def _check_options(p: Packets, where: np.ndarray, offset: np.ndarray, size: np.ndarray, name: str) -> None:
    """Kinds 0 (end; the rest must be zero) and 1 stand alone, others have a length of two or more within the area."""
    at, open_ = np.zeros(p.n, dtype=np.int64), where & p.live & (size > 0)
    while open_.any():
        kind, length = p.byte(offset + at), p.byte(offset + at + 1)
        ended = open_ & (kind == 0)
        rest, stop = (p.start + offset + at)[ended], (p.start + offset + size)[ended]
        padded = np.zeros(p.n, dtype=bool)
        padded[ended] = p.any_set(rest, stop)
        p.fail(padded, STRUCTURAL, f"{name} option padding must be zero")
        open_ &= ~ended
        single = open_ & (kind == 1)
        sized = open_ & ~single
        no_length = sized & (at + 1 >= size)
        p.fail(no_length, STRUCTURAL, f"{name} option length field exceeds option area")
        short = sized & ~no_length & (length < 2)
        p.fail(short, STRUCTURAL, f"{name} option length must be at least 2 bytes")
        long = sized & ~no_length & ~short & (at + length > size)
        p.fail(long, STRUCTURAL, f"{name} option length exceeds option area")
        open_ &= p.live
        at = at + np.where(single, 1, length)
        open_ &= at < size


def _link_layer(p: Packets, link: np.ndarray, out: dict) -> tuple[np.ndarray, np.ndarray]:
    ethernet, raw, cooked = link == ETHERNET, link == RAW_IP, link == LINUX_COOKED
    p.fail(~(ethernet | raw | cooked), UNSUPPORTED, "Packet analysis requires LinkType 1, 101 or 113")
    p.fail(ethernet & (p.length < 14), INCOMPLETE, lambda k: f"Ethernet frame is too short: expected at least 14 bytes, got {p.length[k]}")
    kind, offset = p.number(12, 2), np.where(ethernet, 14, 0)
    tags = Nested(VLAN_FIELDS)
    for depth in range(3):
        tagged = p.live & ethernet & np.isin(kind, VLAN_TAGS)
        if depth == 2:
            p.fail(tagged, UNSUPPORTED, "Ethernet frame exceeds the supported VLAN tag depth")
            break
        p.fail(tagged & (p.length < offset + 4), INCOMPLETE, lambda k: f"Ethernet VLAN tag is too short: expected at least {offset[k] + 4} bytes, got {p.length[k]}")
        tagged &= p.live
        control, after = p.number(offset, 2), p.number(offset + 2, 2)
        tags.add(np.flatnonzero(tagged), tpid=kind, pcp=control >> 13, dei=control >> 12 & 1, vid=control & 0xFFF)
        kind, offset = np.where(tagged, after, kind), offset + 4 * tagged
    p.fail(raw & (p.length < 1), INCOMPLETE, lambda k: f"Raw IP packet is too short: expected at least 1 byte, got {p.length[k]}")
    version = p.byte(0) >> 4
    p.fail(raw & ~np.isin(version, (4, 6)), UNSUPPORTED, "Raw IP version must be 4 or 6")
    kind = np.where(raw, np.where(version == 4, IPV4, IPV6), kind)
    p.fail(cooked & (p.length < 16), INCOMPLETE, lambda k: f"Linux cooked frame is too short: expected at least 16 bytes, got {p.length[k]}")
    kind, offset = np.where(cooked, p.number(14, 2), kind), np.where(cooked, 16, offset)
    seen = p.live & ethernet
    out["ether_type"] = (kind, p.live.copy())
    out["eth_destination"], out["eth_source"] = Stretch(seen, 0, 6), Stretch(seen, 6, 6)
    tags.where = seen
    out["vlan_tags"] = tags
    p.fail(~np.isin(kind, (IPV4, IPV6)), UNSUPPORTED, "Packet analysis requires IPv4 EtherType 0x0800 or IPv6 EtherType 0x86DD")
    return kind, offset


def _ipv4(p: Packets, v4: np.ndarray, at: np.ndarray, out: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    room, first = p.length - at, p.byte(at)
    ihl, total = first & 15, p.number(at + 2, 2)
    header = ihl * 4
    p.fail(v4 & (room < 20), INCOMPLETE, "IPv4 header is too short: expected at least 20 bytes")
    p.fail(v4 & (first >> 4 != 4), STRUCTURAL, "IPv4 version must be 4")
    p.fail(v4 & (ihl < 5), STRUCTURAL, "IPv4 IHL must be at least 5")
    p.fail(v4 & (header > room), INCOMPLETE, "IPv4 header length exceeds available bytes")
    p.fail(v4 & (total < header), STRUCTURAL, "IPv4 total length is smaller than header length")
    p.fail(v4 & (total > room), INCOMPLETE, "IPv4 total length exceeds available bytes")
    _check_options(p, v4, at + 20, header - 20, "IPv4")
    ok, place = v4 & p.live, p.number(at + 6, 2)
    for name, value in (("ihl", ihl), ("dscp", p.byte(at + 1) >> 2), ("ecn", p.byte(at + 1) & 3), ("total_length", total), ("identification", p.number(at + 4, 2)), ("ip_flags", place >> 13), ("fragment_offset", place & 0x1FFF), ("ip_checksum", p.number(at + 10, 2))):
        out[name] = (value, ok)
    out["ip_options"] = Stretch(ok, at + 20, header - 20)
    field = p.number(at + 10, 2)
    valid = (~folded(p.word_sum(at, np.where(ok, header, 0)) - field) & 0xFFFF) == field
    out["ipv4_checksum_valid"] = (valid, ok)
    return at + header, total - header, place


def _ipv6(p: Packets, v6: np.ndarray, at: np.ndarray, out: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    room, word, size = p.length - at, p.number(at, 4), p.number(at + 4, 2)
    p.fail(v6 & (room < 40), INCOMPLETE, "IPv6 header is too short: expected at least 40 bytes")
    p.fail(v6 & (word >> 28 != 6), STRUCTURAL, "IPv6 version must be 6")
    p.fail(v6 & (size + 40 > room), INCOMPLETE, "IPv6 payload length exceeds available bytes")
    base, used, kind = at + 40, np.zeros(p.n, dtype=np.int64), p.byte(at + 6)
    chains = Nested(HEADER_FIELDS)
    open_, later, whole = v6 & p.live & np.isin(kind, EXTENSION_HEADERS), np.zeros(p.n, dtype=bool), np.ones(p.n, dtype=bool)
    while open_.any():
        fragment = kind == 44
        p.fail(open_ & (size - used < np.where(fragment, 1, 2)), INCOMPLETE, "IPv6 extension header prefix exceeds available IPv6 payload")
        open_ &= p.live
        declared = np.where(fragment, 8, (p.byte(base + used + 1) + 1) * 8)
        p.fail(open_ & (used + declared > size), INCOMPLETE, "IPv6 extension header length exceeds available IPv6 payload")
        open_ &= p.live
        after, place, ident, spare = p.byte(base + used), p.number(base + used + 2, 2), p.number(base + used + 4, 4), p.byte(base + used + 1)
        chains.add(np.flatnonzero(open_), header_type=kind, header_offset=40 + used, declared_length=declared, next_header=after, fragment_offset=(place >> 3, fragment), more_fragments=(place & 1, fragment), identification=(ident, fragment), reserved=(spare, fragment), reserved_bits=(place >> 1 & 3, fragment))
        stop = open_ & fragment & (place >> 3 > 0)
        later |= stop
        whole &= ~(open_ & fragment & ((place >> 3 > 0) | (place & 1 == 1)))
        used, kind = np.where(open_, used + declared, used), np.where(open_, after, kind)
        open_ &= ~stop & np.isin(kind, EXTENSION_HEADERS)
    ok = v6 & p.live
    for name, value in (("traffic_class", word >> 20 & 0xFF), ("flow_label", word & 0xFFFFF), ("payload_length", size), ("next_header", p.byte(at + 6))):
        out[name] = (value, ok)
    chains.where = ok
    out["extension_headers"] = chains
    return base + used, size - used, kind, later, whole


def decode(link_type: pa.Array, raw: pa.Array, wanted: tuple[str, ...] = tuple(DECODED)) -> pa.RecordBatch:
    """One row of the ``wanted`` among the ``DECODED`` columns for each packet.

    A null link type is none that can be analysed; a null packet is an empty one.
    """
    p, out = Packets(raw), {}
    link = link_type.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(link_type) else np.zeros(0, dtype=np.int64)
    kind, at = _link_layer(p, link, out)
    v4, v6 = kind == IPV4, kind == IPV6
    protocol4, hops, source = p.byte(at + 9), np.where(v4, p.byte(at + 8), p.byte(at + 7)), np.where(v4, at + 12, at + 8)
    body4, size4, place = _ipv4(p, v4, at, out)
    body6, size6, protocol6, later, whole = _ipv6(p, v6, at, out)
    body, size, protocol = np.where(v4, body4, body6), np.where(v4, size4, size6), np.where(v4, protocol4, protocol6)
    family = np.where(v4, 4, 6)
    width = np.where(v4, 4, 16)
    offset4 = np.where(v4, place & 0x1FFF, 0)
    named = np.where(v4, "IPv4", "IPv6")
    tcp, udp = (protocol == 6) & ~(v6 & later), (protocol == 17) & ~(v6 & later)
    icmp4, icmp6 = v4 & (protocol == 1), v6 & (protocol == 58) & whole

    headed = v4 & p.live

    p.fail(tcp & (offset4 > 0), UNSUPPORTED, "TCP decoding requires an initial IPv4 fragment")
    p.fail(tcp & (size < 20), INCOMPLETE, "TCP header is too short: expected at least 20 bytes")
    control = p.number(body + 12, 2)
    header = (control >> 12) * 4
    p.fail(tcp & (header < 20), STRUCTURAL, "TCP data offset must be at least 5")
    p.fail(tcp & (header > size), INCOMPLETE, lambda k: f"TCP header length exceeds available {named[k]} payload")
    _check_options(p, tcp, body + 20, header - 20, "TCP")

    p.fail(udp & (offset4 > 0), UNSUPPORTED, "UDP decoding requires an initial IPv4 fragment")
    p.fail(udp & (size < 8), INCOMPLETE, "UDP header is too short: expected at least 8 bytes")
    stated = p.number(body + 4, 2)
    p.fail(udp & (stated < 8), STRUCTURAL, "UDP length must be at least 8 bytes")
    p.fail(udp & (stated > size), INCOMPLETE, lambda k: f"UDP length exceeds available {named[k]} payload")

    p.fail(icmp4 & (offset4 > 0), UNSUPPORTED, "ICMP decoding requires an initial IPv4 fragment")
    p.fail(icmp4 & (size < 8), INCOMPLETE, "ICMP header is too short: expected at least 8 bytes")
    p.fail(icmp6 & (size < 4), INCOMPLETE, "ICMPv6 header is too short: expected at least 4 bytes")

    tcp, udp, icmp4, icmp6 = tcp & p.live, udp & p.live, icmp4 & p.live, icmp6 & p.live
    # checksums of IPv4 transports: a pseudo header, then the segment with its own field left out
    span = np.where(udp, stated, size)
    field = np.where(tcp, p.number(body + 16, 2), np.where(udp, p.number(body + 6, 2), p.number(body + 2, 2)))
    checked = v4 & (tcp | udp | icmp4)
    total = p.word_sum(body, np.where(checked, span, 0)) - field
    total = total + np.where(icmp4, 0, p.word_sum(source, np.where(checked, 8, 0)) + protocol + span)
    computed = ~folded(np.maximum(total, 0)) & 0xFFFF
    valid = np.where(udp, np.where(computed == 0, 0xFFFF, computed) == field, computed == field)

    ip_bad = v4 & p.live & ~out["ipv4_checksum_valid"][0]
    bad = {"TCP": checked & tcp & ~valid, "UDP": checked & udp & ~valid & (field != 0), "ICMPv4": checked & icmp4 & ~valid}
    failed = ip_bad.copy()
    for mask in bad.values():
        failed |= mask

    def layers(k: int) -> str:
        return "Checksum validation failed for " + ", ".join([*(["IPv4"] if ip_bad[k] else []), *(n for n, m in bad.items() if m[k])])

    p.fail(failed, INTEGRITY, layers)
    ok = p.live
    # the place in their datagram of packets that succeed, and of later fragments whose header holds
    later4 = headed & out["ipv4_checksum_valid"][0] & (offset4 > 0) & np.isin(protocol, (1, 6, 17)) & (p.classification == UNSUPPORTED)
    placed = (v4 & ok) | later4
    out |= {"ip_version": (family, ok), "protocol": (protocol, ok), "hop_limit": (hops, ok), "src_addr": Stretch(ok, source, width), "dst_addr": Stretch(ok, source + width, width)}
    ports = tcp | udp
    out |= {"src_port": (p.number(body, 2), ports), "dst_port": (p.number(body + 2, 2), ports), "tcp_seq": (p.number(body + 4, 4), tcp), "tcp_ack": (p.number(body + 8, 4), tcp), "data_offset": (control >> 12, tcp), "reserved_bits": (control >> 9 & 7, tcp)}
    out |= {name: (control >> bit & 1 == 1, tcp) for bit, name in enumerate(("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr", "ns"))}
    out |= {"tcp_window": (p.number(body + 14, 2), tcp), "urgent_pointer": (p.number(body + 18, 2), tcp), "tcp_options": Stretch(tcp & ok, body + 20, header - 20)}
    icmp = icmp4 | icmp6
    shown = field.copy()
    shown[v6 & tcp], shown[v6 & udp], shown[icmp6] = p.number(body + 16, 2)[v6 & tcp], p.number(body + 6, 2)[v6 & udp], p.number(body + 2, 2)[icmp6]
    out |= {"transport_checksum": (shown, ports | icmp), "transport_checksum_valid": (valid, checked), "udp_length": (stated, udp), "udp_surplus": (size - stated, udp), "icmp_type": (p.byte(body), icmp), "icmp_code": (p.byte(body + 1), icmp)}
    echo = (icmp4 & np.isin(p.byte(body), (0, 8))) | (icmp6 & np.isin(p.byte(body), (128, 129)) & (size >= 8))
    out["icmp_echo_id"] = (p.number(body + 4, 2), echo)
    skip = np.where(tcp, header, np.where(udp, 8, np.where(icmp4, 8, np.where(icmp6, 4, 0))))
    out["payload"] = Stretch(ok, body + skip, np.maximum(np.where(udp, stated, size) - skip, 0))
    out["is_fragment"] = (np.where(v4, (place >> 13 & 1 == 1) | (offset4 > 0), ~whole), ok)
    out["admitted"] = (tcp | udp | icmp, ok)
    out |= {"placed_protocol": (protocol, placed), "placed_flags": (place >> 13, placed), "placed_offset": (offset4, placed)}

    arrays = []
    # a packet that failed shows its classification and message only
    for name, kind_ in ((n, DECODED[n]) for n in wanted):
        if name == "failure_classification":
            arrays.append(pa.array(p.classification.tolist(), pa.string()))
        elif name == "failure_description":
            arrays.append(pa.array(p.description.tolist(), pa.string()))
        elif isinstance(out[name], Stretch):
            arrays.append(p.slices(out[name], ok))
        elif isinstance(out[name], Nested):
            arrays.append(out[name].array(out[name].where & ok))
        else:
            value, mask = out[name]
            shown_mask = mask & (ok | placed)
            if not name.startswith("placed_"):
                shown_mask &= ok
            arrays.append(pa.array(value.astype(bool) if kind_ == "boolean" else value, _ARROW[kind_], mask=~shown_mask))
    return pa.RecordBatch.from_arrays(arrays, names=list(wanted))
