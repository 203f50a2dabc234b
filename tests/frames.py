"""Builders of packets and captures for tests."""

from __future__ import annotations

import struct

A4, B4 = bytes.fromhex("c0000201"), bytes.fromhex("c6336402")
A6, B6 = bytes.fromhex("20010db8" + "0" * 23 + "1"), bytes.fromhex("20010db8" + "0" * 23 + "2")
ETHERNET = bytes.fromhex("00112233445566778899aabb")
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def checksum(data: bytes) -> int:
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f"!{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def ipv4(protocol: int, body: bytes, *, src: bytes = A4, dst: bytes = B4, options: bytes = b"", fragment: int = 0, ttl: int = 64, tos: int = 0) -> bytes:
    head = struct.pack("!BBHHHBBH4s4s", 0x40 | 5 + len(options) // 4, tos, 20 + len(options) + len(body), 1, fragment, ttl, protocol, 0, src, dst) + options
    return head[:10] + struct.pack("!H", checksum(head)) + head[12:] + body


def ipv6(next_header: int, body: bytes, *, src: bytes = A6, dst: bytes = B6, label: int = 0, hops: int = 64) -> bytes:
    return struct.pack("!IHBB", 6 << 28 | label, len(body), next_header, hops) + src + dst + body


def tcp(flags: int, *, seq: int = 0, ack: int = 0, payload: bytes = b"", sport: int = 12345, dport: int = 443, src: bytes = A4, dst: bytes = B4, options: bytes = b"") -> bytes:
    head = struct.pack("!HHIIHHHH", sport, dport, seq, ack, (5 + len(options) // 4) << 12 | flags, 4096, 0, 0) + options
    pseudo = src + dst + (struct.pack("!BBH", 0, 6, len(head) + len(payload)) if len(src) == 4 else struct.pack("!IHBB", len(head) + len(payload), 0, 0, 6))
    return head[:16] + struct.pack("!H", checksum(pseudo + head + payload)) + head[18:] + payload


def udp(payload: bytes, *, sport: int = 12345, dport: int = 443, check: int = 0) -> bytes:
    return struct.pack("!HHHH", sport, dport, 8 + len(payload), check) + payload


def ethernet(packet: bytes) -> bytes:
    kind = b"\x08\x00" if packet[0] >> 4 == 4 else b"\x86\xdd"
    return (ETHERNET + kind + packet).ljust(60, b"\0")


def segment(forward: bool, flags: int, *, version: int = 4, seq: int = 0, ack: int = 0, payload: bytes = b"", port: int = 12345, server: int = 443) -> bytes:
    """A TCP frame from client to server or back."""
    a, b = (A4, B4) if version == 4 else (A6, B6)
    src, dst, sport, dport = (a, b, port, server) if forward else (b, a, server, port)
    body = tcp(flags, seq=seq, ack=ack, payload=payload, sport=sport, dport=dport, src=src, dst=dst)
    return ethernet(ipv4(6, body, src=src, dst=dst) if version == 4 else ipv6(6, body, src=src, dst=dst))


def datagram(forward: bool, payload: bytes, *, version: int = 4, port: int = 12345, server: int = 443) -> bytes:
    a, b = (A4, B4) if version == 4 else (A6, B6)
    src, dst, sport, dport = (a, b, port, server) if forward else (b, a, server, port)
    body = udp(payload, sport=sport, dport=dport)
    return ethernet(ipv4(17, body, src=src, dst=dst) if version == 4 else ipv6(17, body, src=src, dst=dst))


def capture(records: list[tuple[int, bytes]], *, order: str = "<", nano: bool = False, snaplen: int = 65535, network: int = 1, version: tuple[int, int] = (2, 4)) -> bytes:
    """A capture file of (time in microseconds, bytes) records."""
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, *version, 0, 0, snaplen, network)]
    for ts, data in records:
        fraction = ts % 1_000_000 * (1000 if nano else 1)
        out.append(struct.pack(order + "IIII", ts // 1_000_000, fraction, len(data), len(data)) + data)
    return b"".join(out)


TCP_EXCHANGE = [(1000000, True, 100, 0, SYN, b""), (1100000, False, 900, 101, SYN | ACK, b""), (1200000, True, 101, 901, ACK, b""), (1300000, True, 101, 901, PSH | ACK, b"abc"), (1500000, False, 901, 104, ACK, b""), (1700000, False, 901, 104, FIN | ACK, b""), (1800000, True, 104, 902, ACK, b"")]


def tcp_exchange(version: int = 4) -> list[tuple[int, bytes]]:
    return [(ts, segment(f, flags, version=version, seq=s, ack=a, payload=p)) for ts, f, s, a, flags, p in TCP_EXCHANGE]


def rows_of(records: list[tuple[int, bytes]], session: str = "s", link: int = 1) -> list[tuple]:
    return [(session, k, ts, link, len(d), len(d), d, "test") for k, (ts, d) in enumerate(records)]
