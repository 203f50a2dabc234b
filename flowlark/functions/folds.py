"""Streams, framing and correlation of the packets of a window, chunk by chunk. No Spark in here.

A window's packets come as columns. Each direction is assembled as a whole: the
longest run of segments that simply follow each other is found by arithmetic on
their sequence numbers and taken at once; only a segment that breaks a run is
looked at alone. Readers cut the assembled bytes into frames, a frame belongs
to the packet that brought its last byte, and correlation is a scan over the
messages of both directions in packet order. Between chunks a window keeps at
most the fixed limits below, which are part of the results. Complete windows
that no protocol reads and that have no irregular segment need none of this:
``regular_streams`` settles all of a batch in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from flowlark.functions.messages import COMPLETE, INCOMPLETE, LDAP_ANSWERS, LDAP_BYTES, LDAP_CONTINUATIONS, MALFORMED, UNSUPPORTED, DnsMessage, parse_dns, parse_ldap_message

STREAM_BYTES = 65536
PENDING_REQUESTS = 128
TLS_RECORD_BYTES = 18432
TLS_HANDSHAKE_BYTES = 262144
_RING = 1 << 32
READABLE = ("open", "fin", "reset")
LIMIT, LOST, CLOSED = "limit_exceeded", "stream_unavailable", "flow_closed"


@dataclass
class Segments:
    """Columns of the TCP segments of one direction; ``place`` is the packet's place in its chunk."""

    place: np.ndarray
    first: np.ndarray
    size: np.ndarray
    syn: np.ndarray
    fin: np.ndarray
    rst: np.ndarray
    fragment: np.ndarray
    payload: list[bytes]


def _ahead(a: int, b: int) -> int:
    """How far ``a`` is ahead of ``b`` on the ring of sequence numbers, from - half to half."""
    return (a - b + _RING // 2) % _RING - _RING // 2


class Stream:
    """The certain bytes of one direction: those from ``start`` to ``total`` are held, ``reader`` says up to where they are used."""

    def __init__(self, reader: Reader | None = None) -> None:
        self.status, self.reader = "open", reader
        self.held, self.start = bytearray(), 0
        self.due: int | None = None
        self.opened: int | None = None
        self.began = False

    @property
    def total(self) -> int:
        return self.start + len(self.held)

    @property
    def used(self) -> int:
        return self.reader.used if self.reader else 0

    def _room(self, size: int) -> bool:
        """Whether ``size`` more bytes fit; used ones are let go only when they must."""
        if len(self.held) + size > STREAM_BYTES and self.reader:
            self.reader.read(self)
            del self.held[: self.used - self.start]
            self.start = self.used
        return len(self.held) + size <= STREAM_BYTES

    def take(self, s: Segments) -> tuple[list[str], list[str], np.ndarray]:
        """Status and relation of each segment, and the stream's bytes after it."""
        n = len(s.size)
        statuses, relations, upto = ["open"] * n, ["empty"] * n, np.zeros(n, dtype=np.int64)
        plain = ~(s.syn | s.fin | s.rst | s.fragment)
        at = 0
        while at < n:
            run = self._run(s, plain, at) if self.status == "open" else 0
            if run:
                sizes = s.size[at : at + run]
                for k in np.flatnonzero(sizes).tolist():
                    relations[at + k] = "contiguous" if self.began else "first"
                    self.began = True
                if self.due is None and sizes.any():
                    self.due = int(s.first[at + int(np.flatnonzero(sizes)[0])])
                upto[at : at + run] = self.total + np.cumsum(sizes)
                self.held += b"".join(s.payload[at : at + run])
                if self.due is not None:
                    self.due = (self.due + int(sizes.sum())) % _RING
                at += run
                continue
            self.status, relations[at] = self._alone(s, at)
            statuses[at], upto[at] = self.status, self.total
            at += 1
        return statuses, relations, upto

    def _run(self, s: Segments, plain: np.ndarray, at: int) -> int:
        """How many segments from ``at`` on follow each other and fit; empty ones always do."""
        stop = at + 4096
        some = s.size[at:stop] > 0
        before = np.cumsum(s.size[at:stop]) - s.size[at:stop]
        due = self.due if self.due is not None else int(s.first[at:stop][some][0]) if some.any() else 0
        good = plain[at:stop] & (~some | ((s.first[at:stop] - due - before) % _RING == 0))
        good &= len(self.held) + before + s.size[at:stop] <= STREAM_BYTES
        return len(good) if good.all() else int(good.argmin())

    def _alone(self, s: Segments, k: int) -> tuple[str, str]:
        """(status after, relation) of a segment that is in no run: the first of these rules that holds."""
        payload, syn, first = s.payload[k], bool(s.syn[k]), int(s.first[k])
        unseen = "unavailable" if payload else "empty"
        if self.status != "open":
            late = self.status in ("fin", "reset") and (payload or syn)
            return ("after_close", "unavailable") if late else (self.status, unseen)
        if s.fragment[k]:
            return "fragmented", "unavailable"
        if syn and self.due is not None and self.opened != (first - 1) % _RING:
            return "restart", "unavailable"
        if syn and self.opened is None:
            self.opened, self.due = (first - 1) % _RING, first
        status, relation = self._placed(first, payload) if payload else ("open", "empty")
        if status != "open" or not (s.rst[k] or s.fin[k]):
            return status, relation
        if s.rst[k]:
            return "reset", relation
        end = (first + len(payload)) % _RING
        gap = 0 if self.due is None else _ahead(end, self.due)
        if gap == 0:
            self.due = (end + 1) % _RING
        return ("fin" if gap == 0 else "ambiguous" if abs(gap) == _RING // 2 else "gap" if gap > 0 else "overlap"), relation

    def _placed(self, first: int, payload: bytes) -> tuple[str, str]:
        """(status, relation) of a payload against the bytes at hand; one that follows is added."""
        gap = 0 if self.due is None else _ahead(first, self.due)
        if abs(gap) == _RING // 2:
            return "ambiguous", "ambiguous"
        if gap > 0:
            return "gap", "gap"
        if gap == 0:
            relation = "contiguous" if self.began else "first"
            if not self._room(len(payload)):
                return LIMIT, relation
            self.began, self.due = True, (first + len(payload)) % _RING
            self.held += payload
            return "open", relation
        begin = len(self.held) + gap
        both = slice(max(begin, 0), min(begin + len(payload), len(self.held)))
        if both.start < both.stop and self.held[both] != payload[both.start - begin : both.stop - begin]:
            return "conflict", "overlap"
        inside = begin >= 0 and begin + len(payload) <= len(self.held)
        return ("open", "duplicate") if inside else ("overlap", "overlap")


# --- readers --------------------------------------------------------------------------------------------------------


class Reader:
    """Reads messages off a stream; ``found`` holds (end in the stream, message) of those not fetched yet."""

    def __init__(self) -> None:
        self.used, self.found = 0, []

    def read(self, stream: Stream) -> None:
        raise NotImplementedError

    def fetch(self) -> list[tuple[int, object]]:
        out, self.found = self.found, []
        return out


class FrameReader(Reader):
    """Frames of a head, whose last bytes say the length, and a body; takes all bytes at once, whole or not."""

    def __init__(self, head: int, width: int, limit: int) -> None:
        super().__init__()
        self.head, self.width, self.limit = head, width, limit
        self.partial, self.failed = bytearray(), False

    def feed(self, data: bytes) -> list[tuple[int, bytes, bytes]]:
        """(end among all bytes fed, head, body) of each frame that is whole now."""
        out: list[tuple[int, bytes, bytes]] = []
        if self.failed:
            return out
        self.partial += data
        base, at, view = self.used - (len(self.partial) - len(data)), 0, bytes(self.partial)
        self.used += len(data)
        while len(view) - at >= self.head:
            body = at + self.head
            size = int.from_bytes(view[body - self.width : body], "big")
            if size > self.limit:
                self.failed, self.used = True, base + body
                break
            if len(view) < body + size:
                break
            out.append((base + body + size, view[at:body], view[body : body + size]))
            at = body + size
        del self.partial[:at]
        return out

    def read(self, stream: Stream) -> None:
        self.found += [(end, (head, body)) for end, head, body in self.feed(bytes(stream.held[self.used - stream.start :]))]

    def state(self) -> str:
        return "unavailable" if self.failed else "incomplete" if self.partial else "ready"


class LdapReader(Reader):
    """Message envelopes; ends for good at a malformed one, or at one that cannot be told from what follows."""

    def __init__(self) -> None:
        super().__init__()
        self.status, self.asked, self.broken = "ready", 0, None
        self.speaks: bool | None = None  # whether the direction begins with a sequence

    def read(self, stream: Stream) -> None:
        if self.speaks is None and stream.total:
            self.speaks = stream.held[0] == 0x30
        if not self.speaks or self.broken is not None or stream.total < self.asked:
            return
        self.asked, self.status = stream.total + 1, "ready"
        data, at = bytes(stream.held), self.used - stream.start
        while at < len(data):
            m = parse_ldap_message(data, at, len(data), stream.start)
            length, whole = m["message_length"], m["envelope_complete"] and m["message_length"] is not None
            if m["status"] != MALFORMED and whole:
                at += length
                self.found.append((stream.start + at, m))
                continue
            fits = length is not None and length <= LDAP_BYTES
            if m["status"] == INCOMPLETE or (m["status"] != MALFORMED and fits):
                self.status = "incomplete"
                if length is not None and (m["status"] == UNSUPPORTED or (m["operation_length"] is not None and m["controls_present"] is False)):
                    self.asked = stream.start + at + length
            else:
                self.status = "malformed" if m["status"] == MALFORMED else "unsupported"
                self.broken = stream.start + self._evidence(data, at, m["status"])
            break
        self.used = stream.start + at

    @staticmethod
    def _evidence(data: bytes, at: int, status: str) -> int:
        """The number of bytes from which on the message is seen to be broken."""
        low, high = at + 1, len(data)
        while low < high:
            middle = (low + high) // 2
            if parse_ldap_message(data, at, middle)["status"] == status:
                high = middle
            else:
                low = middle + 1
        return low

    def state(self) -> str:
        return self.status


# --- correlation ----------------------------------------------------------------------------------------------------


@dataclass
class DnsLedger:
    """Open requests by (direction, id). A response closes the one of the other direction that asks the same."""

    open: dict[tuple[bool, int], dict] = field(default_factory=dict)
    shut: str | None = None

    def scan(self, messages: Iterator[tuple[DnsMessage, bytes, bool, int]]) -> Iterator[dict]:
        for m, raw, forward, ts in messages:
            if m.status != COMPLETE:
                continue
            entry = {"raw": raw, "message": m, "forward": forward, "ts": ts, "reason": self.shut, "request": None}
            key = (forward ^ m.is_response, m.header["id"])
            yield from (self._answer if m.is_response else self._ask)(key, entry)

    def _ask(self, key: tuple[bool, int], entry: dict) -> Iterator[dict]:
        if self.shut is None and key not in self.open and len(self.open) >= PENDING_REQUESTS:
            self.shut = entry["reason"] = LIMIT
            yield from self.end(LIMIT)
        if self.shut is not None:
            yield entry | {"status": "unresolved"}
        elif key in self.open:
            self.open[key]["status"] = "ambiguous"
            yield entry | {"status": "ambiguous", "request": self.open[key]}
        else:
            self.open[key] = entry | {"status": "pending"}
            yield self.open[key] | {}

    def _answer(self, key: tuple[bool, int], entry: dict) -> Iterator[dict]:
        asked = None if self.shut else self.open.get(key)
        if asked is None:
            status = "unmatched"
        elif asked["status"] == "ambiguous":
            status = "ambiguous"
        else:
            same = (asked["message"].opcode, asked["message"].question_key()) == (entry["message"].opcode, entry["message"].question_key())
            status = "matched" if same else "unmatched"
        if status == "matched":
            entry["request"] = self.open.pop(key)
        yield entry | {"status": status}

    def end(self, reason: str = CLOSED) -> list[dict]:
        left, self.open = list(self.open.values()), {}
        return [w | {"status": "unresolved", "reason": reason} for w in left]


@dataclass
class LdapLedger:
    """Requests by (direction, id) with their responses; entries and references of a search leave it open."""

    open: dict[tuple[bool, int], dict] = field(default_factory=dict)
    ended: list[dict] = field(default_factory=list)
    shut: bool = False

    def note(self, m: dict, forward: bool) -> str:
        """How a message relates to the open requests."""
        name, key = m["operation"], (forward, m["message_id"])
        answers = LDAP_ANSWERS.get(name)
        asks = name in LDAP_ANSWERS.values()
        if m["status"] != COMPLETE or not m["message_id"] or not (asks or answers):
            if m["status"] == UNSUPPORTED and not self.shut and key in self.open:
                self.open[key]["status"] = "ambiguous"
            return "non_correlatable"
        return self._ask(m, key) if asks else self._answer(m, (not forward, m["message_id"]), answers)

    def _ask(self, m: dict, key: tuple[bool, int]) -> str:
        entry = {"request": m, "forward": key[0], "status": "pending", "response_count": 0, "terminal": None}
        if not self.shut and key in self.open:
            self.open[key]["status"] = "ambiguous"
            return "ambiguous"
        if not self.shut and len(self.open) < PENDING_REQUESTS:
            self.open[key] = entry
            return "pending"
        self.ended.append(entry | {"status": "unresolved"})
        self.lose()
        return "unresolved"

    def _answer(self, m: dict, key: tuple[bool, int], answers: str) -> str:
        entry = None if self.shut else self.open.get(key)
        if entry is None or (entry["status"] != "ambiguous" and entry["request"]["operation"] != answers):
            return "unmatched"
        if entry["status"] == "ambiguous":
            return "ambiguous"
        entry["response_count"] += 1
        if m["operation"] not in LDAP_CONTINUATIONS:
            self.ended.append(self.open.pop(key) | {"status": "completed", "terminal": m})
        return "matched"

    def lose(self) -> None:
        """No more can be matched: what is pending stays unresolved."""
        self.shut = True
        for entry in self.open.values():
            entry["status"] = "unresolved" if entry["status"] == "pending" else entry["status"]

    def end(self) -> list[dict]:
        self.lose()
        return [*self.ended, *self.open.values()]


# --- windows --------------------------------------------------------------------------------------------------------


def owner_of(ports: tuple[int | None, int | None], protocol: int) -> str | None:
    """Which protocol reads a window: LDAP before DNS before TLS on TCP, DNS on UDP."""
    if protocol == 17:
        return "dns" if 53 in ports else None
    if protocol != 6:
        return None
    if 389 in ports:
        return None if 636 in ports else "ldap"
    return "dns" if 53 in ports else "tls" if 443 in ports else None


Event = tuple[int, str, dict]
#: Columns of ``WindowFold.take``; the last five are those of TCP.
COLUMNS = ("is_forward", "ts_us", "payload", "tcp_seq", "syn", "fin", "rst", "is_fragment")


class WindowFold:
    """A window, chunk by chunk. ``take`` gives (place in the chunk, kind, fields) of each event, ``close`` those of the end (place -1)."""

    def __init__(self, protocol: int, a_port: int | None, b_port: int | None, *, segments: bool = False) -> None:
        self.protocol, self.owner, self.segments = protocol, owner_of((a_port, b_port), protocol), segments
        self.streams: dict[bool, Stream] = {}
        self.shakes: dict[bool, FrameReader] = {}
        self.framed: set[bool] = set()
        self.unreadable: set[bool] = set()
        self.lost_next = False
        self.dns, self.ldap = DnsLedger(), LdapLedger()

    def _reader(self) -> Reader | None:
        if self.owner == "ldap":
            return LdapReader()
        return FrameReader(2, 2, 65535) if self.owner == "dns" else FrameReader(5, 2, TLS_RECORD_BYTES) if self.owner else None

    def take(self, p: dict[str, np.ndarray | list]) -> list[Event]:
        forward = np.asarray(p["is_forward"], dtype=bool)
        if self.protocol == 17:
            return self._looked_up(zip(range(len(forward)), forward.tolist(), p["payload"]), p["ts_us"]) if self.owner else []
        if self.protocol != 6:
            return []
        out: list[Event] = []
        turns: list[tuple[int, int, bool, object]] = []
        for side in (True, False):
            place = np.flatnonzero(forward == side)
            if len(place):
                events, own = self._direction(side, place, p)
                out += events
                turns += own
        # in packet order; within a packet what makes a stream unreadable, messages, forward before reverse, what breaks one
        turns.sort(key=lambda t: (t[0], t[1], not t[2]))
        if self.owner == "dns":
            return out + self._looked_up(((k, side, m[1]) for k, phase, side, m in turns if phase == 1), p["ts_us"])
        if self.owner == "tls":
            return out + self._secured((k, side, m) for k, phase, side, m in turns if phase == 1)
        return out + self._directory(turns, len(forward)) if self.owner else out

    def _direction(self, side: bool, place: np.ndarray, p: dict) -> tuple[list[Event], list[tuple[int, int, bool, object]]]:
        """Events of the segments, and (place, phase, side, what) of what its reader saw."""
        if side not in self.streams:
            self.streams[side] = Stream(self._reader())
        stream = self.streams[side]
        flags = [np.asarray(p[c], dtype=bool)[place] for c in ("syn", "fin", "rst", "is_fragment")]
        payload = [p["payload"][k] for k in place.tolist()]
        first = (np.asarray(p["tcp_seq"], dtype=np.int64)[place] + flags[0]) % _RING
        s = Segments(place, first, np.array([len(x) for x in payload], dtype=np.int64), *flags, payload)
        readable = stream.status in READABLE
        statuses, relations, upto = stream.take(s)
        at = lambda end: int(place[min(int(np.searchsorted(upto, end)), len(place) - 1)])
        events = [(k, "segment", {"is_forward": side, "status": a, "relation": b, "length": n}) for k, a, b, n in zip(place.tolist(), statuses, relations, s.size.tolist())] if self.segments else []
        turns: list[tuple[int, int, bool, object]] = []
        if readable and stream.status not in READABLE:
            turns.append((int(place[next(k for k, a in enumerate(statuses) if a not in READABLE)]), 0, side, "unreadable"))
        if (reader := stream.reader) is not None:
            whole = reader.broken if isinstance(reader, LdapReader) else None
            reader.read(stream)
            if isinstance(reader, LdapReader) and reader.speaks and side not in self.framed:
                self.framed.add(side)
                turns.append((at(1), 1, side, "framed"))
            turns += [(at(end), 1, side, m) for end, m in reader.fetch()]
            if whole is None and isinstance(reader, LdapReader) and reader.broken is not None:
                turns.append((at(reader.broken), 2, side, "broken"))
        return events, turns

    def _looked_up(self, raws: Iterator[tuple[int, bool, bytes]], ts: np.ndarray) -> list[Event]:
        out: list[Event] = []
        for k, side, raw in raws:
            m = parse_dns(raw)
            out.append((k, "dns_message", {"is_forward": side, "status": m.status, "reason": m.reason, "length": len(raw), "raw": raw}))
            out += [(k, *self._transaction(o)) for o in self.dns.scan(iter([(m, raw, side, int(ts[k]))]))]
        return out

    @staticmethod
    def _transaction(o: dict) -> tuple[str, dict]:
        h, asked = o["message"].header, o["request"] if o["status"] == "matched" else None
        return "dns_transaction", {"status": o["status"], "reason": o["reason"], "message_id": h["id"], "code": h["flags"], "raw": o["raw"], "is_forward": o["forward"], "ts_us": o["ts"], "request_raw": asked and asked["raw"], "latency_us": o["ts"] - asked["ts"] if asked else None}

    def _secured(self, records: Iterator[tuple[int, bool, tuple[bytes, bytes]]]) -> list[Event]:
        out: list[Event] = []
        for k, side, (head, body) in records:
            out.append((k, "tls_record", {"is_forward": side, "code": head[0], "length": len(body), "status": "ready"}))
            if head[0] == 22:
                shakes = self.shakes.setdefault(side, FrameReader(4, 3, TLS_HANDSHAKE_BYTES))
                out += [(k, "tls_handshake", {"is_forward": side, "code": h[0], "length": len(b), "raw": b, "status": "ready"}) for _, h, b in shakes.feed(body)]
        return out

    def _directory(self, turns: list[tuple[int, int, bool, object]], n: int) -> list[Event]:
        """LDAP messages in order. A stream that is lost ends matching from its packet on, or from the packet after the first one that speaks LDAP."""
        out: list[Event] = []
        lost = 0 if self.lost_next else None
        speaking = {side for _, _, side, what in turns if what == "framed"}
        before = len(self.framed - speaking) > 0
        for k, phase, side, what in turns:
            if lost is not None and k >= lost:
                self.ldap.lose()
            if what == "unreadable":
                self.unreadable.add(side)
                if before:
                    self.ldap.lose()
            elif what == "framed":
                before = True
                lost = k + 1 if self.unreadable and lost is None else lost
            elif what == "broken":
                self.ldap.lose()
            else:
                status = self.ldap.note(what, side)
                out.append((k, "ldap", {"status": status, "reason": what["reason"], "message_id": what["message_id"], "code": what["operation_tag"], "operation": what["operation"], "length": what["message_length"], "is_forward": side, "relation": what["status"]}))
        if lost is not None and lost < n:
            self.ldap.lose()
        self.lost_next = lost is not None
        return out

    def _framing(self, side: bool, stream: Stream) -> str | None:
        if stream.reader is None or (self.owner == "ldap" and side not in self.framed):
            return None
        return stream.reader.state() if stream.status in READABLE else "unavailable"

    def close(self) -> list[Event]:
        """The window's end: open requests, summaries, and the state of each stream."""
        out: list[Event] = [(-1, *self._transaction(o)) for o in self.dns.end()]
        for s in self.ldap.end():
            m, last = s["request"], s["terminal"]
            out.append((-1, "ldap_summary", {"status": s["status"], "message_id": m["message_id"], "code": m["operation_tag"], "operation": m["operation"], "is_forward": s["forward"], "response_count": s["response_count"], "reason": last and last["operation"], "length": m["message_length"]}))
        for side, stream in sorted(self.streams.items(), reverse=True):
            out.append((-1, "stream", {"status": stream.status, "is_forward": side, "length": stream.total, "response_count": stream.used, "reason": self._framing(side, stream)}))
        return out


def regular_streams(group: np.ndarray, first: np.ndarray, size: np.ndarray, syn: np.ndarray, fin: np.ndarray, rst: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, whether it is regular, final status, bytes) of each direction of complete windows.

    Regular is one without fragments whose payloads follow each other up to the
    limit, with a SYN at its first segment only and FIN or RST at its last only,
    a FIN where the stream ends. All directions are settled at once.
    """
    n = len(group)
    if n == 0:
        return group, np.zeros(0, dtype=bool), np.zeros(0, dtype="U5"), size
    order = np.argsort(group, kind="stable")
    group, first, size, syn, fin, rst, fragment = (x[order] for x in (group, first, size, syn, fin, rst, fragment))
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    last = np.append(begin[1:], n) - 1
    head, tail = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    head[begin], tail[last] = True, True
    before = np.cumsum(size) - size
    before -= before[begin][of]
    anchor = np.minimum.reduceat(np.where((size > 0) | syn, np.arange(n), n), begin)
    known = anchor < n
    astray = (first - first[np.minimum(anchor, n - 1)][of] - before) % _RING != 0
    odd = fragment | (syn & ~head) | ((fin | rst) & ~tail) | ((size > 0) & astray) | (fin & ~rst & known[of] & astray)
    total = np.add.reduceat(size, begin)
    regular = ~np.logical_or.reduceat(odd, begin) & (total <= STREAM_BYTES)
    return group[begin], regular, np.where(rst[last], "reset", np.where(fin[last], "fin", "open")), total
