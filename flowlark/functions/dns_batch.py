"""DNS messages of a whole Arrow batch at once.

Plain messages (one question without pointers, records owned by the root or by
the question's name through a pointer to it, no OPT record, nothing left over)
are read by array steps over all of them; loops run over labels and records,
never over messages. Any other message goes to ``parse_dns``, which decides
what is wrong with it; both give the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from flowlark.functions.messages import COMPLETE, DNS_BYTES, DNS_LABEL, DNS_NAME, DnsMessage, parse_dns

PLAIN_LABELS, PLAIN_RECORDS = 16, 16
_HEAD = ("id", "flags", "qdcount", "ancount", "nscount", "arcount")


def dns_value(m: DnsMessage) -> dict:
    """A message as a value of the struct of messages."""
    return {"status": m.status, "reason": m.reason, "failure_offset": m.failure_offset, "limit_reached": m.limit_reached, "parsed_length": m.parsed_length, "remaining_bytes": m.remaining_bytes, **(m.header or {}), "questions": m.questions, "records": m.records, "edns": m.edns}


def asked(m: DnsMessage) -> bytes:
    """Opcode and questions, letters alike in either case, as bytes that tell any two apart."""
    names = lambda labels: b"".join(bytes([len(x)]) + x.lower() for x in labels)
    return bytes([m.opcode]) + b"".join(names(q["labels"]) + b"\0" + q["type"].to_bytes(2, "big") + q["class"].to_bytes(2, "big") for q in m.questions)


class Messages:
    """The messages of a binary column: ``plain`` tells which were read here, ``others`` has the rest by place (null: none)."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        self.n = len(column)
        self.known = column.is_valid().to_numpy(zero_copy_only=False)
        if self.n:
            _, offsets, data = column.buffers()
            offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + self.n + 1]
            own = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        else:
            offsets, own = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
        self.start = offsets[:-1] - offsets[0]
        self.length = np.diff(offsets)
        self.data = np.append(own, np.uint8(0))
        self._read()
        raw = self.data.tobytes()
        self.others = {k: parse_dns(raw[self.start[k] : self.start[k] + self.length[k]]) for k in np.flatnonzero(self.known & ~self.plain).tolist()}
        self.raw = raw

    def _number(self, at: np.ndarray | int, size: int) -> np.ndarray:
        """The big-endian number at ``at`` of each message; bytes beyond its end are 0."""
        total = np.zeros(self.n, dtype=np.int64)
        for k in range(size):
            inside = at + k < self.length
            total = total << 8 | np.where(inside, self.data[np.where(inside, self.start + at + k, len(self.data) - 1)], 0)
        return total

    def _read(self) -> None:
        n, length = self.n, self.length
        self.head = {name: self._number(2 * k, 2) for k, name in enumerate(_HEAD)}
        many = self.head["ancount"] + self.head["nscount"] + self.head["arcount"]
        ok = self.known & (length >= 12) & (length <= DNS_BYTES) & (self.head["qdcount"] == 1) & (many <= PLAIN_RECORDS)
        # labels of the question: (place, size) by depth, size 0 where there is none
        at, open_, labels = np.full(n, 12, dtype=np.int64), ok.copy(), []
        while open_.any() and len(labels) <= PLAIN_LABELS:
            size = self._number(at, 1)
            ok &= ~open_ | ((at < length) & (size <= DNS_LABEL) & (at + 1 + size <= length))
            open_ &= ok
            labels.append((at + 1, np.where(open_, size, 0)))
            at = at + np.where(open_, size + 1, 0)
            open_ &= size > 0
        ok &= ~open_ & (at - 12 <= DNS_NAME) & (at + 4 <= length)
        self.labels, self.after_name = labels, at
        self.type, self.class_ = self._number(at, 2), self._number(at + 2, 2)
        at = at + 4
        self.records = []
        for k in range(int(many[ok].max()) if ok.any() else 0):
            here = ok & (k < many)
            root, pointer = self._number(at, 1) == 0, self._number(at, 2) == 0xC00C
            body = at + np.where(root, 1, 2)
            kind, size = self._number(body, 2), self._number(body + 8, 2)
            good = (root | pointer) & (body + 10 + size <= length) & (kind != 41)
            ok &= ~here | good
            here &= good
            self.records.append({"here": here, "offset": at, "root": root, "encoded_length": body - at, "type": kind, "class": self._number(body + 2, 2), "ttl": self._number(body + 4, 4), "rdlength": size})
            at = at + np.where(here, body + 10 + size - at, 0)
        self.plain = ok & (at == length)
        self.many = many

    def heads(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(places of complete messages, ids, flags, what each asks)."""
        complete = self.plain.copy()
        complete[[k for k, m in self.others.items() if m.status == COMPLETE]] = True
        places = np.flatnonzero(complete)
        ids, flags = self.head["id"][places], self.head["flags"][places]
        own = self.data.copy()
        own[(own >= 65) & (own <= 90)] |= 32
        low, asks = own.tobytes(), []
        first, name = self.start + 12, self.start + self.after_name
        for k, a, b, code in zip(places.tolist(), first[places].tolist(), name[places].tolist(), (flags >> 11 & 15).tolist()):
            asks.append(asked(self.others[k]) if k in self.others else bytes([code]) + low[a:b] + self.raw[b : b + 4])
        return places, ids, flags, asks

    def array(self, kind: pa.StructType) -> pa.Array:
        """The messages as a struct of the fields that ``kind`` has."""
        places = np.flatnonzero(self.plain)
        rest = np.flatnonzero(~self.plain)
        whole = pa.StructArray.from_arrays([self._field(f, places) for f in kind], fields=list(kind))
        if len(rest) == 0:
            return whole
        values = [dns_value(self.others[k]) if k in self.others else None for k in rest.tolist()]
        order = np.empty(self.n, dtype=np.int64)
        order[np.concatenate([places, rest])] = np.arange(self.n)
        return pa.concat_arrays([whole, pa.array([v and {f.name: v.get(f.name) for f in kind} for v in values], kind)]).take(pa.array(order))

    def _field(self, field: pa.Field, places: np.ndarray) -> pa.Array:
        n = len(places)
        fixed = {"status": COMPLETE, "limit_reached": False, "remaining_bytes": 0}
        if field.name in self.head:
            return pa.array(self.head[field.name][places], field.type)
        if field.name in fixed:
            return pa.array([fixed[field.name]] * n, field.type)
        if field.name == "parsed_length":
            return pa.array(self.length[places], field.type)
        if field.name == "questions":
            ones = np.ones(n, dtype=bool)
            values = {"offset": np.full(n, 12), "encoded_length": self.after_name[places] - 12, "pointer_hops": np.zeros(n, dtype=np.int64), "type": self.type[places], "class": self.class_[places]}
            return self._entries(field.type, np.arange(n + 1), values, places, ones)
        if field.name == "records":
            here = np.stack([r["here"][places] for r in self.records], axis=1) if self.records else np.zeros((n, 0), dtype=bool)
            pick = lambda v: np.stack([x[places] for x in v], axis=1)[here] if self.records else np.zeros(0, dtype=np.int64)
            values = {name: pick([r[name] for r in self.records]) for name in ("offset", "encoded_length", "type", "class", "ttl", "rdlength")}
            root = pick([r["root"] for r in self.records]).astype(bool)
            values["pointer_hops"] = 1 - root.astype(np.int64)
            answers, authorities = self.head["ancount"], self.head["nscount"]
            values["section"] = pick([1 + (k >= answers) + (k >= answers + authorities) for k in range(len(self.records))])
            return self._entries(field.type, np.append(0, np.cumsum(here.sum(axis=1))), values, np.repeat(places, here.sum(axis=1)), ~root)
        return pa.nulls(n, field.type)

    def _entries(self, kind: pa.ListType, offsets: np.ndarray, values: dict[str, np.ndarray], of: np.ndarray, named: np.ndarray) -> pa.Array:
        """Lists of questions or records; those that are ``named`` have the labels of the question of message ``of``."""
        item = kind.value_type
        columns = [self._labels(f.type, of, named) if f.name == "labels" else pa.array(values[f.name], f.type) for f in item]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item)), type=kind)

    def _labels(self, kind: pa.ListType, of: np.ndarray, named: np.ndarray) -> pa.Array:
        size = np.stack([s[of] for _, s in self.labels], axis=1) if self.labels else np.zeros((len(of), 0), dtype=np.int64)
        place = np.stack([p[of] for p, _ in self.labels], axis=1) if self.labels else size
        shown = (size > 0) & named[:, None]
        begin, sizes = (place + self.start[of][:, None])[shown], size[shown]
        ends = np.cumsum(sizes)
        at = np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        flat = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(self.data[at])])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(shown.sum(axis=1))), pa.int32()), flat, type=kind)
