"""Protocol folds of windows, and the statistics of their messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlark.functions.dns_batch import Messages
from flowlark.functions.folds import WindowFold, regular_streams
from flowlark.functions.messages import parse_hello, parse_ldap, parse_tcp_options
from flowlark.operators.flows import flow_segments, sessionize
from flowlark.runtime import written
from flowlark.schemas import IDENTITY, WINDOW_KEY

EVENT_FIELDS = {"kind": pa.string(), "is_forward": pa.bool_(), "ts_us": pa.int64(), "status": pa.string(), "reason": pa.string(), "relation": pa.string(), "operation": pa.string(), "message_id": pa.int64(), "code": pa.int64(), "length": pa.int64(), "response_count": pa.int64(), "latency_us": pa.int64(), "raw": pa.binary(), "request_raw": pa.binary()}
EVENTS = "packet_index bigint, kind string, is_forward boolean, ts_us bigint, status string, reason string, relation string, operation string, message_id bigint, code bigint, length bigint, response_count bigint, latency_us bigint, raw binary, request_raw binary"
PACKET_FIELDS = ("packet_index", "ts_us", "is_forward", "protocol", "a_port", "b_port", "tcp_seq", "syn", "fin", "rst", "is_fragment", "payload")
#: A flow with more packets than this is cut while its windows are found with the payloads, of which a task keeps a flow's (or a slice's) on disk at most.
FOLD_SLICE = 1 << 19
#: Key of a window by its flow, without the number it has in its session.
SEGMENT_KEY = ("session", *IDENTITY, "segment")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; null is like null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    codes = column.fill_null(0) if pa.types.is_integer(column.type) else column.dictionary_encode().indices.fill_null(-1)
    codes = codes.to_numpy(zero_copy_only=False)
    return (codes[1:] != codes[:-1]) | (null[1:] != null[:-1])


class _Folder:
    """Folds windows that come one after the other; the last of a batch stays open, as it may go on in the next. ``keys`` name a window."""

    def __init__(self, segments: bool, keys: tuple[str, ...], types: list[pa.DataType]) -> None:
        self.segments, self.keys = segments, keys
        self.schema = pa.schema([*zip(keys, types), ("packet_index", pa.int64()), *EVENT_FIELDS.items()])
        self.key: tuple | None = None
        self.fold: WindowFold | None = None
        self.rows: list[dict] = []

    def _put(self, key: tuple, events: list, index: list | None = None, ts: list | None = None) -> None:
        for k, kind, fields in events:
            own = {"kind": kind}
            if k >= 0:
                own |= {"packet_index": index[k], "ts_us": ts[k]}
            self.rows.append(own | fields | dict(zip(self.keys, key)))

    def close(self) -> None:
        if self.fold is not None:
            self._put(self.key, self.fold.close())
        self.key = self.fold = None

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in self.rows], t) for n, t in zip(self.schema.names, self.schema.types)], schema=self.schema)
            self.rows = []

    def batch(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if n == 0:
            return
        column = lambda c: batch.column(batch.schema.names.index(c))
        bits = lambda c: column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        number = lambda c: column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.zeros(n, dtype=bool)
        fresh[0] = True
        for c in self.keys:
            fresh[1:] |= _changes(column(c))
        starts = np.flatnonzero(fresh)
        stops = np.append(starts[1:], n)
        protocol, a_port, b_port = number("protocol"), number("a_port"), number("b_port")
        forward, size = bits("is_forward"), pc.fill_null(pc.binary_length(column("payload")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flags = {c: bits(c) for c in ("syn", "fin", "rst", "is_fragment")}
        first = (number("tcp_seq") + flags["syn"]) % (1 << 32)
        name = lambda k: tuple(column(c)[k].as_py() for c in self.keys)

        # windows that begin and end in this batch and that no protocol reads: all at once
        whole = np.ones(len(starts), dtype=bool)
        whole[-1] = False
        whole[0] &= self.key != name(0)
        ports = [np.isin(x[starts], (53, 389, 443)) for x in (a_port, b_port)]
        whole &= (protocol[starts] == 6) & ~ports[0] & ~ports[1] & (not self.segments)
        of = np.repeat(np.arange(len(starts)), stops - starts)
        rows = np.flatnonzero(whole[of])
        group, regular, status, total = regular_streams(of[rows] * 2 + ~forward[rows], first[rows], size[rows], *(flags[c][rows] for c in flags))
        settled = np.zeros(len(starts), dtype=bool)
        settled[group // 2] = True
        settled[group[~regular] // 2] = False
        keep = settled[group // 2]
        if keep.any():
            at = starts[group[keep] // 2]
            made = {c: column(c).take(pa.array(at)) for c in self.keys} | {"kind": pa.array(["stream"] * len(at)), "is_forward": pa.array(group[keep] % 2 == 0), "status": pa.array(status[keep]), "length": pa.array(total[keep]), "response_count": pa.array(np.zeros(len(at), dtype=np.int64))}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(len(at), f.type) for f in self.schema], schema=self.schema)

        # the others one after the other; a batch's last window is one of them, so what was open before it is closed here
        for k in np.flatnonzero(~settled).tolist():
            a, b = int(starts[k]), int(stops[k])
            if name(a) != self.key:
                self.close()
                self.key, self.fold = name(a), WindowFold(int(protocol[a]), int(a_port[a]), int(b_port[a]), segments=self.segments)
            ts, index = column("ts_us").slice(a, b - a).to_pylist(), column("packet_index").slice(a, b - a).to_pylist()
            part = {"is_forward": forward[a:b], "ts_us": ts, "payload": [x or b"" for x in column("payload").slice(a, b - a).to_pylist()], "tcp_seq": number("tcp_seq")[a:b] if self.fold.protocol == 6 else None}
            self._put(self.key, self.fold.take(part | {c: f[a:b] for c, f in flags.items()}), index, ts)
            if len(self.rows) >= 4096:
                yield from self.flush()


def in_windows(packets: DataFrame, *, timeout_us: int, max_active: int | None = None) -> DataFrame:
    """The packets, in the columns that folds need, with the ``sequence_number`` of their window."""
    return with_windows(packets, timeout_us=timeout_us, max_active=max_active)[0]


def with_windows(packets: DataFrame, *, timeout_us: int, max_active: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(packets as of ``in_windows``, windows as of ``sessionize``).

    Windows are found over times and identities alone; payloads meet their
    window's number by place and identity, a key without hot values.
    """
    wide = written(packets.select("session", *PACKET_FIELDS, "src_port", "dst_port", *(c for c in IDENTITY if c not in PACKET_FIELDS)), "packets")
    placed, windows = sessionize(wide.select("session", "packet_index", "ts_us", *IDENTITY, "is_forward"), timeout_us=timeout_us, max_active=max_active)
    keys = ("session", "packet_index", *IDENTITY)
    numbers = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], "sequence_number").distinct()
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return wide.join(numbers, match).drop(*[f"_{k}" for k in keys]), windows


def _read(packets: DataFrame) -> DataFrame:
    """The packets that a protocol fold reads: TCP, and DNS over UDP."""
    return packets.where("protocol = 6 OR (protocol = 17 AND (a_port = 53 OR b_port = 53))")


def fold_windows(packets: DataFrame, *, segments: bool = False) -> DataFrame:
    """Events of all state machines. Windows stream through a task one after the other; only TCP and DNS packets go.

    ``packets`` are those of ``sessionize``, with the decoded transport columns.
    TCP payloads are all dealt with their window, as retransmitted bytes are
    compared. ``segments`` asks for an event of each TCP packet too.
    """
    rows = _read(packets).select(*WINDOW_KEY, *PACKET_FIELDS).repartition(*WINDOW_KEY).sortWithinPartitions(*WINDOW_KEY, "packet_index")
    return _folded(rows, WINDOW_KEY, segments)


def fold_flows(packets: DataFrame, *, timeout_us: int, segments: bool = False, slice_packets: int = FOLD_SLICE) -> DataFrame:
    """As ``fold_windows`` of ``in_windows``, but windows are named by ``SEGMENT_KEY`` and not by their number in the session.

    Payloads go along while windows are found, so packets are dealt once, and
    nothing is ranked or joined.
    """
    own = tuple(c for c in PACKET_FIELDS if c not in IDENTITY)
    rows = written(_read(packets).select("session", *IDENTITY, *own), "packets")
    return _folded(flow_segments(rows, timeout_us=timeout_us, slice_packets=slice_packets), SEGMENT_KEY, segments)


def _folded(rows: DataFrame, keys: tuple[str, ...], segments: bool) -> DataFrame:
    """Events of rows whose windows come whole and one after the other in each task."""
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema[c].dataType) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(segments, keys, types)
        for batch in batches:
            yield from folder.batch(batch)
            yield from folder.flush()
        folder.close()
        yield from folder.flush()

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keys), EVENTS]))


def tcp_streams(events: DataFrame, *, by: tuple[str, ...] = WINDOW_KEY) -> DataFrame:
    """Final status, observed and consumed bytes of each direction."""
    return events.where("kind = 'stream'").select(*by, "is_forward", "status", F.col("length").alias("stream_bytes"), F.col("response_count").alias("consumed_bytes"), F.col("reason").alias("framing_status"))


# --- messages as columns ------------------------------------------------------------------------------------------

_NAME = "offset:int,encoded_length:int,labels:array<binary>,pointer_hops:int,type:int,class:int"
DNS_TYPE = f"struct<status:string,reason:string,failure_offset:int,limit_reached:boolean,parsed_length:int,remaining_bytes:int,id:int,flags:int,qdcount:int,ancount:int,nscount:int,arcount:int,questions:array<struct<{_NAME}>>,records:array<struct<{_NAME},section:int,ttl:bigint,rdlength:int>>,edns:struct<udp_payload_size:int,extended_rcode:int,version:int,do:boolean,options:array<struct<code:int,length:int>>>>"
HELLO_TYPE = "struct<status:string,reason:string,failure_offset:int,version:int,session_id_length:int,cipher_suites:array<int>,compression_methods:array<int>,extensions_present:boolean,extensions:array<struct<type:int,length:int,groups:array<int>,signatures:array<int>,protocols:array<binary>>>>"
LDAP_TYPE = "struct<remaining_bytes:int,limit_reached:boolean,messages:array<struct<offset:int,status:string,reason:string,message_length:bigint,envelope_complete:boolean,message_id:bigint,operation_tag:int,operation:string,operation_length:bigint,controls_present:boolean,controls_length:bigint>>>"
OPTIONS_TYPE = "struct<kinds:array<int>,mss:array<int>,window_scale:array<int>,sack_blocks:int>"


def _with(df: DataFrame, column: str, name: str, kind: str, parse) -> DataFrame:
    """Adds ``name`` of type ``kind``: ``parse`` of each distinct binary value of a batch; null stays null."""
    rows = df.withColumn(name, F.lit(None).cast(kind))
    at = df.columns.index(column)
    from pyspark.sql.pandas.types import to_arrow_type

    target = to_arrow_type(rows.schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            out = []
            for v in batch.column(at).to_pylist():
                if v is not None and v not in known:
                    known[v] = parse(v)
                out.append(None if v is None else known[v])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, target)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _part(kind: T.StructType, fields: tuple[str, ...]) -> T.StructType:
    """The struct with only the named fields, ``entries.field`` for a field of a list's entries."""
    wanted: dict[str, list[str]] = {}
    for f in fields:
        wanted.setdefault(f.split(".")[0], []).extend(f.split(".")[1:])
    out = []
    for f in kind:
        if f.name in wanted:
            inner = wanted[f.name]
            out.append(T.StructField(f.name, T.ArrayType(_part(f.dataType.elementType, tuple(inner))) if inner else f.dataType))
    return T.StructType(out)


def with_dns(df: DataFrame, column: str = "raw", name: str = "dns", fields: tuple[str, ...] = ()) -> DataFrame:
    """Adds the messages as structs; with ``fields`` only these (``records.ttl``: of entries) come back from Python, which is most of the work."""
    from pyspark.sql.pandas.types import to_arrow_type

    whole = df.withColumn(name, F.lit(None).cast(DNS_TYPE))
    kind = _part(whole.schema[name].dataType, fields) if fields else whole.schema[name].dataType
    # the bytes themselves go no further if only some fields are wanted
    own = [c for c in df.columns if c != column or not fields]
    rows = df.select(*own, F.col(column).alias("_message"))
    schema = T.StructType([*df.select(*own).schema, T.StructField(name, kind)])
    target = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], Messages(batch.column(batch.num_columns - 1)).array(target)], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_hello(df: DataFrame, kind: int, column: str = "raw", name: str = "hello") -> DataFrame:
    def parse(data: bytes) -> dict:
        got = parse_hello(kind, data)
        return {k: got[k] for k in ("status", "reason", "failure_offset")} | (got["hello"] or {})

    return _with(df, column, name, HELLO_TYPE, parse)


def with_ldap(df: DataFrame, column: str = "payload", name: str = "ldap") -> DataFrame:
    return _with(df, column, name, LDAP_TYPE, parse_ldap)


def with_tcp_options(df: DataFrame, column: str = "tcp_options", name: str = "options") -> DataFrame:
    return _with(df, column, name, OPTIONS_TYPE, parse_tcp_options)


# --- statistics ---------------------------------------------------------------------------------------------------

DIRECTION = (*WINDOW_KEY, "is_forward")


def _bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def tcp_option_statistics(packets: DataFrame, *, by: tuple[str, ...] = DIRECTION) -> DataFrame:
    """Option counters of TCP packets; a packet with a wrong known option counts as malformed and no more."""
    rows = with_tcp_options(packets.where("protocol = 6").select(*by, "tcp_options"))
    k = F.filter("options.kinds", lambda x: x > 1)
    good = F.col("options").isNotNull()
    size = F.when(good, F.octet_length("tcp_options"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("packets"), F.count_if(~good).alias("malformed"), F.count_if(size > 0).alias("with_options"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("option_bytes"), F.coalesce(F.sum(F.size(k) - F.size(F.array_distinct(k))), F.lit(0)).cast("bigint").alias("duplicates"), F.coalesce(F.sum("options.sack_blocks"), F.lit(0)).cast("bigint").alias("sack_blocks"))


def tcp_option_histograms(packets: DataFrame, *, by: tuple[str, ...] = DIRECTION) -> DataFrame:
    """Kinds, MSS values and window scales of packets whose options are well formed."""
    rows = with_tcp_options(packets.where("protocol = 6").select(*by, "tcp_options")).where("options IS NOT NULL")
    return _counted(rows, by, kind=F.col("options.kinds"), mss=F.col("options.mss"), window_scale=F.col("options.window_scale"))


def ldap_flow_statistics(packets: DataFrame) -> DataFrame:
    """Envelopes by status in LDAP payloads, packet by packet, of each window that has a candidate."""
    from flowlark.operators.decoding import ldap_candidate

    rows = with_ldap(packets.where(ldap_candidate()).select(*WINDOW_KEY, "packet_index", "payload"))
    m = rows.select(*WINDOW_KEY, "packet_index", F.explode("ldap.messages").alias("m")).select(*WINDOW_KEY, "packet_index", "m.*")
    done = F.col("status") == "complete"
    counted = m.groupBy(*WINDOW_KEY).agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("complete", "incomplete", "malformed", "unsupported")], F.count_if(done & F.col("operation").endswith("request")).alias("request_count"), F.count_if(done & ~F.col("operation").endswith("request")).alias("response_count"))
    limited = rows.groupBy(*WINDOW_KEY).agg(F.count_if("ldap.limit_reached").alias("limited_payloads"))
    return counted.join(limited, list(WINDOW_KEY))


def dns_messages(events: DataFrame, *fields: str) -> DataFrame:
    """The parsed messages that finished transactions count: of a match both request and response, else one; of each the named ``fields``, or all."""
    final = events.where("kind = 'dns_transaction' AND status <> 'pending'")
    both = final.select(*WINDOW_KEY, F.explode(F.array_compact(F.array("request_raw", "raw"))).alias("raw"))
    return with_dns(both, fields=fields)


def _spread(value: Column, name: str) -> list[Column]:
    """Least, greatest and total of a number."""
    return [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}"), F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(f"total_{name}")]


def _counted(rows: DataFrame, keys: tuple[str, ...], **values: Column) -> DataFrame:
    """(``keys``, code_kind, value, count): how often each element of the named arrays occurs."""
    def tag(name: str):
        return lambda x: F.struct(F.lit(name).alias("code_kind"), x.cast("int").alias("value"))

    tagged = F.flatten(F.array(*[F.transform(v, tag(name)) for name, v in values.items()]))
    return rows.select(*keys, F.explode(tagged).alias("v")).groupBy(*keys, "v.code_kind", "v.value").agg(F.count(F.lit(1)).alias("count"))


def dns_transaction_statistics(events: DataFrame) -> DataFrame:
    """Transactions by status and the latency of matches, in microseconds; header counts of all messages counted."""
    final = events.where("kind = 'dns_transaction' AND status <> 'pending'")
    latency = [F.coalesce(F.sum("latency_us"), F.lit(0)).alias("latency_us_total"), F.min("latency_us").alias("latency_us_min"), F.max("latency_us").alias("latency_us_max"), F.avg("latency_us").alias("latency_us_mean")]
    # counts stand at fixed places of a header; of a match both messages count
    number = lambda raw, at: F.when(F.octet_length(raw) >= 12, F.conv(F.hex(F.substring(raw, at, 2)), 16, 10).cast("bigint"))
    heads = [F.sum(F.coalesce(number(F.col("raw"), at), F.lit(0)) + F.coalesce(number(F.col("request_raw"), at), F.lit(0))).alias(n) for n, at in (("qdcount", 5), ("ancount", 7), ("nscount", 9), ("arcount", 11))]
    return final.groupBy(*WINDOW_KEY).agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("matched", "unmatched", "ambiguous", "unresolved")], *latency, *heads)


def dns_flag_statistics(messages: DataFrame) -> DataFrame:
    flags = F.col("dns.flags")
    return messages.groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).alias("messages"), *[F.count_if(_bit(flags, m)).alias(n) for n, m in (("responses", 0x8000), ("truncated", 0x200), ("authoritative", 0x400), ("recursion_desired", 0x100), ("recursion_available", 0x80), ("authentic_data", 0x20), ("checking_disabled", 0x10))], F.count_if(~_bit(flags, 0x8000)).alias("queries"))


def dns_code_histograms(messages: DataFrame) -> DataFrame:
    """Opcodes of all messages, response codes of responses."""
    flags = F.col("dns.flags")
    rcode = F.when(_bit(flags, 0x8000), F.array(flags.bitwiseAND(15))).otherwise(F.array().cast("array<int>"))
    return _counted(messages, WINDOW_KEY, opcode=F.array(F.shiftright(flags, 11).bitwiseAND(15)), rcode=rcode)


def dns_query_name_statistics(messages: DataFrame) -> DataFrame:
    """Lengths, labels and kinds of characters of question names; means are exact quotients (null without names or labels)."""
    q = messages.select(*WINDOW_KEY, F.explode("dns.questions").alias("q"))
    labels = F.col("q.labels")
    joined = F.aggregate(labels, F.lit("").cast("string"), lambda a, x: F.concat(a, F.hex(x)))
    sizes = F.transform(labels, lambda x: F.octet_length(x))
    rows = q.select(*WINDOW_KEY, (F.aggregate(sizes, F.lit(0), lambda a, x: a + x + 1) + 1).alias("wire_length"), F.size(labels).alias("n_labels"), joined.alias("h"), F.array_min(sizes).alias("least"), F.array_max(sizes).alias("most"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("label_bytes"))
    any_of = lambda p: F.count_if(F.col("h").rlike(f"^(?:..)*(?:{p})"))
    n, in_labels = F.count(F.lit(1)), F.sum("n_labels")
    return rows.groupBy(*WINDOW_KEY).agg(
        n.alias("names"), *_spread(F.col("wire_length"), "length"), (F.sum("wire_length") / n).alias("mean_length"), *_spread(F.col("n_labels"), "labels"), F.min(F.when(F.col("n_labels") > 0, F.col("n_labels"))).alias("min_labels_non_root"),
        F.min("least").alias("min_label_length"), F.max("most").alias("max_label_length"), F.sum("label_bytes").cast("bigint").alias("total_label_length"), F.when(in_labels > 0, F.sum("label_bytes") / in_labels).alias("mean_label_length"),
        F.count_if(F.col("n_labels") == 0).alias("root_names"), any_of("3[0-9]").alias("with_digit"), any_of("2D").alias("with_hyphen"), any_of("5F").alias("with_underscore"), any_of("[89A-F].").alias("with_non_ascii"),
    )


def dns_record_statistics(messages: DataFrame) -> DataFrame:
    r = messages.select(*WINDOW_KEY, F.explode("dns.records").alias("r")).select(*WINDOW_KEY, "r.*")
    return r.groupBy(*WINDOW_KEY).agg(*[F.count_if(F.col("section") == k).alias(n) for k, n in ((1, "answers"), (2, "authorities"), (3, "additionals"))], F.min("rdlength").alias("min_rdlength"), F.max("rdlength").alias("max_rdlength"), F.sum("rdlength").cast("bigint").alias("total_rdlength"))


def dns_record_histograms(messages: DataFrame) -> DataFrame:
    records = F.col("dns.records")
    return _counted(messages, WINDOW_KEY, **{"type": F.transform(records, lambda r: r["type"]), "class": F.transform(records, lambda r: r["class"])})


def dns_edns_statistics(messages: DataFrame) -> DataFrame:
    """OPT records: options and their lengths, UDP sizes, DNSSEC OK. All options are opaque, so all count as unknown."""
    e = messages.where("dns.edns IS NOT NULL").select(*WINDOW_KEY, "dns.edns.*")
    sizes = F.transform("options", lambda o: o["length"])
    e = e.withColumns({"n": F.size("options"), "least": F.array_min(sizes), "most": F.array_max(sizes), "bytes": F.aggregate(sizes, F.lit(0), lambda a, x: a + x), "zero": F.size(F.filter(sizes, lambda x: x == 0))})
    total = lambda c: F.sum(c).cast("bigint")
    return e.groupBy(*WINDOW_KEY).agg(
        F.count(F.lit(1)).alias("messages"), total("n").alias("options"), total("n").alias("unknown_options"), total("bytes").alias("option_bytes"), F.min("least").alias("min_option_length"), F.max("most").alias("max_option_length"), total("zero").alias("zero_length_options"),
        F.min("n").alias("min_options"), F.max("n").alias("max_options"), *_spread(F.col("udp_payload_size"), "udp_size"), F.count_if("do").alias("dnssec_ok"),
    )


def dns_edns_histograms(messages: DataFrame) -> DataFrame:
    e = F.col("dns.edns")
    return _counted(messages.where("dns.edns IS NOT NULL"), WINDOW_KEY, extended_rcode=F.array(e["extended_rcode"]), version=F.array(e["version"]), option_code=F.transform(e["options"], lambda o: o["code"]))


def tls_handshake_statistics(events: DataFrame) -> DataFrame:
    h = events.where("kind = 'tls_handshake'")
    return h.groupBy(*DIRECTION).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("length") == 0).alias("empty"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.sum("length").alias("total_length"), (F.sum("length") / F.count(F.lit(1))).alias("mean_length"))


def tls_handshake_types(events: DataFrame) -> DataFrame:
    return events.where("kind = 'tls_handshake'").groupBy(*DIRECTION, F.col("code").cast("int").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def _hellos(events: DataFrame, kind: int) -> DataFrame:
    rows = with_hello(events.where((F.col("kind") == "tls_handshake") & (F.col("code") == kind)).select(*DIRECTION, "raw"), kind)
    return rows.where("hello.status = 'complete'").select(*DIRECTION, "hello.*")


def _of_type(code: int) -> Column:
    return F.filter("extensions", lambda e: e["type"] == code)


def _size_of(field: str):
    return lambda e: F.greatest(F.coalesce(F.size(e[field]), F.lit(0)), F.lit(0))


def tls_hello_statistics(events: DataFrame, kind: int) -> DataFrame:
    """Counters of complete ClientHellos (1) or ServerHellos (2): extrema and totals of every vector.

    Extrema of groups, signature algorithms and ALPN names are of the hellos
    that have such an extension, those of extension lengths of all extensions.
    """
    rows = _hellos(events, kind)
    types = F.transform("extensions", lambda e: e["type"])
    sizes = F.transform("extensions", lambda e: e["length"])
    vectors = {"groups": (10, "supported_groups"), "signatures": (13, "signature_algorithms"), "protocols": (16, "alpn_protocols")}
    rows = rows.withColumns({"n_suites": F.size("cipher_suites"), "n_methods": F.size("compression_methods"), "n_extensions": F.size(types), "n_unknown": F.size(F.filter(types, lambda t: ~t.isin(10, 13, 16))), "n_repeated": F.size(types) - F.size(F.array_distinct(types)), "least": F.array_min(sizes), "most": F.array_max(sizes), "bytes": F.aggregate(sizes, F.lit(0), lambda a, x: a + x)})
    for field, (code, _) in vectors.items():
        own, items = _of_type(code), F.transform(_of_type(code), _size_of(field))
        rows = rows.withColumn(f"has_{field}", F.size(own)).withColumn(f"n_{field}", F.when(F.size(own) > 0, F.aggregate(items, F.lit(0), lambda a, x: a + x)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    more = [column for field, (_, name) in vectors.items() for column in (total(f"has_{field}").alias(f"{name}_extensions"), total(f"n_{field}").alias(name), F.min(f"n_{field}").alias(f"min_{name}"), F.max(f"n_{field}").alias(f"max_{name}"))]
    extrema = [f(c).alias(f"{word}_{name}") for c, name in (("version", "version"), ("session_id_length", "session_id_length"), ("n_suites", "cipher_suites"), ("n_methods", "compression_methods"), ("n_extensions", "extensions")) for word, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(*DIRECTION).agg(
        F.count(F.lit(1)).alias("hellos"), F.count_if(F.col("session_id_length") > 0).alias("with_session_id"), total("session_id_length").alias("session_id_bytes"), total("n_suites").alias("cipher_suites"), total("n_methods").alias("compression_methods"),
        F.count_if("extensions_present").alias("with_extensions"), total("n_extensions").alias("extensions"), total("n_unknown").alias("unknown_extensions"), total("n_repeated").alias("duplicate_extensions"),
        total("bytes").alias("extension_bytes"), F.min("least").alias("min_extension_length"), F.max("most").alias("max_extension_length"), *extrema, *more,
    )


def tls_hello_histograms(events: DataFrame, kind: int) -> DataFrame:
    """(what, value, count) over versions, cipher suites, compression methods and extension types of complete hellos."""
    counted = _counted(_hellos(events, kind), DIRECTION, version=F.array("version"), cipher_suite=F.col("cipher_suites"), compression_method=F.col("compression_methods"), extension_type=F.transform("extensions", lambda e: e["type"]))
    return counted.withColumnRenamed("code_kind", "what")
