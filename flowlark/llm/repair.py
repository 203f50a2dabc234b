"""Conversation structure repair by composition of weighted finite-state machines.

The input acceptor is the chain of a conversation's rows, each a symbol of role
and fault. The edit transducer has one state: Keep, Rerole and Delete read a
row, Insert reads none. The role grammar accepts ``(s?(ua)+)?``. Their
composition is expanded only where a state is reached, position by position,
which is a topological order once inserts of a position are laid out in a row.
Weights are pairs of cost and label string; paths add costs and join labels,
and the lesser pair wins. From a given state a label fixes its path, so no
label of a state is the beginning of another of equal cost, and the lesser of
two stays the lesser whatever follows.

A long conversation is cut into pieces of bounded length. A piece's weights from
each state of the grammar to each other form a matrix, and matrices of
neighbours compose; so no conversation is gathered in one task. Repaired text
is written in pieces too. Only the digest of a whole repaired conversation
passes through one task, as a stream: SHA-256 has no other order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import discard, stage_table
from flowlark.runtime import with_rank

_SPACES = " \t\n\x0b\x0c\r"
_ENDS = ".!?"

Weight = tuple[int, str]
Frontier = dict[int, tuple[int, str, str]]  # state: cost, label, states at the borders of pieces

#: Role grammar: states after nothing, a system, a user and an assistant turn; the first and the last may end.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
STATES = 4
INSERTS = (("I", 3, "u"), ("I", 3, "a"))
_ROLES = {"u": "user", "a": "assistant"}
_KEPT = 32  # rows up to which weights are remembered


def edits(symbol: str) -> list[tuple[str, int, str]]:
    """Arcs of the edit transducer that read one row: (label, cost, role initial given out)."""
    role, fault = symbol
    arcs = [("D", 4, "")]
    if fault not in "bd":
        more = 3 if fault == "t" else 0
        arcs += [("K", more, role), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
    return arcs


def relax(frontier: Frontier, arcs) -> Frontier:
    """States that ``arcs`` lead to, composed with the grammar, with the least weight of each."""
    out: Frontier = {}
    for state, (cost, label, route) in frontier.items():
        for edit, price, gives in arcs:
            to = GRAMMAR[state].get(gives) if gives else state
            if to is not None:
                weight = (cost + price, label + edit, route)
                if to not in out or weight < out[to]:
                    out[to] = weight
    return out


def least(*frontiers: Frontier) -> Frontier:
    out: Frontier = {}
    for frontier in frontiers:
        for state, weight in frontier.items():
            if state not in out or weight < out[state]:
                out[state] = weight
    return out


def inserted(frontier: Frontier) -> Frontier:
    """No insert, one or two: a third would only come back to a state at a higher cost."""
    once = relax(frontier, INSERTS)
    return least(frontier, once, relax(once, INSERTS))


def paths(symbols: tuple[str, ...], start: int) -> Frontier:
    frontier: Frontier = {start: (0, "", "")}
    for symbol in symbols:
        frontier = relax(inserted(frontier), edits(symbol))
    return frontier


_remembered = lru_cache(maxsize=1 << 16)(paths)


def piece_weights(symbols: tuple[str, ...], starts: tuple[int, ...]) -> dict[int, Frontier]:
    find = _remembered if len(symbols) <= _KEPT else paths
    return {start: find(symbols, start) for start in starts}


def compose(left: dict[int, Frontier], right: dict[int, Frontier]) -> dict[int, Frontier]:
    """Weights over two neighbouring pieces; ``route`` notes the state between them."""
    out = {}
    for start, frontier in left.items():
        reached: list[Frontier] = []
        for between, (cost, label, route) in frontier.items():
            reached.append({end: (cost + c, label + x, f"{route}{between}{r}") for end, (c, x, r) in right.get(between, {}).items()})
        out[start] = least(*reached)
    return out


def finished(frontier: Frontier) -> tuple[int, str, str, int, str]:
    """(cost, audit, route, state before the last inserts, last inserts) of the least path that the grammar accepts."""
    best = None
    for state, (cost, label, route) in frontier.items():
        for end, (c, x, _) in inserted({state: (0, "", "")}).items():
            if end in FINAL and (best is None or (cost + c, label + x) < best[:2]):
                best = (cost + c, label + x, route, state, x)
    return best


# --- relations ----------------------------------------------------------------------------------------------------


def symbols(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Ranked rows (``c``, ``rank``, ``block``, ``turn``, ``role``, ``text``), and their narrow form (``c``, ``rank``, ``block``, ``symbol``).

    ``c`` is the conversation as text, empty for null. Rows of a conversation
    are ordered by turn, nulls first, then role and text. A symbol is the role's
    class (``s``, ``u``, ``a`` or ``x``) and the fault (``b``, ``d``, ``t`` or ``-``).
    """
    rows = messages.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("c"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    ranked = with_rank(rows.withColumn("_u", F.monotonically_increasing_id()), "rank", "c", "turn", "role", "text", "_u").drop("_u")
    ranked = ranked.withColumn("block", F.expr(f"rank DIV {block}"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    first = F.substring("role", 1, 1)
    narrow = ranked.select("c", "rank", "block", F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x")).alias("r"), (F.length(bare) == 0).alias("blank"), (F.instr(F.lit(_ENDS), F.substring(bare, -1, 1)) == 0).alias("cut"))
    # of rows alike in role and text the first is no duplicate; firsts are joined by rank, a key without repeats
    alike = ranked.select("c", "rank", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256).alias("h"))
    firsts = alike.groupBy("c", "h").agg(F.min("rank").alias("rank")).select("rank", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), F.lit("b")).when(F.col("new").isNull(), F.lit("d")).when(F.col("cut"), F.lit("t")).otherwise(F.lit("-"))
    return ranked, narrow.join(firsts, "rank", "left").select("c", "rank", "block", F.concat("r", fault).alias("symbol"))


_PIECE = "c string, block long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, labels array<string>, routes array<string>"
_LEGAL = ("su", "ua", "au")


def _flat(weights: dict[int, Frontier]) -> tuple[list, list, list]:
    cells = [weights.get(a, {}).get(b) for a in range(STATES) for b in range(STATES)]
    return tuple([None if x is None else x[k] for x in cells] for k in range(3))


def _deep(costs: list, labels: list, routes: list) -> dict[int, Frontier]:
    out: dict[int, Frontier] = {}
    for k, (cost, label, route) in enumerate(zip(costs, labels, routes)):
        if cost is not None:
            out.setdefault(k // STATES, {})[k % STATES] = (cost, label, route)
    return out


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.rsplit(" ", 1)[0], kinds[f.rsplit(" ", 1)[1]]) for f in schema.split(", ")])


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows sorted by (block, rank). The first piece of a block may go on from the block before, so it is weighed from every state."""
    held: list[str] = []
    at, fresh, done = None, False, []

    def piece() -> dict:
        roles = [s[0] for s in held]
        illegal = sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))
        costs, labels, routes = _flat(piece_weights(tuple(held), (0,) if fresh else tuple(range(STATES))))
        counts = {name: sum(s[1] == f for s in held) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
        return {"c": at[1], "block": at[0], "n": len(held), **counts, "illegal": illegal, "first": roles[0], "last": roles[-1], "costs": costs, "labels": labels, "routes": routes}

    for batch in batches:
        for c, block, symbol in zip(*(batch.column(k).to_pylist() for k in ("c", "block", "symbol"))):
            if (block, c) != at:
                if held:
                    done.append(piece())
                fresh = at is not None and at[0] == block
                at, held = (block, c), []
            held.append(symbol)
        if len(done) >= 256:
            yield _table(done, _PIECE)
            done = []
    if held:
        done.append(piece())
    yield _table(done, _PIECE)


def _joined(group: pa.Table) -> pa.Table:
    """A few neighbouring pieces as one."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    out, weights = dict(rows[0]), _deep(rows[0]["costs"], rows[0]["labels"], rows[0]["routes"])
    for r in rows[1:]:
        weights = compose(weights, _deep(r["costs"], r["labels"], r["routes"]))
        out["illegal"] += r["illegal"] + (out["last"] + r["first"] not in _LEGAL)
        for k in ("n", "blank", "duplicate", "truncated"):
            out[k] += r[k]
        out["last"] = r["last"]
    out["costs"], out["labels"], out["routes"] = _flat(weights)
    return pa.Table.from_batches([_table([{k: out[k] for k in _arrow(_PIECE).names}], _PIECE)])


_AUDIT = "c string, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, route string, state int, tail string"


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit, route, state, tail = finished(_deep(r["costs"], r["labels"], r["routes"])[0])
            out.append({**{k: r[k] for k in ("c", "n", "blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "route": route, "state": state, "tail": tail})
        yield _table(out, _AUDIT)


def audits(narrow: DataFrame, *, fan: int = 16) -> tuple[DataFrame, DataFrame]:
    """One row a conversation with its counts, cost, audit and route; and one row a piece: (``c``, ``block``, ``start``, ``label``, ``alone``)."""
    pieces = stage_table(narrow.select("c", "block", "rank", "symbol").repartition("block").sortWithinPartitions("block", "rank").select("c", "block", "symbol").mapInArrow(_cut, _PIECE), "pieces")
    spans = pieces.groupBy("c").agg(F.min("block").alias("from"), F.count(F.lit(1)).alias("m"))
    placed = stage_table(pieces.select("c", "block", "labels").join(spans, "c").select("c", "block", "m", (F.col("block") - F.col("from")).alias("k"), "labels"), "placed")
    whole = pieces.join(spans.where("m = 1").select("c"), "c", "left_semi")
    rest = stage_table(pieces.join(spans.where("m > 1").select("c", "from"), "c").withColumn("block", F.col("block") - F.col("from")).drop("from"), "long")
    longest = (placed.agg(F.max("m")).first()[0]) or 1
    while longest > 1:  # a fan of neighbours at a time, so no task holds more than a fan of matrices
        old = rest
        rest = stage_table(rest.withColumn("at", F.expr(f"block DIV {fan}")).groupBy("c", "at").applyInArrow(_joined, _PIECE).withColumn("block", F.expr(f"block DIV {fan}")), "long")
        discard(old)
        longest = -(-longest // fan)
    result = stage_table(whole.select(*rest.columns).unionByName(rest).mapInArrow(_closed, _AUDIT), "audits")
    # the route has the states between pieces: before the first is state 0, after the last ``state``
    digits = lambda x: F.split(x, "(?!$)")
    zipped = F.arrays_zip(digits(F.concat(F.lit("0"), "route")).alias("start"), digits(F.concat("route", F.col("state").cast("string"))).alias("end"))
    steps = result.select("c", "tail", F.length("route").alias("last"), F.posexplode(zipped).alias("k", "x"))
    steps = steps.select("c", F.col("k").cast("long").alias("k"), F.col("x.start").cast("int").alias("start"), F.col("x.end").cast("int").alias("end"), F.when(F.col("k") == F.col("last"), F.col("tail")).otherwise(F.lit("")).alias("tail"))
    plan = placed.join(steps, ["c", "k"]).select("c", "block", "start", F.concat(F.get("labels", F.col("start") * STATES + F.col("end")), "tail").alias("label"), (F.col("m") == 1).alias("alone"))
    return result, plan


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, str, str | None, str | None]]:
    """((c, block, alone), edit, role, text) of rows sorted by (block, c, rank), each piece's plan before its rows; a deleted row has no role."""
    key, letters, state = None, iter(()), 0

    def inserts(edit: str | None) -> Iterator:
        nonlocal state
        while edit == "I":
            gives = next(iter(GRAMMAR[state].keys() & {"u", "a"}))
            state = GRAMMAR[state][gives]
            yield key, "I", _ROLES[gives], ""
            edit = next(letters, None)
        return edit

    for batch in batches:
        for c, block, start, label, alone, role, text in zip(*(batch.column(k).to_pylist() for k in ("c", "block", "start", "label", "alone", "role", "text"))):
            if label is not None:
                if key is not None:
                    yield from inserts(next(letters, None))
                key, letters, state = (c, block, alone), iter(label), start
                continue
            edit = yield from inserts(next(letters, None))
            if edit == "D":
                yield key, "D", None, None
            elif edit == "K":
                state = GRAMMAR[state][role[:1]]
                yield key, "K", role, text
            else:
                gives = next(iter(GRAMMAR[state].keys() & {"u", "a"}))
                state = GRAMMAR[state][gives]
                yield key, "R", _ROLES[gives], text
    if key is not None:
        yield from inserts(next(letters, None))


def _scripted(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows and the plans of their pieces, a block's in one task and in order."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = ranked.select("c", "block", "rank", none("int").alias("start"), none("string").alias("label"), none("boolean").alias("alone"), "role", "text")
    plans = plan.select("c", "block", F.lit(-1).cast("long").alias("rank"), "start", "label", "alone", none("string").alias("role"), none("string").alias("text"))
    return rows.unionByName(plans).repartition("block").sortWithinPartitions("block", "c", "rank")


_TURNS = "c string, block long, place long, edit string, role string, text string"
_PARTS = "c string, block long, part long, lines binary, digest string"
_PART_BYTES = 1 << 22


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, last, place, held = [], None, 0, 0
    for key, edit, role, text in _edited(batches):
        place = place + 1 if key == last else 0
        last, held = key, held + len(text or "")
        out.append({"c": key[0], "block": key[1], "place": place, "edit": edit, "role": role, "text": text})
        if len(out) >= 4096 or held > _PART_BYTES:
            yield _table(out, _TURNS)
            out, held = [], 0
    yield _table(out, _TURNS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of a conversation that is one piece; of others the repaired lines, in parts of some MB."""
    done, size = [], 0
    last, digest, lines, part = None, None, [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal lines, part, size, done
        if last is not None and lines:
            joined = "\n".join(lines).encode()
            if last[2]:
                digest.update(b"\n" + joined if part else joined)
            else:
                done.append({"c": last[0], "block": last[1], "part": part, "lines": joined, "digest": None})
                size += len(joined)
            lines, part = [], part + 1
        if len(done) >= 1024 or size > _PART_BYTES:
            yield _table(done, _PARTS)
            done, size = [], 0

    held = 0
    for key, _, role, text in _edited(batches):
        if key != last:
            yield from flush()
            if last is not None and last[2]:
                done.append({"c": last[0], "block": None, "part": None, "lines": None, "digest": digest.hexdigest()})
            last, digest, part, held = key, hashlib.sha256(), 0, 0
        if role is not None:
            lines.append(f"{role}:{text}")
            held += len(lines[-1])
            if held > _PART_BYTES:
                yield from flush()
                held = 0
    yield from flush()
    if last is not None and last[2]:
        done.append({"c": last[0], "block": None, "part": None, "lines": None, "digest": digest.hexdigest()})
    yield _table(done, _PARTS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of parts sorted by (c, block, part): a stream, nothing of it is held."""
    at, digest, out = None, None, []
    for batch in batches:
        for c, lines in zip(batch.column("c").to_pylist(), batch.column("lines").to_pylist()):
            if c != at:
                if at is not None:
                    out.append({"c": at, "digest": digest.hexdigest()})
                at, digest = c, hashlib.sha256(lines)
            else:
                digest.update(b"\n" + lines)
    if at is not None:
        out.append({"c": at, "digest": digest.hexdigest()})
    yield _table(out, "c string, digest string")


def _as_id(c: str = "c") -> Column:
    return F.when(F.col(c) != "", F.col(c).cast("long"))


def repaired_turns(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 256) -> DataFrame:
    """(conv_id, block, place, edit, role, text): the cheapest repair, an edit a row.

    Ordered by ``conv_id, block, place`` a conversation's edits stand in order;
    those without a role are deleted rows. See ``repair_conversations`` for the
    edits and for odd values.
    """
    ranked, narrow = symbols(messages, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col, block=block)
    _, plan = audits(narrow)
    return _scripted(ranked, plan).mapInArrow(_turns, _TURNS).select(_as_id().alias("conv_id"), "block", "place", "edit", "role", "text")


def repair_conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 256) -> DataFrame:
    """A row for each conversation of ``messages``: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.

    A row is blank without a character that is no space, else a duplicate if its
    role and text stood earlier, else truncated if its last such character is
    none of ``.!?``. Keep costs 0, Rerole to user or assistant 3, Delete 4 (the
    only edit of blank and duplicate rows), Insert of an empty user or assistant
    turn 3; a truncated row that stays adds 3. ``audit`` holds the initials of
    the cheapest edits after which role initials read ``(s?(ua)+)?``, of equal
    ones the least. ``illegal`` counts neighbours other than su, ua and au.
    ``gaps`` counts numbers missing between the least and the largest turn, null
    if that is no 64-bit number.

    Null roles and texts are one space; a null conversation is one conversation;
    rows are ordered by turn (nulls first), role and text, so ties have one
    order; repeated rows are duplicates. Whole texts count. An empty table gives
    an empty result; other columns are dropped. A conversation of any length is
    weighed in pieces of at most ``block`` rows.
    """
    ranked, narrow = symbols(messages, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col, block=block)
    result, plan = audits(narrow)
    parts = stage_table(_scripted(ranked, plan).mapInArrow(_parts, _PARTS), "parts")
    long = parts.where("digest IS NULL").select("c", "block", "part", "lines").repartition("c").sortWithinPartitions("c", "block", "part").mapInArrow(_hashed, "c string, digest string")
    digests = parts.where("digest IS NOT NULL").select("c", "digest").unionByName(long)
    big = lambda x: x.cast("decimal(20,0)")
    turns = ranked.groupBy("c").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("seen"))
    gaps = turns.select("c", F.coalesce(F.expr("high IS NULL"), F.lit(True)).alias("none"), (big(F.col("high")) - big(F.col("low")) + 1 - big(F.col("seen"))).try_cast("long").alias("gaps"))
    gaps = gaps.select("c", F.when(F.col("none"), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"))
    out = result.select("c", "blank", "duplicate", "truncated", "illegal", "cost", "audit").join(gaps, "c").join(digests, "c", "left")
    return out.select(_as_id().alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def with_untouched(repaired: DataFrame, ids: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """``repaired`` with a row for each conversation of ``ids``: one that has no rows has no faults, an empty audit and the digest of nothing."""
    every = ids.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    key = lambda df, name: df.withColumn(name, F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    joined = key(every, "c").join(key(repaired, "c").drop("conv_id"), "c", "left")
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    # a gap that is no 64-bit number stays null
    zeros[0] = F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cells: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of ``conv:turn``: some rows are dropped, emptied, cut short, repeated or given the role user.

    Nulls count as one space, for roles and texts as well as in the hash.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % cells
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), lot.alias("_lot")).where("_lot <> 0")
    text = F.when(F.col("_lot") == 1, F.lit("")).when(F.col("_lot") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_lot") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_t")).drop("_t")
