"""Chat formatting: quotations are linked to their originals and left out, in DataFrame functions only.

A line's quote level is the number of '>' it begins with. Runs of lines of one
level are passages; their text is normalised (small letters, single spaces) and
hashed. A passage is linked to the first message of its conversation with the
same hash, of its whole body or of one of its lines. A message replies to the
latest message that its outermost quotes come from.

The result has a row for each message, ordered within a conversation by its
root and its position in the root's tree, so that no conversation, however long
or deep, is gathered in one place. Positions come from the tour around a tree
(down to each message, on to its replies, up again), which is a linked list:
each round halves the way to its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import discard, stage_table
from flowlark.runtime import with_rank

_PREFIX = r"^(?:[ \t]*>)+"


def _level(line: Column) -> Column:
    prefix = F.regexp_extract(line, _PREFIX, 0)
    return F.length(prefix) - F.length(F.translate(prefix, ">", ""))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def _key(text: Column) -> Column:
    return F.sha1(_normal(text).cast("binary"))


def parse_quotes(messages: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds ``body`` (the lines without a quote mark, outer empty lines cut) and ``passages``, an array of (level, text) in order.

    A quoted line loses its marks and one space. Null texts have an empty body and no passages.
    """
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\r?\n", -1)
    parsed = F.transform(lines, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _PREFIX + r" ?", "").alias("text")))
    df = messages.withColumn("_lines", parsed)
    # a passage is the slice of lines from one change of level to the next
    changed = lambda i: (i == 0) | (F.get("_lines", i)["level"] != F.get("_lines", i - 1)["level"])
    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), changed))
    held = lambda s, k: F.slice("_lines", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - s)
    runs = F.transform("_starts", lambda s, k: F.struct(F.get("_lines", s)["level"].alias("level"), F.array_join(F.transform(held(s, k), lambda x: x["text"]), "\n").alias("text")))
    df = df.withColumn("_passages", runs)
    body = F.array_join(F.transform(F.filter("_passages", lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    quoted = F.filter("_passages", lambda x: (x["level"] > 0) & (F.length(F.trim(x["text"])) > 0))
    return df.withColumn("body", F.regexp_replace(body, r"^\n+|\n+\z", "")).withColumn("passages", quoted).drop("_lines", "_starts", "_passages")


def link_quotes(parsed: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, level, original): for each quoting message and level, the latest of the first messages that hold a passage of it.

    Only earlier messages of the same conversation count.
    """
    conv, turn = F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn")
    units = F.array_union(F.array("body"), F.split("body", "\n", -1))
    held = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL" if (conv_col, turn_col) == ("conv_id", "turn") else F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull())
    quotes = held.select(conv, turn, F.explode("passages").alias("q")).select("conv", "turn", F.col("q")["level"].alias("level"), F.explode(F.array_union(F.array(F.col("q")["text"]), F.split(F.col("q")["text"], "\n", -1))).alias("unit"))
    quotes = quotes.where(F.length(_normal(F.col("unit"))) > 0).select("conv", "turn", "level", _key(F.col("unit")).alias("key")).distinct()
    originals = held.select(conv, turn, F.explode(units).alias("unit")).where(F.length(_normal(F.col("unit"))) > 0)
    # grouped by three keys and joined by two: both sides are dealt anew, and a hot passage can be split
    firsts = originals.select("conv", _key(F.col("unit")).alias("key"), "turn").groupBy("conv", "key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("h")).agg(F.min("turn").alias("original")).select("conv", "key", "original")
    linked = quotes.join(firsts, ["conv", "key"]).where("original < turn")
    return linked.groupBy("conv", "turn", "level").agg(F.max("original").alias("original"))


def _tour(parents: DataFrame) -> DataFrame:
    """Two steps for each message of a tree, into it and out of it, each with the next step and what both weigh.

    ``into`` counts messages entered, ``level`` adds 1 on the way down and takes
    it off on the way up. Siblings follow each other by turn; they are found by
    rank over all replies, so even a message with most replies is no group.
    """
    ranked = with_rank(parents.select("conv", "turn", "parent"), "place", "conv", "parent", "turn")
    ranked = ranked.select("conv", "turn", "parent", "place")
    after = ranked.select((F.col("place") - 1).alias("place"), F.col("conv").alias("c"), F.col("parent").alias("p"), F.col("turn").alias("sibling"))
    siblings = ranked.join(after, "place", "left").select("conv", "turn", "parent", F.when((F.col("c") == F.col("conv")) & (F.col("p") == F.col("parent")), F.col("sibling")).alias("sibling"))
    firsts = parents.groupBy(F.col("conv"), F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    roots = firsts.select("conv", "turn").join(parents.select("conv", "turn"), ["conv", "turn"], "left_anti")
    nodes = siblings.unionByName(roots.select("conv", "turn", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("sibling")))
    nodes = nodes.join(firsts, ["conv", "turn"], "left")
    step = lambda into, turn, next_into: F.struct(F.lit(into).alias("entering"), turn.alias("to"), next_into.alias("to_entering"))
    own = F.col("turn")
    down = step(True, F.coalesce("child", own), F.col("child").isNotNull())
    up = step(False, F.coalesce("sibling", "parent"), F.col("sibling").isNotNull())
    arcs = nodes.select("conv", "turn", F.explode(F.array(down, up)).alias("s")).select("conv", "turn", "s.*")
    into = F.col("entering").cast("long")
    return arcs.select("conv", "turn", "entering", "to", "to_entering", into.alias("into"), (2 * into - 1).alias("level"), F.col("turn").alias("last"))


def reply_order(parents: DataFrame, *, most_rounds: int = 64) -> DataFrame:
    """(conv, turn, root, depth, position) of each message that replies or is replied to, in one row.

    ``parents`` has (conv, turn, parent), each turn of a conversation once and
    its parent earlier. A round joins each step with the one it points to and
    takes over where that points; rounds grow with the logarithm of a tree's
    size, rows with the number of messages. A list that has not come to its end
    after ``most_rounds`` rounds raises an error.
    """
    arcs = stage_table(_tour(parents), "tour")
    for _ in range(most_rounds):
        if arcs.where("to IS NOT NULL").limit(1).count() == 0:
            break
        there = arcs.select("conv", F.col("turn").alias("to"), F.col("entering").alias("to_entering"), F.col("to").alias("far"), F.col("to_entering").alias("far_entering"), F.col("into").alias("more_into"), F.col("level").alias("more_level"), F.col("last").alias("far_last"))
        open_ = arcs.where("to IS NOT NULL").join(there, ["conv", "to", "to_entering"], "left")
        moved = open_.select("conv", "turn", "entering", F.col("far").alias("to"), F.col("far_entering").alias("to_entering"), (F.col("into") + F.col("more_into")).alias("into"), (F.col("level") + F.col("more_level")).alias("level"), F.col("far_last").alias("last"))
        old, arcs = arcs, stage_table(moved.unionByName(arcs.where("to IS NULL")), "tour")
        discard(old)
    else:
        raise RuntimeError(f"reply trees are not ordered after {most_rounds} rounds")
    entered = arcs.where("entering").select("conv", "turn", F.col("last").alias("root"), "into", (-F.col("level")).alias("depth"))
    sizes = entered.where("turn = root").select("conv", "root", F.col("into").alias("size"))
    return entered.join(sizes, ["conv", "root"]).select("conv", "turn", "root", "depth", (F.col("size") - F.col("into")).alias("position"))


def format_conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: ``conv_id``, ``turn``, ``role``, ``parent_turn``, ``root_turn``, ``depth``, ``position``, ``n_quotes``, ``n_linked_levels``, ``body`` and ``formatted``.

    Ordered by ``conv_id, root_turn, position`` the messages of a conversation
    stand in reply order, each after the one it replies to, siblings by turn.
    ``formatted`` is the message as a chat turn, without quotes. A message
    without a linked quote is a root, at position 0. Messages with a null
    conversation or turn are roots that nothing is linked to; a null role is
    'unknown'; a null text is an empty one. Rows of equal conversation and turn
    share parent and position. Whole texts count. An empty table gives an empty
    result; other columns are dropped.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.col(text_col).cast("string").alias("text"))
    # parsed once: three plans read it, and filters that Spark infers for an exploded array would parse it again
    parsed = stage_table(parse_quotes(rows).drop("text"), "parsed")
    links = stage_table(link_quotes(parsed), "quotes")
    outer = stage_table(links.groupBy("conv", "turn").agg(F.max_by("original", -F.col("level")).alias("parent"), F.count(F.lit(1)).alias("n_linked_levels")), "parents")
    known = reply_order(outer).join(outer, ["conv", "turn"], "left").withColumnRenamed("conv", "conv_id")
    out = parsed.join(known, ["conv_id", "turn"], "left")
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), zero("depth"), zero("position"), F.size("passages").cast("long").alias("n_quotes"), zero("n_linked_levels"), "body", formatted.alias("formatted"))
