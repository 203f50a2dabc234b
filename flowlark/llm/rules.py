"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Statistics are array expressions over a text's own words and lines, so nothing
is shuffled and a text is never taken apart into rows. The order of the rules
comes from a sample: each rule's selectivity is the share it rejects there, its
cost the work it takes (characters scanned, elements built, comparisons of
sorts), which is counted, not timed, so the order is the same on every machine
and in every run. Rules run by rejection per cost. The cascade is one nested
expression in which a statistic is computed inside of the branch that first
needs it: a text that an early rule rejects costs no later statistic, and a
rule with a screen computes its costly statistic only where the cheap screen
says that it could reject. The verdict depends on neither.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects where ``condition`` of the statistics named in ``needs`` (columns, in that order) is true."""

    name: str
    needs: tuple[str, ...]
    condition: Callable[..., Column]
    #: A cheaper condition, and what it needs, that holds wherever the rule rejects.
    screen: tuple[tuple[str, ...], Callable[..., Column]] | None = None

    def rejects(self, known: dict[str, Column]) -> Column:
        return self.condition(*(known[n] for n in self.needs))


#: Integer arithmetic, so that every engine decides alike at the limits.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    # a window too many brings in at most itself and one earlier window, six words
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, repeated: 100 * repeated > 50 * n, (("n_words", "n_surplus"), lambda n, surplus: 100 * 6 * surplus > 50 * n)),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, symbols: 10 * symbols > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, chars: (chars < 2 * n) | (chars > 15 * n)),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, repeated: 2 * repeated > n),
)


def _hashes(words: Column) -> Column:
    """Hashes of runs of three words, in order."""
    starts = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 2))
    return F.transform(starts, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def _windows(words: Column) -> Column:
    """(hash, place) of each run of three words, sorted."""
    starts = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 2))
    return F.sort_array(F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))


def _repeated(windows: Column) -> Column:
    """Places of windows that equal a neighbour in sorted order: they stand twice or more in the text."""
    twice = F.filter(windows, lambda x, i: (x["h"] == F.get(windows, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(windows, i - 1)["h"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words under the windows at ``places``."""
    each = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x).cast("long")


#: Each statistic, and what it is made of: the text (``text``) or other ones.
_MADE: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "words": ("text", lambda t: F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "")),
    "n_words": ("words", lambda w: F.size(w).cast("long")),
    "word_chars": ("text", lambda t: F.length(F.translate(t, _SPACES, "")).cast("long")),
    "n_symbols": ("text", lambda t: (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long")),
    "lines": ("text", lambda t: F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)),
    "n_lines": ("lines", lambda x: F.size(x).cast("long")),
    "n_dup_lines": ("lines", lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    "windows": ("words", _windows),
    "places": ("windows", _repeated),
    "n_repeat_words": ("places", _covered),
    "hashes": ("words", _hashes),
    "n_surplus": ("hashes", lambda h: (F.size(h) - F.size(F.array_distinct(h))).cast("long")),
}
#: The work that each takes, of the numbers of characters, words and lines.
_SORT = lambda n: n * (F.log2(n + 2.0) + 1)
_WORK: dict[str, Callable[[Column, Column, Column], Column]] = {
    "words": lambda c, w, x: c + w, "n_words": lambda c, w, x: F.lit(1), "word_chars": lambda c, w, x: c, "n_symbols": lambda c, w, x: c,
    "lines": lambda c, w, x: 2 * c + x, "n_lines": lambda c, w, x: F.lit(1), "n_dup_lines": lambda c, w, x: c + x,
    "windows": lambda c, w, x: c + _SORT(w), "places": lambda c, w, x: 2 * w, "n_repeat_words": lambda c, w, x: w,
    "hashes": lambda c, w, x: c + w, "n_surplus": lambda c, w, x: w,
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variable that holds ``value``: computed once, and only if ``body`` is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with(names: tuple[str, ...], known: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` with the statistics ``names`` among the known values."""
    missing = [n for n in names if n not in known]
    if not missing:
        return body(known)
    name = missing[0]
    while _MADE[name][0] not in known:
        name = _MADE[name][0]
    of, make = _MADE[name]
    return _let(make(known[of]), lambda v: _with(names, known | {name: v}, body))


def with_statistics(docs: DataFrame, *, text_col: str = "text", mark: str = "_q_") -> DataFrame:
    """Adds all statistics (long) under ``mark`` + name. Null texts count as empty ones; whole texts count.

    They are made as one value, in which nothing is computed twice even where a
    filter on them is pushed below.
    """
    own, all_ = [f"`{c}`" for c in docs.columns], f"{mark}all"
    made = _let(_text(text_col), lambda t: _with(STATISTICS, {"text": t}, lambda known: F.struct(*[known[n].alias(n) for n in STATISTICS])))
    return docs.withColumn(all_, made).select(*own, *[F.col(all_)[n].alias(f"{mark}{n}") for n in STATISTICS])


def cascade(ordered: list[Rule], known: dict[str, Column]) -> Column:
    """The name of the first rule that rejects, or null. ``known`` holds the ``text``, and statistics that exist already."""
    if not ordered:
        return F.lit(None).cast("string")
    first, rest = ordered[0], ordered[1:]
    judge = lambda now: _with(first.needs, now, lambda all_: first.rejects(all_))
    if first.screen is None or all(n in known for n in first.needs):
        return _with(first.needs, known, lambda now: F.when(first.rejects(now), F.lit(first.name)).otherwise(cascade(rest, now)))
    needs, could = first.screen
    return _with(needs, known, lambda now: F.when(could(*(now[n] for n in needs)) & judge(now), F.lit(first.name)).otherwise(cascade(rest, now)))


def _needed(names: tuple[str, ...]) -> set[str]:
    """Statistics that these are made of, themselves included."""
    out: set[str] = set()
    for name in names:
        while name != "text":
            out.add(name)
            name = _MADE[name][0]
    return out


def measured_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = 1000) -> list[tuple[Rule, float, float]]:
    """(rule, share of rows rejected, work a row) on about ``sample_rows`` rows, in one job.

    Each row is taken with the same chance, where it lies, so no task gathers
    candidates, and the same table gives the same rows. A rule's work is that
    of judging by it alone, its screen included where it has one.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = with_statistics(docs.select(_text(text_col).alias("text")).sample(fraction=share, seed=11))
    known = {n: F.col(f"_q_{n}") for n in STATISTICS}
    size = (F.length("text").cast("double"), known["n_words"].cast("double"), known["n_lines"].cast("double"))
    figures = [F.count(F.lit(1)).alias("n")]
    for k, rule in enumerate(rules):
        work = sum((_WORK[n](*size).cast("double") for n in sorted(_needed(rule.needs))), F.lit(0.0))
        figures += [F.count_if(rule.rejects(known)).alias(f"r{k}"), F.sum(F.floor(work)).alias(f"c{k}")]
    got = sample.agg(*figures).first()
    n = max(1, got["n"])
    return [(rule, got[f"r{k}"] / n, (got[f"c{k}"] or 0) / n) for k, rule in enumerate(rules)]


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = 1000) -> list[Rule]:
    """The rules by rejection per work on a sample; rules that reject nothing there come last, cheapest first."""
    found = measured_rules(docs, rules, text_col=text_col, sample_rows=sample_rows)
    ranked = sorted((-(rejected / max(work, 1.0)), 0.0 if rejected else work, k) for k, (_, rejected, work) in enumerate(found))
    return [rules[k] for *_, k in ranked]


def quality_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ordered: list[Rule] | None = None) -> DataFrame:
    """A row for each row of ``docs``: the id, all statistics, ``base_failed`` and ``kept``.

    As it returns every statistic, the order saves work only in the conditions.
    Null and empty texts have no words and fail. Whole texts count; repeated
    rows repeat; an empty table gives an empty result; other columns are
    dropped.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered or order_rules(rows, rules)
    known = {n: F.col(f"_q_{n}") for n in STATISTICS} | {"text": F.col("text")}
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.rejects(known)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return with_statistics(rows).select("doc_id", *[known[n].alias(n) for n in names], base.alias("base_failed"), (cascade(ordered, known).isNull() & ~base).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ordered: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns, whatever these are called.

    Null and empty texts have no words and go; whole texts count; repeated rows
    stay repeated; an empty table gives an empty result.
    """
    ordered = ordered or order_rules(docs, rules, text_col=text_col)
    return docs.where(_let(_text(text_col), lambda t: cascade(ordered, {"text": t})).isNull())
