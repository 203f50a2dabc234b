"""Token counts of whole texts by a tokenizer file of the ``tokenizers`` library.

Arrow functions encode in batches of about equal bytes and return lengths only.
Texts are cut at safe boundaries: before a space that stands between two
characters that are no white space, and, in long stretches without one, between
a punctuation mark and a letter. No match of a byte-level pre-tokenizer can
span such a place (of the marks only apostrophes begin a match that goes on
with letters), nor can a special string that has none inside; so the counts of
the segments add up to the count of the whole. Equal segments are encoded once
a worker; the memory of them is bounded in bytes.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import byte_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: A mark and a letter of blocks that every version of Unicode knows as such.
_MARK = re.compile("(?<=[.,;:!?\u2026\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[A-Za-z\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])")
LONG = 256


def safe_segments(text: str) -> list[str]:
    """The text in order, cut at safe spaces; segments of more than ``LONG`` characters between marks and letters too."""
    if not text:
        return []
    cut = _SAFE.split(text)
    return cut if max(map(len, cut)) <= LONG else [x for s in cut for x in (_MARK.split(s) if len(s) > LONG else (s,))]


class TokenCounter:
    """Counts of segments; remembers them up to about ``remember`` bytes, and one batch more."""

    def __init__(self, path: str, remember: int = 1 << 26, batch_bytes: int = 1 << 17) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.loads(self.tokenizer.to_str())
        before = described["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"] and not described["normalizer"]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        safe = plain and not any(re.search(r"\s", a) or _MARK.search(a) for a in added)
        self.cut = safe_segments if safe else (lambda t: [t] if t else [])
        self.known: dict[str, int] = {}
        self.held, self.remember, self.batch_bytes = 0, remember, batch_bytes

    def learn(self, segments: list[str]) -> None:
        """Encode in batches that hold about equal bytes."""
        start, total = 0, 0
        for k, s in enumerate(segments):
            total += len(s) + 64
            if total >= self.batch_bytes or k == len(segments) - 1:
                part = segments[start : k + 1]
                for x, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    self.known[x] = len(e)
                start, total = k + 1, 0

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(list(new))
            self.held += sum(map(sys.getsizeof, new)) + 100 * len(new)
        get = self.known.__getitem__
        counted = [sum(map(get, c)) for c in cut]
        if self.held > self.remember:
            self.known.clear()
            self.held = 0
        return counted


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _count(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in byte_slices(batch, batch.num_columns - 1, most):
                n = counter.counts([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(part.num_columns - 1)), pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, path: str, limit: int = 512, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 20) -> DataFrame:
    """``keep``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each text.

    No begin, end or other tokens are added; special strings inside a text count
    as the library counts them. Null and empty texts have 0 bytes and 0 tokens.
    Whole texts count. Repeated rows repeat; other columns are dropped; an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [c for c in keep]
    rows = docs.select(*names, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[:-1]), "n_tokens long"])
    return rows.mapInArrow(_count(path, batch_bytes), schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
