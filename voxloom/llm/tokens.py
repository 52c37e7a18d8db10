"""Token counts by a two-tier lookup of pre-token lengths, all on the map side.

Tier one is a compact table of the lengths of frequent pre-tokens, counted on a sample of rows
from all over the table and broadcast to every worker; its size is bounded by ``hot_entries``. Tier two is a cache in each worker
that the tokenizer fills on a miss. No pre-token is ever shuffled.

A pre-token here is a run of non-blank characters with the one space before it, or a
run of blanks: the coarsest pieces at which the tokenizer's own pattern always cuts.
The library itself encodes every piece that is not in a table, so a count is what the
library gives for the whole text. Texts with characters on whose class the library
and Python could differ, or with a special token's string, go to the library whole.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row. Texts of any
length are counted whole. The operator's columns replace ones of the input with the same
names; all others are kept. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.texts import Cache, byte_letters, fresh, held, map_rows, per_task

#: The sample from which tier one is filled; it steers speed only, never counts.
HOT_ROWS = 2000
HOT_CHARS = 4000
HOT_ENTRIES = 100_000
CACHE_ENTRIES = 300_000

_PIECE = re.compile(r" ?[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+")
#: Blanks and separators beyond ASCII's six, on which two engines' classes could differ.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿\ud800-\udfff]")


#: The common shape of a piece: letters in composed form, then marks; one pre-token of the tokenizer each.
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([!-&(-/:-@[-`{-~]*)")
_LETTERS = byte_letters()


class Misses(Cache):
    """Tier two: piece -> number of tokens, from the tokenizer itself."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model

    def make(self, piece: str) -> int:
        if m := _PLAIN.fullmatch(piece):
            marks = m.start(1)
            return self.merged(piece[:marks]) + (self.merged(m[1]) if m[1] else 0)
        return self.whole(piece)

    def merged(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token.encode().decode("latin-1").translate(_LETTERS)))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False))


class Lengths(dict):
    """Tier one: the frequent pieces' lengths; what it lacks goes to tier two."""

    def __init__(self, misses: Misses, hot: dict[str, int]):
        super().__init__(hot)
        self.misses = misses

    def __missing__(self, piece: str) -> int:
        return self.misses[piece]

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if _ODD.search(text) or any(s in text for s in self.misses.special):
            return self.misses.whole(text)
        return sum(map(self.__getitem__, _PIECE.findall(text)))


def hot_lengths(docs: DataFrame, misses: Misses, text: str, rows: int, chars: int, entries: int) -> dict[str, int]:
    """Lengths of the frequent pieces in the first ``chars`` characters of about ``rows`` rows, drawn evenly.

    The driver sees at most twice rows * chars characters and encodes each frequent piece once.
    Texts are counted whole elsewhere; which pieces stand in tier one changes speed alone.
    """
    total = docs.count()
    some = docs if total <= rows else docs.sample(rows / total, seed=1)
    count: Counter = Counter()
    for (t,) in some.select(F.substring(text, 1, chars)).take(2 * rows):
        count.update(_PIECE.findall(t or ""))
    return {p: misses.make(p) for p, _ in count.most_common(entries) if len(p) <= 64}


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``)."""
    hot = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, hot_lengths(docs, Misses(tokenizer, 0), text, hot_rows, hot_chars, hot_entries)))
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    kept = docs.select(*keep, F.col(text).alias(fresh("text", keep)))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes bigint, n_tokens bigint, over_limit boolean"])

    @per_task
    def count():
        lengths = _worker_lengths(tokenizer, hot)

        def step(*cols):
            texts = cols[-1]
            n = [lengths.of(t) for t in texts]
            size = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            return [*cols[:-1], size, n, [x > limit for x in n]]

        return step

    return map_rows(kept, count, schema, raw=keep)


def _worker_lengths(path: str, hot) -> Lengths:
    """One table in each worker process, for all its tasks."""
    name, lengths = hot.value
    return held(("lengths", name), lambda: Lengths(Misses(path, CACHE_ENTRIES), lengths))
