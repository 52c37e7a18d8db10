"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and reduced to words with one blank between. An item
of m characters may differ by up to ``rate`` * m edits; it is split into one piece more
than that, so one piece at least stands unharmed in any such copy. One automaton finds all
exact piece hits; about each, Myers' bit-parallel distance decides.

Items are broadcast in shards of at most ``SHARD_CHARS`` characters, one pass over the
documents each, which ends before the next shard is read, so a large benchmark takes more passes
rather than more memory on the driver or the workers. Items
under ``short`` characters must occur exactly and at word ends; blank or null ones match
nothing. Null or empty texts match nothing. Rows with equal ids or texts each count;
equal (doc_id, item_id) matches are reported once. Other columns don't pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.texts import map_rows, per_task
from voxloom.plans.durable import durable

RATE = 0.08
SHORT = 40
SHARD_CHARS = 4_000_000

_WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly one length."""
    n, m = budget + 1, len(item)
    cuts = [m * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` within ``limit`` edits of ``item``; the first of equals."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float, short: int):
        import ahocorasick

        pieces: dict[str, list[tuple[int, int]]] = {}
        self.items = []
        for key, raw in items:
            item = normal(raw)
            if not item:
                continue
            budget = int(len(item) * rate) if len(item) >= short else 0
            k = len(self.items)
            self.items.append((key, item, budget, len(item) < short))
            for at, piece in split(item, budget):
                pieces.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end in the reduced text), one for each item found."""
        low = normal(text)
        if not low or not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        done: dict[int, tuple[int, int]] = {}
        for end, (size, where) in self.automaton.iter(low):
            for k, at in where:
                if k in done and done[k][0] == 0:
                    continue
                _, item, budget, exact = self.items[k]
                start = end + 1 - size - at
                if start >= 0 and low.startswith(item, start):
                    stop = start + len(item)
                    if not exact or not ((start and low[start - 1] != " ") or (stop < len(low) and low[stop] != " ")):
                        done[k] = (0, stop)
                    continue
                if budget:
                    lo, hi = max(0, start - budget), start + len(item) + budget
                    own = windows.setdefault(k, [])
                    # Hits come by their ends, not by the starts they imply: a window may reach back over several.
                    while own and lo <= own[-1][1]:
                        last = own.pop()
                        lo, hi = min(lo, last[0]), max(hi, last[1])
                    own.append([lo, hi])
        for k, own in windows.items():
            if k in done:
                continue
            _, item, budget, _ = self.items[k]
            for lo, hi in own:
                if (got := myers(item, low[lo:hi], budget)) and (k not in done or got[0] < done[k][0]):
                    done[k] = (got[0], lo + got[1])
        return [(self.items[k][0], d, e) for k, (d, e) in sorted(done.items())]


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, short: int = SHORT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end) for every document and item that it holds."""
    doc_kind, item_kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    source = docs.select(doc_id, text)
    out = None
    for shared, whole in _shards(items, item_id, item_text, shard_chars):

        @per_task
        def find(shared=shared):
            matcher = Matcher(shared.value, rate, short)

            def step(doc, texts):
                rows = [(d, *m) for d, t in zip(doc, texts, strict=True) for m in matcher.matches(t)]
                return [list(c) for c in zip(*rows, strict=True)] if rows else None

            return step

        got = map_rows(source, find, f"doc_id {doc_kind}, item_id {item_kind}, distance int, end bigint")
        if not whole:  # a pass ends before the next shard is read
            got = durable(got)
            shared.destroy()
        out = got if out is None else out.union(got)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end")).alias("m")).select("doc_id", "item_id", "m.distance", "m.end")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, short: int = SHORT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. Nothing is shuffled."""
    others = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*others, text])
    out = docs.select(*others, text)
    for shared, whole in _shards(items, item_id, item_text, shard_chars):

        @per_task
        def clean(shared=shared):
            matcher = Matcher(shared.value, rate, short)

            def step(*cols):
                keep = [k for k, t in enumerate(cols[-1]) if not matcher.matches(t)]
                return [*(c.take(pa.array(keep, pa.int64())) for c in cols[:-1]), [cols[-1][k] for k in keep]]

            return step

        out = map_rows(out, clean, schema, raw=others)
        if not whole:
            out = durable(out)
            shared.destroy()
    return out.select(*docs.columns)


def _shards(items: DataFrame, item_id: str, item_text: str, shard_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """One broadcast after another of the items, each of about ``shard_chars`` characters at most; and whether it is the only one."""
    bench = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // shard_chars))
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield items.sparkSession.sparkContext.broadcast([tuple(r) for r in part.distinct().orderBy("item_id", "text").collect()]), n == 1
