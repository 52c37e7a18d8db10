"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Exact-complement hashing on the histogram of piece lengths: the gaps that long pieces leave
are filled by singles, pairs and triples of just the gap's length, found by their complements in the
counts and consumed while these last; what is left goes best-fit, longest first. The
histogram has one entry a length, so the plan is made on at most ``capacity`` numbers
whatever the size of the corpus, and comes back as ranges of ranks that pieces join.

Null text is an empty document: its end id alone. Ties among pieces of one length are
broken by document and piece; equal rows are interchangeable. An empty table packs into
nothing. Columns of the input other than the id and the text don't pass through.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.texts import Cache, byte_letters, held, map_rows, per_task
from voxloom.plans.durable import durable

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps, twice as many at most.
CACHE_ENTRIES = 200_000
#: Pieces of one length that are ranked together at most, on average; ranks are offset by the counts before.
RANK_ROWS = 100_000


#: The common shape of a word: letters in composed form, then marks; one pre-token of the tokenizer each.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
_LETTERS = byte_letters()


class Ids(Cache):
    """Word -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops blanks, and no rule of it reaches across one, so a text's ids
    are those of its words in turn.
    """

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def make(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            return self.merged(m[1].lower()) + (self.merged(m[2]) if m[2] else b"")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, pre_token: str) -> bytes:
        got = self.model.tokenize(pre_token.encode().decode("latin-1").translate(_LETTERS))
        return b"".join([t.id.to_bytes(4, "little") for t in got])

    def of(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of at most ``capacity`` ids."""
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    end = np.array([END_ID], "<u4").tobytes()

    @per_task
    def cut():
        ids = held(("ids", tokenizer), lambda: Ids(tokenizer))

        def step(doc, texts):
            out = [[] for _ in range(6 if with_ids else 5)]
            for d, t in zip(doc, texts, strict=True):
                coded = ids.of(t) + end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    row = (d, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").tolist()] if with_ids else ()))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            return out

        return step

    return map_rows(docs.select(F.col(doc_id), F.col(text)), cut, schema)


class Left:
    """Counts of lengths still to be packed, and the patterns that use them up."""

    def __init__(self, counts: dict[int, int]):
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.out: list[tuple[tuple[int, ...], int]] = []

    def take(self, *lengths: int) -> None:
        """The pattern as often as the counts allow."""
        need = {n: lengths.count(n) for n in lengths}
        times = min(self.left.get(n, 0) // k for n, k in need.items())
        if times:
            self.out.append((lengths, times))
            for n, k in need.items():
                self.left[n] -= k * times
                if not self.left[n]:
                    del self.left[n]


def fill_exactly(work: Left, capacity: int, most: int) -> None:
    """Gaps that pieces leave, longest first, filled by a single piece, a pair or a triple of just the gap's
    length; ``most``: pieces that may fill a gap. Sums are found by their complements in the counts."""
    left = work.left
    work.take(capacity)
    if most >= 1:
        for a in sorted(left, reverse=True):
            if 2 * a < capacity:
                break
            if a in left and capacity - a in left:
                work.take(a, capacity - a)
    if most >= 2:
        for a in sorted(left, reverse=True):
            if 3 * a < capacity:
                break
            _pairs(work, (a,), capacity - a)
    if most >= 3:
        for a in sorted(left, reverse=True):
            if 4 * a < capacity:
                break
            gap = capacity - a
            for b in sorted((x for x in left if x <= a and 3 * x >= gap), reverse=True):
                if a not in left:
                    break
                if b in left and gap - b > 0:
                    _pairs(work, (a, b), gap - b)


def _pairs(work: Left, held: tuple[int, ...], gap: int) -> None:
    """Fill ``gap`` beside ``held`` by pairs, none longer than the last of ``held``."""
    left = work.left
    for b in sorted((x for x in left if x <= held[-1] and x < gap <= 2 * x), reverse=True):
        if any(h not in left for h in held):
            return
        if b in left and gap - b in left:
            work.take(*held, b, gap - b)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: each piece goes to the sequence with the least room that takes it.

    Sequences of one room are interchangeable, so pieces of one length are placed together.
    """
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for n in sorted(counts, reverse=True):
        todo = counts[n]
        for room in sorted(r for r in rooms if r >= n) + [capacity]:
            fit = room // n  # a sequence that took one has less room than its like, so it is next as well
            open_ = rooms.pop(room) if room in rooms and room != capacity else {(): -(-todo // fit)}
            for pattern, times in open_.items():
                full = min(times, todo // fit)
                some = todo - full * fit if full < times else 0
                todo -= full * fit + some
                for k, m in ((fit, full), (some, 1 if some else 0), (0, times - full - (1 if some else 0))):
                    if m and (pattern or k):
                        held = rooms.setdefault(room - k * n, {})
                        held[pattern + (n,) * k] = held.get(pattern + (n,) * k, 0) + m
            if not todo:
                break
    return [x for held in rooms.values() for x in held.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): patterns that use up ``counts``, each of at most ``capacity``.

    Exact fills may use up the small pieces that the rest would need, so gaps are filled by triples
    at most, by pairs, by singles or by none, the rest by best fit each time, and the plan of the
    fewest sequences holds; of equals the one that fills most exactly.
    """
    best = None
    for most in (3, 2, 1, 0):
        work = Left(counts)
        if most:
            fill_exactly(work, capacity, most)
        found = work.out + best_fit(work.left, capacity)
        size = sum(times for _, times in found)
        if best is None or size < best[0]:
            best = size, found
    return best[1]


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    cut = durable(pieces(docs, tokenizer, doc_id, text, capacity, with_ids))
    sizes = cut.groupBy("length").agg(F.ceil(F.count("*") / RANK_ROWS).cast("int").alias("parts"))
    cut = cut.join(F.broadcast(sizes), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"))
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    # At most one number a length, however large the corpus.
    counts = {int(n): int(c) for n, c in per_part.groupBy("length").agg(F.sum("n")).collect()}
    slots, at, base = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for n in dict.fromkeys(lengths):
            k = lengths.count(n)
            slots.append((n, at[n], at[n] + k * times, base, k, offset))
            at[n] += k * times
            offset += k * n
        base += times
    names = "length bigint, lo bigint, hi bigint, base bigint, k int, at bigint"
    ranges = spark.createDataFrame(slots, names).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "k", "at"))).alias("slots"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("_local", local).join(first, ["length", "part"]).withColumn("_rank", F.col("first") + F.col("_local"))
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), 1)
    placed = ranked.join(F.broadcast(ranges), "length").withColumn("_slot", slot)
    within = F.col("_rank") - F.col("_slot.lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("_slot.base") + F.floor(within / F.col("_slot.k"))).cast("bigint").alias("sequence_id"),
        (F.col("_slot.at") + (within % F.col("_slot.k")) * F.col("length")).cast("bigint").alias("offset"),
    )
