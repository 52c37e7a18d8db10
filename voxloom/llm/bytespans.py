"""Removal of byte strings that occur more than once, by a suffix array sorted deep-shallow.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the table, in the same
document or another; overlaps count, no string crosses documents, and strings are judged on the input. So, unlike in ``substrings``, no copy stays.

The suffixes of a corpus don't fit in one sort, and most of them can't have an equal. So they are sorted in shards that hold just what can match:

1. Among the ``GRAM``-byte grams of a window of ``length`` bytes, the one of least hash is its anchor. Equal windows have equal anchors at
   equal places; consecutive windows that share their anchor's place are a run. Only runs whose anchor occurs again can hold a repeated window.
2. Runs with one anchor form a shard. Equal byte sequences in it are counted first, by a 64-bit BLAKE2b beside the anchor's
   hash and with map-side combine, so copies by the thousand are one sequence with a weight. Windows of a sequence that occurs twice are repeated; those of
   one that occurs once are if the shard's other sequences hold them.
3. Shards of several sequences are sorted: all suffixes of their sequences at which a window starts, by their first
   ``length`` bytes (``deepshallow``). Equal neighbours are one string; it is repeated if its weights add up to two.

A shard of over ``HOT`` sequences (a common phrase in very many contexts) is no task's: its windows are dealt
by 128 bits of BLAKE2b of their bytes and counted. Hashes that meet by chance in step 1 only make a shard larger.

Null text is the empty one; texts under ``length`` bytes lose nothing. Equal rows, and rows that share an id, are different places, so
they make each other go. Ids may be of any type that can be grouped; a null id is one of them. A very long text is read in pieces, and takes memory in proportion to
itself when it is cut. Columns other than the id and the text don't pass through, so names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.deepshallow import suffix_order
from voxloom.llm.texts import map_rows, map_stream, per_task, written

LENGTH = 200
GRAM = 64
#: Sequences of a shard that one task sorts.
HOT = 4000
#: Bytes that are hashed, or sorted, at once.
PIECE = 1 << 21
#: Bits of a gram's place beside its hash; a piece is shorter.
PLACE = 24


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive bytes, from those of half as many."""
    h, have = x.astype(np.uint64) + np.uint64(1), 1
    while have < size:
        step = min(have, size - have)
        factor = np.uint64((0x9E3779B97F4A7C15 + 2 * have * 0x632BE59BD9B4E019) % 2**64 | 1)
        h, have = h[:-step] * factor + (h[step:] ^ (h[step:] >> np.uint64(29))), have + step
    return _mix(h)


def runs_in(x: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, windows) of all runs in documents that lie in ``x`` one after another."""
    if len(x) < length:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(x, gram)
    low = np.uint64((1 << PLACE) - 1)
    # The least hash, the first of equals: equal windows choose the same place.
    v, have, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, length - gram + 1
    while have < span:
        step = min(have, span - have)
        v, have = np.minimum(v[:-step], v[step:]), have + step
    place = (v & low).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(v)), "right")
    whole = np.arange(len(v)) + length <= ends[doc]
    first = whole & np.r_[True, ~whole[:-1] | (place[1:] != place[:-1])]
    starts = np.flatnonzero(first)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    count = np.bincount(np.cumsum(first)[whole] - 1)
    own = doc[starts]
    return own, h[place[starts]].view(np.int64), starts, count


def pieces(texts: list[bytes], length: int, size: int = PIECE):
    """Lists of (document, offset, bytes) of about ``size`` bytes; a longer text comes in pieces that overlap, so that each window is in one."""
    have, n = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), size):
            part = t[at : at + size + length - 1] if len(t) > size else t
            have.append((k, at, part))
            n += len(part)
            if n >= size:
                yield have
                have, n = [], 0
            if part is t:
                break
    if have:
        yield have


def runs_of(texts: list[bytes], length: int, gram: int):
    """(documents, anchors, first windows, windows, list of the bytes that each run's windows cover), piece by piece."""
    for part in pieces(texts, length):
        data = b"".join(p for _, _, p in part)
        ends = np.cumsum([len(p) for _, _, p in part])
        own, v, starts, count = runs_in(np.frombuffer(data, np.uint8), ends, length, gram)
        begin = np.r_[0, ends][own]
        at = starts - begin + np.array([a for _, a, _ in part])[own]
        covered = [data[s : s + n + length - 1] for s, n in zip(starts.tolist(), count.tolist(), strict=True)]
        yield np.array([k for k, _, _ in part])[own], v, at, count, covered


def _digest(data: bytes, size: int = 8) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def judged(seqs: list[bytes], times: list[int], shard: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each sequence, which of its windows occur once only; sequences of a shard follow each other and differ."""
    data = np.frombuffer(b"".join(seqs), np.uint8)
    n = np.array([len(s) for s in seqs])
    windows = n - length + 1
    own = np.repeat(np.arange(len(seqs)), windows)
    first = np.cumsum(windows) - windows
    starts = np.arange(len(own)) - first[own] + (np.cumsum(n) - n)[own]
    order, same = suffix_order(data, starts, shard[own], length)
    string = np.cumsum(~same) - 1
    once = np.empty(len(own), bool)
    once[order] = (np.bincount(string, np.array(times)[own[order]]) < 2)[string]
    return np.split(once, first[1:])


def repeated(docs: DataFrame, doc_id: str, text: str, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): rows (doc, z), z the packed text; marks (doc, runs, kept): of each document the runs whose anchor occurs
    again, as first window * 256 + windows, and first windows and bits of those windows among them that stay."""
    assert 0 < gram < length and length - gram + 1 < 256
    rows = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    encoded = lambda texts: [(t or "").encode("utf-8", "surrogatepass") for t in texts]

    @per_task
    def squeeze():
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return lambda doc, texts: (doc, [c.compress(t) for t in encoded(texts)])

    # One exchange of the packed texts serves both joins below.
    packed = map_rows(rows, squeeze, f"doc {kind}, z binary", raw=["doc"])

    def anchored(texts):
        found = [v for _, v, _, _, _ in runs_of(encoded(texts), length, gram)]
        return [np.concatenate(found)] if found else None

    def told(doc, texts):
        own, v, k, at = [], [], [], []
        for o, a, starts, n, covered in runs_of(encoded(texts), length, gram):
            own.append(o)
            v.append(a)
            at.append(starts * 256 + n)
            k.append(np.frombuffer(b"".join(map(_digest, covered)), np.int64))
        return [doc.take(pa.array(np.concatenate(own))), *(np.concatenate(c) for c in (v, k, at))] if own else None

    # The texts are parsed twice, which is cheaper than to keep all runs.
    again = map_rows(rows.select("text"), anchored, "v bigint").groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    runs = written(map_rows(rows, told, f"doc {kind}, v bigint, k bigint, at bigint", raw=["doc"]).join(again, "v"), "runs")
    kinds = written(runs.groupBy("v", "k").agg(F.count("*").alias("times"), F.min(F.struct("doc", "at")).alias("f")).select("v", "k", "times", "f.doc", "f.at"), "kinds")
    shards = kinds.groupBy("v").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(shards, "v").select("v", "k", "times", "doc", "at", (F.col("kinds") > hot).alias("hot"))
    parts = wanted.groupBy("doc").agg(F.collect_list(F.struct("v", "k", "times", "at", "hot")).alias("parts"))

    @per_task
    def cut():
        import zstandard

        d = zstandard.ZstdDecompressor()

        def step(doc, z, parts):
            out = []
            for x, t, ps in zip(doc, z, parts, strict=True):
                data = d.decompress(t)
                for p in ps:
                    at, n = p["at"] >> 8, p["at"] & 255
                    where = x if p["times"] == 1 else None
                    if p["hot"]:
                        for a in range(at, at + n):
                            v, w = np.frombuffer(_digest(data[a : a + length], 16), np.int64).tolist()
                            out.append((v, w, where, a, p["times"], None))
                    else:
                        out.append((p["v"], p["k"], where, at, p["times"], data[at : at + n + length - 1]))
            return [list(c) for c in zip(*out, strict=True)] if out else None

        return step

    # Equal rows would bring a sequence twice, and a weight with it: the first is taken.
    cuts = map_rows(packed.join(parts, "doc").select("doc", "z", "parts"), cut, f"v bigint, w bigint, doc {kind}, at bigint, times bigint, seq binary")
    windows = cuts.where("seq is null").groupBy("v", "w").agg(F.sum("times").alias("n"), F.min(F.struct("doc", "at")).alias("f")).where("n = 1")
    lone = windows.select("f.doc", "f.at", F.lit(b"\x80").alias("keep"))
    mixed = cuts.where("seq is not null").repartition("v").sortWithinPartitions("v", "w").select("v", "w", "doc", "at", "times", "seq")

    def judge(slices):
        have, n, last = [], 0, None

        def result(rows):
            shard = np.cumsum([False, *(a[0] != b[0] for a, b in zip(rows[1:], rows, strict=False))])
            found = judged([r[5] for r in rows], [r[4] for r in rows], shard, length)
            out = [(r[2], r[3], np.packbits(f).tobytes()) for r, f in zip(rows, found, strict=True) if r[4] == 1 and f.any()]
            return [list(c) for c in zip(*out, strict=True)] if out else None

        for cols in slices:
            for row in zip(*cols, strict=True):
                if row[:2] == last:
                    continue
                if n >= PIECE and row[0] != last[0]:
                    if (out := result(have)) is not None:
                        yield out
                    have, n = [], 0
                have.append(row)
                n += len(row[5])
                last = row[:2]
        if have and (out := result(have)) is not None:
            yield out

    single = map_stream(mixed, judge, f"doc {kind}, at bigint, keep binary")
    every = runs.select("doc", "at", F.lit(None).cast("binary").alias("keep"))
    marks = every.unionByName(single).unionByName(lone).groupBy("doc").agg(
        F.collect_list(F.when(F.col("keep").isNull(), F.col("at"))).alias("runs"), F.collect_list(F.when(F.col("keep").isNotNull(), F.struct("at", "keep"))).alias("kept")
    )
    return packed, marks.select("doc", "runs", F.col("kept.at").alias("at"), F.col("kept.keep").alias("keep"))


def removed_bytes(n: int, runs: list[int], at: list[int], keep: list[bytes], length: int) -> np.ndarray:
    """Which of ``n`` bytes go."""
    r = np.array(runs, np.int64)
    windows = _covered(n, r >> 8, (r >> 8) + (r & 255))
    for a, k in zip(at, keep, strict=True):
        windows[a + np.flatnonzero(np.unpackbits(np.frombuffer(k, np.uint8)))] = False
    starts = np.flatnonzero(windows)
    return _covered(n, starts, starts + length)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row."""
    rows, marks = repeated(docs, doc_id, text, length, gram, hot)

    @per_task
    def rest():
        import zstandard

        d = zstandard.ZstdDecompressor()

        def step(ids, z, runs, at, keep):
            out = []
            for t, r, a, k in zip(z, runs, at, keep, strict=True):
                data = d.decompress(t)
                size, n, spans = len(data), 0, 0
                if r:
                    gone = removed_bytes(size, r, a, k, length)
                    n, spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                    data = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((size, n, spans, hashlib.sha256(data).hexdigest(), *([data] if with_text else ())))
            return [ids, *(list(c) for c in zip(*out, strict=True))]

        return step

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return map_rows(rows.join(marks, "doc", "left").select("doc.id", "z", "runs", "at", "keep"), rest, schema, raw=["id"])
