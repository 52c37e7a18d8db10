"""Removal of repeated word passages, by suffix automata of reference shards.

A window is ``window`` consecutive words of one document. A word goes if a window covers it
whose word sequence also starts earlier (smaller doc_id, or same document, earlier start);
windows are judged on the input. What remains of a text is its other words in order.

The reference for a corpus against itself is the corpus, so its automata can't be broadcast:
their size has no bound. Instead the reference is cut into shards that hold just what can
match, and each shard meets only its own passages:

1. The least hash among a window's ``GRAM``-word grams is its anchor. Equal windows have
   equal anchors; consecutive windows that share the anchor's place are a run. Only runs
   whose anchor occurs again anywhere can hold a repeated window.
2. Runs with one anchor form a shard, as word sequences. Equal sequences are merged first, by 64 bits of XXH3
   beside the anchor's 64 and with map-side combine, remembering the earliest, so copies by
   the thousand are one sequence; all windows of a later copy start earlier in the first.
3. Where a shard has several sequences, their words are fetched and stream through a suffix automaton in the order of
   their first occurrence. The automaton gives at each word the longest match with anything
   before (the matching statistic); where that reaches a window's length, the window has
   an earlier start.

An anchor with more than ``HOT`` different sequences (a frequent phrase in many contexts) would
make a large shard, so it is cut further: each different window of it (128 bits of XXH3) is a shard of its own.

Against a reference of bounded size, ``matched_spans`` broadcasts the automata themselves.

Null text has no words. Texts under ``window`` words lose nothing. Equal rows get equal
results and don't make each other go; rows that share an id but not the text are told apart
by the text's hash. Ids may be of any type that sorts; a null id sorts before all others.
Columns other than the id and the text don't pass through, so names can't clash. Texts are
hashed in blocks, so a very long one takes memory in proportion to its words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.suffix import SuffixAutomaton
from voxloom.llm.texts import blocks, map_rows, per_task, words_of
from voxloom.plans.durable import durable

WINDOW = 20
GRAM = 5
HOT = 1000
#: States at which a task's automaton is dropped, once its shard is done.
STATES = 100_000
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
#: Words of a broadcast reference shard.
SHARD_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """The hash (XXH3) of each word."""
    out = []
    for part in blocks(data, BLOCK):
        words = part.split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sequences(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash (XXH3) of each h[start:end]."""
    raw = memoryview(h.tobytes())
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((8 * starts).tolist(), (8 * ends).tolist(), strict=True)], np.uint64)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words, mixed word by word."""
    n = len(h) - size + 1
    g = h[:n]
    with np.errstate(over="ignore"):
        for k in range(1, size):
            g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return _mix(g)


def anchors(g: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the least of each ``span`` consecutive grams, the last of equals."""
    v, p, have = g, np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        right = v[step:] <= v[: len(v) - step]
        v, p, have = np.where(right, v[step:], v[: len(v) - step]), np.where(right, p[step:], p[: len(p) - step]), have + step
    return v, p


def runs_of(texts: list[str | None], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, anchor, sequence, first window, windows) of all runs, over texts at once.

    ``sequence``: a hash of the words that the run's windows cover.
    """
    said = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    h = word_hashes(b"\n".join(said))
    ends = np.cumsum([len(t.split()) for t in said])
    if len(h) < window:
        return (np.zeros(0, np.int64),) * 5
    v, p = anchors(grams(h, gram), window - gram + 1)
    at = np.arange(len(v))
    doc = np.searchsorted(ends, at, "right")
    whole = at + window <= ends[doc]
    first = whole & np.r_[True, ~whole[:-1] | (p[1:] != p[:-1])]
    starts = np.flatnonzero(first)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    count = np.bincount(np.cumsum(first)[whole] - 1)
    own = doc[starts]
    sequence = sequences(h, starts, starts + count + window - 1)
    return own, v[starts].view(np.int64), sequence.view(np.int64), starts - np.r_[0, ends][own], count


def _groups(texts: list[str | None], size: int = 4 * BLOCK):
    """(first, end) of consecutive texts of about ``size`` characters."""
    start, n = 0, 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield start, k + 1
            start, n = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): rows (doc, z), z the packed text; marks (doc, runs, at, keep): of each document the runs of
    step 1, as first window * 64 + windows, and first windows and bits of those windows that stay."""
    rows = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("doc"), F.col(text).alias("text"))
    doc_kind = rows.schema["doc"].dataType.simpleString()
    assert window - gram + 1 < 64

    @per_task
    def squeeze():
        import zstandard

        c = zstandard.ZstdCompressor(level=3)

        def step(doc, texts):
            return doc, [None if t is None else c.compress(t.encode("utf-8", "surrogatepass")) for t in texts]

        return step

    # One exchange of the packed texts serves every join below.
    packed = map_rows(rows, squeeze, f"doc {doc_kind}, z binary", raw=["doc"])

    def found(wanted: str, schema: str) -> DataFrame:
        def find(doc, texts):
            parts = [(a, runs_of(texts[a:b], window, gram)) for a, b in _groups(texts)]
            own, v, h, at, n = (np.concatenate([x[k] + (a if k == 0 else 0) for a, x in parts]) for k in range(5))
            out = {"v": v, "h": h, "at": at, "n": n}
            if "doc" in wanted:
                out["doc"] = doc.take(pa.array(own))
            return [out[c] for c in wanted.split()]

        return map_rows(rows, find, schema, raw=["doc"])

    # The texts are parsed twice, which is cheaper than to keep all runs.
    again = found("v", "v bigint").groupBy("v").agg(F.count("*").alias("times")).where("times > 1").select("v")
    runs = durable(found("v h at n doc", f"v bigint, h bigint, at int, n int, doc {doc_kind}").join(again, "v"))
    # No window comes twice within a run, so windows that start earlier lie in other sequences or in an earlier copy of this one.
    firsts = durable(runs.groupBy("v", "h").agg(F.min(F.struct("doc", "at", "n")).alias("f")).select("v", "f.doc", "f.at", "f.n"))
    kinds = firsts.groupBy("v").agg(F.count("*").alias("kinds"))
    firsts = firsts.join(kinds.where("kinds > 1"), "v", "left")
    # The only sequence of a shard all stays.
    lone = firsts.where("kinds is null").select("doc", "at", "n", (F.expr("shiftleft(1L, n)") - 1).alias("keep"))
    parts = firsts.where("kinds > 1").groupBy("doc").agg(F.collect_list(F.struct("v", "at", "n", (F.col("kinds") > hot).alias("hot"))).alias("parts"))

    @per_task
    def cut():
        whole = unpacker()

        def step(doc, z, parts):
            out = []
            for d, t, ps in zip(doc, z, parts, strict=True):
                words = whole(t).split()
                h = word_hashes(b" ".join(words)) if any(p["hot"] for p in ps) else None
                for p in {(p["v"], p["at"]): p for p in ps}.values():
                    if p["hot"]:
                        for k in range(p["at"], p["at"] + p["n"]):
                            v, w = np.frombuffer(xxhash.xxh3_128_digest(h[k : k + window].tobytes()), np.int64).tolist()
                            out.append((v, w, d, k, 1, None))
                    else:
                        out.append((p["v"], 0, d, p["at"], p["n"], b" ".join(words[p["at"] : p["at"] + p["n"] + window - 1])))
            return [list(c) for c in zip(*out, strict=True)] if out else None

        return step

    shards = map_rows(packed.join(parts, "doc").select("doc", "z", "parts"), cut, f"v bigint, w bigint, doc {doc_kind}, at int, n int, seq binary")
    windows = shards.where("seq is null").groupBy("v", "w").agg(F.min(F.struct("doc", "at")).alias("f")).select("f.doc", "f.at", F.lit(1).alias("n"), F.lit(1).cast("bigint").alias("keep"))
    # Rows equal in all would come twice; the judge drops the second.
    mixed = shards.where("seq is not null").repartition("v").sortWithinPartitions("v", "doc", "at").select("v", "doc", "at", "n", "seq")

    @per_task
    def judge():
        state = {"v": None, "last": None, "automaton": SuffixAutomaton()}

        def stream(seq: bytes) -> int:
            """Bits of the windows that don't start earlier."""
            a, mask = state["automaton"], 0
            a.begin()
            for j, w in enumerate(seq.split(b" ")):
                if a.extend(w) < window and j >= window - 1:
                    mask |= 1 << (j - window + 1)
            return mask

        def step(v, doc, at, n, seqs):
            out = []
            for row in zip(v, doc, at, n, seqs, strict=True):
                if row[:3] == state["last"]:
                    continue
                state["last"] = row[:3]
                if row[0] != state["v"]:
                    state["v"] = row[0]
                    if len(state["automaton"]) > STATES:
                        state["automaton"] = SuffixAutomaton()
                if mask := stream(row[4]):
                    out.append((*row[1:4], mask))
            return [list(c) for c in zip(*out, strict=True)] if out else None

        return step

    stays = map_rows(mixed, judge, f"doc {doc_kind}, at int, n int, keep bigint")
    every = runs.select("doc", "at", "n", F.lit(0).cast("bigint").alias("keep"))
    found_, keep = F.when(F.col("keep") == 0, F.col("at").cast("bigint") * 64 + F.col("n")), F.col("keep") != 0
    marks = every.union(lone).union(stays).union(windows).groupBy("doc").agg(
        F.collect_list(found_).alias("runs"), F.collect_list(F.when(keep, F.struct("at", "keep"))).alias("kept")
    )
    return packed, marks.select("doc", "runs", F.col("kept.at").alias("at"), F.col("kept.keep").alias("keep"))


def unpacker():
    """Packed bytes -> text in UTF-8; nothing for null."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    return lambda z: b"" if z is None else d.decompress(z)


def removed_words(n: int, runs: list[int], at: list[int], keep: list[int], window: int) -> np.ndarray:
    """Which of ``n`` words go."""
    r = np.array(runs, np.int64)
    gone = _covered(n, r >> 6, (r >> 6) + (r & 63))
    if keep:
        bits = (np.array(keep, np.int64)[:, None] >> np.arange(63)) & 1
        k, j = np.nonzero(bits)
        gone[np.array(at, np.int64)[k] + j] = False
    starts = np.flatnonzero(gone)
    return _covered(n, starts, starts + window)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row."""
    rows, marks = repeated(docs, doc_id, text, window, gram, hot)

    @per_task
    def rest():
        whole = unpacker()

        def step(ids, z, runs, at, keep):
            out = [[] for _ in range(4 if with_text else 3)]
            for t, r, a, k in zip(z, runs, at, keep, strict=True):
                words, n = whole(t).split(), 0
                left = words
                if r:
                    gone = removed_words(len(words), r, a, k, window)
                    n = int(gone.sum())
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                data = b" ".join(left)
                row = (len(words), n, hashlib.sha256(data).hexdigest(), *([data.decode("utf-8", "replace")] if with_text else ()))
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            return [ids, *out]

        return step

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    return map_rows(rows.join(marks, "doc", "left").select("doc.id", "z", "runs", "at", "keep"), rest, schema, raw=["id"])


def matched_spans(docs: DataFrame, reference: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, spans array<struct<start,end>>): maximal runs of at least ``least`` words that ``reference`` holds.

    ``reference`` (text) is of bounded size: it is cut into shards of about ``shard_words`` words,
    whose automata are built in the workers from a broadcast, one pass over the documents each.
    Words are counted from 0, ends are exclusive; spans of different shards are united.
    """
    size = reference.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-size // shard_words))
    kind = docs.schema[doc_id].dataType.simpleString()
    row = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(n):
        part = [r[0] for r in reference.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).where("text is not null").select("text").distinct().toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(part)

        @per_task
        def match(shared=shared):
            automaton = SuffixAutomaton()
            for t in shared.value:
                automaton.begin()
                for w in words_of(t):
                    automaton.extend(w)

            def step(rows, ids, texts):
                return rows, ids, [spans_of(automaton, words_of(t), least) for t in texts]

            return step

        got = map_rows(row, match, f"row bigint, doc_id {kind}, spans array<struct<start:int,end:int>>")
        out = got if out is None else out.union(got)
    if n == 1:
        return out.select("doc_id", "spans")
    joined = F.array_sort(F.flatten(F.collect_list("spans")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    merge = F.aggregate("spans", empty, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(
        F.element_at(acc, -1)["end"] >= x["start"],
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x))))
    return out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), joined.alias("spans")).select("doc_id", merge.alias("spans"))


def spans_of(automaton: SuffixAutomaton, words: list[bytes], least: int) -> list[dict[str, int]]:
    """Matching statistics of ``words``, as the maximal spans of length ``least`` or more, united where they touch."""
    out: list[dict[str, int]] = []
    for end, n in enumerate(automaton.statistics(words), 1):
        if n >= least:
            if out and end - n <= out[-1]["end"]:
                out[-1] = {"start": min(out[-1]["start"], end - n), "end": end}
            else:
                out.append({"start": end - n, "end": end})
    return out
