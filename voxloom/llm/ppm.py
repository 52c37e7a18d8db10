"""Language-model scores by prediction by partial matching (PPM, method C).

The model is a trie of byte contexts over whole texts: each byte of a text's lower-cased
words, with one blank between, and the end of the text are predicted from the ``ORDER``
symbols before, across blanks; before a text stand ends. In a context, the escape's probability
is d / (n + d) for d different symbols seen n times; a symbol's share is c / (n + d);
symbols that a longer context offered are excluded from the shorter ones. Below order 0
all ``SYMBOLS`` symbols are equally likely. The model is pretrained: its counts come from
every training text, and a text's score is the log10 probability of its symbols.

A context and its symbol, ``ORDER`` + 1 bytes, are one integer: a gram. The trie's lowest
level is the table of grams with their counts; every level above is an aggregate of the one
below, since the contexts of a level are the endings of those below it. What a gram costs
depends on the gram alone, so each different one is priced once:

* a gram of the training texts costs c / (n + d) of its whole context;
* the others walk up the levels, a join each. The symbols excluded on arrival are just those
  of the context below, so how often they were seen (``under``) is a figure of that context.

Scores are sums of prices. The most frequent grams and words are broadcast, at most
``HOT_GRAMS`` and ``HOT_WORDS``; documents meet the prices and counts of all others in one join.
Both tables grow with the input, and their bounds change no score.

Null text is empty: one end, nothing else. Repeated rows each give a row with the same
scores. Long texts are cut nowhere. With no training rows, N and V are 0, every word is
unknown and all symbols are equally likely. An empty table gives no rows. Columns other than
the id and the text don't pass through, so their names can't clash.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.texts import held, map_rows, map_stream, per_task, words_of
from voxloom.plans.durable import durable

ORDER = 5
HOT_GRAMS = 1_000_000
HOT_WORDS = 300_000
#: Grams that a task gathers before it sorts, counts and passes them on.
GATHER = 6_000_000
#: The end's token; no word is empty.
END = b""
#: The end's symbol: a blank that no sequence of words holds. It stands before texts as well.
END_SYMBOL = 10
#: All bytes but the six blanks, then the blank between words and the end.
SYMBOLS = 252
SMOOTH = 0.1


def grams(texts: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text's place) of every symbol of the texts, given as words."""
    pad = bytes([END_SYMBOL]) * order
    said = [b" ".join(words) for words in texts]
    data = np.frombuffer(pad + pad.join(said) + pad, np.uint8)
    sizes = np.fromiter(map(len, said), np.int64, len(said)) + 1
    key = np.zeros(len(data) - order, np.int64)
    for k in range(order + 1):
        key <<= 8
        key |= data[k : len(data) - order + k]
    # Of the ends between two texts the first is a symbol; the others are context only.
    first = np.cumsum(np.r_[0, sizes[:-1] + order - 1])
    own = np.repeat(np.arange(len(said)), sizes)
    at = np.arange(len(own)) + np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    return key[at], own


def counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and how often each comes."""
    x = np.concatenate(keys)
    x.sort()
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return x[starts], np.diff(np.r_[starts, len(x)])


def gram_counts(docs: DataFrame, order: int, text: str = "text", held_out: str = "held_out") -> DataFrame:
    """(gram, n) of all symbols of whole texts; held-out rows add 0."""

    def count(batches):
        held: dict[bool, list] = {False: [], True: []}
        size = 0

        def passed():
            for h, keys in held.items():
                if keys:
                    k, n = counted(keys)
                    yield [k, n * 0 if h else n]
                    keys.clear()

        for texts, flags in batches:
            for h, keys in held.items():
                some = [words_of(t, lower=True) for t, f in zip(texts, flags, strict=True) if f == h]
                if some:
                    keys.append(grams(some, order)[0])
                    size += len(keys[-1])
            if size >= GATHER:
                yield from passed()
                size = 0
        yield from passed()

    return map_stream(docs.select(text, held_out), count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text: str = "text", held_out: str = "held_out") -> DataFrame:
    """(word binary, n): lower-cased words and the ends, over whole texts; held-out rows add 0."""

    @per_task
    def count():
        def step(texts, held):
            c = Counter({END: len(texts) - sum(held)})
            for t, h in zip(texts, held, strict=True):
                words = words_of(t, lower=True)
                c.update(dict.fromkeys(words, 0) if h else words)
            return list(c.keys()), list(c.values())

        return step

    return map_rows(docs.select(text, held_out), count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _low(gram: str, symbols: int) -> Column:
    """The last ``symbols`` symbols of a gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * symbols) - 1).cast("bigint"))


def trie(seen: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(counts, contexts) by level. ``counts``: (gram, n), grams of level + 1 symbols.

    ``contexts``: (context, total, kinds, under); under: how often the context's symbols
    were seen in the context that is shorter by one.
    """
    counts = [seen]
    for k in range(order - 1, -1, -1):
        counts.insert(0, durable(counts[0].groupBy(_low("gram", k + 1).alias("gram")).agg(F.sum("n").alias("n"))))
    contexts = []
    for k, level in enumerate(counts):
        if k:
            level = level.withColumn("short", _low("gram", k)).join(counts[k - 1].select(F.col("gram").alias("short"), F.col("n").alias("m")), "short")
        else:
            level = level.withColumn("m", F.lit(0).cast("bigint"))
        contexts.append(level.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("m").alias("under")))
    return counts, contexts


def prices(table: DataFrame, order: int) -> DataFrame:
    """(gram, n, log) of ``table`` (gram, n): the log10 probability of each gram's symbol after its context."""
    counts, contexts = trie(durable(table.where("n > 0")), order)
    own = contexts[order].select("context", "total", "kinds")
    met = counts[order].withColumn("context", F.shiftright("gram", 8)).join(own, "context")
    known = met.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log"))
    zero = F.lit(0).cast("bigint")
    left = table.where("n = 0").select("gram", F.lit(0.0).alias("log"), zero.alias("gone"), zero.alias("gone_kinds"), F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        left = left.withColumn("key", _low("gram", k + 1)).withColumn("context", F.shiftright("key", 8))
        if k < order:
            left = left.join(counts[k].select(F.col("gram").alias("key"), "n"), "key", "left")
        else:
            left = left.withColumn("n", F.lit(None).cast("bigint"))
        left = left.join(contexts[k], "context", "left")
        total, kinds = F.col("total") - F.col("gone"), F.col("kinds") - F.col("gone_kinds")
        # A context that offers nothing new says nothing; a null one was never seen.
        says = ~F.col("done") & F.coalesce(kinds > 0, F.lit(False))
        step = F.when(says, F.log10(F.coalesce(F.col("n"), kinds) / (total + kinds))).otherwise(0.0)
        here = F.col("total").isNotNull()
        left = left.select(
            "gram", (F.col("log") + step).alias("log"),
            F.when(here, F.col("under")).otherwise(F.col("gone")).alias("gone"), F.when(here, F.col("kinds")).otherwise(F.col("gone_kinds")).alias("gone_kinds"),
            (F.col("done") | (says & F.col("n").isNotNull())).alias("done"),
        )
    rest = F.when(F.col("done"), 0.0).otherwise(-F.log10(F.lit(float(SYMBOLS)) - F.col("gone_kinds")))
    return known.union(left.select("gram", zero.alias("n"), (F.col("log") + rest).alias("log")))


def frequent(table: DataFrame, limit: int) -> DataFrame:
    """The rows of ``table`` of the highest counts ``n``: all down to one that leaves at most ``limit``."""
    bins = table.where("n > 0").groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.min("n").alias("least"), F.count("*").alias("rows")).orderBy(F.desc("bin")).collect()
    rows, least = 0, None
    for b in bins:
        rows += b["rows"]
        if rows > limit:
            break
        least = b["least"]
    return table.where(F.col("n") >= F.lit(least) if least is not None else F.lit(False))


def hot_words(words: DataFrame, limit: int) -> tuple[bytes, bytes]:
    """Frequent words, blank between, and their counts: compact to broadcast."""
    top = frequent(words.where("length(word) <= 64"), limit).toArrow()
    return b" ".join(top["word"].to_pylist()), np.asarray(top["n"].to_numpy(), "<i8").tobytes()


def hot_grams(priced: DataFrame, limit: int) -> tuple[bytes, bytes]:
    """Frequent grams and their prices."""
    top = frequent(priced, limit).select("gram", "log").toArrow()
    return np.asarray(top["gram"].to_numpy(), "<i8").tobytes(), np.asarray(top["log"].to_numpy(), "<f8").tobytes()


class Prices:
    """Grams' prices in an open hash table, looked up by the array."""

    EMPTY = np.int64(-1)

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.logs = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits)
        slot = self._slot(keys)
        while len(keys):
            # Of the keys that want a free slot, the last to be written has it; the rest go on.
            free = np.flatnonzero(self.keys[slot] == self.EMPTY)
            self.keys[slot[free]] = keys[free]
            set_ = self.keys[slot] == keys
            self.logs[slot[set_]] = logs[set_]
            keys, logs, slot = keys[~set_], logs[~set_], (slot[~set_] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logs, places of the keys that the table lacks, whose log is 0)."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.logs[slot], 0.0)
        lost, open_ = [np.flatnonzero(got == self.EMPTY)], np.flatnonzero((got != keys) & (got != self.EMPTY))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            hit, none = got == keys[open_], got == self.EMPTY
            out[open_[hit]] = self.logs[slot[hit]]
            lost.append(open_[none])
            open_, slot = open_[~(hit | none)], slot[~(hit | none)]
        return out, np.concatenate(lost)


def scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns from rows that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    words = durable(word_counts(rows))
    total, kinds = (int(x or 0) for x in words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first())
    priced = durable(prices(durable(gram_counts(rows, order)), order))
    hot = spark.sparkContext.broadcast((uuid.uuid4().hex, *hot_words(words, HOT_WORDS), *hot_grams(priced, HOT_GRAMS)))
    floor = math.log10(total + SMOOTH * (kinds + 1))

    @per_task
    def score():
        place, figures, price = _worker_tables(hot)
        known = place.get

        def step(key, doc, held, texts):
            out = [[] for _ in range(9)]
            cut = [words_of(t, lower=True) for t in texts]
            keys, own = grams(cut, order)
            logs, lost = price(keys)
            sums = np.bincount(own, logs, len(cut)).tolist()
            rare: list[Counter] = [Counter() for _ in cut]
            for k, n in zip(own[lost].tolist(), keys[lost].tolist(), strict=True):
                rare[k][b" " + n.to_bytes(8)] += 1
            for row, d, h, words, own_score, rest in zip(key, doc, held, cut, sums, rare, strict=True):
                words.append(END)
                at = list(map(known, words))
                found = [x for x in at if x is not None]
                if len(found) < len(words):
                    rest.update(w for w, x in zip(words, at, strict=True) if x is None)
                # The document's own figures go with its first rare token. No word has a blank,
                # so the stand-in for a document without one meets nothing.
                first = (d, h, len(words), len(found), float(figures[found].sum()), own_score)
                for w, n in rest.items() or ((b" %d" % row, 0),):
                    for c, v in zip(out, (row, w, n, *first), strict=True):
                        c.append(v)
                    first = (None,) * 6
            return out

        return step

    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", "text")
    kind = dict(rows.dtypes)["doc_id"]
    part = map_rows(keyed, score, f"key bigint, token binary, n int, doc_id {kind}, held_out boolean, n_tokens bigint, hot bigint, hot_log double, hot_score double")
    # Words and grams, the latter after a blank as eight bytes, are met in one join.
    as_bytes = F.concat(F.lit(b" "), F.unhex(F.lpad(F.hex("gram"), 16, "0")))
    table = words.select(F.col("word").alias("token"), F.col("n").alias("c"), F.lit(0.0).alias("log")).union(priced.select(as_bytes, F.lit(None).cast("bigint"), "log"))
    met = part.join(table, "token", "left")
    got = met.groupBy("key").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "hot", "hot_log", "hot_score")),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + F.lit(SMOOTH))).otherwise(0.0)).alias("rare_log"),
        F.sum(F.col("n") * F.coalesce("log", F.lit(0.0))).alias("rare_score"),
    )
    return got.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot") + F.col("rare")).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("hot_score") + F.col("rare_score")).alias("score"),
    )


def _worker_tables(hot) -> tuple[dict[bytes, int], np.ndarray, Prices]:
    """One set of tables in each worker process: hot words' places, logarithms of their counts by place, grams' prices."""
    name, words, ns, keys, logs = hot.value

    def make():
        table = words.split(b" ") if ns else []  # the end's token is empty
        return {w: k for k, w in enumerate(table)}, np.log10(np.frombuffer(ns, "<i8") + SMOOTH), Prices(np.frombuffer(keys, "<i8"), np.frombuffer(logs, "<f8"))

    return held(("prices", name), make)
