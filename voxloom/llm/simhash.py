"""SimHash near-duplicates by multi-index hashing.

A fingerprint has ``bits`` bits; bit b is 1 if it is set in over half of the hashes of the
text's word shingles (repeats included). For the search the fingerprint is cut into
segments. Each segment value is a row of that segment's table; each fingerprint
enumerates the Hamming ball of the segment's radius about its own value, fetches the
table rows that match, and verifies the complete distance. Radii follow the pigeonhole
rule of Norouzi, Punjani and Fleet (2014): with distance r and m segments, the first
r mod m + 1 need radius r div m, the others one less; then no pair within r is missed.

Equal fingerprints are one node, so exact copies never pair up. Table buckets of more
than ``BUCKET`` fingerprints are not paired row by row either:

* where two differing bits at most are allowed, each fingerprint that meets such a bucket
  enumerates its whole ball of radius 1 (``bits`` + 1 points). Two fingerprints differ in
  at most two bits just if their balls share a point, so linking each point's holders to
  their least one gives the same groups in linear work;
* for larger distances the bucket is dealt into tiles of bounded size, compared in numpy,
  of which only links that join up new groups come out.

Null or blank texts have fingerprint zero and link like any other. Rows with equal text
or id each give a row; with equal ids, the group's id is still the least. A null id takes
part and is never the least. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.texts import map_rows, per_task, words_of
from voxloom.operators.graph import connected_components
from voxloom.plans.durable import durable
from voxloom.plans.ship import ship
from voxloom.plans.tiles import tiled

SEED = 42
#: Fingerprints in a table bucket beyond which it is searched by balls or tiles.
BUCKET = 16
#: Points of a segment's ball at most.
BALL = 10_000
#: Rows by rows of a tile.
TILE = 1024
#: Shingles hashed at once, so that a long text's hashes stay small.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, bits: int = 64, lower: bool = True) -> np.ndarray:
    """The ``bits`` bits as booleans, the lowest bit of the hash first.

    The first 64 come from XXH64 under seed 42; further words of 64 bits are mixed from it.
    """
    import xxhash

    words = words_of(text, lower)
    if not words:
        return np.zeros(bits, bool)
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(bits, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        cut = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False)) if len(part) >= shingle else [b" ".join(part)]
        h = np.array([digest(s, SEED) for s in cut], np.uint64)
        total += _ones(np.stack([_mixed(h, k) for k in range(bits // 64)], 1))
    return total * 2 > n


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of 64 bits: the finalizer of a public 64-bit mixer on h plus k odd steps."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set; sums of up to 255 rows stay in bytes."""
    rows = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    whole = len(rows) // 255 * 255
    total = rows[whole:].sum(0, dtype=np.int64)
    if whole:
        total += rows[:whole].reshape(-1, 255, rows.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp array<bigint>): the fingerprint as words of 64 bits."""

    @per_task
    def make():
        def step(doc, texts):
            packed = [np.packbits(fingerprint(t, shingle, bits), bitorder="little").view(np.int64).tolist() for t in texts]
            return doc, packed

        return step

    return map_rows(docs.select(doc_id, text), make, f"doc_id {dict(docs.dtypes)[doc_id]}, fp array<bigint>")


def segments(bits: int, width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each whole segment of ``width`` bits, at most 32."""
    return [(at, width) for at in range(0, bits - width + 1, width)]


def radii(distance: int, parts: int) -> list[int]:
    """The pigeonhole rule's radius of each segment; -1 where it need not be searched."""
    whole, more = divmod(distance, parts)
    return [whole] * (more + 1) + [whole - 1] * (parts - more - 1)


def links(nodes: DataFrame, bits: int, distance: int, width: int, ball: list[int], bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges whose components are those of all pairs within ``distance`` that the balls meet.

    ``nodes``: distinct (node bigint, fp array<bigint>). ``ball``: each segment's radius, -1 for none.
    """
    own = own_keys(bits, width, ball)
    table = nodes.select("node", F.explode(own).alias("key"))
    large = durable(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"))
    asks = nodes.select(F.col("node").alias("a"), F.explode(F.concat(own, ball_keys(bits, width, ball))).alias("key"))
    small = table.join(large, "key", "left_anti").select("key", F.col("node").alias("b"))
    # One row stands for a large bucket: who meets it is compared below.
    met = asks.join(small.unionByName(large.withColumn("b", F.lit(None).cast("bigint"))), "key").where("b is null or a <> b")
    if bits == 64 and distance <= 2:  # the node is the fingerprint
        met = durable(met.where(F.col("b").isNull() | (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)))
        return met.where("b is not null").select("a", "b").union(_by_balls(met.where("b is null").select(F.col("a").alias("node")).distinct()))
    met = durable(met.select("key", "a", "b"))
    pairs = met.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    prints = lambda x: nodes.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"))
    far = sum((F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(1, bits // 64)), F.bit_count(F.col("fa")[0].bitwiseXOR(F.col("fb")[0])))
    pairs = pairs.join(prints("a"), "a").join(prints("b"), "b").where(far <= distance).select("a", "b")
    prints = nodes.select("node", "fp")
    visitors = met.where("b is null").select("key", F.col("a").alias("node")).join(prints, "node")
    members = table.join(visitors.select("key").distinct(), "key", "left_semi").join(prints, "node")
    return pairs.union(_by_tiles(members.select("key", "node", "fp"), visitors, distance))


def own_keys(bits: int, width: int, ball: list[int] | None = None):
    """The segments' values as keys of their tables."""
    return F.array(*(segment_key(s, at, n) for s, (at, n) in enumerate(segments(bits, width)) if not ball or ball[s] >= 0))


def segment_key(s: int, at: int, n: int):
    """The key of segment ``s``, its number above the value of its ``n`` bits."""
    return _key(s, _segment(at, n))


def ball_keys(bits: int, width: int, ball: list[int]):
    """The other keys within the radii. Of two values in reach of each other only the smaller one asks."""
    return F.flatten(F.array(*(_flipped(s, _segment(at, n), n, ball[s]) for s, (at, n) in enumerate(segments(bits, width)) if ball[s] >= 1), F.array().cast("array<bigint>")))


def _key(s: int, v):
    return F.lit(s << 32).cast("bigint").bitwiseOR(v)


def _flipped(s: int, v, width: int, radius: int):
    """The larger keys that differ from ``v`` in 1 to ``radius`` bits."""
    size = sum(math.comb(width, r) for r in range(1, radius + 1))
    if size > BALL:
        raise ValueError(f"a ball of radius {radius} in {width} bits has {size} points: take more segments")
    masks = F.array(*(F.lit(sum(1 << i for i in flips)).cast("bigint") for r in range(1, radius + 1) for flips in combinations(range(width), r)))
    return F.transform(F.filter(masks, lambda m: v.bitwiseXOR(m) > v), lambda m: _key(s, v.bitwiseXOR(m)))


def _segment(at: int, n: int):
    """Bits at .. at+n of the fingerprint's words as a bigint."""
    k, low = divmod(at, 64)
    v = F.shiftrightunsigned(F.col("fp")[k], low)
    if low + n > 64:
        v = v.bitwiseOR(F.shiftleft(F.col("fp")[k + 1], 64 - low))
    return v.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def _by_balls(rows: DataFrame) -> DataFrame:
    """Every holder of a point within one bit, linked to the point's least holder."""
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    points = rows.select("node", F.explode(F.transform(flips, lambda m: F.col("node").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("point", "a")
    return points.join(least, "point").where("node <> a").select("a", F.col("node").alias("b"))


def _by_tiles(members: DataFrame, visitors: DataFrame, distance: int) -> DataFrame:
    ship(members.sparkSession)
    both = members.select("key", "node", "fp", F.lit(False).alias("visits")).unionByName(visitors.select("key", "node", "fp", F.lit(True).alias("visits")))
    dealt = tiled(both, ["key"], F.col("visits"), F.col("node"), TILE)

    def compare(pdf):
        import pandas as pd

        m, v = pdf[~pdf["visits"]], pdf[pdf["visits"]]
        fm, fv = (np.array(x["fp"].tolist(), np.int64).reshape(len(x), -1).view(np.uint64) for x in (m, v))
        ids, who = m["node"].to_numpy(), v["node"].to_numpy()
        out: list[tuple[int, int]] = []
        for i in range(0, len(v), 256):
            d = sum(np.bitwise_count(fv[i : i + 256, k, None] ^ fm[None, :, k]).astype(np.int16) for k in range(fm.shape[1]))
            out += spanning(who[i : i + 256], ids, d <= distance)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.select("key", "ta", "tb", "node", "fp", "visits").groupBy("key", "ta", "tb").applyInPandas(compare, "a bigint, b bigint")


def spanning(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what ``near`` (left by right) connects, at most one for each row and column."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    hit = near.any(1)
    first = near.argmax(1)
    for i in np.flatnonzero(hit):  # each row to its first column
        a, b = find(int(left[i])), find(int(right[first[i]]))
        if a != b:
            root[a] = b
            out.append((int(left[i]), int(right[first[i]])))
    top = near.argmax(0)
    for j in np.flatnonzero(near.any(0)):  # each column to its first row
        a, b = find(int(right[j])), find(int(left[top[j]]))
        if a != b:
            root[a] = b
            out.append((int(left[top[j]]), int(right[j])))
    # What still stands apart is joined by rows whose columns lie in two groups.
    label = np.array([find(int(x)) for x in right])
    order = np.argsort(label, kind="stable")
    if len(order) and label[order[0]] != label[order[-1]]:
        starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
        touched = np.logical_or.reduceat(near[:, order], starts, axis=1)
        for i in np.flatnonzero(touched.sum(1) > 1):
            for s in np.flatnonzero(touched[i]):
                js = order[starts[s] : starts[s + 1] if s + 1 < len(starts) else None]
                j = js[near[i, js].argmax()]
                a, b = find(int(left[i])), find(int(right[j]))
                if a != b:
                    root[a] = b
                    out.append((int(left[i]), int(right[j])))
    return out


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64, distance: int = 2, width: int = 32, ball: list[int] | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable over links.

    ``ball``: the radius searched in each segment of ``width`` bits; by default the
    pigeonhole rule's, under which no pair within ``distance`` is missed.
    """
    prints = durable(fingerprints(docs, doc_id, text, shingle, bits))
    # Any number of its own will do for a node; these are small, so they pack well in shuffles.
    node = F.col("fp")[0] if bits == 64 else F.monotonically_increasing_id()
    kinds = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", node))
    ball = ball or radii(distance, len(segments(bits, width)))
    parts = connected_components(links(kinds.select("node", "fp"), bits, distance, width, ball), "a", "b")
    grouped = kinds.join(parts, "node").select("fp", "component", "least")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = grouped.join(least, "component").select("fp", "component_id")
    alone = kinds.join(parts, "node", "left_anti").select("fp", F.col("least").alias("component_id"))
    return prints.join(linked.union(alone), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    """A fingerprint's words as 16 lower-case hex digits each."""
    return F.array_join(F.transform(fp, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
