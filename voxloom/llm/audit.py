"""What each filter of a chain removes, in every order of the filters.

Each row fails or passes each of k filters, so the rows of a part make a contingency tensor of
2 x 2 x ... x 2 counts (pass, fail on each axis). Every figure of every step of every order is
a contraction of that tensor: along an axis, one selects pass (the filter came before and let the row through), fail,
or all (the filter hasn't been applied). One ``einsum`` does this for all parts, orders and steps of a batch.

The tensors are small whatever the table's size: rows are counted by part and cell in one
aggregate with map-side combine, so a part that holds most rows is no hot key.

``filter_audit`` applies five text filters. A failure is: A, under 50 words; B, under 65 distinct words
in 100; C, over 5 capital letters A-Z in 100 code points; D, any of ``#$%&*|``; E, a text identical
to that of a smaller doc_id anywhere in the table, whether removed or not. Words are maximal runs of anything but
ASCII blanks and case counts. Texts are held identical by SHA-256.

Null text is the empty one; a null source is the part of the empty string. A row without an id has no smaller id and is none,
so it neither fails E nor makes others fail. Equal rows count each; rows that share id and text don't make each other fail.
Labels of one id are united (1 if any of its rows says 1), other values and nulls count as 0. Long texts are split into words in blocks, so they take memory for their
distinct words. Columns other than those named don't matter. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.texts import blocks, map_rows
from voxloom.plans.durable import durable

FILTERS = "ABCDE"
MEASURES = ("rows", "good", "toxic")
#: Bytes that are split into words at once.
BLOCK = 1 << 20

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = re.compile(rb"[#$%&*|]")


def failures(text: str | None) -> tuple[int, bytes]:
    """(bits of the failed filters A to D, A the lowest; SHA-256 of the text)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n, seen = 0, set()
    for b in blocks(data, BLOCK):
        words = b.split()
        n += len(words)
        seen.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    fails = (n < 50) | (100 * len(seen) < 65 * n) << 1 | (100 * capitals > 5 * len(text)) << 2 | (_SIGNS.search(data) is not None) << 3
    return fails, hashlib.sha256(data).digest()


def contractions(tensors: np.ndarray, names: str = FILTERS) -> dict[str, np.ndarray]:
    """Figures of (parts, orders, steps) from ``tensors``: (parts, measures, 2, ..., 2), an axis for each filter.

    ``orders`` are all orders of the filters, as in ``permutations(range(k))``.
    """
    k = len(names)
    orders = np.array(list(permutations(range(k))))
    place = np.argsort(orders, axis=1)  # where in its order a filter comes
    step = np.arange(k)[None, :, None]
    before, here = place[:, None, :] < step, place[:, None, :] == step
    passing, failing, every = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])

    def select(chosen: np.ndarray, **by) -> np.ndarray:
        """The contraction that takes, along each axis, what ``chosen`` (orders, steps, filters) numbers."""
        picks = np.stack([every, passing, failing])[chosen]
        axes = "abcdefgh"[:k]
        return np.einsum(f"pm{axes},{','.join('xy' + a for a in axes)}->pmxy", tensors, *(picks[:, :, j] for j in range(k)), optimize="greedy")

    kept = select(np.where(before | here, 1, 0))[:, 0]
    removed = select(np.where(here, 2, np.where(before, 1, 0)))
    failed = select(np.where(here, 2, 0))[:, 0]
    alone = select(np.where(here, 2, 1))[:, 0]
    gone = removed[:, 0]
    by_filter = np.stack([np.where(orders == f, gone, 0).sum(axis=(1, 2)) for f in range(k)], axis=1)
    return {
        "kept": kept, "removed": gone, "redundant": failed - gone, "unique_fails": alone, "good_lost": removed[:, 1], "toxic_lost": removed[:, 2],
        "shapley": by_filter[:, orders],
    }


def interactions(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order and step; ``cells``: (part, cell, rows, good, toxic), cell the bits of the failed filters."""
    orders = list(permutations(range(len(names))))
    letters = ["".join(names[f] for f in o) for o in orders]
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def step(parts, found):
        tensors = np.zeros((len(parts), len(MEASURES), 1 << len(names)), np.int64)
        for t, cs in zip(tensors, found, strict=True):
            for c in cs:
                t[:, c["cell"]] = [c[m] for m in MEASURES]
        # The last axis of a reshaped cell number is its lowest bit, which is the first filter's.
        shaped = tensors.reshape(len(parts), len(MEASURES), *[2] * len(names)).transpose(0, 1, *range(len(names) + 1, 1, -1))
        out, each = contractions(shaped, names), len(orders) * len(names)
        which = np.repeat(np.arange(len(parts)), each)
        return [
            pa.array(parts, pa.string()).take(pa.array(which)), pa.array(letters).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), len(names)), len(parts)))),
            np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(parts) * len(orders)), *(out[f].reshape(-1) for f in figures),
        ]

    tensors = cells.groupBy("part").agg(F.collect_list(F.struct("cell", *MEASURES)).alias("cells"))  # 2 ** k cells at most
    return map_rows(tensors, step, "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in figures))


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("part"), F.col(text).alias("text"))

    def step(ids, parts, texts):
        found = [failures(t) for t in texts]
        return ids, parts, [f for f, _ in found], [d for _, d in found]

    kind = rows.schema["id"].dataType.simpleString()
    told = map_rows(rows, step, f"id {kind}, part string, fails int, digest binary", raw=["id", "part"])
    # Equal rows become one before any join.
    facts = durable(told.groupBy("id", "part", "fails", "digest").agg(F.count("*").alias("n")))
    firsts = facts.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    # Both joins are by id, so a text that a third of all rows share isn't a hot key.
    marked = facts.join(said, "id", "left").join(firsts, ["id", "digest"], "left")
    copied = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")
    cells = marked.groupBy("part", (F.col("fails") + F.lit(16) * copied).alias("cell")).agg(
        F.sum("n").alias("rows"), *(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic"))
    )
    return interactions(cells)
