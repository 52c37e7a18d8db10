"""Merkle manifest of a table, and a proof for each row by pointer jumping.

Leaves ascend by id within a source. While several nodes remain, every ``RUN`` consecutive ones become their hash; the last run
may be shorter, even one. What remains is the source's subroot; subroots, ordered by source, make a tree of the same kind, whose root stands for the table.

How it is built:

1. Leaves are ranked by a range partition and a sort; a row's place is its place in the partition and the
   counts before. Nothing is sorted in one task, and a source that holds most rows is many ranges.
2. ``LEVELS`` levels are made at once: a task gets chunks of RUN**LEVELS consecutive nodes, so the rounds are as many as the logarithm of the largest source.
3. Proofs: a node holds a segment, its siblings towards an ancestor, and that ancestor. A self-join
   doubles the distance and concatenates the segments, until every node has reached the root (14 levels take 4 joins).
   An ancestor far away has very many nodes below it; their rows meet copies of its row, one for ``DEALT`` of them, so it is no hot key.
4. A leaf takes its siblings and the rest of its path from its parent, in one join.

A hash is SHA-256 in lower-case hex over its inputs, digests as hex text. A leaf's inputs: doc_id, source, lang,
n_chars and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.

A null source comes first, as does a null id within a source. Rows with one id are ordered by their leaves; equal rows have equal leaves and places next to each
other. Texts are hashed one at a time, so a very long one takes memory for itself alone. Columns other than the five don't count. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.texts import map_rows, written

RUN = 3
#: Levels that one task makes of a chunk of RUN ** LEVELS nodes.
LEVELS = 6
#: Nodes that meet one copy of a common ancestor.
DEALT = 243
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def combine(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def leaf_of(values: list) -> bytes:
    h = hashlib.sha256()
    for v in values:
        if v is None:
            h.update(b"-")
        else:
            data = str(v).encode("utf-8", "surrogatepass")
            h.update(b"%d:" % len(data))
            h.update(data)
    return h.digest()


def siblings(run: list[bytes], k: int) -> bytes:
    """A segment of one level: place and size of the run in a byte, then the others of the run."""
    return bytes([k * RUN + len(run) - 1]) + b"".join(run[:k] + run[k + 1 :])


def levels_of(path: bytes) -> list[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of concatenated segments."""
    out, at = [], 0
    while at < len(path):
        k, n = divmod(path[at], RUN)
        out.append((k, [path[at + 1 + j * DIGEST : at + 1 + (j + 1) * DIGEST] for j in range(n)]))
        at += 1 + n * DIGEST
    return out


def fold(digest: bytes, levels: list[tuple[int, list[bytes]]]) -> list[bytes]:
    """The digests from ``digest`` up, one for each level."""
    out = [digest]
    for k, others in levels:
        out.append(combine([*others[:k], out[-1], *others[k:]]))
    return out


def leaves(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """(doc_id, source, digest, told): the leaf of each row, and the leaf of the row as received, where its text is ``received``."""
    text = F.col("text")
    other = text if received is None else received
    changed = ~text.eqNullSafe(other)
    rows = docs.select(*FIELDS, changed.alias("changed"), F.when(changed, other).alias("received"))

    def step(ids, source, lang, n, texts, changed, received):
        mine = [leaf_of(list(v)) for v in zip(ids, source, lang, n, texts, strict=True)]
        told = [leaf_of([i, s, g, k, r]) if c else d for i, s, g, k, c, r, d in zip(ids, source, lang, n, changed, received, mine, strict=True)]
        return ids, source, mine, told

    return map_rows(rows, step, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, digest binary, told binary")


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``mid``, counts): rows sorted in ranges and written; counts: of each range and group, ``less`` and ``n``.

    The place of a row in its group is mid - less; ``n`` is the group's size. Rows are told apart where all of ``order`` is equal,
    so equal ones may be dealt to several ranges.
    """
    keys = [*by, *order, "tie"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = written(placed.withColumn("mid", F.monotonically_increasing_id()), name)
    counts = placed.groupBy(F.shiftright("mid", 33).alias("range"), *by).agg(F.count("*").alias("here"), F.min("mid").alias("first"))
    group = Window.partitionBy(*by)  # a row for each range that the group lies in
    before = F.coalesce(F.sum("here").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, counts.select("range", *by, (F.col("first") - before).alias("less"), F.sum("here").over(group).alias("n"))


def tree(nodes: DataFrame, most: int, with_leaves: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """(links, tops) of the trees over ``nodes`` (s, idx, n, digest): s the tree, n its leaves, the largest of them ``most``.

    links: (s, level, idx, seg, kids) for each node but the tops: its segment to its parent, and its children's digests if it stands right above leaves.
    tops: (s, level, digest, kids). Links of leaves only ``with_leaves``.
    """
    links, tops, level = [], [], 0
    chunk = RUN**LEVELS
    nodes = nodes.select("s", "idx", F.col("n").alias("m"), "digest", F.lit(None).cast("binary").alias("kids"))
    while True:
        tops.append(nodes.where("m = 1").select("s", F.lit(level).alias("level"), "digest", "kids"))
        if most == 1:
            break
        chunks = nodes.where("m > 1").groupBy("s", "m", F.floor(F.col("idx") / chunk).alias("chunk")).agg(F.collect_list(F.struct("idx", "digest")).alias("members"))

        def step(ss, ms, cs, members, level=level):
            out = []
            for s, m, c, found in zip(ss, ms, cs, members, strict=True):
                have = [x["digest"] for x in sorted(found, key=lambda x: x["idx"])]
                below, base, m_ = [None] * len(have), c * chunk, m
                for at in range(level, level + LEVELS):
                    if m_ == 1:
                        break
                    runs = [have[j : j + RUN] for j in range(0, len(have), RUN)]
                    if at or with_leaves:
                        out += [(s, at, base + j, None, None, siblings(runs[j // RUN], j % RUN), below[j]) for j in range(len(have))]
                    have, below = [combine(r) for r in runs], [b"".join(r) if at == 0 else None for r in runs]
                    base, m_ = base // RUN, -(-m_ // RUN)
                else:
                    at = level + LEVELS
                out.append((s, at, base, m_, have[0], None, below[0]))
            return [list(c) for c in zip(*out, strict=True)]

        made = written(map_rows(chunks, step, "s bigint, level int, idx bigint, m bigint, digest binary, seg binary, kids binary"), name)
        links.append(made.where("digest is null").select("s", "level", "idx", "seg", "kids"))
        nodes = made.where("digest is not null")
        tops.append(nodes.where((F.col("m") == 1) & (F.col("level") < level + LEVELS)).select("s", "level", "digest", "kids"))
        nodes = nodes.where(F.col("level") == level + LEVELS).select("s", "idx", "m", "digest", "kids")
        level, most = level + LEVELS, -(-most // chunk)
    union = lambda parts: parts[0] if len(parts) == 1 else union([*parts[:-2], parts[-2].unionByName(parts[-1])])
    none = tops[0].limit(0).select("s", "level", F.lit(0).cast("bigint").alias("idx"), F.col("digest").alias("seg"), "kids")
    return union(links or [none]), union(tops)


def jump(table: DataFrame, name: str) -> DataFrame:
    """(node, seg, kids) with every segment grown up to the root; ``table``: (node, anc, seg, kids), anc null where the parent is the root."""
    while True:
        table = written(table, name)
        live = table.where("anc is not null").withColumn("share", F.struct(*(F.floor(F.col(f"node.{c}") / DEALT).alias(c) for c in ("s", "idx"))))
        if live.isEmpty():
            return table.drop("anc")
        asked = live.select(F.col("anc").alias("node"), "share").distinct()
        targets = asked.join(table.select("node", F.col("anc").alias("further"), F.col("seg").alias("more")), "node").withColumnRenamed("node", "anc")
        grown = live.join(targets, ["anc", "share"]).select("node", F.col("further").alias("anc"), F.concat("seg", "more").alias("seg"), "kids")
        table = table.where("anc is null").unionByName(grown)


def manifest(docs: DataFrame, received: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    ``received``: the text as it arrived. The last two columns fold the leaf of the row with that text along
    the original siblings, and tell whether the root comes out.
    """
    made = written(leaves(docs, received), "leaves")
    placed, counts = ranked(made, ["source"], ["doc_id", "digest"], "ranked")
    counts = written(counts, "counts")
    sources = counts.select("source", "n").distinct()
    in_order, order = ranked(sources, [], ["source"], "sources")
    numbered = in_order.join(order, F.shiftright("mid", 33) == F.col("range")).select(F.col("source").alias("named"), (F.col("mid") - F.col("less")).alias("s"))
    n_sources, most = sources.agg(F.count("*"), F.max("n")).first()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not n_sources:
        return docs.sparkSession.createDataFrame([], schema)
    base = counts.join(numbered, F.col("source").eqNullSafe(F.col("named"))).select("range", F.col("source").alias("named"), "less", "n", "s")
    here = (F.shiftright("mid", 33) == F.col("range")) & F.col("source").eqNullSafe(F.col("named"))
    rows = written(placed.join(base, here).select("doc_id", "digest", "told", "s", "n", (F.col("mid") - F.col("less")).alias("idx")), "placed")

    links, tops = tree(rows, most, False, "tree")
    tops = written(tops, "subroots")
    upper, peak = tree(tops.select(F.lit(-1).cast("bigint").alias("s"), F.col("s").alias("idx"), F.lit(n_sources).cast("bigint").alias("n"), "digest"), n_sources, True, "top")
    top = peak.select("level", "digest", "kids").first()
    root = top["digest"]

    point = lambda s, level, idx: F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(level).cast("int").alias("level"), F.lit(idx).cast("bigint").alias("idx"))
    up = F.floor(F.col("idx") / RUN)
    inner = links.select(point(F.col("s"), F.col("level"), F.col("idx")).alias("node"), point(F.col("s"), F.col("level") + 1, up).alias("anc"), "seg", "kids")
    # A subroot is the top of its tree and a leaf of the upper one.
    hung = upper.where("level = 0").select(F.col("idx").alias("s"), "seg").join(tops.select("s", "level", "kids"), "s")
    hung = hung.select(point(F.col("s"), F.col("level"), 0).alias("node"), point(-1, 1, F.floor(F.col("s") / RUN)).alias("anc"), "seg", "kids")
    above = upper.where("level > 0").select(point(-1, F.col("level"), F.col("idx")).alias("node"), point(-1, F.col("level") + 1, up).alias("anc"), "seg", "kids")
    # The root has nothing above it; it is there for the leaves right below.
    if n_sources == 1:
        head = tops.select(point(F.col("s"), F.col("level"), 0).alias("node"), F.lit(b"").alias("seg"), "kids")
        height = tops.first()["level"]
        summit = point(0, height, 0)
    else:
        head = peak.select(point(-1, F.col("level"), 0).alias("node"), F.lit(b"").alias("seg"), "kids")
        summit = point(-1, top["level"], 0)
    table = inner.unionByName(hung).unionByName(above)
    table = table.withColumn("anc", F.when(F.col("anc") != summit, F.col("anc")))
    table = table.unionByName(head.withColumn("anc", F.lit(None).cast(table.schema["anc"].dataType)))
    paths = jump(table, "paths").where("kids is not null")

    lone = F.col("n") == 1
    parent = F.when(lone, point(-1, 1, F.floor(F.col("s") / RUN))).otherwise(point(F.col("s"), 1, up))
    asking = rows.select("doc_id", "digest", "told", "n", F.pmod(F.when(lone, F.col("s")).otherwise(F.col("idx")), F.lit(RUN)).cast("int").alias("k"), parent.alias("node"))

    def prove(ids, digest, told, n, k, seg, kids):
        out = []
        for i, d, t, n_, k_, s, c in zip(ids, digest, told, n, k, seg, kids, strict=True):
            run = [c[j : j + DIGEST] for j in range(0, len(c), DIGEST)] if c else [d]
            steps = levels_of(siblings(run, k_) + s) if c else []
            up = fold(d, steps)
            height = 0
            while RUN**height < n_:
                height += 1
            proof = hashlib.sha256("".join(x.hex() for _, others in steps for x in others).encode()).hexdigest()
            folded = up[-1] if t == d else fold(t, steps)[-1]
            out.append((i, d.hex(), up[height].hex(), root.hex(), proof, folded.hex(), folded == root))
        return [list(c) for c in zip(*out, strict=True)] if out else None

    return map_rows(asking.join(paths, "node", "left").select("doc_id", "digest", "told", "n", "k", "seg", "kids"), prove, schema)
