"""Operators 11 to 13 against brute force on small tables: nulls, empties, ties, copies, clashing columns."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import audit, bytespans, manifest
from voxloom.llm.deepshallow import suffix_order
from voxloom.llm.texts import blocks

RNG = np.random.default_rng(5)
WORDS = ["alpha", "Beta", "gamma", "été", "x$", "DELTA", "eps\nilon", "日本"]
LONG = " ".join(RNG.choice(WORDS, 400))
TEXTS = [
    None, "", " ", "\n\n", LONG, LONG, LONG + " tail", LONG[:900] + "!" + LONG[900:], "pre " + LONG[300:1400], "ab" * 300, "a" * 199, "a" * 200, "a" * 201, "one two\nthree", "é" * 150, "word " * 60,
    " ".join(f"w{i}" for i in range(70)), " ".join(RNG.choice(WORDS, 300)), "x\ny",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated ids and rows, null ids and sources, and columns with the operators' own names."""
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "en" if i % 2 else None, i if i % 4 else None) for i, t in enumerate(TEXTS)]
    rows += [(4, LONG, "s1", "en", 4), (4, LONG, "s1", "en", 4), (None, LONG, "", None, None), (None, "null id\n", "é", "fr", 1), (7, "other text of seven", "", "en", 0)]
    clash = {c: F.lit(1) for c in ("n", "digest", "part", "seg", "idx", "runs", "z", "v", "first")}
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(15)] + [(4, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(5))


# 11. Filter interaction audit


def brute_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    told = []
    for r in rows:
        t = r["text"] or ""
        w = words(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == t for o in rows),
        }
        mine = [x for x in labels if x["doc_id"] is not None and x["doc_id"] == r["doc_id"]]
        told.append((r["source"] or "", fails, any(x["quality"] == 1 for x in mine), any(x["toxic"] == 1 for x in mine)))
    out = []
    for part in {p for p, *_ in told}:
        own, shapley = [x for x in told if x[0] == part], Counter()
        found = []
        for o in permutations("ABCDE"):
            left = own
            for k, f in enumerate(o, 1):
                gone, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                failed = sum(x[1][f] for x in own)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                shapley[f] += len(gone)
                found.append((part, "".join(o), k, len(left), len(gone), failed - len(gone), alone, sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def test_audit(docs, labels):
    got = audit.filter_audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs.collect(), labels.collect())


def test_audit_of_nothing(docs, labels):
    assert audit.filter_audit(docs.limit(0), labels).count() == 0
    none = audit.filter_audit(docs, labels.limit(0))
    assert none.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_words_in_blocks():
    data = " \n".join(f"w{i}" for i in range(500)).encode() + b"x" * 90 + b" "
    for size in (1, 7, 64, 10_000):
        parts = list(blocks(data, size))
        assert b"".join(parts) == data
        assert [w for p in parts for w in p.split()] == data.split()


# 12. Merkle manifest


def brute_tree(nodes):
    """(root, proofs as lists of levels) by the plain rules."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            proofs[leaf].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        nodes = [hashlib.sha256("".join(nodes[i : i + 3]).encode()).hexdigest() for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], proofs


def brute_manifest(rows, tamper):
    def leaf(r, text):
        s = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))
        return hashlib.sha256(s.encode()).hexdigest()

    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = brute_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (*_, mine, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path, told = path + up, leaf(r, tamper(r))
            for k, others in path:
                told = hashlib.sha256("".join([*others[:k], told, *others[k:]]).encode()).hexdigest()
            proof = hashlib.sha256("".join(x for _, others in path for x in others).encode()).hexdigest()
            out.append((r["doc_id"], mine, trees[s][0], root, proof, told, told == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels, dealt", [(6, 243), (2, 3)])
def test_manifest(docs, levels, dealt, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "DEALT", dealt)
    told = lambda r: r["text"].replace("\n", "") if r["text"] is not None and r["doc_id"] is not None and r["doc_id"] % 2 else r["text"]
    received = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = manifest.manifest(docs, received)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(docs.collect(), told)


@pytest.mark.parametrize("n, sources", [(1, 1), (2, 1), (40, 1), (30, 30), (100, 2), (400, 7)])
def test_manifest_shapes(spark, n, sources, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = [(i, f"t{i}", f"s{i % sources}" if i % 3 or sources > 20 or sources == 1 else "s0", "en", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    got = manifest.manifest(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(docs.collect(), lambda r: r["text"])


def test_manifest_of_nothing(docs):
    got = manifest.manifest(docs.limit(0))
    assert got.count() == 0
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


# 13. Suffix-array dedup


def brute_bytes(rows, length):
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in rows]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        left = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, gram, hot", [(200, 64, 4000), (200, 64, 1), (60, 20, 3), (33, 8, 4000)])
def test_bytes(docs, length, gram, hot):
    got = bytespans.remove_repeats(docs, length=length, gram=gram, hot=hot)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(docs.collect(), length)


def test_bytes_in_pieces(docs, monkeypatch):
    """Texts longer than a piece, whose runs are cut at other places than those of their copies."""
    monkeypatch.setattr(bytespans, "PIECE", 150)
    for part in bytespans.pieces([b"x" * 1000, b"", b"y" * 80, b"z" * 149], 60, 150):
        assert all(len(p) >= 60 for _, _, p in part)
    covered = [at + i for part in bytespans.pieces([b"x" * 1000], 60, 150) for _, at, p in part for i in range(len(p) - 59)]
    assert covered == list(range(941))
    runs = [(v, a, n) for _, vs, at, ns, _ in bytespans.runs_of([LONG.encode()], 60, 20) for v, a, n in zip(vs.tolist(), at.tolist(), ns.tolist(), strict=True)]
    assert sum(n for *_, n in runs) == len(LONG.encode()) - 59


def test_bytes_of_nothing(docs):
    assert bytespans.remove_repeats(docs.limit(0)).count() == 0


def test_bytes_copies_of_a_row(spark):
    docs = spark.createDataFrame([(1, LONG)] * 300 + [(i, LONG[:700] + f"{i:05d}" + LONG[700:]) for i in range(2, 60)], "doc_id bigint, text string")
    for hot in (4000, 10):
        assert sorted(map(tuple, bytespans.remove_repeats(docs, hot=hot).collect()), key=str) == brute_bytes(docs.collect(), 200)


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(60):
        length = int(rng.choice([5, 8, 13, 24, 40, 100]))
        base, seqs = rng.integers(97, 97 + int(rng.choice([1, 2, 4])), 300), []
        for _ in range(int(rng.integers(1, 40))):
            s = base[: int(rng.integers(length, 301))].copy()
            s[rng.integers(len(s), size=int(rng.integers(0, 3)))] = 99
            seqs.append(s.astype(np.uint8))
        data, off = np.concatenate(seqs), np.cumsum([0] + [len(s) for s in seqs])
        starts = np.concatenate([off[i] + np.arange(len(s) - length + 1) for i, s in enumerate(seqs)])
        group = np.concatenate([np.full(len(s) - length + 1, i * 3 // len(seqs)) for i, s in enumerate(seqs)])
        order, same = suffix_order(data, starts, group, length, shallow=int(rng.integers(0, 4)), most=int(rng.choice([2, 8, 32, 1000])))
        keys = [(g, data.tobytes()[s : s + length]) for g, s in zip(group.tolist(), starts.tolist(), strict=True)]
        got = [keys[i] for i in order.tolist()]
        assert got == sorted(keys)
        assert same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]
