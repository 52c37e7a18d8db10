"""The ten operators against brute force on small tables: nulls, empties, ties, copies, clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxloom.llm import decontaminate, embeddings, language, neardup, packing, ppm, secrets, simhash, substrings, texts, tokens, warc
from voxloom.llm.suffix import SuffixAutomaton

RNG = np.random.default_rng(11)
VOCAB = ["alpha", "Beta", "gamma,", "delta", "été", "naïve", "ſ", "K", "x1", "42", "don't", "日本", "<|endoftext|>", "a_b"]


def text_of(n, rng=RNG):
    return " ".join(rng.choice(VOCAB, n))


BASE = text_of(60)
TEXTS = [
    None, "", "   ", "\t\n\x0b", BASE, BASE, BASE + " tail", "pre " + BASE, text_of(200), "one", "two words", "A b c d", "a  b\n\n c \n", "'s it's 'RE we're", "é é", "x" * 5000, text_of(3000),
    "word " * 100, "\x1c\x1d a", "﻿bom", "tab\there",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with repeated ids and rows, a null id, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(4, BASE, "en", "s1"), (None, "null id " + BASE, "fr", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({"fp": F.lit(1), "n_tokens": F.lit(-1), "score": F.lit("x"), "key": F.lit(0), "length": F.lit(9)}).coalesce(2)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


# 1. SimHash


def brute_print(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(s))


def groups_of(prints, ids, r):
    lab = list(range(len(prints)))
    near = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= r] for i in range(len(prints))]
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(lab[j] for j in js)
            changed |= m < lab[i]
            lab[i] = m
    out = {}
    for i, g in enumerate(lab):
        out.setdefault(g, []).append(ids[i])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in out.items()}
    return [least[g] for g in lab]


def test_simhash(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(r["text"]) for r in rows]
    want = Counter(zip([r["doc_id"] for r in rows], [f"{p:016x}" for p in prints], groups_of(prints, [r["doc_id"] for r in rows], 2), strict=True))
    got = simhash.simhash_groups(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("bucket", [0, 2, 16])
def test_links_lose_none(spark, bucket):
    """Clusters of fingerprints, by buckets of any size: groups equal brute force."""
    seeds = [int(x) for x in RNG.integers(0, 1 << 62, 6)]
    fps = {s ^ sum(1 << int(b) for b in RNG.choice(64, int(RNG.integers(0, 4)), replace=False)) for s in seeds for _ in range(40)}
    fps = sorted(x - (1 << 64) if x >= 1 << 63 else x for x in fps)
    nodes = spark.createDataFrame([(f, [f]) for f in fps], "node bigint, fp array<bigint>")
    edges = simhash.links(nodes, 64, 2, 32, simhash.radii(2, 2), bucket).collect()
    lab = {f: f for f in fps}

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        lab[find(a)] = find(b)
    want = groups_of([f & (1 << 64) - 1 for f in fps], fps, 2)
    assert len({find(f) for f in fps}) == len(set(want))


def parts_of(nodes, edges):
    lab = {n: n for n in nodes}

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a, b in edges:
        lab[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("bits", "width", "distance", "bucket"), [(64, 32, 4, 16), (64, 16, 6, 0), (128, 32, 3, 16), (128, 16, 9, 1)])
def test_links_search_the_whole_radii(spark, bits, width, distance, bucket):
    """Pairs planted at every distance up to the limit, flips spread evenly over the segments, are all linked."""
    segs = simhash.segments(bits, width)
    fps = {}
    for k in range(120):
        x = int(RNG.integers(0, 1 << 62)) | int(RNG.integers(0, 1 << 62)) << 62
        flips = [segs[i % len(segs)][0] + int(j) for i, j in enumerate(RNG.choice(width, 1 + k % distance, replace=False))]
        for n, v in ((2 * k, x), (2 * k + 1, x ^ sum(1 << f for f in flips))):
            fps[n] = np.array([v >> 64 * i & (1 << 64) - 1 for i in range(bits // 64)], np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(fps.items()), "node bigint, fp array<bigint>")
    got = parts_of(fps, map(tuple, simhash.links(nodes, bits, distance, width, simhash.radii(distance, len(segs)), bucket).collect()))
    assert all(got[2 * k] == got[2 * k + 1] for k in range(120))
    assert len(set(got.values())) == 120


def test_balls_too_large_are_refused(spark):
    with pytest.raises(ValueError, match="more segments"):
        simhash.links(spark.createDataFrame([(1, [1])], "node bigint, fp array<bigint>"), 64, 12, 32, simhash.radii(12, 2))


def test_spanning_keeps_connections():
    def parts(edges):
        p = {n: n for n in range(20)}

        def f(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in edges:
            p[max(f(a), f(b))] = min(f(a), f(b))
        return [f(x) for x in range(20)]

    for _ in range(300):
        n, m = RNG.integers(1, 12, 2)
        left, right = RNG.permutation(20)[:n], RNG.permutation(20)[:m]
        near = RNG.random((n, m)) < RNG.choice([0.05, 0.2, 0.5])
        assert parts((int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(near), strict=True)) == parts(simhash.spanning(left, right, near))


def shingles_of(t, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(words, n, rng):
    """``n`` words replaced, spread evenly."""
    out = list(words)
    for k in range(n):
        out[(2 * k + 1) * len(out) // (2 * n)] = f"new{int(rng.integers(1 << 30))}"
    return out


def test_near_copies_leave_one(docs):
    clash = docs.withColumns({"KEY": F.lit(1), "key_": F.lit(2), "least": F.lit(3)})
    kept = neardup.drop_near_copies(clash)
    assert kept.columns == clash.columns
    same = [r for r in kept.collect() if BASE in (r["text"] or "")]
    assert len(same) == 1
    assert same[0]["doc_id"] is None  # a null id sorts first
    assert kept.where("doc_id = 8").count() == 1
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [0, 16])
def test_near_groups_against_brute_force(spark, bucket):
    """No link below 0.8; over 0.9 of the pairs from 0.8 up are found, band by band."""
    rng = np.random.default_rng(7)
    texts_ = []
    for n in (60, 300):
        for k in range(150):
            words = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts_ += [" ".join(words), " ".join(edited(words, 1 + k % (3 if n == 60 else 12), rng))]
    hot = [f"h{x}" for x in rng.integers(0, 5000, 200)]
    texts_ += [" ".join(edited(hot, 1 + k % 4, rng)) for k in range(60)] + [" ".join(hot)] * 5 + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts_)), "id bigint, text string")
    got = {r["id"]: r["least"] for r in neardup.near_groups(df, "id", bucket=bucket).collect()}
    sets = [shingles_of(t) for t in texts_]
    links = [(i, j, q) for i in range(len(sets)) for j in range(i) if (q := jaccard(sets[i], sets[j])) >= 0.8]
    exact = parts_of(range(len(sets)), [x[:2] for x in links])
    for i in got:
        assert exact[i] == exact[got[i]]  # groups are within those of brute force
    for lo in (0.8, 0.85, 0.9, 0.95):
        band = [got[i] == got[j] for i, j, q in links if lo <= q < lo + 0.05 and i < 600]
        assert not band or sum(band) >= 0.9 * len(band)
    assert len({got[i] for i in range(600, 665)}) == 1
    assert len({got[i] for i in range(665, 668)}) == 1


def test_tile_links():
    sets = [np.sort(RNG.choice(1000, 40, replace=False)).astype(np.int32) for _ in range(30)]
    sets += [np.sort(np.r_[s[:-2], [2000, 2001]]).astype(np.int32) for s in sets[:10]]
    ids, groups, fp = np.arange(40), np.arange(40), np.zeros((40, 8), np.uint64)
    out = neardup.tile_links([ids, groups, fp, sets], [ids, groups, fp, sets], 96, 0.8)
    want = {(i, j) for i in range(40) for j in range(40) if i != j and jaccard(set(sets[i]), set(sets[j])) >= 0.8}
    assert set(out) == want
    assert len(want) == 20


# 2. Token counts


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(t.encode(r["text"] or "", add_special_tokens=False).ids), n > 100) for r in rows)
    got = tokens.token_counts(docs, path, limit=100)
    assert set(docs.columns) <= set(got.columns)
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def test_token_counts_of_any_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, misses = Tokenizer.from_file(path), tokens.Misses(path, 50)
    table = tokens.Lengths(misses, {p: misses.make(p) for p in ("a", " the")})
    chars = list(" \n\t'sdreabcéñ日1٣²_.,<|>endoftxt ́\xa0Å")
    for _ in range(1500):
        s = "".join(RNG.choice(chars, int(RNG.integers(0, 25))))
        assert table.of(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


# 3. Embeddings


def test_embedding_links(spark):
    centres = RNG.normal(size=(5, 6))
    rows = [(i, [float(x) for x in centres[i % 5] + RNG.normal(size=6) * 0.12], i % 2) for i in range(150)]
    rows += [(150 + i, rows[i][1], rows[i][2]) for i in range(10)] + [(3, rows[3][1], rows[3][2])]
    odd = [(900, None, 0), (901, [0.0] * 6, 0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (903, [float("nan")] * 6, 1), (904, [float("inf")] + [0.0] * 5, 1), (905, rows[0][1], None), (906, [], 0), (907, [1.0, 2.0], 0), (908, [2.0, 4.0], 0), (909, [1e300, 2e300], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    ok = rows + odd[-3:]
    x = [np.array(r[1]) / np.max(np.abs(r[1])) for r in ok]
    near = [[j for j in range(len(ok)) if j != i and ok[i][2] == ok[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98] for i in range(len(ok))]
    lab = [r[0] for r in ok]
    while True:
        new = [min([lab[i], *(lab[j] for j in near[i])]) for i in range(len(ok))]
        if new == lab:
            break
        lab = new
    want = Counter((r[0], len(near[i]), lab[i], r[0] == lab[i]) for i, r in enumerate(ok)) + Counter((r[0], 0, r[0], True) for r in odd[:-3])
    for rows_a_cell in (1, 16):
        got = embeddings.embedding_links(df, cell_rows=rows_a_cell, recall=1)
        assert Counter(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want
    assert embeddings.embedding_links(df.limit(0)).count() == 0
    assert embeddings.embedding_links(df.where("vec_id in (900, 901)")).count() == 2


@pytest.mark.parametrize("held", [1, 40, 5000])
def test_codebooks_by_blocks(monkeypatch, held):
    """However few distances are held at once, the codebook is the same; and no more are held."""
    x, most = np.random.default_rng(6).integers(0, 40, (300, 4)).astype(float), []
    whole = embeddings.centroids(x, 12)
    squares = embeddings._squares
    monkeypatch.setattr(embeddings, "HELD", held)
    monkeypatch.setattr(embeddings, "_squares", lambda a, c: most.append(len(a) * len(c)) or squares(a, c))
    assert np.allclose(embeddings.centroids(x, 12), whole)
    assert max(most) <= max(held, 12)


def test_embedding_recall(spark, sf_dir):
    """Copies with noise at the threshold, in 64 dimensions: recall at the default target."""
    base = RNG.normal(size=(400, 64))
    noise = RNG.normal(size=(400, 64))
    far = base + noise / np.linalg.norm(noise, axis=1)[:, None] * np.linalg.norm(base, axis=1)[:, None] * 0.19
    df = spark.createDataFrame([(i, [float(v) for v in x], 0) for i, x in enumerate(np.r_[base, far])], "vec_id bigint, embedding array<float>, label int")
    x = np.r_[base, far]
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = int((x @ x.T >= 0.98).sum() - len(x))
    got = embeddings.embedding_links(df, cell_rows=4).agg(F.sum("n_links")).first()[0]
    assert want > 500
    assert got >= 0.98 * want


def test_traverse_is_sorted_and_whole():
    a, b = RNG.random(7), RNG.random(9)
    got = embeddings.traverse(a, b, 0.8)
    d = [a[i] ** 2 + b[j] ** 2 for i, j in got]
    assert d == sorted(d)
    assert set(got) == {(i, j) for i in range(7) for j in range(9) if a[i] ** 2 + b[j] ** 2 <= 0.8}


# 4. Packing


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(docs, path, capacity=256, with_ids=True).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256
    assert packing.pack(none, path).count() == 0


def test_plan_uses_everything_once():
    for _ in range(50):
        counts = {int(n): int(c) for n, c in zip(RNG.integers(1, 65, 20), RNG.integers(1, 30, 20), strict=True)}
        used = Counter()
        total = 0
        for lengths, times in packing.plan(counts, 64):
            assert sum(lengths) <= 64
            assert times > 0
            total += times
            for n in lengths:
                used[n] += times
        assert used == Counter(counts)
        # Pieces over half the capacity need a sequence each, whatever the sum is.
        least = max(math.ceil(sum(n * c for n, c in counts.items()) / 64), sum(c for n, c in counts.items() if n > 32))
        assert least <= total <= bins_of(counts, 64, lambda fit, rooms: min(fit, key=lambda i: (rooms[i], i)))
    assert packing.plan({30: 4, 34: 4, 20: 3, 24: 3}, 64)[0] == ((34, 30), 4)
    assert packing.plan({}, 64) == []


def bins_of(counts, capacity, pick):
    """Piece by piece, longest first, into the sequence that ``pick`` takes of those with room."""
    rooms = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [i for i, r in enumerate(rooms) if r >= n]
            if fit:
                rooms[pick(fit, rooms)] -= n
            else:
                rooms.append(capacity - n)
    return len(rooms)


def test_best_fit_is_that_of_one_piece_after_another():
    better = 0
    for k in range(300):
        top = (65, 40, 90)[k % 3]
        counts = dict(Counter(int(n) for n in RNG.integers(1, top, int(RNG.integers(1, 120)))))
        best = bins_of(counts, 100, lambda fit, rooms: min(fit, key=lambda i: (rooms[i], i)))
        first = bins_of(counts, 100, lambda fit, rooms: fit[0])
        found = packing.best_fit(counts, 100)
        used = Counter()
        for lengths, times in found:
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] += times
        assert used == Counter(counts)
        assert sum(t for _, t in found) == best
        plan = sum(t for _, t in packing.plan(counts, 100))
        assert plan <= best
        better += plan < min(best, first)
    assert better  # exact fills save sequences


def test_gaps_are_filled_by_triples():
    assert packing.plan({50: 1, 25: 1, 15: 1, 10: 1}, 100) == [((50, 25, 15, 10), 1)]


# 5. Secrets


def github(body):
    return f"ghp_{body}{secrets.checksum(body)}"


def test_secrets(spark, docs):
    good = github("A" * 30)
    cases = [
        'password = "abcdefgh1"', "PASSWD:short", "token=token=abcdefgh", "apikey: x api_key='abcd1234'", "AKIA123456789012", "AKIA1 AKIAABCDEFGHIJKLM", "f" * 31 + " " + "0" * 40, f"x {good} y", good[:-1] + "!", good[:-1] + ("0" if good[-1] != "0" else "1"),
        "İ secret=ABCDEFGHI", "ſecret=abcdefghij toKen=abcdefghij", "secret:secret:abcdefgh", None, "", "é" * 10 + " token: 12345678",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "doc_id bigint, text string")
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = {r["doc_id"]: r for r in secrets.digest(secrets.secret_spans(df)).collect()}
    for i, c in enumerate(cases):
        c = c or ""
        base = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(c) if len(m[2]) >= 8] + [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", c) if len(m[0]) >= 16] + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", c) if len(m[0]) >= 32]
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(base))
        assert found[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), c
        assert set(filter(None, line.split(","))) <= set(found[i]["spans"].split(","))
    assert found[7]["spans"] == "github:2:42"
    assert "github" not in found[8]["spans"] + found[9]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[7] == "x <github> y"
    assert clean[13] is None
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.redact(docs).count() == docs.count()


# 6. Substrings


def brute_repeats(rows, w):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    for i in order:
        for s in range(len(words[i]) - w + 1):
            k = tuple(words[i][s : s + w])
            at = (rows[i][0] is not None, rows[i][0] or 0, s)
            if k not in seen or at < seen[k]:
                seen[k] = at
    for i, (d, _) in enumerate(rows):
        gone = np.zeros(len(words[i]), bool)
        for s in range(len(words[i]) - w + 1):
            if seen[tuple(words[i][s : s + w])] < (d is not None, d or 0, s):
                gone[s : s + w] = True
        kept = b" ".join(x for x, g in zip(words[i], gone, strict=True) if not g)
        out.append((d, len(words[i]), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_substrings(spark, docs, hot):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    passage = text_of(30)
    rows += [(1000 + i, text_of(int(RNG.integers(0, 30))) + " " + passage + " " + text_of(10)) for i in range(12)] + [(2000, "a b c " * 40), (2001, "a b c " * 15), (2002, passage + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for window, gram in ((20, 5), (6, 3)):
        got = substrings.remove_repeats(df, window=window, gram=gram, hot=hot)
        assert Counter(map(tuple, got.collect())) == brute_repeats(rows, window)


def test_substrings_with_ids_of_text_and_long_texts(spark):
    long = text_of(25_000)
    rows = [("b", long), ("a", long[:60_000]), (None, "x " + long[30_000:31_000]), ("c", "z" * 3_000_000 + " " + long), ("c", None)]
    want = Counter({(d, n, k, h) for d, n, k, h in brute_repeats([(None if d is None else "abc".index(d), t) for d, t in rows], 20)})
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((None if r[0] is None else "abc".index(r[0]), *r[1:]) for r in got) == want


def test_word_hashes(monkeypatch):
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"x" * 300, "é".encode(), b"ab"]
    one = substrings.word_hashes(b" ".join(words) + b"  \n")
    assert len(set(one.tolist())) == 7
    assert one[2] == one[7]
    monkeypatch.setattr(substrings, "BLOCK", 7)
    for data in (b" ".join(words), b"\n" + b"\t ".join(words) + b" "):
        assert substrings.word_hashes(data).tolist() == one.tolist()
    assert len(substrings.word_hashes(b"")) == len(substrings.word_hashes(b" \n ")) == 0


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    """Thue-Morse words and their letter swaps are alike for polynomials modulo powers of two."""
    filler = " ".join(f"w{k}" for k in range(12))
    rows = [(k, f"{filler} {w} {filler}") for k, w in enumerate((thue_morse(n), thue_morse(n, "b", "a")))]
    rows += [(2, " ".join(thue_morse(n, "x ", "y ").split())), (3, " ".join(thue_morse(n, "y ", "x ").split()))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows, 20)
    assert got.where("doc_id < 2").agg(F.sum("n_removed")).first()[0] == 0


def test_segment_keys(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(-(2**63), 2**63, (20, 8))
    got = spark.createDataFrame([(w.tolist(),) for w in words], "fp array<bigint>").select(F.array(*neardup.segment_keys(512, 24)).alias("keys")).collect()
    for w, r in zip(words, got, strict=True):
        bits = np.unpackbits(w.astype(np.int64).view(np.uint8), bitorder="little")
        assert r["keys"] == [(s << 32) + sum(int(x) << j for j, x in enumerate(bits[24 * s : 24 * s + 24])) for s in range(21)]


@pytest.mark.parametrize("shard", [20, 100_000])
def test_spans_of_a_reference(spark, shard):
    ref = [text_of(40) for _ in range(6)] + [None]
    texts_ = [text_of(10) + " " + ref[k % 6][5:120] + " " + text_of(15) + " " + ref[(k + 1) % 6] for k in range(12)] + [None, "", ref[0]]
    grams_ = {tuple(w[i : i + 8]) for t in ref if t for w in [t.split()] for i in range(len(w) - 7)}
    rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in substrings.matched_spans(rows, spark.createDataFrame([(t,) for t in ref], "text string"), least=8, shard_words=shard).collect()}
    for i, t in enumerate(texts_):
        w = (t or "").split()
        want = {j for s in range(len(w) - 7) if tuple(w[s : s + 8]) in grams_ for j in range(s, s + 8)}
        assert {j for x in got[i] for j in range(x["start"], x["end"])} == want


def test_substrings_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0


def test_automaton():
    for _ in range(200):
        a, fed = SuffixAutomaton(), []
        for _ in range(int(RNG.integers(1, 4))):
            s = "".join(RNG.choice(list("ab"), int(RNG.integers(1, 12))))
            a.begin()
            for i, c in enumerate(s):
                before = [*fed, s[:i]]
                ends = lambda n, s=s, i=i, before=before: any(s[i + 1 - n : i + 1] in t for t in before)
                assert a.extend(c) == max((n for n in range(i + 2) if n == 0 or ends(n)), default=0)
            fed.append(s)
        q, n, at = "".join(RNG.choice(list("abc"), 15)), 0, 0
        while at < len(q):
            k = max((k for k in range(1, len(q) - at + 1) if any(q[at : at + k] in t for t in fed)), default=1)
            n, at = n + 1, at + k
        assert a.phrases(q) == n


# 7. WARC


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\nx", ""), (4, "u", None), (5, "u", "é" * 50000), (6, "u", "lone"), (2, "again", "same"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "size": F.lit(2)})
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {"same": 2, "": 4}
    want = Counter((p, len((h or "").encode()), sha(h), "response" if (h or "") not in top or p == top[h or ""] else "revisit", None if (h or "") not in top or p == top[h or ""] else top[h or ""]) for p, _, h in rows)
    for size in (1, 1 << 20):
        assert Counter(map(tuple, warc.round_trip(pages, archive_bytes=size).collect())) == want
    kinds = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, least=1).collect()}
    assert kinds[3] == kinds[4] == "response"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_with_ids_of_text_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 200)
    rows = [(f"id <{k}>\n%", f"http://{k}", f"body {k % 7} " * 50) for k in range(40)] + [("", "u", "lone"), (None, "u", "body 1 " * 50)]
    made = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), archive_bytes=500)
    assert made.rdd.getNumPartitions() > 1
    top = {h: max(p for p, _, g in rows if g == h and p is not None) for _, _, h in rows}
    want = Counter((p, len(h), "response" if p == top[h] else "revisit", None if p == top[h] else top[h]) for p, _, h in rows)
    assert Counter((r[0], r[1], r[3], r[4]) for r in made.collect()) == want


@pytest.mark.parametrize("limits", [(1 << 16, 1 << 31), (2, 60)])
def test_zip64(tmp_path, monkeypatch, limits):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limits[0])
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limits[1])
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5):
            z.writestr(zipfile.ZipInfo(f"m{k}é"), bytes([k]) * (50 + 50 * k))
        z.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"
    data = path.read_bytes()
    d = warc.ZipDirectory(lambda at, n: data[at : at + n], len(data))
    assert len(d.members) == 6
    for k in range(5):
        at, n = d.place(f"m{k}é")
        assert data[at : at + n] == bytes([k]) * (50 + 50 * k)
    with pytest.raises(ValueError, match="compressed"):
        d.place("packed")
    with pytest.raises(ValueError, match="no end"):
        warc.ZipDirectory(lambda at, n: b"junk"[at : at + n], 4)


# 8. Language


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = language.fold_of("doc_id", 4) == 2
    sample = language.labelled_sample(docs.where(~held))
    rows = language.identify(docs.where(held).withColumn("bits", F.lit("clash")), sample).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, docs, none):
    sample = {"xx": "abab baba", "yy": "cdcd dcdc"}
    got = {r["text"]: r for r in language.identify(docs, sample).collect()}
    assert got[None]["lang_pred"] == got["   "]["lang_pred"] == "und"
    assert got[None]["score"] == 0
    one = language.Parser(sample)
    # A tie goes to the language that sorts first.
    assert [one.predict(t)[0] for t in ("abba 123", "qq", "12 ½ ²!")] == ["xx", "xx", "und"]
    assert language.Parser({}).predict("abc")[0] == "und"
    assert language.labelled_sample(none) == {}
    assert language.identify(none, sample).count() == 0


def brute_language(sample, text):
    """Greedy cross-parsing by looking for each phrase in the labelled text itself."""
    reduced = language.letters(text) if text and any(c.isalpha() for c in text) else ""
    if not reduced:
        return "und"
    cost = {}
    for k in sorted(sample):
        held, at, n = language.letters(sample[k]), 0, 0
        while at < len(reduced):
            end = at + 1
            while end <= len(reduced) and reduced[at:end] in held:
                end += 1
            at, n = max(at + 1, end - 1), n + 1
        cost[k] = n * math.log2(len(sample[k]) + 2)
    return min(cost, key=cost.get)


def test_parses_stop_only_where_they_lose(monkeypatch):
    monkeypatch.setattr(language, "PROBE", 10)
    words = lambda n, of: " ".join("".join(RNG.choice(list(of), int(k))) for k in RNG.integers(1, 6, n))
    p = language.Parser({"a": words(60, "abcé"), "b": words(60, "abxy"), "c": "z"})
    for t in [words(int(n), of) for n in RNG.integers(0, 60, 30) for of in ("abcxyzé日", "abc", "xy")] + ["z", "zz é"]:
        reduced = language.letters(t)
        whole = [a.phrases(reduced) for a in p.automata]
        for a, n in zip(p.automata, whole, strict=True):
            for most in (0, 1, n - 1, n, n + 1):
                got, read = a.parsed(reduced, most)
                assert (got, read) == (n, len(reduced)) if n <= most else got > most
        if reduced:
            cost = [n * b / (len(reduced) - 1) for n, b in zip(whole, p.bits, strict=True)]
            lang, score, bits, size, n = p.predict(t)
            assert (lang, size) == (p.languages[cost.index(min(cost))], len(reduced) - 1)
            assert (bits, n) == (pytest.approx(min(cost)), whole[cost.index(min(cost))])
            assert 0.5 <= score <= 1


def test_language_against_brute_force(spark, sf_dir, docs):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    sample = language.labelled_sample(rows, chars=2000)
    every = rows.select("doc_id", "text").union(docs.select("doc_id", "text"))
    for r in language.identify(every, sample).collect():
        assert r["lang_pred"] == brute_language(sample, r["text"])


def test_foreign_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample, more = language.labelled_halves(docs)
    usual = language.typical(sample, more)
    noise = "".join(RNG.choice(list("qxzjkvwßłđ "), 3000))
    odd = spark.createDataFrame([(-1, noise), (-2, "the and zzz"), (-3, "日本語" * 300)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["f"] for r in language.identify(docs.select("doc_id", "text").union(odd), sample).select("doc_id", language.foreign(usual).alias("f")).collect()}
    assert got[-1]
    assert got[-3]
    assert not got[-2]


# 9. PPM


def test_ppm(spark, docs):
    rows = [r for r in docs.select("doc_id", "text").collect()]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = ppm.scores(docs, held)
    out = [tuple(r) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
    tok = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]
    out_of = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 0
    c = Counter(w for r in rows if not out_of(r["doc_id"]) for w in tok(r["text"]))
    n, v = sum(c.values()), len(c)
    want = [(r["doc_id"], out_of(r["doc_id"]), len(t := tok(r["text"])), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for r in rows]
    key = lambda r: (*map(str, r[:4]), round(r[5], 4))
    for a, b in zip(sorted(out, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)


def test_ppm_words_met_by_join(spark, docs, monkeypatch):
    held = F.lit(False)
    whole = sorted(map(str, ppm.scores(docs, held).select("doc_id", "n_known", F.round("base_score", 6), F.round("score", 6)).collect()))
    monkeypatch.setattr(ppm, "HOT_WORDS", 2)
    assert sorted(map(str, ppm.scores(docs, held).select("doc_id", "n_known", F.round("base_score", 6), F.round("score", 6)).collect())) == whole


class Ppm:
    """PPM, method C with exclusion, from its definition: counts of every context in a dictionary."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.seen = order, {}
        for t in texts:
            for before, s in self.symbols(t):
                for k in range(order + 1):
                    self.seen.setdefault(before[order - k :], Counter())[s] += 1

    def symbols(self, text):
        data = b"\n" * self.order + b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())) + b"\n"
        return [(data[i - self.order : i], data[i]) for i in range(self.order, len(data))]

    def p(self, before, s):
        p, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            new = {x: n for x, n in self.seen.get(before[self.order - k :], {}).items() if x not in gone}
            if new:
                total = sum(new.values()) + len(new)
                if s in new:
                    return p * new[s] / total
                p *= len(new) / total
                gone |= new.keys()
        return p / (ppm.SYMBOLS - len(gone))

    def score(self, text):
        return sum(math.log10(self.p(*x)) for x in self.symbols(text))


def test_ppm_probabilities_sum_to_one():
    m = Ppm(["abra abba", "cab", None], 3)
    alphabet = [b for b in range(256) if b not in (9, 11, 12, 13)]
    assert len(alphabet) == ppm.SYMBOLS
    for context in (b"\n\n\n", b" ab", b"abr", b"zz "):
        assert sum(m.p(context, s) for s in alphabet) == pytest.approx(1)


def test_grams_are_contexts_and_symbols():
    texts_ = [[], [b"a"], [b"bc", b"d"], []]
    key, own = ppm.grams(texts_, 2)
    data = [b"\n\n\n", b"\n\na", b"\na\n", b"\n\nb", b"\nbc", b"bc ", b"c d", b" d\n", b"\n\n\n"]
    assert [int(k).to_bytes(3) for k in key] == data
    assert own.tolist() == [0, 1, 1, 2, 2, 2, 2, 2, 3]


def test_prices_by_table():
    keys = np.unique(RNG.integers(0, 1 << 48, 5000))
    logs = -RNG.random(len(keys))
    asked = np.concatenate([RNG.choice(keys, 700), RNG.integers(0, 1 << 48, 300)])
    for n in (0, 1, 4000):
        got, lost = ppm.Prices(keys[:n], logs[:n])(asked)
        held = dict(zip(keys[:n].tolist(), logs[:n].tolist(), strict=True))
        assert got.tolist() == [held.get(k, 0.0) for k in asked.tolist()]
        assert sorted(lost.tolist()) == [i for i, k in enumerate(asked.tolist()) if k not in held]


@pytest.mark.parametrize("hot", [0, 100, 1_000_000])
def test_ppm_scores_are_those_of_brute_force(docs, monkeypatch, hot):
    """Rows with ids from 100 on are held out; every score is that of the whole trie, whatever is broadcast."""
    monkeypatch.setattr(ppm, "HOT_GRAMS", hot)
    monkeypatch.setattr(ppm, "GATHER", max(hot, 500))
    more = docs.sparkSession.createDataFrame([(100, "alphabet gammadelta zzz naïf"), (101, "x1y2 été\x01\x02"), (102, "alphabet " * 3), (103, BASE)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").union(more)
    rows = every.collect()
    model = Ppm([r["text"] for r in rows if (r["doc_id"] or 0) < 100])
    want = sorted((r["doc_id"] or 0, model.score(r["text"])) for r in rows)
    got = sorted((r["doc_id"] or 0, r["score"]) for r in ppm.scores(every, F.col("doc_id") >= 100).collect())
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [x[1] for x in got] == pytest.approx([x[1] for x in want], rel=1e-9)


def test_ppm_without_training(docs, none):
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 for r in ppm.scores(docs, F.lit(True)).collect())
    assert ppm.scores(none, F.lit(False)).count() == 0


# 10. Decontamination


def test_myers():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row

    for _ in range(300):
        a, b = ("".join(RNG.choice(list("abc"), int(RNG.integers(1, 12)))) for _ in range(2))
        d = brute(a, b)[1:]
        got = decontaminate.myers(a, b, 3)
        assert got == (None if min(d) > 3 else (min(d), d.index(min(d)) + 1))


def test_decontamination(spark, docs):
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil eight toads slowly"
    worn = item.replace("quick", "quack").replace("seven", "sevn").replace("toads", "toods")
    far = item.replace("quick brown fox", "slow white hen").replace("seven wizards", "eleven witches")
    rows = [(1, f"x y. {item.upper()}! z"), (2, worn), (3, far), (4, None), (5, ""), (6, "a short one here"), (7, "ashort one heretoo"), (6, "a short one here"), (8, item[:40])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(10, item), (11, "short one here"), (12, None), (13, "  "), (10, item), (14, item)], "item_id bigint, text string")
    for shard in (4_000_000, 60):
        got = sorted(map(tuple, decontaminate.contaminated(df, items, shard_chars=shard).select("doc_id", "item_id", "distance").collect()))
        assert got == [(1, 10, 0), (1, 14, 0), (2, 10, 3), (2, 14, 3), (6, 11, 0)]
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(df, items, shard_chars=shard).collect()) == [3, 4, 5, 7, 8]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(df.limit(0), items).count() == 0


def test_matcher_finds_what_brute_force_does():
    items = [(i, "".join(RNG.choice(list("abcd "), 50)).strip()) for i in range(6)]
    m = decontaminate.Matcher(items, 0.08, 40)
    for _ in range(60):
        k = int(RNG.integers(0, 6))
        s = list(decontaminate.normal(items[k][1]))
        for _ in range(int(RNG.integers(0, 6))):
            s[int(RNG.integers(0, len(s)))] = str(RNG.choice(list("abcde")))
        text = decontaminate.normal("zz " + "".join(s) + " yy")
        want = {i for i, t in items if decontaminate.myers(n := decontaminate.normal(t), text, int(len(n) * 0.08) if len(n) >= 40 else 0)}
        assert {i for i, *_ in m.matches(text)} == {i for i in want if len(decontaminate.normal(items[i][1])) >= 40}


def test_matcher_reads_a_recurring_piece_at_each_offset():
    rng = np.random.default_rng(3)
    budget, m = 8, 100
    for _ in range(20):
        item = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), m))
        cuts = [m * k // (budget + 1) for k in range(budget + 2)]
        item = item[: cuts[4]] + item[: cuts[5] - cuts[4]] + item[cuts[5] :]
        pieces = decontaminate.split(item, budget)
        assert pieces[0][1] == pieces[4][1]
        copy = list(item)
        for a, b in zip(cuts[:4], cuts[1:5], strict=True):
            copy[(a + b) // 2] = "0"
        text = "zero " * 30 + "".join(copy) + " one" * 30
        assert decontaminate.myers(item, decontaminate.normal(text), budget)[0] == 4
        assert [x[:2] for x in decontaminate.Matcher([(7, item)], 0.08, 40).matches(text)] == [(7, 4)]


def test_words():
    assert texts.words_of("A\x0bb c \x1cd", lower=True) == [b"a", b"b\xe2\x80\x83c", b"\x1cd"]
    assert texts.words_of(None) == []


def test_a_worker_holds_one_stage():
    made = []

    def make(name):
        return texts.held(name, lambda: made.append(name) or [name])

    texts.release()
    assert make("a") is make("a")
    assert make("b") == ["b"]
    assert make("a") == ["a"]
    assert made == ["a", "b", "a"]
    texts.release()
    texts.release()
    assert make("a") == ["a"]
    assert made == ["a", "b", "a", "a"]
    texts.release()


def test_meetings_leave_out_groups_and_chance(spark):
    """Texts of one group, and texts that share a segment's value by chance, don't come out of the join; near ones and large buckets do."""
    rng = np.random.default_rng(11)
    base, other = rng.integers(-(2**63), 2**63, (2, 8))
    chance = np.r_[base[0], rng.integers(-(2**63), 2**63, 7)]  # the first two segments are those of base
    near = base ^ np.int64(1 << 5)
    rows = [(0, base, 0), (1, near, 0), (2, near, 2), (3, chance, 3), *((10 + k, other, 10 + k) for k in range(6)), (20, other, 10)]
    nodes = spark.createDataFrame([(n, fp.tolist(), [7] * 21, g) for n, fp, g in rows], "node bigint, fp array<bigint>, weak array<int>, group bigint")
    keys = F.array(*neardup.segment_keys(512, 24)).alias("keys")
    table = nodes.select("node", "group", F.element_at("fp", -1).alias("tag"), F.explode(keys).alias("key"))
    met = neardup.meetings(nodes, table, keys, 512, 3, 96, 4)
    got = met.collect()
    assert {(r["a"], r["b"]) for r in got if r["b"] is not None} == {(0, 2), (2, 0), (1, 2), (2, 1)}
    assert {r["a"] for r in got if r["b"] is None} == {10, 11, 12, 13, 14, 15, 20}
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert neardup.slack(512, 96) == 22
    assert neardup.slack(64, 2) == 2


def test_families_of_texts_that_are_not_near(spark):
    """Texts that edits of their own keep apart don't come out of the join; what may be near, or has no number, does."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = [(n, " ".join(edited(base, 5, rng)), n) for n in range(60)]
    rows += [(n, " ".join(edited(base, 1, rng)), n) for n in (60, 61)]
    docs = spark.createDataFrame(rows, "node bigint, text string, group bigint")
    prints = docs.select("node", "group").join(neardup.sketches(docs, "node", "text").drop("sig"), "node").localCheckpoint()
    sets = neardup.shingle_sets(docs, 5).localCheckpoint()
    keys = F.array(*neardup.segment_keys(512, 24)).alias("keys")

    def met(nodes, bucket):
        table = nodes.select("*", F.element_at("fp", -1).alias("tag"), F.explode(keys).alias("key")).drop("fp", "weak")
        return [(r["a"], r["b"]) for r in neardup.meetings(nodes, table, keys, 512, 3, 96, bucket).collect()]

    numbers = neardup.reaches(sets)
    every = met(prints, 100)
    assert len(every) > 500
    got = met(prints.join(numbers, "node"), 100)
    assert set(got) == {(a, b) for a, b in every if min(a, b) >= 60} == {(60, 61), (61, 60)}
    assert len(met(prints.join(numbers, "node"), 0)) < len(met(prints, 0)) / 2
    # Numbers among others say nothing of a text that has none.
    some = neardup.reaches(sets.where("node < 61"))
    assert {x for x in met(prints.join(some, "node", "left"), 100) if 61 in x} == {x for x in every if 61 in x}
    assert neardup.near_groups(docs.select(F.col("node").alias("id"), "text"), "id").select("least").distinct().count() == 61
