"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut into the
fewest greedy phrases that occur in that labelled text, across words; phrases times the bits that a
position in the labelled text takes, for each character, estimates the cross entropy
(Ziv and Merhav 1993). The language with the least wins. Texts are lower-cased and reduced to
runs of letters with one blank between and around.

The labelled text is a bounded sample: ``sample_chars`` characters a language, from the
``sample_docs`` training rows that come first in the order of their ids' hash. Every text
is predicted whole, however long. Null text, or text without a letter, is ``und`` with score 0; so is
every text if nothing was learned. Ties go to the language that sorts first. Null
languages are never learned from. Repeated rows each give a row.

``typical`` says what texts cost in their own language: the phrases a character of labelled rows
that the automata don't hold. A text of ``n`` characters is ``foreign`` to its winner if it takes over
``EXCESS`` times that, and by more than ``SLACK`` phrases, so that a few odd words in a short text aren't held against it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.suffix import SuffixAutomaton
from voxloom.llm.texts import fresh, held, map_rows, per_task

UNDETERMINED = "und"
SAMPLE_DOCS = 200
SAMPLE_CHARS = 60_000
#: Times a language's own phrases a character that a text may take, and phrases that it may take beyond.
EXCESS, SLACK = 2.5, 12
#: Characters by which the languages are ordered before the parse.
PROBE = 150

_LETTERS = re.compile(r"[^\W\d_]+")


def fold_of(doc_id: str | Column, folds: int) -> Column:
    """crc32(doc_id as text) mod ``folds``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % folds


def labelled_sample(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Language -> at most ``chars`` characters of lower-cased text of ``docs`` rows."""
    return {k: " ".join(v)[:chars] for k, v in _labelled(train, doc_id, text, lang, docs, chars).items()}


def labelled_halves(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[dict[str, str], dict[str, str]]:
    """Two samples of different rows, one to learn from and one for ``typical``."""
    rows = _labelled(train, doc_id, text, lang, 2 * docs, 2 * chars)
    return tuple({k: " ".join(v[half::2])[:chars] for k, v in rows.items() if v[half::2]} for half in (0, 1))


def _labelled(train: DataFrame, doc_id: str, text: str, lang: str, docs: int, chars: int) -> dict[str, list[str]]:
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = train.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    keys = rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("_n") <= docs)
    # At most ``docs`` ids a language.
    chosen = rows.join(F.broadcast(keys.select("lang", "doc_id").distinct()), ["lang", "doc_id"], "left_semi")
    # Each row brings its even share, or all of a shorter text; so no row alone makes up a language.
    chosen = chosen.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= docs).select("lang", F.col("_n").alias("n"), F.lower(F.substring("text", 1, max(1, 8 * chars // docs))).alias("text"))
    out: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "n").collect():
        out.setdefault(r["lang"], []).append(" ".join(r["text"].split()))
    return out


def letters(text: str) -> str:
    """Lower-case runs of letters with one blank between and around; nothing if there is no letter."""
    runs = _LETTERS.findall(text.lower())
    return f" {' '.join(runs)} " if runs else ""


class Parser:
    """Phrases of a text in every language.

    The language that leads after ``PROBE`` characters is parsed to the end; each other one as far as it can still
    win. So the winner is that of whole parses; a loser's cost is that of the part up to which it was parsed.
    """

    def __init__(self, sample: dict[str, str]):
        self.languages = sorted(sample)
        self.automata, self.bits = [], []
        for k in self.languages:
            a = SuffixAutomaton()
            for c in letters(sample[k]):
                a.extend(c)
            self.automata.append(a)
            self.bits.append(math.log2(len(sample[k]) + 2))

    def predict(self, text: str | None) -> tuple[str, float, float, int, int]:
        """(language, score, bits a character, characters, phrases); a score of 1 is sure, near 0.5 a close call."""
        reduced = letters(text) if text and self.languages and any(map(str.isalpha, text)) else ""
        if not reduced:
            return UNDETERMINED, 0.0, 0.0, 0, 0
        size, kinds = len(reduced) - 1, range(len(self.languages))
        start = reduced[:PROBE]
        order = sorted(kinds, key=lambda k: self.automata[k].phrases(start) * self.bits[k]) if len(reduced) > 2 * PROBE else kinds
        best = second = None
        for k in order:
            most = None if best is None else int(best[0] * size / self.bits[k])
            n, read = self.automata[k].parsed(reduced, most)
            cost = n * self.bits[k] / max(1, read - 1)
            if best is None or (read == len(reduced) and (cost, k) < best[:2]):
                best, second = (cost, k, n), best and min(best[0], second or best[0])
            else:
                second = cost if second is None else min(second, cost)
        cost, k, n = best
        return self.languages[k], 1.0 if second is None else max(second, cost) / (max(second, cost) + cost), cost, size, n


OUTPUT = {"lang_pred": "string", "score": "double", "bits": "double", "size": "bigint", "phrases": "bigint"}


def identify(docs: DataFrame, sample: dict[str, str], text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``OUTPUT``: language, score, bits (cross entropy a character), characters and phrases.

    Columns of ``docs`` with these names are replaced, unless ``names`` gives others; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    new = {(names or {}).get(c, c): kind for c, kind in OUTPUT.items()}
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` {kind}" for c, kind in new.items())])

    @per_task
    def label():
        parser = _worker_parser(shared)

        def step(*cols):
            got = [parser.predict(t) for t in cols[-1]]
            return [*cols[:-1], *([g[k] for g in got] for k in range(len(OUTPUT)))]

        return step

    return map_rows(docs.select(*keep, F.col(text).alias(fresh("text", keep))), label, schema, raw=keep)


def typical(sample: dict[str, str], more: dict[str, str]) -> dict[str, float]:
    """Language -> phrases a character of its texts ``more``, which ``sample`` doesn't hold."""
    parser, out = Parser(sample), {}
    for k, a in zip(parser.languages, parser.automata, strict=True):
        reduced = letters(more.get(k, ""))
        if reduced:
            out[k] = a.phrases(reduced) / (len(reduced) - 1)
    return out


def foreign(usual: dict[str, float], lang: str = "lang_pred", size: str = "size", phrases: str = "phrases") -> Column:
    """Whether a text is in none of the languages: far more phrases than its winner's own texts take."""
    expected = F.lit(None).cast("double")
    for k, rate in usual.items():
        expected = F.when(F.col(lang) == k, F.lit(rate)).otherwise(expected)
    expected = expected * F.col(size)
    return F.coalesce(F.col(phrases) > F.greatest(EXCESS * expected, expected + SLACK), F.lit(False))


def _worker_parser(shared) -> Parser:
    sample = shared.value
    return held(("languages", *sorted(sample.items())), lambda: Parser(sample))
