"""Secret scans: keyword automaton first, anchored patterns only at its hits, checksums last.

Kinds of the base: ``assign`` (a name, a separator and a value of 8 or more characters),
``access`` (AKIA and capitals or digits, 16 or more characters), ``hex`` (32 or more
lower-case hex digits). The scan adds ``github`` and ``npm``: tokens whose last six
characters are the base-62 CRC-32 of the rest, so a chance likeness doesn't count.

Spans are in code points, end exclusive, leftmost and non-overlapping within a kind; a
match that a kind's length rule drops still uses up its text. Null text is empty. Rows
with equal text or id each give a row; columns other than id and text don't pass through.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.texts import map_rows, per_task

# The kinds in the order of ties, and their patterns.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def checksum(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def scan(text: str | None, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by the kinds' order."""
    if not text:
        return []
    found, free = [], {"assign": 0, "access": 0, "checked": 0}
    low = text.lower()
    if len(low) != len(text):  # some character has a longer lower case: positions would shift
        low = text.translate(LOWER)
    for end, (size, kind) in keywords.iter(low):
        at = end + 1 - size
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= 8:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= 16:
                    found.append((at, m.end(), kind))
        elif (m := CHECKED.match(text, at)) and checksum(m[2]) == m[3] and not (at and text[at - 1].isalnum()):
            free[kind] = m.end()
            found.append((at, m.end(), "npm" if m[1] == "npm_" else "github"))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row."""

    @per_task
    def find():
        keywords = automaton()

        def step(doc, texts):
            return doc, [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t, keywords)] for t in texts]

        return step

    return map_rows(docs.select(doc_id, text), find, f"doc_id {dict(docs.dtypes)[doc_id]}, spans array<struct<kind:string,start:int,end:int>>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as a string."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda col: F.array_join(F.transform(col, line), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by its kind in angle brackets; all columns and rows stay.

    Overlapping spans are replaced as one, under the first one's kind. ``n_chars``, if
    there, follows the text.
    """

    @per_task
    def hide():
        keywords = automaton()

        def clean(t):
            out, last = [], 0
            for s, e, kind in scan(t, keywords):
                if s >= last:
                    out += [t[last:s], f"<{kind}>"]
                last = max(last, e)
            return "".join([*out, t[last:]]) if last else t

        def step(*cols):
            return [*cols[:-1], [clean(t) for t in cols[-1]]]

        return step

    others = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*others, text])
    out = map_rows(docs.select(*others, text), hide, schema).select(*docs.columns)
    return out.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
