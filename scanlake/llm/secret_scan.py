"""Secrets in text: Aho-Corasick keywords, anchored expressions at the hits, checksums inside tokens.

Three base kinds are plain shapes. ``assign`` and ``access`` begin with a keyword, so one automaton pass finds every place
where they can begin and the expression is tried only there, from left to right, never inside the match before.
A run of 32 hexadecimal digits has no keyword, but it covers two neighbouring characters of any every-16th sample, so
the expression is tried only around such samples. ``github`` and ``npm`` tokens are added by the method: 30
base-62 characters followed by their CRC-32 in six base-62 digits; a token whose digits do not agree is no secret.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.tables import map_batches, map_texts, slices

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
#: Keywords of assignments and the prefixes of tokens that carry a checksum.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_SAMPLED = re.compile(r"[0-9a-f]{2,}")
STEP = 16


class Span(NamedTuple):
    start: int
    rank: int
    end: int

    def text(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, (0, len(w)))
    a.add_word("akia", (1, 4))
    for p, kind in TOKEN_PREFIXES.items():
        a.add_word(p, (KINDS.index(kind), len(p)))
    a.make_automaton()
    return a


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's body."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, r = divmod(value, 62)
        out = DIGITS[r] + out
    return out


def _hex_spans(text: str) -> list[Span]:
    out, reached = [], 0
    for m in _SAMPLED.finditer(text[::STEP]):
        for at in range(m.start() * STEP, m.end() * STEP, STEP):
            if at < reached:
                continue
            start, end = at, HEX.match(text, at).end()
            while start > reached and text[start - 1] in "0123456789abcdef":
                start -= 1
            reached = end
            if end - start >= 32:
                out.append(Span(start, 2, end))
    return out


def find(text: str) -> list[Span]:
    """All spans of a text, by start and then kind; per kind leftmost and not overlapping."""
    low = text.lower()
    if len(low) != len(text):  # one capital letter has a longer lower case
        low = text.replace("İ", "i").lower()
    out, reached = [], [0] * len(KINDS)
    hits = sorted((end - n + 1, rank) for end, (rank, n) in _automaton().iter(low))
    for start, rank in hits:
        if start < reached[rank]:
            continue
        m = (ASSIGN, ACCESS, None, CHECKED, CHECKED)[rank].match(text, start)
        if not m:
            continue
        reached[rank] = m.end()
        if rank == 0 and len(m[2]) >= 8 or rank == 1 and m.end() - start >= 16 or rank > 2 and checksum(m[1]) == m[2]:
            out.append(Span(start, rank, m.end()))
    return sorted(out + _hex_spans(text))


def redacted(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> for the base kinds, base_sha256, spans) of every whole text; null reads as empty.

    Positions are code points, ends exclusive. ``base_sha256`` digests the base spans, ``spans`` lists all.
    """
    def run(ids, texts):
        found = [find(t) for t in texts]
        listed = [",".join(s.text() for s in spans) for spans in found]
        base = [",".join(s.text() for s in spans if s.rank < len(BASE)) for spans in found]
        counts = {f"n_{k}": pa.array([sum(s.rank == r for s in spans) for spans in found], pa.int64()) for r, k in enumerate(BASE)}
        return {"_id": ids, **counts, "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), "spans": pa.array(listed, pa.string())}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(df, id_col, text_col, run, schema).withColumnRenamed("_id", id_col)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets of the text column replaced; null texts stay null."""
    def run(batches):
        at = batch_names.index(text_col)
        for batch, texts in slices(batches, text_col):
            new = [redacted(t, spans) if (spans := find(t)) else t for t in texts]
            null = batch.column(at).is_null().to_pylist()
            changed = pa.array([None if z else t for t, z in zip(new, null)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), changed)

    batch_names = df.columns
    return map_batches(df, run, df.schema)
