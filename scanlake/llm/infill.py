"""Fill-in-middle: a text is cut at two places and put together anew, so that its middle comes last.

Cut places are numbered in units (code points, words, lines; any expression that matches at least one character, from left to right).
Each text keeps a Fenwick tree over its blocks of ``BLOCK`` code points: one sum of the units that end in a block, one of the UTF-8 bytes
that it takes. The block of a cut is found by binary lifting (one descent, no scan of the text); the place inside the block is found in
that block alone.

Which texts are cut, and where, follows from a hash of the id, so a job that is run again gives the same examples.
"""

from __future__ import annotations

import functools
import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanlake.llm.tables import map_texts

BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Units: code points, words with the space before them, lines.
UNITS = {"code_point": r"(?s:.)", "word": r"\s*\S+|\s+\Z", "line": r"[^\n]*\n|[^\n]+"}


class Fenwick:
    """Prefix sums over blocks, of any number of columns side by side."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        self.tree = np.zeros((self.n + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        step = 1
        while step <= self.n:  # every node takes the sum of the child of this height
            parents = np.arange(2 * step, self.n + 1, 2 * step)
            self.tree[parents] += self.tree[parents - step]
            step *= 2

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The last block before which fewer than k of the first column lie, and the sums before it."""
        at, before = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << self.n.bit_length()
        while step := step >> 1:
            if at + step <= self.n and before[0] + self.tree[at + step, 0] < k:
                at += step
                before = before + self.tree[at]
        return at, before

    def total(self) -> np.ndarray:
        at, out = self.n, np.zeros(self.tree.shape[1], np.int64)
        while at:
            out += self.tree[at]
            at &= at - 1
        return out


class Units:
    """Where the units of a text end."""

    def __init__(self, text: str, unit: str):
        self.text = text
        n_blocks = -(-len(text) // BLOCK)
        sizes = np.full(n_blocks, BLOCK, np.int64)
        sizes[-1:] -= n_blocks * BLOCK - len(text)
        self.ends = None
        if unit == UNITS["code_point"]:
            counts = sizes
        else:
            self.ends = np.fromiter((m.end() for m in _compiled(unit).finditer(text) if m.end() > m.start()), np.int64)
            counts = np.bincount((self.ends - 1) // BLOCK, minlength=n_blocks) if n_blocks else sizes
        self.tree = Fenwick(np.stack([counts, sizes], axis=1))
        self.n = int(self.tree.total()[0])

    def end_of(self, k: int) -> int:
        """Code points of the first k units (0 for none, all of the text for the last)."""
        if k <= 0:
            return 0
        if k >= self.n:
            return len(self.text)
        _, (units, points) = self.tree.descend(k)
        if self.ends is None:
            return int(points) + k - int(units)
        here = self.ends[np.searchsorted(self.ends, points, "right") :]
        return int(here[k - int(units) - 1])


@functools.lru_cache(maxsize=16)
def _compiled(unit: str) -> re.Pattern:
    return re.compile(unit)


class Cut(NamedTuple):
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def lots(name: str, salt: str = "1") -> list[int]:
    """Four numbers below 2**32 drawn from a name."""
    digest = hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, name: str, unit: str = UNITS["code_point"], rate: int = 90, spm_rate: int = 20, salt: str = "1") -> Cut:
    """One text as plain, prefix-suffix-middle or suffix-prefix-middle; a text that holds a mark stays plain."""
    h1, h2, h3, h4 = lots(name, salt)
    units = Units(text, unit)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return Cut(units.n, "plain", None, None, text)
    a, b = sorted((units.end_of(h1 % (units.n + 1)), units.end_of(h2 % (units.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return Cut(units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Cut(units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_point", rate: int = 90, spm_rate: int = 20, salt: str = "1") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text; one row per row, repeated rows alike.

    ``n`` counts units. ``unit`` is a name of ``UNITS`` or an expression. A null text reads as empty and stays plain; a null id draws like the
    empty name. Lengths are code points, null for plain texts. Other columns are not read; an empty table gives an empty result.
    """
    pattern = UNITS.get(unit, unit)

    def run(ids, texts):
        names = ["" if i is None else str(i) for i in ids.to_pylist()]
        cuts = [cut(t, name, pattern, rate, spm_rate, salt) for t, name in zip(texts, names)]
        longs = {c: pa.array([getattr(x, f) for x in cuts], pa.int64()) for c, f in (("n", "n"), ("prefix_chars", "prefix"), ("middle_chars", "middle"))}
        return {"_id": ids, "n": longs["n"], "form": pa.array([x.form for x in cuts], pa.string()), "prefix_chars": longs["prefix_chars"],
                "middle_chars": longs["middle_chars"], "output": pa.array([x.output for x in cuts], pa.string())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text again, from output and form alone: the marks stand nowhere else, so the first of each is the real one."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    after = lambda s, mark: F.substring_index(s, mark, -1)
    before = lambda s, mark: F.substring_index(s, mark, 1)
    head, middle = before(out, MIDDLE), after(out, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(kind == "plain", out).when(kind == "psm", psm).otherwise(spm)
