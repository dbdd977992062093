"""Quality rules: how much of a text is said again.

Words are runs of anything but ASCII white space. All texts of a piece of a partition go through numpy together: words are numbered, an
n-gram's key is a rolling hash over the numbers (multiply, add, 64 bits), and one sort of the keys of a length shows which windows
repeat within their text. Windows whose keys agree are compared number by number, so a collision can't count as a repeat.

The verdict is on coverage: the characters of words inside n-grams of 5 to 10 words that stood earlier in the text, and those on
lines that stood earlier. The shares allowed are those that Rae et al. 2021 (table A1) publish for web text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.tables import map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BASE_N = 3
MIN_WORDS, MAX_REPEATED = 50, 50
#: Length of an n-gram and the per cent of word characters that repeated ones may cover; the same for lines.
NGRAM_SHARE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_SHARE = 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS)}]")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits (the finisher of splitmix64)."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(mixed: np.ndarray, lengths: list[int]):
    """(n, keys of all windows of n words) for ascending lengths; each length extends the one before it."""
    keys, n = np.zeros(len(mixed) + 1, np.uint64), 0
    for want in lengths:
        while n < want:
            keys = keys[: max(0, len(mixed) - n)] * _MULTIPLIER + mixed[n:]
            n += 1
        yield want, keys


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for k in range(n):
        out &= words[a + k] == words[b + k]
    return out


def repeats(words: np.ndarray, docs: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window stood earlier in its text, window stands twice or more in its text), for every window start of ``keys``.

    ``words`` are word numbers, ``docs`` the number of each word's text. Windows that leave their text never repeat.
    """
    later, twice = np.zeros(len(words), bool), np.zeros(len(words), bool)
    starts = np.flatnonzero(docs[: len(keys)] == docs[n - 1 :][: len(keys)]) if len(keys) else np.zeros(0, np.int64)
    own = keys[starts] ^ _mixed(docs[starts])
    order = np.argsort(own, kind="stable")
    own, starts = own[order], starts[order]
    pairs = np.flatnonzero(own[1:] == own[:-1])
    a, b = starts[pairs], starts[pairs + 1]
    if not (_same(words, a, b, n) & (docs[a] == docs[b])).all():  # two n-grams with one key: group by the words themselves
        groups: dict[tuple, int] = {}
        for s in np.sort(starts).tolist():
            seen = groups.setdefault((int(docs[s]), *words[s : s + n].tolist()), s)
            later[s], twice[s] = seen != s, seen != s
            twice[seen] |= seen != s
        return later, twice
    later[b] = True
    twice[a] = twice[b] = True
    return later, twice


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a marked window of n words."""
    edge = np.zeros(len(starts) + n + 1, np.int64)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge)[: len(starts)] > 0


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of each text, by name."""
    numbers: dict[str, int] = {}
    number = numbers.setdefault
    split = [WORD.findall(t) for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    words = np.fromiter((number(w, len(numbers)) for s in split for w in s), np.int64, int(n_words.sum()))
    size = np.fromiter((len(w) for s in split for w in s), np.int64, len(words))
    docs = np.repeat(np.arange(len(texts)), n_words)
    total = lambda x: np.bincount(docs, weights=x, minlength=len(texts)).astype(np.int64)
    out = {"n_words": n_words, "word_chars": total(size), "n_symbols": np.array([len(_SYMBOL.findall(t)) for t in texts], np.int64)}
    dup_lines, dup_line_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        seen: set[str] = set()
        for line in t.split("\n"):
            if line in seen:
                dup_lines[i] += 1
                dup_line_chars[i] += sum(map(len, WORD.findall(line)))
            elif WORD.search(line):
                seen.add(line)
    out |= {"n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars}
    for n, keys in rolling(_mixed(words), sorted({BASE_N, *NGRAM_SHARE})):
        later, twice = repeats(words, docs, keys, n)
        if n == BASE_N:
            out["n_repeat_words"] = total(covered(twice, n))
        if n in NGRAM_SHARE:
            out[f"dup_{n}gram_chars"] = total(size * covered(later, n))
    return out


def verdicts(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``base_failed`` and ``kept`` from the counts; whole numbers throughout."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
    bad = 100 * m["dup_line_chars"] > LINE_SHARE * m["word_chars"]
    for n, share in NGRAM_SHARE.items():
        bad |= 100 * m[f"dup_{n}gram_chars"] > share * m["word_chars"]
    return {"base_failed": failed, "kept": ~failed & ~bad}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_{n}gram_chars" for n in NGRAM_SHARE]]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept) of every whole text; one row per row, repeated rows alike.

    A null or empty text has no words and fails. A line counts as repeated if it has a word and equals an earlier one in full. Other
    columns are not read; an empty table gives an empty result.
    """
    def run(ids, texts):
        m = measure(texts)
        return {"_id": ids, **{c: pa.array(m[c], pa.int64()) for c in COUNTS}, **{c: pa.array(v, pa.bool_()) for c, v in verdicts(m).items()}}

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"_id {kind}", *[f"{c} long" for c in COUNTS], "base_failed boolean", "kept boolean"])
    return map_texts(df, id_col, text_col, run, schema).withColumnRenamed("_id", id_col)
