"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

``count(prefix) = count(prefix without its last piece) + tokens of that piece``, and the last piece of each prefix comes
from the lattice in ``pieces``. Counts add up over segments, so a text's table is the table of its distinct words
put together. Truncation and budget questions are answered from it without encoding again. Counts may fall
from one prefix to the next (a longer piece can replace two), so "fits" means the longest prefix within the budget.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanlake.llm.pieces import LONG_WORD, Vocabulary, default_path, vocabulary
from scanlake.llm.tables import map_texts, recent

#: Words whose counts a worker remembers, next to those of the batch at hand.
REMEMBERED = 200_000


def _tokens_of_last(voc: Vocabulary, last: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Tokens that the last piece of each prefix stands for: 1, or the bytes of a character outside the vocabulary."""
    out = np.ones(last.shape, np.uint8)
    if voc.has_bytes:
        other = last[:, 1:] < 0
        for more in (0x7F, 0x7FF, 0xFFFF):
            out[:, 1:] += other & (codes > more)
    return out


def _long_counts(back: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Token counts of one long word: a prefix's count is that of the prefix ``back`` characters shorter and its own step."""
    counts = array("i", [0])
    for b, s in zip(back[1:].tobytes(), step[1:].tobytes()):
        counts.append(counts[-b] + s)
    return np.frombuffer(counts, np.int32)


def prefix_counts(voc: Vocabulary, codes: np.ndarray) -> np.ndarray:
    """Token count at every prefix (0..n) of words of one length."""
    last, back = voc.lattice(codes)
    step = _tokens_of_last(voc, last, codes)
    if codes.shape[1] > LONG_WORD:
        return np.stack([_long_counts(b, s) for b, s in zip(back, step)])
    back = back.astype(np.int32)
    counts = np.zeros(last.shape, np.int32)
    rows = np.arange(len(codes))
    for end in range(1, codes.shape[1] + 1):
        counts[:, end] = counts[rows, end - back[:, end]] + step[:, end]
    return counts


def _totals(path: str, cut: list[list[str]]) -> list[list[int]]:
    """Tokens of each segment of each text."""
    voc, memory = vocabulary(path), recent(("token_counts", path), REMEMBERED)
    new = memory.missing(set().union(*cut))
    for some, codes in voc.groups(new):
        memory.young.update(zip(some, prefix_counts(voc, codes)[:, -1].tolist()))
    found = [list(map(memory.young.__getitem__, words)) for words in cut]
    memory.forget(new, LONG_WORD)
    return found


def _one(voc: Vocabulary, segment: str) -> np.ndarray:
    (_, codes), = voc.groups([segment])
    return prefix_counts(voc, codes)[0]


def _taken(voc: Vocabulary, words: list[str]) -> list[int]:
    """Characters of the text that each segment takes (the first one's leading space is not in the text)."""
    return [len(w) + (i > 0 and not (voc.newline_breaks and w[:1] == "\n")) for i, w in enumerate(words)]


def _fitting(voc: Vocabulary, words: list[str], counts: list[int], limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens."""
    before = np.concatenate([[0], np.cumsum(counts)])
    k = min(int(np.searchsorted(before, limit, "right")) - 1, len(words) - 1)
    taken = _taken(voc, words)
    reach = int(limit - before[k]) * voc.longest + 1  # no token has more characters than the longest piece
    inside = _one(voc, words[k][:reach]) + before[k]
    p = int(np.flatnonzero(inside <= limit)[-1])
    added = voc.surface(words[k]) != words[k] and k == 0  # the library's own leading space is not in the text
    return sum(taken[:k]) + max(0, p - added)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, path: str | None = None) -> DataFrame:
    """(id, n_tokens, fit_chars): tokens of every whole text, and the characters of its longest prefix within ``limit``.

    One row per row, repeated rows alike; a null text counts as empty (no tokens). Other columns are not read.
    """
    path = path or default_path()

    def run(ids, texts):
        voc = vocabulary(path)
        cut = [voc.segments(t) for t in texts]
        n, fit = [], []
        for t, words, counts in zip(texts, cut, _totals(path, cut)):
            n.append(sum(counts))
            fit.append(len(t) if n[-1] <= limit else _fitting(voc, words, counts, limit))
        return {"_id": ids, "n_tokens": pa.array(n, pa.int64()), "fit_chars": pa.array(fit, pa.int64())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, run, f"_id {kind}, n_tokens long, fit_chars long").withColumnRenamed("_id", id_col)


def prefix_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, prefix_tokens): element k is the exact token count of the first k characters."""
    path = path or default_path()

    def whole(voc: Vocabulary, text: str) -> np.ndarray:
        words = voc.segments(text)
        out, base = [np.zeros(1, np.int32)], 0
        table = {}
        for some, codes in voc.groups(set(words)):
            table.update(zip(some, prefix_counts(voc, codes)))
        for w, taken in zip(words, _taken(voc, words)):
            inside = table[w]
            out.append(base + inside[len(inside) - taken :])
            base += int(inside[-1])
        return np.concatenate(out)

    def run(ids, texts):
        voc = vocabulary(path)
        return {"_id": ids, "prefix_tokens": pa.array([whole(voc, t).tolist() for t in texts], pa.list_(pa.int32()))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, run, f"_id {kind}, prefix_tokens array<int>").withColumnRenamed("_id", id_col)


def tokens_within(prefix_tokens: str | Column, n_chars: int) -> Column:
    """Tokens of the first ``n_chars`` characters (of the whole text if it is shorter)."""
    c = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.element_at(c, F.least(F.lit(n_chars + 1), F.size(c)))


def chars_within(prefix_tokens: str | Column, n_tokens: int) -> Column:
    """Characters of the longest prefix with at most ``n_tokens`` tokens."""
    c = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.aggregate(F.transform(c, lambda x, i: F.when(x <= n_tokens, i).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
