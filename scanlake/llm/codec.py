"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Distinct words of equal length advance together; rolling substring hashes probe the sorted piece keys; the maximum
over the pieces that end at a position is stored as back pointer (``pieces.Vocabulary.lattice``). The ids are
those of the library for a BPE model with byte fallback. A text that holds U+2581 decodes with a space there,
as the library does; null reads as the empty text and has no ids.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.pieces import LONG_WORD, SPACE, Vocabulary, default_path, vocabulary
from scanlake.llm.tables import map_batches, map_texts, recent

#: Words whose ids a worker remembers, next to those of the batch at hand.
REMEMBERED = 150_000


def _other_ids(voc: Vocabulary, path: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> bytes:
    """Ids of a path that holds characters outside the vocabulary."""
    got: list[int] = []
    for i, e in zip(path.tolist(), ends.tolist()):
        if i >= 0:
            got.append(i)
        else:
            char = chr(int(codes[e - 1])).encode("utf-8", "surrogatepass")
            got.extend(voc.byte_ids[list(char)].tolist() if voc.has_bytes else [voc.unk])
    return np.array(got, np.int32).tobytes()


def _long_path(back: np.ndarray) -> np.ndarray:
    """Ends of the pieces of one long word."""
    steps, ends, at = back.tobytes(), array("q"), len(back) - 1
    while at:
        ends.append(at)
        at -= steps[at]
    return np.frombuffer(ends, np.int64)[::-1]


def word_ids(voc: Vocabulary, words: list[str]) -> dict[str, bytes]:
    """Ids (int32 bytes) of distinct segments."""
    out = {}
    for some, codes in voc.groups(words):
        last, back = voc.lattice(codes)
        m, n = codes.shape
        if n > LONG_WORD:
            for w, word in enumerate(some):
                ends = _long_path(back[w])
                p = last[w, ends]
                out[word] = _other_ids(voc, p, ends, codes[w]) if (p < 0).any() else p.tobytes()
            continue
        at = np.full(m, n)
        rows = np.arange(m)
        all_ends = []
        while at.any():
            all_ends.append(at)
            at = at - back[rows, at]  # no step from the beginning
        ends = np.array(all_ends[::-1]).T
        path = last[rows[:, None], ends]
        keep = ends > 0
        flat = path[keep].tobytes()
        stop = np.cumsum(keep.sum(1)) * 4
        out.update(zip(some, [flat[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist())]))
        for w in np.flatnonzero((path < 0).any(1)).tolist():
            out[some[w]] = _other_ids(voc, path[w, keep[w]], ends[w, keep[w]], codes[w])
    return out


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text; words not seen before go through the lattice in one batch."""
    voc, memory = vocabulary(path), recent(("codec", path), REMEMBERED)
    cut = [voc.segments(t) for t in texts]
    new = memory.missing(set().union(*cut))
    memory.young.update(word_ids(voc, new))
    out = [np.frombuffer(b"".join(map(memory.young.__getitem__, words)), np.int32) for words in cut]
    memory.forget(new, LONG_WORD)
    return out


def _piece_bytes(voc: Vocabulary) -> list[bytes]:
    out = [n.replace(SPACE, " ").encode() for n in voc.names]
    for value, i in enumerate(voc.byte_ids.tolist()):
        if i != voc.unk:
            out[i] = bytes([value])
    for special in (voc.unk,):
        out[special] = " ⁇ ".encode()
    return out


@functools.lru_cache(maxsize=2)
def _bytes_of(path: str) -> list[bytes]:
    return _piece_bytes(vocabulary(path))


def decode_ids(path: str, ids: list[int]) -> str:
    """Text of ids: pieces joined, byte pieces as UTF-8 (broken bytes as U+FFFD), the leading space removed."""
    raw = b"".join(map(_bytes_of(path).__getitem__, ids))
    return raw.decode("utf-8", "replace").removeprefix(" ")


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, n_tokens, round_trip): ids of every whole text and whether decoding them gives the text back."""
    path = path or default_path()

    def run(ids, texts):
        parts = encode_texts(path, texts)
        back = [decode_ids(path, p.tolist()) == t for p, t in zip(parts, texts)]
        return {"_id": ids, "ids": _list_array(parts), "n_tokens": pa.array([len(p) for p in parts], pa.int64()), "round_trip": pa.array(back, pa.bool_())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, run, f"_id {kind}, ids array<int>, n_tokens long, round_trip boolean").withColumnRenamed("_id", id_col)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of stored ids; null ids give null, ids outside the vocabulary an error naming them."""
    path = path or default_path()

    def run(batches):
        for b in batches:
            size = vocabulary(path).size
            texts = []
            for ids in b.column("_ids").to_pylist():
                if ids is not None and any(i is None or not 0 <= i < size for i in ids):
                    raise ValueError(f"ids outside 0..{size - 1}: {[i for i in ids if i is None or not 0 <= i < size][:5]}")
                texts.append(None if ids is None else decode_ids(path, ids))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids")), run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
