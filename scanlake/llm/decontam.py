"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Both sides are reduced to lower-case words with single spaces. Every stretch of ``WINDOW`` bytes of an item, wherever it
starts, is a window (a shorter item is one window). A region that matches a window of m bytes within e edits shares at least
``m - q + 1 - q * e`` of its q-grams, all on diagonals at most e apart. Documents are read once as bytes: eight neighbouring
bytes are one integer, a bit table lets q-grams of the benchmark through, a running count drops every place where even
all hits together miss the bound, and the rest is sorted by item place in overlapping diagonal bands, where a sliding
count finds the windows that meet the bound. Windows that lie whole on one diagonal are found by that; the others are
verified by alignment inside their band, after a part of them that many windows have in common.

An item of fewer than ``LEAST`` bytes is too short for the lemma to tell anything; it is found where a document holds exactly its words, in a row.

The benchmark is handled in blocks of ``BLOCK_BYTES``, one after the other, each against all documents, so what the driver and a task hold is bounded.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.tables import map_batches, slices
from scanlake.scale import stable

Q = 8
#: Bytes of a window: what a document must hold of a longer item to be a leak.
WINDOW = 96
#: Bytes that neighbouring windows have in common and that are aligned first.
PART = 64
#: Items with fewer bytes than this match as whole words, without edits.
LEAST = 24
BLOCK_BYTES = 4_000_000
#: Slots of the bit table: at least 2 to this, and this many for each q-gram.
_TABLE_BITS, _SLOTS = 20, 8
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GAP = b"\x00" * (2 * WINDOW)
#: Bytes of documents that are matched at once.
_BUFFER = 2_000_000


def normal(text: str) -> bytes:
    """Lower case, ASCII other than letters and digits as spaces, single spaces."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split())


class Windows(NamedTuple):
    """Items of a block, laid out in one run of bytes with gaps between them, and their q-grams, sorted.

    The window that starts at byte s of an item has the name ``start + s``, its place in ``data``.
    """

    data: np.ndarray
    start: np.ndarray  # of each item in ``data``, ascending
    length: np.ndarray  # of the item's windows
    edits: np.ndarray
    bound: np.ndarray
    last: np.ndarray  # place of the item's last window
    grams: np.ndarray  # distinct q-grams
    first: np.ndarray  # of each gram in ``place``; one more at the end
    place: np.ndarray
    table: np.ndarray
    bits: int  # of a place in the table
    reach: int  # the longest region of a window
    least: int  # the smallest bound


def _grams(data: bytes) -> np.ndarray:
    n = len(data) - Q + 1
    return np.ndarray((max(n, 0),), "<u8", data, strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * _MIX) >> np.uint64(64 - bits)


def windows(items: list[bytes], rate: float = 0.1) -> Windows:
    """Windows of normalised items of ``LEAST`` bytes or more; edits allowed are ``rate`` of a window, or what the lemma can still tell."""
    data = _GAP + _GAP.join(items) + _GAP
    size = np.array([len(t) for t in items], np.int64)
    start = len(_GAP) + np.cumsum(np.append(0, size[:-1] + len(_GAP)))[: len(size)]
    length = np.minimum(size, WINDOW)
    edits = np.minimum((length * rate).astype(np.int64), (length - Q) // Q)
    bound = length - Q + 1 - Q * edits
    every = size - Q + 1
    place = np.repeat(start - np.cumsum(every) + every, every) + np.arange(every.sum())
    grams = _grams(data)[place]
    order = np.argsort(grams, kind="stable")
    names, first = np.unique(grams[order], return_index=True)
    bits = max(_TABLE_BITS, int(_SLOTS * len(names)).bit_length())
    table = np.zeros(1 << bits, bool)
    table[_slot(names, bits)] = True
    return Windows(np.frombuffer(data, np.uint8), start, length, edits, bound, start + size - length, names, np.append(first, len(grams)), place[order], table, bits,
                   int((length + edits).max(initial=0)), int(bound.min(initial=1)))


def align(patterns: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits between each pattern and any part of its region that keeps to the region's diagonals.

    Both have one row per candidate. A region holds the bytes from the band's first diagonal on; its width beyond the
    pattern is the band. Starts on any diagonal of the band are free, and so are ends.
    """
    n, width = len(regions), regions.shape[1] - patterns.shape[1] + 1
    k = np.arange(width, dtype=np.int16)
    cost = np.zeros((n, width), np.int16)
    for i in range(patterns.shape[1]):
        new = cost + (regions[:, i : i + width] != patterns[:, i, None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - k, axis=1) + k
    return cost.min(1)


def matches(w: Windows, texts: list[bytes]) -> np.ndarray:
    """(text, item, first window, last window, edits), one row per run of windows of an item found in a text; edits are the least of all runs of that item and text.

    Items are numbers, windows count from the item's start.
    """
    out = [np.zeros((0, 5), np.int64)]
    start = 0
    while start < len(texts) and len(w.start):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _BUFFER):
            size += len(texts[stop])
            stop += 1
        out.append(_runs(w, *_match(w, texts[start:stop])) + np.array([start, 0, 0, 0, 0]))
        start = stop
    return np.concatenate(out)


def _runs(w: Windows, text: np.ndarray, window: np.ndarray, edits: np.ndarray) -> np.ndarray:
    order = np.lexsort((edits, window, text))
    text, window, edits = text[order], window[order], edits[order]
    if not len(text):
        return np.zeros((0, 5), np.int64)
    item = np.searchsorted(w.start, window, "right") - 1
    pair = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))
    best = np.minimum.reduceat(edits, np.flatnonzero(pair))[np.cumsum(pair) - 1]
    head = pair | np.append(True, window[1:] > window[:-1] + 1)
    tail = np.append(head[1:], True)
    return np.stack([text[head], item[head], (window - w.start[item])[head], (window - w.start[item])[tail], best[head]], axis=1)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Every value from low to high, both included, of each range."""
    n = np.maximum(high - low + 1, 0)
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _match(w: Windows, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, edits) of all verified regions; a window may have several in one text."""
    none = (np.zeros(0, np.int64),) * 3
    data = _GAP + _GAP.join(texts) + _GAP
    begin = np.cumsum([len(_GAP)] + [len(t) + len(_GAP) for t in texts])[:-1]
    grams = _grams(data)
    hit = np.flatnonzero(w.table[_slot(grams, w.bits)])
    at = np.minimum(np.searchsorted(w.grams, grams[hit]), len(w.grams) - 1)
    good = w.grams[at] == grams[hit]
    hit, at = hit[good], at[good]
    if not len(hit):
        return none
    # a region of a window holds ``least`` hits within ``reach`` bytes: keep hits of such stretches
    far = np.searchsorted(hit, hit + w.reach, "right") - np.arange(len(hit)) >= w.least
    cover = np.zeros(len(hit) + 1, np.int64)
    heads = np.flatnonzero(far)
    ends = np.searchsorted(hit, hit[heads] + w.reach, "right")
    np.add.at(cover, heads, 1)
    np.add.at(cover, ends, -1)
    keep = np.cumsum(cover[:-1]) > 0
    hit, at = hit[keep], at[keep]
    if not len(hit):
        return none
    place = w.place[_spread(w.first[at], w.first[at + 1] - 1)]
    whole = len(w.data)
    diagonal = np.repeat(hit, w.first[at + 1] - w.first[at]) - place + whole
    # a window whose q-grams all lie on one diagonal is there without an edit
    line = np.sort(diagonal * whole + place)
    head = np.flatnonzero(np.append(True, np.diff(line) != 1))
    tail = np.append(head[1:], len(line)) - 1
    item = np.searchsorted(w.start, line[head] % whole, "right") - 1
    exact = _spread(line[head], line[tail] - (w.length[item] - Q))
    text = np.searchsorted(begin, exact // whole + exact % whole - whole, "right") - 1
    exact = np.unique(text * whole + exact % whole)
    # a hit lies in two overlapping bands, each two steps wide
    step = w.edits[np.searchsorted(w.start, place, "right") - 1] + 1
    band = diagonal // step
    rows = np.sort(np.concatenate([band * whole + place, (band - 1) * whole + place]))
    item = np.searchsorted(w.start, rows % whole, "right") - 1
    last = np.arange(len(rows)) + w.bound[item] - 1
    span = w.length[item] - Q
    head = np.flatnonzero(last < len(rows))
    head = head[rows[last[head]] - rows[head] <= span[head]]  # gaps between items are wider than a window
    item, shift = item[head], rows[head] // whole * whole
    low = np.maximum(rows[last[head]] - span[head], shift + w.start[item])
    high = np.minimum(rows[head], shift + w.last[item])
    low[1:] = np.maximum(low[1:], high[:-1] + 1)  # both ascend: each window once
    found = _spread(low, high)
    item = np.searchsorted(w.start, found % whole, "right") - 1
    length, edits = w.length[item], w.edits[item]
    window = found % whole
    middle = found // whole * (edits + 1) - whole + window + length // 2  # of the region, inside every match of the band
    text = np.maximum(np.searchsorted(begin, middle, "right") - 1, 0)
    rest = ~np.isin(text * whole + window, exact)
    found, item, length, edits, window, text = (x[rest] for x in (found, item, length, edits, window, text))
    raw = np.frombuffer(data, np.uint8)
    out = [(exact // whole, exact % whole, np.zeros(len(exact), np.int64))]
    for m, e in {*zip(length.tolist(), edits.tolist())}:
        mine = np.flatnonzero((length == m) & (edits == e))
        if m == WINDOW:
            # a part that starts at a multiple of PART // 2 lies in up to as many windows: none of them can do with fewer edits
            begins = w.start[item[mine]]
            part = found[mine] + (begins - window[mine]) % (PART // 2)
            parts, which = np.unique(part, return_inverse=True)
            mine = mine[(_least(w, raw, parts, PART, e) <= e)[which]]
        cost = _least(w, raw, found[mine], m, e)
        ok = mine[cost <= e]
        out.append((text[ok], window[ok], cost[cost <= e].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _least(w: Windows, raw: np.ndarray, found: np.ndarray, length: int, edits: int) -> np.ndarray:
    """Least edits of the stretch of ``length`` bytes at each band and place (``band * len(w.data) + place``)."""
    whole = len(w.data)
    out = [np.zeros(0, np.int16)]
    for s in range(0, len(found), 2000):
        place = found[s : s + 2000] % whole
        low = found[s : s + 2000] // whole * (edits + 1) - whole + place - edits
        width = length + 4 * edits + 2  # the band and, on both sides, what the edits may drift
        regions = raw[np.clip(low[:, None] + np.arange(width), 0, len(raw) - 1)]
        out.append(align(w.data[place[:, None] + np.arange(length)], regions))
    return np.concatenate(out)


def short_matches(items: list[bytes], texts: list[bytes]) -> list[tuple[int, int]]:
    """(text, item) for items of few words, wherever a text holds exactly their words in a row."""
    by_size: dict[int, dict[bytes, list[int]]] = {}
    for i, item in enumerate(items):
        if item:
            by_size.setdefault(item.count(b" ") + 1, {}).setdefault(item, []).append(i)
    out = set()
    for t, text in enumerate(texts):
        words = text.split()
        for n, known in by_size.items():
            found = known.keys() & {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n > 1 else known.keys() & set(words)
            out |= {(t, i) for item in found for i in known[item]}
    return sorted(out)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", rate: float = 0.1) -> DataFrame:
    """(id, item_id, n_windows, edits): documents that hold part of a benchmark item, one row per document and item.

    ``n_windows`` counts the item's windows found (one starts at every byte that leaves it whole), ``edits`` is the least
    number of edits of one of them. A leak is one whole window (or the whole item, if shorter) within ``rate`` edits; an item of fewer
    than ``LEAST`` bytes is one window without edits. Null texts and items, and items without a letter or digit, hold nothing; repeated documents of one id give one row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("body")).filter("item is not null and body is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, item_id long, body long, low long, high long, edits long"
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    found = None
    for i in range(blocks):
        body = items.withColumn("hash", F.xxhash64("item", "body")).filter(F.pmod("hash", F.lit(blocks)) == i).orderBy("item", "body").collect()
        held = spark.sparkContext.broadcast([(r["item"], r["hash"], normal(r["body"])) for r in body])
        del body
        part = map_batches(texts, functools.partial(_find, held, rate), schema)
        if blocks > 1:  # its matches are written, then the block is let go
            part = stable(part)
            held.destroy()
        found = part if found is None else found.unionByName(part)
    each = found.select("_id", "item_id", "body", F.explode(F.sequence("low", "high")).alias("window"), "edits")
    return each.groupBy("_id", "item_id").agg(F.countDistinct("body", "window").alias("n_windows"), F.min("edits").alias("edits")).withColumnRenamed("_id", id_col)


def _find(held, rate: float, batches):
    kept = sorted(held.value, key=lambda k: len(k[2]) < LEAST)  # the short ones last
    long = sum(len(t) >= LEAST for _, _, t in kept)
    number, name = (np.array([k[c] for k in kept], np.int64) for c in (0, 1))
    w, short = windows([t for _, _, t in kept[:long]], rate), [t for _, _, t in kept[long:]]
    for batch, texts in slices(batches, "_t"):
        plain = [normal(t) for t in texts]
        rows = matches(w, plain)
        if any(short):
            rows = np.concatenate([rows, *[np.array([[t, long + i, 0, 0, 0]]) for t, i in short_matches(short, plain)]])
        text, item, low, high, edits = rows.T
        columns = [pa.array(np.ascontiguousarray(c)) for c in (number[item], name[item], low, high, edits)]
        yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(np.ascontiguousarray(text))), *columns], names=["_id", "item_id", "body", "low", "high", "edits"])
