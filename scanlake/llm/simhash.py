"""Near copies by 64-bit fingerprints, found by a grid join on segment bit counts.

A fingerprint is cut into 16 segments of 4 bits and becomes the point of its 16 bit counts. The Manhattan distance of
two points is a lower bound of the fingerprints' differing bits, so links at 2 or fewer bits lie at 2 or less there.
Two such points share a grid cell at distance 1 or less from both: each fingerprint enters its own cell and the up to 32
cells next to it, cells join, and every meeting pair is verified on all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scanlake.llm.components import connected_components
from scanlake.llm.tables import map_texts
from scanlake.scale import stable

MAX_BITS = 2
_SHINGLES = 65_536  # hashed at once


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit majority fingerprint: bit set where over half of the shingle hashes have it set; no word: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _SHINGLES):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + _SHINGLES], ends[i : i + _SHINGLES])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp) of every whole text; null reads as empty."""
    def run(ids, texts):
        return {"_id": ids, "fp": pa.array([fingerprint(t, words_per_shingle) for t in texts], pa.int64())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, run, f"_id {kind}, fp long").withColumnRenamed("_id", id_col)


def _half(x: Column) -> Column:
    """Bit counts of the eight segments in the lower half of a long."""
    def both(c, mask, by):
        return c.bitwiseAND(F.lit(mask)) + F.shiftrightunsigned(c, by).bitwiseAND(F.lit(mask))

    return both(both(x, 0x55555555, 1), 0x33333333, 2)


def _cell(fp: Column) -> Column:
    """Bit counts of the 16 segments, each in its own four bits of one long (at most 4, so never negative)."""
    return _half(fp).bitwiseOR(F.shiftleft(_half(F.shiftrightunsigned(fp, 32)), 32))


def _cells(cell: Column) -> Column:
    """The cell itself and its neighbours one step away along one axis, inside the grid 0..4."""
    out = [cell]
    for i in range(16):
        count = F.shiftrightunsigned(cell, 4 * i).bitwiseAND(F.lit(15))
        step = F.shiftleft(F.lit(1).cast("long"), 4 * i)
        out += [F.when(count < 4, cell.bitwiseXOR(_moved(count, 1, i, step))), F.when(count > 0, cell.bitwiseXOR(_moved(count, -1, i, step)))]
    return F.array_compact(F.array(*out))


def _moved(count: Column, by: int, i: int, step: Column) -> Column:
    """What to flip in segment i so that its count changes by one (no carry, so the sign bit is safe)."""
    return F.shiftleft(count.bitwiseXOR(count + by), 4 * i)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs a < b of distinct fingerprints in column ``fp`` at MAX_BITS or fewer differing bits."""
    # a few bytes per fingerprint become 33 rows: deal them out before they grow, not after
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = dealt.select(F.explode(_cells(_cell(F.col("fp")))).alias("cell"), "fp")
    left, right = cells.withColumnRenamed("fp", "a"), cells.withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    # Spark sizes the 33 rows like the one they come from and would send them all through the driver
    return left.hint("merge").join(right, "cell").filter(near).select("a", "b").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): smallest id reachable over links of near-equal fingerprints, itself included.

    Equal fingerprints are one node, so a group of copies costs one row however large it is. Rows of one id share
    their groups; rows without an id take part with their fingerprint but never name a component. A group in
    which no row has an id has a null component.
    """
    marked = stable(fingerprints(df, id_col, text_col))
    fps = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = connected_components(fingerprint_links(fps), "a", "b").withColumnsRenamed({"node": "fp"})
    linked = stable(fps.join(found, "fp"))
    top = linked.groupBy("component").agg(F.min("least").alias("top"))
    by_fp = linked.join(top, "component").select("fp", "top")
    nodes = fps.join(by_fp, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id"))
    return marked.join(nodes, "fp").select(id_col, "fp", "component_id")


def hex_digits(fp: str | Column) -> Column:
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.lpad(F.lower(F.hex(c)), 16, "0")
