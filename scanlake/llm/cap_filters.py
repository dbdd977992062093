"""Near-duplicate vectors by spherical-cap filters.

Directions are product codes: a vector is rotated, cut into blocks, and a direction is one unit vector per block from a small
random codebook, so that ``size ** blocks`` directions need ``size * blocks`` inner products. A vector enters
every filter whose direction it exceeds ``alpha`` with; partial sums that the best remaining blocks can't lift over alpha are
cut early, so the work follows the number of filters it enters (list decoding). Vectors that share a filter are compared
exactly. ``plan`` derives alpha and the number of directions from the number of vectors and the recall that a pair
exactly at the threshold must have. A pair counts only in the first filter its two vectors share, so links add up over
filters without listing pairs; each filter hands on one row per vector with links.
"""

from __future__ import annotations

import functools
import itertools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.components import connected_components
from scanlake.llm.tables import map_batches
from scanlake.scale import stable

#: Vectors of one filter that one task compares with as many others; fuller filters are cut into blocks of this size.
BLOCK = 1500
#: Vectors that a filter holds on average.
PER_FILTER = 24


class Plan(NamedTuple):
    dim: int
    blocks: int
    size: int
    alpha: float
    seed: int


def _marginal(dim: int, n: int = 4001) -> tuple[np.ndarray, np.ndarray]:
    """Grid and probabilities of one coordinate of a uniform unit vector."""
    x = (2 * np.arange(n) + 1) / n - 1
    w = (1 - x * x) ** ((dim - 3) / 2)
    return x, w / w.sum()


def plan(n: int, dim: int, threshold: float = 0.9, miss: float = 0.002, seed: int = 7) -> Plan:
    """Alpha so that a filter holds about PER_FILTER of n vectors; enough directions that a pair at the threshold
    shares none with probability ``miss`` or less. Where that takes far more directions than vectors (few dimensions),
    alpha falls until it does not."""
    x, p = _marginal(dim)
    tail = np.cumsum(p[::-1])[::-1]
    y, q = _marginal(max(dim - 1, 3))
    above = np.append(np.cumsum(q[::-1])[::-1], 0.0)
    share = min(0.05, PER_FILTER / max(n, 1))
    while True:
        a = min(int(np.searchsorted(-tail, -share)), len(x) - 1)
        alpha = float(x[a])
        side = np.sqrt(max(1 - threshold**2, 1e-12) * np.maximum(1 - x[a:] ** 2, 1e-12))
        both = float((p[a:] * above[np.searchsorted(y, (alpha - threshold * x[a:]) / side)]).sum())
        directions = 1.3 * math.log(1 / miss) / max(both, 1e-15)
        if directions <= 16 * n + 4096:
            break
        share = min(1.0, 1.5 * share)
    blocks = max(1, min(dim // 8, math.ceil(math.log(directions) / math.log(400))))
    return Plan(dim, blocks, math.ceil(directions ** (1 / blocks)), alpha, seed)


@functools.lru_cache(maxsize=8)
def _codebook(p: Plan) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    rng = np.random.default_rng([p.seed, p.dim])
    rotation = np.linalg.qr(rng.standard_normal((p.dim, p.dim)))[0]
    cuts = np.linspace(0, p.dim, p.blocks + 1).astype(int)
    parts = [slice(a, b) for a, b in itertools.pairwise(cuts.tolist())]
    books = []
    for s in parts:
        c = rng.standard_normal((p.size, s.stop - s.start))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return rotation, books, parts


def decode(p: Plan, unit: np.ndarray) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all directions with inner product alpha or more."""
    rotation, books, parts = _codebook(p)
    turned = unit @ rotation
    scores = [turned[:, s] @ b.T for s, b in zip(parts, books)]
    rest = np.zeros((len(unit), p.blocks + 1))  # the most that blocks k.. can still add
    for k in range(p.blocks - 1, -1, -1):
        rest[:, k] = rest[:, k + 1] + scores[k].max(1)
    need = p.alpha * math.sqrt(p.blocks)
    out = []
    for i in range(len(unit)):
        total, number = np.zeros(1), np.zeros(1, np.int64)
        for k in range(p.blocks):
            s = scores[k][i]
            good = np.flatnonzero(s >= need - rest[i, k + 1] - total.max(initial=-np.inf))
            sums = total[:, None] + s[good][None, :]
            a, b = np.nonzero(sums >= need - rest[i, k + 1])
            total, number = sums[a, b], number[a] * p.size + good[b]
        out.append(np.sort(number))
    return out


def _valid(col: str):
    """Null, empty and zero vectors and those with null or non-finite components link with nothing."""
    c = F.col(col)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(c, lambda x: x != 0), F.lit(False))


def _compare(threshold: float):
    """All pairs of one filter (or of two blocks of it): exact cosines, links counted where the pair is first met."""
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        number, lo, hi = (int(x) for x in key)
        side = g["block"].to_numpy()
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        unit = np.stack(g["unit"].to_list())
        linked = unit[left] @ unit[right].T >= threshold
        if lo == hi:
            linked = np.triu(linked, 1)
        a, b = np.nonzero(linked)
        if not len(a):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        # filters that members share before this one
        used = np.unique(np.concatenate([a if lo == hi else left[a], b if lo == hi else right[b]]) if lo == hi else np.concatenate([left[a], right[b]]))
        rows = np.concatenate([np.full(k, i) for i, k in zip(used, g["filters"].iloc[used].map(len))])
        filters = np.concatenate(g["filters"].iloc[used].to_list())
        early = filters < number
        rows, filters = rows[early], filters[early]
        names, back, times = np.unique(filters, return_inverse=True, return_counts=True)
        met = np.zeros(linked.shape, np.float32)
        often = np.flatnonzero(times > 1)
        column = np.full(len(names), -1)
        column[often] = np.arange(len(often))
        for start in range(0, len(often), 512):
            in_slice = (column[back] >= start) & (column[back] < start + 512)
            has = np.zeros((len(g), 512), np.float32)
            has[rows[in_slice], column[back][in_slice] - start] = 1
            met += has[left] @ has[right].T
        first = linked & (met == 0)
        size = g["size"].to_numpy()
        n = np.zeros(len(g), np.int64)
        np.add.at(n, left, first @ size[right])
        np.add.at(n, right, first.T @ size[left])
        root = np.arange(len(g))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        reps = g["rep"].to_numpy()
        for i, j in _tree(left[a], right[b], len(g)):
            x, y = top(i), top(j)
            if x != y:
                root[x if reps[x] > reps[y] else y] = y if reps[x] > reps[y] else x
        some = np.unique(np.concatenate([left[a], right[b]]))
        return pd.DataFrame({"rep": reps[some], "n": n[some], "root": reps[[top(int(i)) for i in some]]})
    return run


def _tree(a: np.ndarray, b: np.ndarray, n: int):
    """Links that keep the components: labels sink along all links at once until none changes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return [(i, int(label[i])) for i in np.unique(np.concatenate([a, b])).tolist() if label[i] != i]
        label = new


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, miss: float = 0.002) -> DataFrame:
    """(id, n_links, component_id, kept) of every distinct (id, vector) row.

    Equal vectors are compared once and linked with each other. Vectors of different lengths link never. Rows without an
    id have no links and no component and are not kept. Vectors that differ under one id share their component.
    """
    vectors = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).distinct()
    good = vectors.filter(F.col("id").isNotNull() & _valid("v"))
    classes = stable(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    plans = {r["d"]: plan(r["n"], r["d"], threshold, miss) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}

    def enter(batches):
        for b in batches:
            lists, size, rep = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_dim.setdefault(len(v), []).append(i)
            for d, rows in by_dim.items():
                for start in range(0, len(rows), 1000):
                    some = rows[start : start + 1000]
                    unit = np.array([lists[i] for i in some])
                    unit = unit / np.abs(unit).max(1, keepdims=True)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    found = decode(plans[d], unit) if d > 1 else [np.array([int(u[0] > 0)]) for u in unit]
                    times = np.array([len(f) for f in found])
                    at = np.repeat(np.arange(len(some)), times)
                    lengths = lambda k: np.concatenate([[0], np.cumsum(k)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), d, np.int32)),
                        pa.array(np.concatenate(found).astype(np.int64) if len(at) else np.zeros(0, np.int64)),
                        pa.array(rep[some][at]), pa.array(size[some][at]),
                        pa.ListArray.from_arrays(pa.array(lengths(np.full(len(at), d))), pa.array(unit[at].ravel())),
                        pa.ListArray.from_arrays(pa.array(lengths(times[at])), pa.array(np.concatenate([found[i] for i in at]).astype(np.int64) if len(at) else np.zeros(0, np.int64))),
                    ], names=["dim", "number", "rep", "size", "unit", "filters"])

    entered = map_batches(classes.select("v", "size", "rep"), enter, "dim int, number long, rep long, size long, unit array<double>, filters array<long>")
    full = entered.groupBy("dim", "number").agg(F.count("*").alias("in_filter")).filter(F.col("in_filter") > 1)
    rows = entered.join(full, ["dim", "number"]).withColumn("blocks", F.ceil(F.col("in_filter") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    key = F.struct("number", "lo", "hi", "dim")
    compare = _compare(threshold)
    found = met.withColumn("key", key).groupBy("number", "lo", "hi", "dim").applyInPandas(lambda k, g: compare(k[:3], g), "rep long, n long, root long")
    found = stable(found.groupBy("rep", "root").agg(F.sum("n").alias("n")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("rep", "root"), "rep", "root").withColumnRenamed("node", "rep")
    of_class = classes.join(links, "rep", "left").join(parts, "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(of_class, "v").select("id", "n_links", "component_id")
    alone = vectors.filter(F.col("id").isNull() | ~_valid("v")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
