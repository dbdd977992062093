"""URL verdicts by a Bloom filter cascade over every key of the corpus.

A key is a host or one of its parent domains, followed by the first characters of the path (as many as some rule names).
The cascade is built over the complete set of the corpus's distinct keys: level 0 holds the listed keys, level 1 the keys that
level 0 lets through by mistake, level 2 the listed keys that level 1 lets through, and so on until no mistake is
left. The first level that does not hold a key decides, so membership is exact for every key of the
corpus and a lookup needs no join. A level has about 1.5 to 12 bits per key it holds; each level's size is known from
the counts before it is built. Listed keys beyond ``MAX_KEYS`` go into several cascades; each has a lookup of its own whose result is written before
the next begins, so what a worker holds at a time stays below ``MAX_KEYS * 24`` bits however long the lists are. Keys are told apart by 64-bit
hashes, so membership is exact up to two keys of one hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanlake.llm.tables import map_batches
from scanlake.scale import stable

MAX_KEYS = 20_000_000
#: Key hashes that a task of a level reads.
KEYS_A_TASK = 500_000
#: Position of a key that is in no list.
NONE = 2**31 - 1

#: The rules (action, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A list of domains for ``verdicts`` (the hosts of the given pages that one would block); lists of any length come as a table.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org"))


class Level(NamedTuple):
    bits: int
    hashes: int
    words: np.ndarray


def host(url: str) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys(host_col: str, path_col: str, lengths: Sequence[int]) -> Column:
    """Every (domain, path start) of a url, joined by a line break, longest in all first, then longest domain.

    A path shorter than a length has no key of that length.
    """
    labels = F.split(host_col, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    every = F.flatten(F.transform(domains, lambda d: F.array(*[
        F.when(F.length(path_col) >= n, F.struct((-(F.length(d) + n)).alias("rank"), (-F.length(d)).alias("host"), F.concat(d, F.lit("\n"), F.substring(path_col, 1, n)).alias("key")))
        for n in lengths])))
    return F.transform(F.array_sort(F.array_compact(every)), lambda x: x["key"])


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _positions(h: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    a = _mixed(h, 2 * level + 1)
    b = _mixed(h, 2 * level + 2) | np.uint64(1)
    return np.stack([(a + np.uint64(j) * b) % np.uint64(bits) for j in range(hashes)])


def holds(level: Level, number: int, h: np.ndarray) -> np.ndarray:
    at = _positions(h, number, level.bits, level.hashes)
    return ((level.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def member(levels: Sequence[Level], h: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the corpus: the first level that does not hold a key decides."""
    out = np.full(len(h), len(levels) % 2 == 1)
    open_ = np.arange(len(h))
    for i, level in enumerate(levels):
        inside = holds(level, i, h[open_])
        out[open_[~inside]] = i % 2 == 1
        open_ = open_[inside]
    return out


def _level(hashes: DataFrame, number: int, n: int, rate: float) -> Level:
    """One Bloom filter of n keys: tasks set bits, words are joined by OR; the driver sees words, never keys."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    k = max(1, round(bits / n * math.log(2)))

    def run(batches):
        for b in batches:
            at = _positions(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), number, bits, k).ravel()
            word = (at >> np.uint64(6)).astype(np.int64)
            order = np.argsort(word, kind="stable")
            word, bit = word[order], np.uint64(1) << (at[order] & np.uint64(63))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], names=["w", "v"])

    words = np.zeros((bits + 63) // 64, np.uint64)
    for row in map_batches(hashes.select("h"), run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        words[row["w"]] = np.uint64(row["v"] & 0xFFFFFFFFFFFFFFFF)
    return Level(bits, k, words)


def _passing(hashes: DataFrame, level: Level, number: int) -> DataFrame:
    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h[holds(level, number, h.view(np.uint64))])], names=["h"])

    return map_batches(hashes, run, "h long")


def _sized(hashes: DataFrame, n: int) -> DataFrame:
    """As many partitions as so many hashes need; the levels that follow inherit them."""
    return hashes.coalesce(max(1, -(-n // KEYS_A_TASK)))


def build_cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels for two disjoint sets of key hashes (column ``h``): listed keys and all other keys of the corpus.

    The first level's error rate follows the ratio of the two counts, later ones are 1/2, which keeps the whole near the
    least size. Ends when a level makes no mistake; a hash in both sets would never end and is an error.
    """
    inside, outside = stable(listed), stable(others)
    n, rest = inside.count(), outside.count()
    inside, outside = _sized(inside, n), _sized(outside, rest)
    levels: list[Level] = []
    rate = min(0.5, n * math.sqrt(2) / max(rest, 1)) if rest else 0.5
    while n:
        levels.append(_level(inside, len(levels), n, rate))
        if not rest:
            break
        if len(levels) > 200:
            raise ValueError("a key hash is both listed and not listed")
        wrong = stable(_passing(outside, levels[-1], len(levels) - 1))
        n_wrong = wrong.count()
        inside, outside, n, rest, rate = wrong, inside, n_wrong, n, 0.5
    return levels


def cascades(pages_keys: DataFrame, listed: DataFrame) -> list[list[Level]]:
    """Cascades for the listed keys (column ``key``) over all distinct keys of the corpus (column ``key``)."""
    h = F.xxhash64("key")
    universe = stable(pages_keys.select(h.alias("h")).distinct())
    named = stable(listed.select(h.alias("h")).distinct())
    n = named.count()
    present = universe.join(named, "h", "left_semi")
    rest = universe.join(named, "h", "left_anti")
    slices = max(1, math.ceil(n / MAX_KEYS))
    if slices == 1:
        return [build_cascade(present, rest)]
    part = F.pmod(F.col("h"), F.lit(slices))
    return [build_cascade(present.filter(part == i), rest.unionByName(present.filter(part != i))) for i in range(slices)]


def _first_listed(held):
    """Arrow function: list of key hashes -> position of the first listed key, from 1; none if none is, or the position found before."""
    def run(batches):
        for b in batches:
            lists = b.column("hs")
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = member(held.value, flat) if held.value else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.flatnonzero(hit)
            first = at[np.minimum(np.searchsorted(at, ends[:-1]), max(len(at) - 1, 0))] if len(at) else np.full(len(ends) - 1, -1)
            found = np.where((first >= ends[:-1]) & (first < ends[1:]), first - ends[:-1] + 1, NONE)
            before = b.column("found").to_numpy(zero_copy_only=False)
            yield b.set_column(b.schema.get_field_index("found"), "found", pa.array(np.minimum(found, before).astype(np.int32)))
    return run


def _lookup(df: DataFrame, keys_col: str, filters: list[list[Level]], name: str) -> DataFrame:
    """Add the first key of the list that is listed, or null. One cascade after the other."""
    sc = df.sparkSession.sparkContext
    out = df.withColumn("hs", F.transform(keys_col, lambda k: F.xxhash64(k))).withColumn("found", F.lit(NONE))
    for levels in filters:
        held = sc.broadcast(levels)
        out = map_batches(out, _first_listed(held), ", ".join(f"`{n}` {t}" for n, t in out.dtypes))
        if len(filters) > 1:
            out = stable(out)
            held.destroy()
    return out.withColumn(name, F.when(F.col("found") < NONE, F.get(keys_col, F.col("found") - 1))).drop("found", "hs")


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: DataFrame | Sequence[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    The longest rule (domain and path together, then domain) that fits decides; where none does, a url is blocked if its host
    or a parent domain is in ``listed`` (names, or a table with ``domain``) and allowed otherwise. Null urls and urls without ``://`` have an empty host
    and path, fit no rule and are allowed. Repeated rows are judged one by one.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(d,) for d in listed], "domain string")
    parsed = pages.select(F.col(id_col).alias("_id"), host(url_col).alias("host"), path(url_col).alias("path"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # the corpus's keys: one row per distinct host and path start, not per page
    longest = max(lengths, default=0)
    heads = parsed.select("host", F.substring("path", 1, longest).alias("path")).distinct()
    rule_keys = heads.select(F.explode(keys("host", "path", lengths)).alias("key"))
    ruled = spark.createDataFrame([(f"{h}\n{p}",) for _, h, p in rules], "key string")
    rule_filter = cascades(rule_keys, ruled)
    list_filter = cascades(heads.select("host").distinct().select(F.explode(domains).alias("key")), listed.select(F.col("domain").alias("key")))
    out = _lookup(parsed.withColumn("ks", keys("host", "path", lengths)), "ks", rule_filter, "rule_key").drop("ks")
    out = _lookup(out.withColumn("ds", domains), "ds", list_filter, "listed_key").drop("ds")
    action = F.lit(None).cast("string")
    for a, h, p in rules:
        action = F.when(F.col("rule_key") == f"{h}\n{p}", a).otherwise(action)
    verdict = F.coalesce(action, F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.translate("rule_key", "\n", "").alias("rule"), verdict.alias("verdict"))
