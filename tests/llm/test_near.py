"""Fingerprints, cap filters and components against brute force."""
import itertools
import random

import numpy as np
import pytest

pytest.importorskip("xxhash")
import xxhash  # noqa: E402

from scanlake.llm import cap_filters, simhash  # noqa: E402
from scanlake.llm.components import connected_components  # noqa: E402


def smallest(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_chain_star_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links + [(7, None)], "a long, b long"), "a", "b").collect()}
    nodes = {x for ab in links for x in ab if ab != (300, 300)}
    assert got == smallest(nodes, [ab for ab in links if ab != (300, 300)])
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    for t in ["", " \t\r\n", "A", "A b", "A b C", "É e\u00a0x Y z", "a\x0bb\x0cc d", "one two three four one two three", "ÀÉ ab AB ab"]:
        assert simhash.fingerprint(t) & (2**64 - 1) == slow_fingerprint(t), t


def test_links_against_all_pairs(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1, 2**63]
    near = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(8)]
    signed = sorted({x - 2**64 if x >> 63 else x for x in base + near})
    got = {tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want and len(want) > 50


def test_near_copies(spark, odd_docs, no_docs):
    rows = simhash.near_copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = {}
    for r in odd_docs.collect():
        by_text.setdefault(slow_fingerprint(r.text or ""), []).append(r.doc_id)
    ids = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert ids[0] == ids[1] == ids[2] == ids[3] == 0 and ids[9] == 8 and ids[4] == 4
    assert simhash.near_copies(no_docs).count() == 0
    assert {r.h for r in simhash.near_copies(odd_docs).select(simhash.hex_digits("fp").alias("h")).collect()} == {f"{f:016x}" for f in by_text}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, unit int")


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 40)  # full filters are cut into several blocks
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 24))
    data = np.concatenate([rng.standard_normal((150, 24))] + [c + rng.standard_normal((25, 24)) * s for c, s in zip(centres, np.linspace(0.05, 0.45, 12))]).astype(np.float32)
    data = np.concatenate([data, data[:20], data[200:205] * 2])
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(data)]
    got = {r.vec_id: r for r in cap_filters.near_vectors(vectors(spark, rows)).collect()}
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    n = linked.sum(1)
    assert sum(r.n_links for r in got.values()) >= 0.99 * n.sum() and all(got[i].n_links <= n[i] for i in got)
    want = smallest(range(len(data)), list(zip(*np.nonzero(linked))))
    assert sum(got[i].component_id == want[i] for i in got) >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0, 0), (2, [], 0, 0), (3, [0.0, 0.0], 0, 0), (4, [nan, 1.0], 0, 0), (5, [1.0, None], 0, 0), (6, [inf, 1.0], 0, 0), (None, [1.0, 0.0], 0, 0),
            (7, [1.0, 0.0], 0, 0), (8, [1.0, 0.0], 1, 0), (8, [1.0, 0.0], 1, 0), (9, [1.0, 0.0, 0.0], 0, 0), (10, [5.0, 0.1], 0, 0), (11, [-1.0, 0.0], 0, 0), (12, [2.0], 0, 0), (13, [3.0], 0, 0)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(vectors(spark, rows)).collect()}
    assert {(7, 2, 7, True), (8, 2, 7, False), (10, 2, 7, False), (9, 0, 9, True), (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False), (None, 0, None, False)} <= got
    assert {(i, 0, i, True) for i in range(1, 7)} <= got and len(got) == 14
    assert cap_filters.near_vectors(vectors(spark, [])).count() == 0


def test_cells_are_never_broadcast(spark):
    """A small table of fingerprints grows 33 rows each after Spark sized it; the join must not collect them."""
    fps = spark.range(200).selectExpr("id as fp")
    plan = simhash.fingerprint_links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
