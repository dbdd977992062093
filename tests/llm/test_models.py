"""Learned operators: held-out accuracy, what they may not look at, and odd rows."""
import collections
import random

import numpy as np

from scanlake.llm import langid, toxicity
from scanlake.llm.tables import held_out

SYLLABLES = {"aa": ("ka", "to", "mi", "ru", "sen"), "bb": ("sch", "ung", "heit", "ver", "be"), "cc": ("eau", "que", "tion", "ment", "oi")}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) + ("." if rnd.random() < 0.1 else "") for _ in range(n))


def corpus(rnd, n=240):
    return [(i, text(rnd, lang, rnd.randint(5, 60)), lang) for i, lang in ((i, rnd.choice(list(SYLLABLES))) for i in range(n))]


def test_language_held_out_and_switched(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROUNDS", 15)
    rnd = random.Random(5)
    docs = corpus(rnd) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ²½ __", "bb"), (1003, text(rnd, "aa", 3) + " " + text(rnd, "bb", 50), None), (None, text(rnd, "cc", 20), "cc"), (1004, text(rnd, "cc", 20_000).replace(".", ""), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as _id", "2 as score").withColumn("fold", held_out())
    model = langid.fit(df)
    assert model.labels == ["aa", "bb", "cc"] and (np.argmax(model.moves, 1) == np.arange(3)).all()
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    fold = {r.doc_id: r.fold for r in df.collect()}
    tested = [(got[i].lang_pred, lang) for i, _, lang in docs[:240] if fold[i]]
    assert len(tested) > 20 and np.mean([a == b for a, b in tested]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "bb", "cc", "cc"]
    assert all(0 <= r.score <= 1 for r in got.values()) and 0.6 < got[1003].score < 1
    # labels of the held-out fold and of nothing else are without effect
    from pyspark.sql import functions as F
    again = langid.fit(df.withColumn("lang", F.when(F.col("fold"), "zz").otherwise(F.col("lang"))))
    assert again.labels == model.labels and np.allclose(again.weights, model.weights)


def test_forward_backward_by_enumeration():
    import itertools
    rng = np.random.default_rng(0)
    score, moves, first = rng.standard_normal((9, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    sizes = np.array([4, 2, 3])
    p, expected, log_z = langid.forward_backward(score, langid.arrange(sizes), moves, first)
    want, want_moves, total = np.zeros((9, 3)), np.zeros((3, 3)), 0.0
    for s, n in zip((0, 4, 6), sizes):
        paths = list(itertools.product(range(3), repeat=int(n)))
        w = np.exp([first[y[0]] + sum(score[s + t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(y)) for y in paths])
        total += np.log(w.sum())
        for y, q in zip(paths, w / w.sum()):
            for t in range(n):
                want[s + t, y[t]] += q
            for a, b in itertools.pairwise(y):
                want_moves[a, b] += q
    assert np.allclose(p, want) and np.allclose(expected, want_moves) and np.isclose(log_z, total)


def test_language_odd_tables(spark, odd_docs, no_docs):
    rows = langid.predict(odd_docs, langid.fit(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r.lang_pred in ("en", "und") for r in rows)
    assert langid.predict(no_docs, langid.fit(no_docs)).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).filter("lang is null")
    assert {r.lang_pred for r in langid.predict(unlabelled, langid.fit(unlabelled)).collect()} == {"und"}


def test_long_sentence_is_one_chain(spark):
    """A sentence of 3,000 words without an end: its labels are those of one chain, over all words."""
    rnd = random.Random(4)
    model = langid.fit(spark.createDataFrame(corpus(rnd), "doc_id long, text string, lang string"))
    words = [w.strip(".") for w in (text(rnd, "aa", 1500) + " " + text(rnd, "bb", 1500)).split(" ")]
    total, n = langid.label_shares(model, [" ".join(words), "kato miru."], {"row": {}, "scores": None})
    score = langid._scores(model, [w.lower() for w in words])
    one = langid.arrange(np.array([len(words)]))
    p, _, _ = langid.forward_backward(score.astype(np.float32), one, model.moves.astype(np.float32), model.first.astype(np.float32))
    assert n.tolist() == [3000, 2] and np.allclose(total[0], p.sum(0), rtol=1e-4)


def test_toxicity_held_out(spark):
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        words = text(rnd, rnd.choice(list(SYLLABLES)), rnd.randint(10, 60)).split(" ")
        toxic = i % 6 == 0
        if toxic:  # half of them with a word that no fixed list knows
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "moron"]) if i % 12 else "grumpf" + rnd.choice(["el", "ig", "er"]))
        docs.append((i, " ".join(words)))
        if rnd.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "idiot " * 4000), (None, "a moron"), (5, "kato kato")]
    labels += [(5, 0, 0), (None, 1, 1), (2000, 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as _id", "0 as y").withColumn("fold", held_out())
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(df, truth, insults=("idiot", "moron")).collect()
    fold = {r.doc_id: r.fold for r in df.collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = [(r.predicted, int(r.doc_id % 6 == 0)) for r in rows if r.doc_id is not None and r.doc_id < 700 and fold[r.doc_id] and r.doc_id != 5]
    assert np.mean([a == b for a, b in seen]) > 0.97 and sum(a for a, _ in seen) > 10
    odd = {r.doc_id: r.predicted for r in rows if r.doc_id is None or r.doc_id >= 2000}
    assert odd == {2000: 0, 2001: 0, 2002: 1, None: 1}


def test_toxicity_rare_word(spark, monkeypatch):
    """A word of under 2 % of the toxic documents is learned, also where the classifier's sample is small."""
    monkeypatch.setattr(toxicity, "SAMPLE", 400)
    rnd = random.Random(7)
    kinds = [(0, [])] * 2600 + [(1, ["idiot"])] * 1400 + [(1, ["blorgon"])] * 26
    docs, labels = [], []
    for i, (toxic, extra) in enumerate(kinds):
        docs.append((i, " ".join([text(rnd, rnd.choice(list(SYLLABLES)), 12), *extra, text(rnd, "aa", 3)])))
        labels.append((i, toxic))
    new = [(9000 + k, f"{text(rnd, 'bb', 12)} {'blorgon' if k % 2 else 'kato'} {text(rnd, 'cc', 5)}") for k in range(20)]
    df = spark.createDataFrame(docs + new, "doc_id long, text string")
    rows = toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.predicted for r in rows if r.doc_id >= 9000} == {i: i % 2 for i, _ in new}
    assert np.mean([r.predicted == kinds[r.doc_id][0] for r in rows if r.doc_id < 9000]) > 0.99


def test_toxicity_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, toxic int")
    assert toxicity.score(no_docs, none).count() == 0
    for labels in (none, some):
        rows = toxicity.score(odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and not any(r.predicted for r in rows)


def test_toxicity_counts_pass_test_and_marks(spark):
    """Counts of ``mine`` and which features pass, by plain counting; the bitmap holds exactly what was put in."""
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(500):
        y = int(rnd.random() < 0.2)
        words = [rnd.choice("kato miru senne beral Vero tox".split()) + rnd.choice(["", "s", "ing", "!"]) for _ in range(rnd.randint(0, 12))]
        if y and rnd.random() < 0.5:
            words.append(rnd.choice(["grumpf", "grumpfel", "Blorg"]))
        docs.append((i, " ".join(words)))
        if rnd.random() < 0.9:
            labels.append((i, y))
    df = spark.createDataFrame(docs, "_id long, _t string")
    truth = spark.createDataFrame(labels, "_id long, y int").filter(~held_out("_id"))
    mined = toxicity.mine(df, truth)
    fold = {r._id: r.y for r in truth.collect()}
    t, c = collections.Counter(), collections.Counter()
    for i, text_ in docs:
        if i in fold:
            (t if fold[i] else c).update({f for w in text_.lower().split() for f in toxicity.word_features(w)})
    n1, n0 = sum(fold.values()), len(fold) - sum(fold.values())
    rate = n1 / (n1 + n0)
    k = next(k for k in range(1, n1) if k * -np.log(rate) >= np.log(max(1, sum(x >= k for x in t.values())) / toxicity.CHANCE))
    least = np.log(max(1, sum(x >= k for x in t.values())) / toxicity.CHANCE)
    passed = {}
    for f, a in t.items():
        b = c[f]
        tail = a * np.log(a / ((a + b) * rate)) + (b * np.log(b / ((a + b) * (1 - rate))) if b else 0)
        if a >= k and a * n0 >= 8 * b * n1 and tail >= least:
            passed[f] = a * (np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    order = sorted(passed, key=lambda f: (-round(passed[f], 9), f))
    assert mined and mined == toxicity.distinct_features([(f, t[f], c[f]) for f in order])
    marks = toxicity._marked(spark.range(1000).selectExpr("xxhash64(id) h"))
    have = {r.h & ((1 << toxicity.MARK_BITS) - 1) for r in spark.range(1000).selectExpr("xxhash64(id) h").collect()}
    assert {int(x) for x in np.flatnonzero(np.unpackbits(marks, bitorder="little"))} == have


def test_toxicity_label_model_sums(spark, monkeypatch):
    """One round of expectation-maximisation by plain sums over single documents."""
    monkeypatch.setattr(toxicity, "EM_ROUNDS", 2)
    rnd = random.Random(9)
    rows = []
    for _ in range(400):
        y = rnd.choice([0, 0, 1, None])
        rows.append((sorted(k for k in range(4) if rnd.random() < (0.6 if y else 0.2)), y))
    votes = spark.createDataFrame([(v, y, 1) for v, y in rows], "v array<int>, y int, n long")
    accuracy, say = toxicity.label_model(votes, 4, 3)
    known = [y for _, y in rows if y is not None]
    base = (sum(known) + 1) / (len(known) + 10)
    a = s = None
    for _ in range(2):
        toxic, total, one = np.zeros(5), np.zeros(5), np.zeros((5, 5))
        for v, y in rows:
            on = v if any(i < 3 for i in v) else [*v, 4]
            for i in on:
                for j in on:
                    one[i, j] += 1
            if y is None and s is None:
                continue
            p = y if y is not None else 1 / (1 + np.exp(-(np.log(base / (1 - base)) + sum(s[i] for i in on))))
            for i in on:
                toxic[i] += p
                total[i] += 1
        a = (toxic + 4 * base) / (total + 4)
        fires = np.maximum(np.diag(one), 1e-9)
        overlap = np.array([[1 if i == j else one[i, j] / np.sqrt(fires[i] * fires[j]) for j in range(5)] for i in range(5)])
        s = (np.log(a / (1 - a)) - np.log(base / (1 - base))) / np.clip((overlap**2).sum(1), 1, 4)
    assert np.allclose(accuracy, a) and np.allclose(say, s)
    w, b = toxicity.regress([[0], [0], [1], []], np.array([0.9, 0.9, 0.1, 0.5]), 2)
    prob = [1 / (1 + np.exp(-(x + b))) for x in (w[0], w[1], 0)]
    assert prob[0] > 0.85 and prob[1] < 0.15 and abs(prob[2] - 0.5) < 0.1
