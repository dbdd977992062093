"""Toxicity by weak supervision: many simple voters, a generative label model, and a linear classifier on its posteriors.

Voters. Lexicon voters fire on a word or on how words begin or end; they are mined from all labelled documents of the training fold (per
feature: in how many toxic and clean documents), next to words that the caller names. The best vote by themselves, the other precise ones in
a pool, however rare they are. Pattern voters look at shouting, symbols and
repetition. One voter speaks for "clean": no lexicon voter fired.

Label model. A voter that does not fire says nothing. The accuracy of a voter is the share of toxic documents among those it
fires on, known where labels are and expected where they are not, so it is estimated by expectation-maximisation over all
documents; pairwise co-firing gives correlations, and a voter's say is divided by how much it overlaps with others. All
counts are sums over all documents, taken on the distinct combinations of votes.

Classifier. Logistic regression on all features of a bounded sample of training documents, against the posteriors. The sample
takes documents of rare features more often, by as much as they then weigh less.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.tables import held_out, map_batches, map_texts, slices
from scanlake.scale import stable

#: Labelled documents that the classifier is trained on, at most (about), before those drawn for rare features.
SAMPLE = 20_000
#: Labelled documents of each feature that are drawn, at least (about), where there are as many.
OF_FEATURE = 25
#: Mined features, and how many of them are voters of their own; others vote in pools by the least share of toxic documents.
FEATURES, VOTERS, POOLS = 2048, 60, (0.95,)
#: Features with the largest gain, before those that say the same are left out.
CANDIDATES = 8000
#: Chance that any feature at all passes without a cause.
CHANCE = 0.05
#: Bits of the bitmaps that tell toxic documents and able features from the rest before the exact join; features a task counts at a time.
MARK_BITS, COUNTERS = 26, 250_000
EM_ROUNDS = 4
#: Words whose features a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…"
_SHOUT = re.compile(r"!{2,}|\?{2,}")
PATTERNS = ("shouting", "many_symbols", "exclaims", "insult_nearby_you")


class Lexicon(NamedTuple):
    features: list[str]  # "w:word", "p:prefix", "s:suffix"
    insults: tuple[str, ...] = ()  # words that the caller knows to be insults

    @property
    def names(self) -> list[str]:
        return [*self.features, *PATTERNS]


class Model(NamedTuple):
    lexicon: Lexicon
    accuracies: np.ndarray  # of the voters
    say: np.ndarray
    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[str]:
    w = word.strip(_STRIP)
    if len(w) < 3:
        return [f"w:{w}"] if w else []
    return [f"w:{w}", *[f"p:{w[:k]}" for k in range(3, min(6, len(w)) + 1)], *[f"s:{w[-k:]}" for k in range(3, min(6, len(w)) + 1)]]


def _marked(hashes: DataFrame) -> np.ndarray:
    """Which of ``1 << MARK_BITS`` places the hashes (one column h) fall on, as bytes of bits; at most 8 MB however many there are."""
    place = F.pmod("h", F.lit(1 << MARK_BITS))
    pieces = hashes.select(F.shiftright(place, 15).alias("b"), place.bitwiseAND(F.lit(32767)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    for r in pieces:  # 4,096 bytes each
        out[r["b"] * 4096 : r["b"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _is_marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.astype(np.int64) & np.int64((1 << MARK_BITS) - 1)
    return (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def _word_set(text: str) -> str:
    return " ".join(dict.fromkeys(text.lower().split()))


def _counted(known: DataFrame, marks=None) -> DataFrame:
    """(feature, n): documents of ``known`` (_t: a word set) that have each feature; with marks (a broadcast) of marked features only."""
    def count(batches):
        import xxhash

        place, bits = (1 << MARK_BITS) - 1, marks.value.tobytes() if marks is not None else b""

        def features(word: str) -> tuple:
            found = word_features(word)
            if not bits:
                return tuple(found)
            at = [xxhash.xxh64_intdigest(f, 42) & place for f in found]
            return tuple(f for f, p in zip(found, at) if bits[p >> 3] >> (p & 7) & 1)

        found: Counter = Counter()
        memory: dict[str, tuple] = {}
        for _, texts in slices(batches, "_t"):
            for t in texts:
                have: set[str] = set()
                for w in t.split():
                    got = memory.get(w)
                    if got is None:
                        got = memory[w] = features(w)
                    have.update(got)
                found.update(have)
                if len(memory) > REMEMBERED // 4:
                    memory.clear()
            if len(found) > COUNTERS:
                yield _counts(found)
                found = Counter()
        yield _counts(found)

    return map_batches(known, count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def least_documents(by_count: dict[int, int], rate: float) -> tuple[int, int]:
    """(k, features that are in k or more toxic documents): the least k with which a feature that is in no clean document passes.

    Features in fewer can't pass whatever else holds and don't count as tests (Tarone's correction).
    """
    left = sum(by_count.values())
    for k in range(1, max(by_count, default=0) + 1):
        if k * -np.log(rate) >= np.log(max(1, left) / CHANCE):
            return k, left
        left -= by_count.get(k, 0)
    return max(by_count, default=0) + 1, 0


def mine(docs: DataFrame, truth: DataFrame) -> list[tuple[str, int, int]]:
    """(feature, toxic, clean) documents of features that are frequent among toxic documents and rare among clean ones; best by weighted log ratio.

    ``docs`` has (_id, _t), ``truth`` (_id, y); all documents with a label are counted. A feature passes if so many toxic ones among its
    documents are unlikely at the common rate (Chernoff's bound on the binomial tail, shared among all features that could pass).
    Two passes: the features of toxic documents first, then those of them that could pass, over the clean documents. Toxic documents are
    told from the rest by a bitmap of fixed size before their texts move, and for certain by the join.
    """
    def words(ids, texts):
        return {"_id": ids, "_t": pa.array([_word_set(t) for t in texts], pa.string())}

    def toxic_words(batches):
        for batch, texts in slices(batches, "_t"):
            rows = np.flatnonzero(_is_marked(toxic_marks.value, batch.column("h").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(rows)), pa.array([_word_set(texts[i]) for i in rows], pa.string())], names=["_id", "_t"])

    n = {r["y"]: r["n"] for r in truth.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return []
    sc, kind = docs.sparkSession.sparkContext, docs.schema["_id"].dataType.simpleString()
    train = docs.filter(~held_out("_id"))
    toxic, clean = (truth.filter(F.col("y") == y).select("_id") for y in (1, 0))
    toxic_marks = sc.broadcast(_marked(toxic.select(F.xxhash64("_id").alias("h"))))
    near = map_batches(train.select("_id", "_t", F.xxhash64("_id").alias("h")), toxic_words, f"_id {kind}, _t string")
    t = stable(_counted(near.join(toxic.hint("merge"), "_id").select("_t")).withColumnRenamed("n", "t"))
    top = 1 << 10
    by_count = {r["k"]: r["n"] for r in t.groupBy(F.least("t", F.lit(top)).alias("k")).agg(F.count("*").alias("n")).collect()}
    rate = n[1] / (n[1] + n[0])
    k, tested = least_documents(by_count, rate)
    least = float(np.log(max(1, tested) / CHANCE))
    able = t.filter(F.col("t") >= k)
    marks = sc.broadcast(_marked(able.select(F.xxhash64("feature").alias("h"))))
    known = map_texts(train, "_id", "_t", words, f"_id {kind}, _t string").join(clean.hint("merge"), "_id").select("_t")
    both_counts = able.join(_counted(known, marks).withColumnRenamed("n", "c"), "feature", "left").select("feature", "t", F.coalesce("c", F.lit(0)).alias("c"))
    both = F.col("t") + F.col("c")
    unlikely = F.col("t") * F.log(F.col("t") / (both * rate)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - rate)))).otherwise(0.0)
    ratio = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    fine = both_counts.filter(F.col("t") * n[0] >= 8 * F.col("c") * n[1]).filter(unlikely >= least).withColumn("gain", F.col("t") * ratio)
    best = fine.orderBy(F.desc("gain"), "feature").limit(CANDIDATES).collect()
    for b in (toxic_marks, marks):
        b.unpersist()
    return distinct_features([(r["feature"], r["t"], r["c"]) for r in best])[:FEATURES]


def distinct_features(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Leave out a feature that says the same as a better one: one text holds the other and the counts are about equal."""
    kept: list[tuple[str, int, int]] = []
    for f, t, c in found:
        core = f[2:]
        if not any((core in k[2:] or k[2:] in core) and abs(t - a) <= 0.05 * max(t, a) + 1 for k, a, _ in kept):
            kept.append((f, t, c))
    return kept


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"])


def _patterns(text: str, n: int, upper: int, symbols: int) -> list[int]:
    """Numbers of the pattern voters that a text of n words fires by itself."""
    fired_ = [upper > 0.5 * max(1, n), symbols > 0.5 * max(1, n), bool(_SHOUT.search(text))]
    return [k for k, yes in enumerate(fired_) if yes]


def firing(lexicon: Lexicon, texts: list[str], memory: dict[str, tuple]) -> list[list[int]]:
    """Numbers of the features that fire on each text. ``memory`` keeps what a word has: features, upper case, symbols."""
    by_kind: dict[str, dict[str, int]] = {"w": {}, "p": {}, "s": {}}
    for i, f in enumerate(lexicon.features):
        by_kind[f[0]][f[2:]] = i
    whole, prefix, suffix = by_kind.values()
    base = len(lexicon.features)
    insult = {whole[w] for w in lexicon.insults if w in whole}

    def look(word: str) -> tuple:
        w = word.lower().strip(_STRIP)
        got = [whole[w]] if w in whole else []
        for k in range(3, min(6, len(w)) + 1):
            if (head := w[:k]) in prefix:
                got.append(prefix[head])
            if (tail := w[-k:]) in suffix:
                got.append(suffix[tail])
        upper = len(word) > 1 and word.isupper()
        symbols = len(word) > 1 and not word[-1].isalnum() and not word[-2].isalnum()
        return (got, upper, symbols) if got or upper or symbols else ()

    out = []
    for t in texts:
        words = set(t.split())
        found: set[int] = set()
        upper = symbols = 0
        for w in words:
            got = memory.get(w)
            if got is None:
                got = memory[w] = look(w)
            if got:
                found.update(got[0])
                upper += got[1]
                symbols += got[2]
        extra = _patterns(t, len(words), upper, symbols)
        if found & insult and ("you" in words or "You" in words):
            extra.append(3)
        out.append(sorted(found) + [base + k for k in extra])
        if len(memory) > REMEMBERED:
            memory.clear()
    return out


def fired(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(_id, _carried, fired) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    docs = docs.select(F.struct("_id", "_carried").alias("_id"), "_t")
    memory: dict[str, tuple] = {}

    def run(ids, texts):
        return {"_id": ids, "fired": pa.array(firing(held.value, texts, memory), pa.list_(pa.int32()))}

    hits = map_texts(docs, "_id", "_t", run, f"_id {docs.schema['_id'].dataType.simpleString()}, fired array<int>")
    return hits.select("_id._id", "_id._carried", "fired")


def voters(lexicon: Lexicon, mined: list[tuple[str, int, int]]) -> tuple[list[int], int, int]:
    """The voter of each feature (-1: none), how many voters are of the lexicon (they come first), and how many there are.

    The best mined features, all named insults and all patterns are voters of their own; of the others those in toxic documents
    mostly share one for each pool, and the rest, about as often in clean ones, are for the classifier only.
    """
    fixed = {f"w:{w}" for w in lexicon.insults}
    pool = {f: next((f"pool {p}" for p in POOLS if t >= p * (t + c)), None) for f, t, c in mined[VOTERS:]}
    names = [f if i < VOTERS or f in fixed else pool[f] for i, f in enumerate(lexicon.features)]
    number = {name: k for k, name in enumerate(dict.fromkeys(n for n in names if n))}
    return [number.get(n, -1) for n in names] + [len(number) + k for k in range(len(PATTERNS))], len(number), len(number) + len(PATTERNS)


def label_model(votes: DataFrame, n_voters: int, lexicon_votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies and say (log odds over overlap) of the voters and, last, of the silence of all lexicon voters.

    ``votes`` has (v array<int>, y int or null, n long): distinct vote combinations with counts over all documents.
    """
    j = n_voters + 1
    totals = votes.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y").isNotNull(), F.col("n"))).alias("known"), F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("toxic")).first()
    base = ((totals["toxic"] or 0) + 1) / ((totals["known"] or 0) + 10)
    # a voter starts with the accuracy among labelled documents, pulled to the base rate (a known insult to one half)
    accuracy, say = None, np.zeros(j)
    for r in range(EM_ROUNDS):
        current = (accuracy, say, base)

        def sums(batches, current=current, first=r == 0):
            one = np.zeros((j, j))  # co-firing
            toxic, known = np.zeros(j), np.zeros(j)
            for b in batches:
                for v, y, n in zip(b.column("v").to_pylist(), b.column("y").to_pylist(), b.column("n").to_pylist()):
                    on = with_silence(v, lexicon_votes, j)
                    one[np.ix_(on, on)] += n
                    if y is None and first:
                        continue
                    p = y if y is not None else posterior(on, current[1], current[2])
                    toxic[on] += n * p
                    known[on] += n
            a, b2 = np.nonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b2), pa.array(one[a, b2])], names=["a", "b", "s"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j, -1)), pa.array(np.arange(j)), pa.array(toxic)], names=["a", "b", "s"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j, -2)), pa.array(np.arange(j)), pa.array(known)], names=["a", "b", "s"])

        one, toxic, known = np.zeros((j, j)), np.zeros(j), np.zeros(j)
        for row in map_batches(votes.select("v", "y", "n"), sums, "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():  # (j + 2) * j sums
            if row["a"] == -1:
                toxic[row["b"]] = row["s"]
            elif row["a"] == -2:
                known[row["b"]] = row["s"]
            else:
                one[row["a"], row["b"]] = row["s"]
        accuracy = (toxic + 4 * base) / (known + 4)
        times = np.maximum(np.diag(one), 1e-9)
        overlap = one / np.sqrt(times[:, None] * times[None, :])  # correlation of firing, 1 on the diagonal
        overlap[np.arange(j), np.arange(j)] = 1
        # a voter counts against overlapping voters by the square of the correlation
        say = (np.log(accuracy / (1 - accuracy)) - np.log(base / (1 - base))) / np.minimum(np.maximum((overlap**2).sum(1), 1), 4)
    return accuracy, say


def with_silence(v: list[int], lexicon_votes: int, j: int) -> list[int]:
    return list(v) if any(i < lexicon_votes for i in v) else [*v, j - 1]


def posterior(on: list[int], say: np.ndarray, base: float) -> float:
    x = np.log(base / (1 - base)) + say[on].sum()
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def regress(rows: list[list[int]], target: np.ndarray, size: int, weight: np.ndarray | None = None, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features against posteriors, by accelerated gradient steps with a small penalty."""
    own = np.repeat(np.arange(len(rows)), [len(on) for on in rows])
    flat = np.array([f for on in rows for f in on], np.int64)
    share = np.full(len(rows), 1 / len(rows)) if weight is None else weight / weight.sum()
    mean_target = float(share @ target)
    penalty = np.minimum(1e-4, 0.02 * np.bincount(flat, share[own], size))  # a rare feature is not held down by its rarity
    w, b = np.zeros(size), float(np.log((mean_target + 1e-3) / (1 - mean_target + 1e-3)))
    mean, var = np.zeros(size + 1), np.zeros(size + 1)
    for r in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(own, w[flat], len(rows)) + b, -30, 30)))
        d = (p - target) * share
        g = np.append(np.bincount(flat, d[own], size) + penalty * w, d.sum())
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        move = 0.1 * (mean / (1 - 0.9**r)) / (np.sqrt(var / (1 - 0.99**r)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _documents(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.struct(F.lit(0).alias("_"), *carry).alias("_carried"))


def truth_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, y) outside the held-out fold; several labels of one document: the majority, ties toxic."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("y")).filter("y is not null").filter(~held_out("_id"))
    return known.groupBy("_id").agg(F.avg(F.col("y").cast("double")).alias("y")).select("_id", (F.col("y") >= 0.5).cast("int").alias("y"))


def _sample(known: DataFrame, size: int) -> tuple[list[list[int]], np.ndarray | None]:
    """What fires on drawn documents and how many documents each stands for: about SAMPLE of all and OF_FEATURE of each feature."""
    total = known.count()
    if not total:
        return [], None
    times = {r["f"]: r["n"] for r in known.select(F.explode("fired").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()}  # one row a feature
    share = min(1.0, SAMPLE / total)
    each = F.lit([max(share, min(1.0, OF_FEATURE / times.get(f, total))) for f in range(size)])
    chance = F.coalesce(F.array_max(F.transform("fired", lambda f: F.element_at(each, f + 1))), F.lit(share))
    drawn = known.withColumn("chance", chance).filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.col("chance") * (1 << 30))
    rows = drawn.select("fired", "chance").collect()  # about SAMPLE and OF_FEATURE times the features at most
    return [r["fired"] for r in rows], np.array([1 / r["chance"] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", insults: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> tuple[Model, DataFrame]:
    """The model, and what fires on every document (written to the checkpoint folder, for scoring)."""
    texts = _documents(docs, id_col, text_col, carry)
    truth = stable(truth_of(labels, id_col, label_col))
    mined = mine(texts, truth)
    fixed = [f"w:{w}" for w in insults]
    names = [f for f, _, _ in mined]
    lexicon = Lexicon([*names, *[f for f in fixed if f not in names]], tuple(insults))
    hits = stable(fired(texts, lexicon))
    voter, lexicon_votes, j = voters(lexicon, mined)
    number = F.lit(voter)
    votes = F.array_sort(F.array_distinct(F.filter(F.transform("fired", lambda f: F.element_at(number, f + 1)), lambda v: v >= 0)))
    combos = stable(hits.select("_id", votes.alias("v")).join(truth, "_id", "left").groupBy("v", "y").agg(F.count("*").alias("n")))
    accuracy, say = label_model(combos, j, lexicon_votes)
    known, weight = _sample(hits.join(truth.select("_id"), "_id"), len(lexicon.names))
    counts = combos.agg(F.sum(F.when(F.col("y").isNotNull(), F.col("n"))).alias("k"), F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("t")).first()
    base = ((counts["t"] or 0) + 1) / ((counts["k"] or 0) + 10)
    if not known:  # nothing to train on: examples with one voter each, at the posteriors that the list's own prior gives
        known = [[i] for i, f in enumerate(lexicon.features) if f in fixed] + [[]] * 20
        target = np.array([0.9] * (len(known) - 20) + [0.02] * 20)
    else:
        target = np.array([posterior(with_silence(sorted({voter[f] for f in on} - {-1}), lexicon_votes, j + 1), say, base) for on in known])
    w, b = regress(known, target, len(lexicon.names), weight)
    return Model(lexicon, accuracy, say, w, b), hits


def scored(hits: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) from what fires: the classifier's probability; empty texts get that of silence."""
    weights = [float(x) for x in model.weights]

    def run(batches):
        w = np.array(weights)
        for b in batches:
            lists = b.column("fired")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(size)), size)
            x = np.bincount(own, w[lists.flatten().to_numpy(zero_copy_only=False)], len(size)) + model.bias
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_carried"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["_id", "_carried", "score", "predicted"])

    kind, carried = (hits.schema[c].dataType for c in ("_id", "_carried"))
    out = map_batches(hits.select("_id", "_carried", "fired"), run, f"_id {kind.simpleString()}, _carried {carried.simpleString()}, score double, predicted int")
    return out.select(F.col("_id").alias(id_col), *[f"_carried.{c}" for c in carried.names if c != "_"], "score", "predicted")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", insults: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, score, predicted) of every row of ``docs``: learned on the training fold of ``labels``, applied to all.

    ``carry`` names columns to hand through, such as a row's own key. ``insults`` are words the caller knows to be toxic; none by default, all words are learned. One row per row: repeated rows score alike, a null text like
    an empty one, a row without an id is scored but not learned from. Null labels are no labels; of several the majority counts. Other columns are not read.
    """
    model, hits = fit(docs, labels, id_col, text_col, label_col, insults, carry)
    return scored(hits, model, id_col)
