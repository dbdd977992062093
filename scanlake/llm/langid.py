"""Language of every text by a linear-chain conditional random field over its words.

A word's score for each language is the sum of learned weights of its features: character 1- to 4-grams of ``^word$`` (those
that hold ``^`` or ``$`` are the affixes) and the word itself (the lexicon). Learned transitions tie neighbouring words of a
sentence, so that words both languages share follow their context and a switch of language costs what it
should. Forward-backward gives each word's label probabilities; a text's language is the one with the largest share.

Training: labelled documents outside the held-out fold, at most ``DOCS_PER_LANGUAGE`` of each language by a hash of the
id and ``SENTENCES_PER_DOC`` sentences of each by a hash of the sentence, which bounds what the driver holds; neighbouring
sentences of different languages are joined to one in ``SWITCHED`` of the cases, so that transitions see switches.
"""

from __future__ import annotations

import functools
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanlake.llm.tables import held_out, map_batches, map_texts, slices

DOCS_PER_LANGUAGE, SENTENCES_PER_DOC, SWITCHED = 300, 20, 0.25
#: Words of a sentence that are learned from, at most, and of a training chain joined from several.
SENTENCE_WORDS = 256
BITS = 16
ROUNDS = 40
#: Words whose scores a worker remembers; beyond it only those of the batch at hand stay.
REMEMBERED = 600_000
UNDETERMINED = "und"
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]")
_STOP = frozenset(".!?;\n")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x label
    first: np.ndarray


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x632BE5AB)) * _M1
    return (((h ^ (h >> np.uint64(32))) * _M2) >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after the other, and where each word's begin (one more at the end)."""
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.repeat(np.cumsum(size), size)
    position = np.arange(len(flat))
    word = np.repeat(np.arange(len(words)), size)
    slots, owner = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, 5):
        follows = np.minimum(position + n - 1, len(flat) - 1)
        h = h * _M2 + flat[follows] + np.uint64(1)
        inside = position + n <= end
        slots.append(_slots(h[inside], n))
        owner.append(word[inside])
    powers = np.cumprod(np.full(int(size.max(initial=1)), _M1))
    starts = np.cumsum(size) - size
    whole = np.add.reduceat((flat + np.uint64(1)) * powers[position - np.repeat(starts, size)], starts) if len(words) else np.zeros(0, np.uint64)
    slots.append(_slots(whole, 5))
    owner.append(np.arange(len(words)))
    slot, own = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(len(words) + 1))


def _chains(tokens: list[str]):
    """Lists of words between sentence ends, whatever their length (the recursion is linear in it)."""
    chain: list[str] = []
    for t in tokens:
        if t in _STOP:
            if chain:
                yield chain
            chain = []
        if t not in _STOP:
            chain.append(t)
    if chain:
        yield chain


class Chains(NamedTuple):
    """Chains by falling length, so that the ones still running at step t are the first ``running[t]``."""

    order: np.ndarray  # chains by falling length
    start: np.ndarray  # of each ordered chain in the list of words
    size: np.ndarray
    running: np.ndarray


def arrange(sizes: np.ndarray) -> Chains:
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    steps = int(size[0]) if len(size) else 0
    return Chains(order, start, size, np.searchsorted(-size, -np.arange(steps), "left"))


def forward_backward(score: np.ndarray, c: Chains, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label probabilities of each word, expected moves, log partition sum; all chains advance together."""
    e = np.exp(score - score.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    a, b = np.zeros_like(e), np.ones_like(e)
    log_z = float(score.max(1).sum()) + float(moves.max()) * int((c.size - 1).sum())
    state = None
    for t, n in enumerate(c.running.tolist()):
        at = c.start[:n] + t
        state = np.exp(first) * e[at] if t == 0 else (state[:n] @ step) * e[at]
        total = state.sum(1, keepdims=True)
        log_z += float(np.log(total).sum())
        state = state / total
        a[at] = state
    expected = np.zeros_like(step)
    for t in range(len(c.running) - 1, 0, -1):
        n = int(c.running[t])
        at = c.start[:n] + t
        later = b[at] * e[at]
        back = later @ step.T
        norm = (a[at - 1] * back).sum(1, keepdims=True)
        b[at - 1] = back / norm
        expected += (a[at - 1] / norm).T @ later * step
    p = a * b
    return p / p.sum(1, keepdims=True), expected, log_z


def train(chains: list[list[str]], labels: list[list[int]], names: list[str]) -> Model:
    """Weights by gradient steps (Adam) on the conditional likelihood with a small quadratic penalty."""
    k = len(names)
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for c in chains for w in c], np.int64)
    gold = np.array([y for c in labels for y in c], np.int64)
    sizes = np.array([len(c) for c in chains], np.int64)
    layout = arrange(sizes)
    slot, bounds = features(list(vocabulary))
    times = np.diff(bounds)
    params = [np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(word), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (gold[inner - 1], gold[inner]), 1)
    seen_first = np.bincount(gold[starts], minlength=k)
    one_hot = np.eye(k)[gold]
    for r in range(1, ROUNDS + 1):
        w, moves, first = params
        score = np.add.reduceat(w[slot], bounds[:-1], axis=0)[word]
        p, expected, _ = forward_backward(score, layout, moves, first)
        diff = p - one_hot
        by_word = np.stack([np.bincount(word, diff[:, j], len(vocabulary)) for j in range(k)], 1)
        spread = np.repeat(by_word, times, axis=0)
        grad_w = np.stack([np.bincount(slot, spread[:, j], 1 << BITS) for j in range(k)], 1)
        grads = [grad_w + 1e-2 * w, expected - seen_moves, p[starts].sum(0) - seen_first]
        for i, g in enumerate(grads):
            g = g / len(sizes)
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            params[i] = params[i] - 0.15 * (mean[i] / (1 - 0.9**r)) / (np.sqrt(var[i] / (1 - 0.99**r)) + 1e-6)
    return Model(names, params[0].astype(np.float32), params[1], params[2])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from text and non-null language of the rows outside the held-out fold; without any, no label is known."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang")).filter(~held_out("_id") & F.col("_lang").isNotNull() & F.col("_t").isNotNull())
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    # a bounded sample per language: ids by hash below a threshold that keeps about DOCS_PER_LANGUAGE
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for name in names:
        chosen = chosen | ((F.col("_lang") == name) & (draw < int(min(1.0, DOCS_PER_LANGUAGE / counts[name]) * (1 << 30))))

    def sentences(batches):
        for batch, texts in slices(batches, "_t"):
            out, langs = [], []
            for t, lang in zip(texts, batch.column("_lang").to_pylist()):
                found = list(_chains(_TOKENS.findall(t.lower())))
                found.sort(key=lambda c: zlib.crc32(" ".join(c).encode("utf-8", "surrogatepass")))
                out += [" ".join(c[:SENTENCE_WORDS]) for c in found[:SENTENCES_PER_DOC]]
                langs += [lang] * min(len(found), SENTENCES_PER_DOC)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["lang", "s"])

    sample = sorted((r["s"], r["lang"]) for r in map_batches(rows.filter(chosen).select("_t", "_lang"), sentences, "lang string, s string").collect())
    if not sample:
        return Model(names, np.zeros((1 << BITS, len(names)), np.float32), np.zeros((len(names),) * 2), np.zeros(len(names)))
    number = {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(11)
    mixed = [sample[i] for i in rng.permutation(len(sample))]
    chains: list[list[str]] = []
    labels: list[list[int]] = []
    join = rng.random(len(mixed)) < SWITCHED
    for (s, lang), joined in zip(mixed, join.tolist()):
        words = s.split(" ")
        if joined and chains and len(chains[-1]) + len(words) <= SENTENCE_WORDS:
            chains[-1] = chains[-1] + words
            labels[-1] = labels[-1] + [number[lang]] * len(words)
        else:
            chains.append(words)
            labels.append([number[lang]] * len(words))
    return train(chains, labels, names)


@functools.lru_cache(maxsize=1)
def _memory(key: bytes) -> dict:
    return {"row": {}, "scores": None}


def _scores(m: Model, words: list[str]) -> np.ndarray:
    slot, bounds = features(words)
    return np.add.reduceat(m.weights[slot], bounds[:-1], axis=0)


def label_shares(m: Model, texts: list[str], memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """Per text the summed label probabilities of its words, and the number of words."""
    k = len(m.labels)
    row = memory["row"]
    cut = [_TOKENS.findall(t.lower()) for t in texts]
    words = set().union(*cut) - _STOP if cut else set()
    new = [w for w in words if w not in row]
    if len(row) + len(new) > REMEMBERED:
        row.clear()
        memory["scores"] = None
        new = list(words)
    new = [w for w in new if any(map(str.isalpha, w))]  # digits and marks outside 0-9 count as word characters, too
    if new:
        base = len(row)
        row.update(zip(new, range(base, base + len(new))))
        scores = np.concatenate([_scores(m, new[i : i + 50_000]) for i in range(0, len(new), 50_000)])
        held = memory["scores"]
        if held is None or len(held) < base + len(new):
            grown = np.zeros((max(2 * base, base + len(new)), k), np.float32)
            if base:
                grown[:base] = held[:base]
            memory["scores"] = held = grown
        held[base : base + len(new)] = scores
    # numbers of all words of all texts, -1 for a sentence end (and for what has no letter)
    flat, owner = [], []
    for i, tokens in enumerate(cut):
        flat.append(np.fromiter((row.get(t, -1) for t in tokens), np.int64, len(tokens)))
        flat.append(np.array([-1]))
        owner.append(np.full(len(tokens) + 1, i))
    ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    text = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    is_word = ids >= 0
    run = np.cumsum(~is_word)[is_word]  # words with one number stand in one sentence
    ids, text = ids[is_word], text[is_word]
    total, n = np.zeros((len(texts), k)), np.bincount(text, minlength=len(texts))
    if len(ids):
        begins = np.flatnonzero(np.diff(run, prepend=-1))
        p, _, _ = forward_backward(memory["scores"][ids], arrange(np.diff(np.append(begins, len(run)))), m.moves.astype(np.float32), m.first.astype(np.float32))
        total = np.stack([np.bincount(text, p[:, j], len(texts)) for j in range(k)], 1)
    return total, n


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words) of every whole text: the label with the largest share of the words, and that share.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned. Ties go to the label that
    sorts first.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        m = held.value
        if not m.labels:
            best, share, n = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts)
        else:
            total, n = label_shares(m, texts, _memory(m.moves.tobytes() + m.weights[::4096].tobytes()))
            top = total.argmax(1)
            best = [m.labels[j] if k else UNDETERMINED for j, k in zip(top.tolist(), n.tolist())]
            share = np.clip(total[np.arange(len(n)), top] / np.maximum(n, 1), 0, 1).tolist()
            n = n.tolist()
        return {"_id": ids, "lang_pred": pa.array(best, pa.string()), "score": pa.array(share, pa.float64()), "n_words": pa.array(n, pa.int64())}

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, run, f"_id {kind}, lang_pred string, score double, n_words long").withColumnRenamed("_id", id_col)
