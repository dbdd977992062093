"""Search and rule scans that touch few lines: a trigram index over files, and one automaton over the words that rules need.

Index. Posting rows say which file holds which three letters in a row (lower case, inside one line). A search draws the literals
that its expression needs, looks their trigrams up, and reads only the files that hold them all; the expression itself decides. New or
changed files are added batch by batch: postings of a file's earlier text only make it a candidate in vain, never hide it.
Expressions that need no literal of three letters fall back to the scan.

Many rules. Every rule has one literal (or one set of them) that its lines must hold. A Bloom filter over the literals' first 16 letters goes to the
executors; a line gives one row per literal that it may hold, those rows meet the rules by the literal's hash, and the JVM's expression decides, so the
result is that of testing every rule. Lines are read once, however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.required import EDGE, edged, grams, required
from ..scale import ensure_checkpoint_dir, stable
from ..session import ship
from .patterns import explode_lines

#: Candidate files that are named in the scan's filter (so that Parquet can skip the others); more of them are joined.
NAMED = 1_000
#: Bytes of expressions up to which the rules are sent to every executor; more of them are joined.
LOT_BYTES = 8 << 20
#: Letters of a literal that are looked up; rules without a literal that one expression tests.
LOOK, LOT_RULES = 16, 500
#: Bits of the filter for a literal, its largest and smallest size as powers of two, bits of one piece, and probes.
BITS, MOST_BITS, LEAST_BITS, PIECE_BITS, PROBES = 24, 30, 16, 16, 3


# ---- trigram index -----------------------------------------------------------------------------------------

def postings(files: DataFrame) -> DataFrame:
    """(gram, path): the trigrams of each file, each once."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(?=([^\r\n]{3}))"), 1))
    return files.select(F.explode(found).alias("gram"), "path")


def add_to_index(files: DataFrame, index: str) -> None:
    """Append a batch of new or changed files. Files are sorted by gram, so a lookup reads a few row groups of each."""
    postings(files).repartitionByRange("gram", "path").sortWithinPartitions("gram", "path").write.mode("append").parquet(index)


def compact_index(index: str, files: DataFrame, out: str) -> None:
    """A new index of the files as they are now, without the postings of earlier texts."""
    add_to_index(files, out)


def candidates(spark, index: str, pattern: str) -> DataFrame | None:
    """(path) of files that hold what the expression needs; None if it needs nothing that the index knows."""
    needs = required(pattern)
    if not needs:
        return None
    rows = [(i, word, g, len(grams(word))) for i, words in enumerate(needs) for word in sorted(words) for g in sorted(grams(word))]
    wanted = spark.createDataFrame(rows, "need int, word string, gram string, n int")  # as long as the expression
    hits = spark.read.parquet(index).filter(F.col("gram").isin(sorted({r[2] for r in rows}))).distinct().join(F.broadcast(wanted), "gram")
    words = hits.groupBy("path", "need", "word").agg(F.count("*").alias("held"), F.first("n").alias("n")).filter("held = n")
    return words.groupBy("path").agg(F.countDistinct("need").alias("met")).filter(F.col("met") == len(needs)).select("path")


def indexed_search(files: DataFrame, index: str, pattern: str, limit: int | None = 50) -> DataFrame:
    """Case-insensitive search as ``patterns.corpus_search``: (path, line, first 300 characters), first ``limit`` by path and line.

    The limit is the feature (a top-k report); None gives all lines.
    """
    at = candidates(files.sparkSession, index, pattern)
    if at is not None:
        names = [r["path"] for r in at.limit(NAMED + 1).collect()]
        files = files.filter(F.col("path").isin(names)) if len(names) <= NAMED else files.join(at, "path", "left_semi")
    lines = explode_lines(files.select("path", "content")).filter(F.col("text").rlike(f"(?i){pattern}"))
    found = lines.select("path", "line", F.substring("text", 1, 300).alias("text"))
    return found if limit is None else found.orderBy("path", "line").limit(limit)


# ---- many rules --------------------------------------------------------------------------------------------

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _kinds(word: str) -> tuple[bytes, int]:
    """The letters of a literal that are looked up, and their kind: length and the ends at which a word edge must be."""
    left, right, plain = word[:1] == EDGE, word[-1:] == EDGE, word.strip(EDGE)
    right = right and len(plain) <= LOOK
    letters = plain[:LOOK].encode()
    return letters, (len(letters) - 3) * 4 + 2 * left + right


def _hashes(data: np.ndarray, at: np.ndarray, kind: int) -> np.ndarray:
    """64-bit hash of the letters of a kind that begin at each position."""
    h = np.full(len(at), kind + 1, np.uint64)
    for j in range(kind // 4 + 3):
        h = h * _STEP + data[at + j]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _hash(letters: bytes, kind: int) -> int:
    """``_hashes`` of one literal, as a signed number."""
    h, most = kind + 1, (1 << 64) - 1
    for b in letters:
        h = (h * int(_STEP) + b) & most
    h ^= h >> 32
    h = h * int(_MIX) & most
    h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of a hash in a filter of 2 to the power of ``bits``."""
    return (h + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)


def _looked_up(rules: DataFrame) -> DataFrame:
    """``rules`` with _keys, _heads and _kinds: hash, first three letters (as a number) and kind of each literal; empty where a rule needs none."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, heads, kinds = [], [], []
            size = lambda words: min(len(w.strip(EDGE)) for w in words)
            for pattern in batch.column("pattern").to_pylist():
                needs = edged(pattern)
                looked = sorted({_kinds(w) for w in max(needs, key=lambda n: (size(n), -len(n)))}) if needs else []
                keys.append([_hash(b, k) for b, k in looked])
                heads.append([b[0] << 14 | b[1] << 7 | b[2] for b, _ in looked])
                kinds.append([k for _, k in looked])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "_keys", "_heads", "_kinds"])

    empty = rules.sparkSession.createDataFrame([], rules.schema)
    schema = empty.select("*", F.array().cast("array<long>").alias("_keys"), F.array().cast("array<int>").alias("_heads"), F.array().cast("array<int>").alias("_kinds")).schema
    return rules.mapInArrow(find, schema)


def _filter(keys: DataFrame, n: int) -> tuple[int, bytes]:
    """(size as a power of two, bits) of a Bloom filter over n hashes; its pieces are made by the executors."""
    bits = min(max((n * BITS).bit_length(), LEAST_BITS), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(PROBES):
                p = _probe(h, k, bits)
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(PIECE_BITS)).astype(np.int32)), pa.array((p & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int32))], names=["piece", "bit"])

    def marked(rows: pa.Table) -> pa.Table:
        held = np.zeros(1 << PIECE_BITS, np.uint8)
        held[rows.column("bit").to_numpy()] = 1
        return pa.table({"piece": pa.array([rows.column("piece")[0].as_py()], pa.int32()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    pieces = keys.mapInArrow(places, "piece int, bit int").groupBy("piece").applyInArrow(marked, "piece int, held binary")
    out = bytearray(1 << (bits - 3))
    width = 1 << (PIECE_BITS - 3)
    for r in pieces.toLocalIterator():
        out[r["piece"] * width:(r["piece"] + 1) * width] = r["held"]
    return bits, bytes(out)


def many_rules(lines: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` columns and (rule_no, rule_id) for every line and rule that match; any number of rules.

    ``rules(rule_no, rule_id, pattern)``: a whole number of its own for each rule; expressions as the JVM reads them. A null text or pattern matches nothing.
    """
    ship(lines.sparkSession)
    rules = stable(_looked_up(rules.select("rule_no", "rule_id", "pattern").filter("pattern is not null")))
    size = F.coalesce(F.sum(F.octet_length("pattern") + 64), F.lit(0))
    of = rules.agg(size.alias("b"), F.count(F.when(F.size("_keys") == 0, 1)).alias("plain"), F.coalesce(F.sum(F.size("_keys")), F.lit(0)).alias("keys"), F.coalesce(F.max(F.size("_keys")), F.lit(0)).alias("most")).first()
    out = lines.select("*", F.lit(None).cast(rules.schema["rule_no"].dataType).alias("rule_no"), F.lit(None).cast("string").alias("rule_id")).limit(0)
    if of["keys"]:
        found = _by_word(lines, rules.filter(F.size("_keys") > 0), of["keys"], of["most"] > 1, of["b"] <= LOT_BYTES, text)
        out = found
    lots = -(-of["plain"] // LOT_RULES)
    for i in range(lots):  # no word to look for: the line is tested against each
        lot = rules.filter((F.size("_keys") == 0) & (F.pmod(F.xxhash64("rule_no"), F.lit(lots)) == i)).select("rule_no", "rule_id", "pattern").collect()
        if not lot:
            continue
        rest = F.filter(F.array(*[F.struct(F.lit(r["rule_no"]).alias("no"), F.lit(r["rule_id"]).alias("id"), F.col(text).rlike(r["pattern"]).alias("yes")) for r in lot]), lambda x: x["yes"])
        plain = lines.filter(F.col(text).isNotNull()).withColumn("_m", F.explode(rest)).select(*lines.columns, F.col("_m.no").alias("rule_no"), F.col("_m.id").alias("rule_id"))
        out = out.unionByName(plain)
    return out


def _by_word(lines: DataFrame, rules: DataFrame, n: int, several: bool, small: bool, text: str) -> DataFrame:
    """Matches of the rules that need a literal; ``several``: some need one of a set, so a line may hold two literals of one rule."""
    spark = lines.sparkSession
    each = rules.select(F.explode(F.arrays_zip(F.col("_keys").alias("k"), F.col("_heads").alias("h"), F.col("_kinds").alias("t"))).alias("x"))
    bits, held = _filter(each.select(F.col("x.k").alias("k")), n)
    # at most 2 to the power of 21 rows: three ASCII letters, with the kinds that begin so
    heads = [(r["h"], r["m"]) for r in each.groupBy(F.col("x.h").alias("h")).agg(F.bit_or(F.expr("shiftleft(1L, x.t)")).alias("m")).toLocalIterator()]
    sent = spark.sparkContext.broadcast((bits, held, heads))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, heads = sent.value
        marks = np.frombuffer(held, np.uint8)
        masks = np.zeros(1 << 21, np.uint64)
        for h, m in heads:
            masks[h] = m & (1 << 64) - 1
        kinds = [k for k in range(4 * (LOOK - 2)) if any(m >> k & 1 for _, m in heads)]
        word = np.zeros(256, bool)
        word[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = True
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            ends = np.cumsum(np.array([0, *map(len, texts)], np.int64))
            raw = np.frombuffer(b"".join(texts), np.uint8)
            total = len(raw)
            ascii_ = np.concatenate([raw & 127, np.zeros(LOOK, np.uint8)]).astype(np.int64)
            head = ascii_[:total] << 14 | ascii_[1:total + 1] << 7 | ascii_[2:total + 2]
            at = np.flatnonzero(masks[head])
            row = np.searchsorted(ends, at, side="right") - 1
            mask = masks[head[at]]
            data = np.concatenate([raw, np.zeros(LOOK, np.uint8)]).astype(np.uint64)
            in_word = np.concatenate([word[raw], np.zeros(LOOK, bool)]) if total else np.zeros(LOOK, bool)
            loose = np.array(batch.column("_loose").to_pylist(), bool)
            rows, keys = [], []
            for kind in kinds:
                size, left, right = kind // 4 + 3, kind & 2, kind & 1
                ok = ((mask >> np.uint64(kind)) & np.uint64(1)).astype(bool) & (at + size <= ends[row + 1])
                if left:
                    ok &= (at == ends[row]) | ~in_word[at - 1] | loose[row]
                if right:
                    ok &= (at + size == ends[row + 1]) | ~in_word[np.minimum(at + size, total)] | loose[row]
                h = _hashes(data, at[ok], kind)
                r = row[ok]
                for k in range(PROBES):
                    p = _probe(h, k, bits)
                    hit = (marks[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    h, r = h[hit], r[hit]
                rows.append(r)
                keys.append(h.view(np.int64))
            r, k = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((k, r))
            r, k = r[order], k[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            r, k = r[new], k[new]
            cells = [*batch.drop_columns(["_text", "_loose"]).take(pa.array(r)).columns, pa.array(k)]
            if several:
                first = np.searchsorted(r, np.arange(batch.num_rows + 1))
                cells.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(k)).take(pa.array(r)))
            yield pa.RecordBatch.from_arrays(cells, names=names)

    # two letters beyond ASCII become ASCII ones in lower case: around them no edge is told from the text
    looked = lines.filter(F.col(text).isNotNull()).withColumn("_text", F.lower(text).cast("binary")).withColumn("_loose", F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212A")))
    empty = spark.createDataFrame([], lines.schema).withColumn("_key", F.lit(0).cast("long"))
    empty = empty.withColumn("_held", F.array().cast("array<long>")) if several else empty
    names = empty.columns
    hit = looked.mapInArrow(near, empty.schema)
    table = rules.select(F.explode(F.array_distinct("_keys")).alias("_key"), "rule_no", "rule_id", "pattern", *(["_keys"] if several else []))
    both = hit.join(F.broadcast(table) if small else table, "_key")
    if several:  # of the literals of a rule that a line holds the least stands for all
        both = both.filter((F.size("_keys") == 1) | (F.col("_key") == F.array_min(F.array_intersect("_held", "_keys"))))
    # sorted by rule, an expression is compiled once a task
    tested = (both.sortWithinPartitions("rule_no") if small else both).filter(F.regexp_like(F.col(text), F.col("pattern")))
    return tested.select(*lines.columns, "rule_no", "rule_id")


def store_folder(spark, name: str) -> str:
    """A folder of its own for an index, in the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
