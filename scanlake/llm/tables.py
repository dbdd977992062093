"""Reading the given tables, and streaming text through Arrow in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanlake.session import ship

#: Rows and characters that one call of a text function sees at most (a longer single text still comes whole).
SLICE_ROWS, SLICE_CHARS = 2000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` on executors that have been given this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches into pieces of bounded size and hand out each piece with its texts; null reads as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start = chars = 0
        for i, t in enumerate(texts):
            if i > start and (i - start >= SLICE_ROWS or chars + len(t) > SLICE_CHARS):
                yield batch.slice(start, i - start), texts[start:i]
                start, chars = i, 0
            chars += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def map_texts(df: DataFrame, id_col: str, text_col: str, fn: Callable[[pa.Array, list[str]], dict], schema: str) -> DataFrame:
    """One output row per input row: ``fn(ids, texts)`` returns the columns of ``schema`` in order.

    Only the two named columns are read, so extra columns of any name do no harm.
    """
    def run(batches):
        for batch, texts in slices(batches, "_t"):
            cols = fn(batch.column("_id"), texts)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in cols.values()], names=list(cols))

    return map_batches(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), run, schema)


class Recent:
    """What a worker remembers of words: the words of late, at most about ``most``. A word that is used again stays, the others go."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Words that are not remembered; the others are in ``young`` afterwards. Generations change here, before a batch."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        return new

    def forget(self, words: Iterable[str], longest: int) -> None:
        """Don't remember those of ``words`` that are longer than ``longest``, so that what is remembered has bounded size."""
        for w in words:
            if len(w) > longest:
                del self.young[w]


_RECENT: dict[tuple, Recent] = {}


def recent(owner: tuple, most: int) -> Recent:
    """The memory of one operator in this worker; the worker serves operators one after the other, so others' memories go."""
    if owner not in _RECENT:
        _RECENT.clear()
        _RECENT[owner] = Recent(most)
    return _RECENT[owner]


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows whose labels must not be learned from, and for rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
