"""Helpers that keep ordered work and small-side joins safe when one key is hot.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task, which is right as long as every key fits
(``ONE_TASK_ROWS``; keys are counted first, a map-side aggregation over the key columns alone). Beyond that the
functions here range-partition on (key, order), so that a hot key is cut into as many pieces as
its size needs, work inside each piece, and then carry one boundary value per piece.
The carried table never has more rows than there are range partitions, which is the
proven bound behind its broadcast. Both ways give the same rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

CHUNK = "_chunk"
#: Rows of one key that a single task may sort.
ONE_TASK_ROWS = 2_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make a local one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scanlake-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so lost executors cost no recompute."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of ``written`` tables, each with a weak reference to the relation that plans over it hold.
_WRITTEN: list[tuple] = []


def written(df: DataFrame) -> DataFrame:
    """``stable`` for wide tables with much text that several branches read: written as Parquet, so that it takes a fraction of the disk
    and a branch reads only its columns. A table goes when a later one is written and no plan holds it any more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    _sweep(sc)
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _WRITTEN.append((sc, folder, sc._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation())))
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def _sweep(sc) -> None:
    """Delete the tables that no plan holds; those of an ended session are left to it."""
    kept = []
    for of, folder, relation in _WRITTEN:
        if of is not sc:
            continue
        if relation.get() is None:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        else:
            kept.append((of, folder, relation))
    _WRITTEN[:] = kept


def keys_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the largest key has at most ``ONE_TASK_ROWS`` rows."""
    top = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (top or 0) <= ONE_TASK_ROWS


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``_chunk``: the range partition of (keys, order). Pinned by a reliable checkpoint."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    return stable(df.repartitionByRange(n, *cols).withColumn(CHUNK, F.spark_partition_id()))


def _chunk_window(keys, order):
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def _across_chunks(keys):
    return W.partitionBy(*keys).orderBy(CHUNK)


def _carry(df: DataFrame, per_chunk: DataFrame, keys, carried: str) -> DataFrame:
    """Left join the boundary table: at most one continuing key per range partition."""
    edge = per_chunk.filter(F.col(carried).isNotNull()).select(
        F.col(CHUNK).alias("_edge_chunk"), *[F.col(k).alias(f"_edge_{k}") for k in keys], carried)
    cond = F.col(CHUNK) == F.col("_edge_chunk")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_edge_{k}"))
    return df.join(F.broadcast(edge), cond, "left").drop("_edge_chunk", *[f"_edge_{k}" for k in keys])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, name: str) -> DataFrame:
    """Inclusive running sum per key in the given order, with hot keys split."""
    if keys_fit(df, keys):
        return df.withColumn(name, F.sum(value.cast("long")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    c = range_chunks(df.withColumn("_v", value.cast("long")), keys, order)
    totals = c.groupBy(*keys, CHUNK).agg(F.sum("_v").alias("_t"))
    before = _across_chunks(keys).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, CHUNK, F.sum("_t").over(before).alias("_base"))
    inside = _chunk_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("_run", F.sum("_v").over(inside))
    out = _carry(c, totals, keys, "_base")
    return out.withColumn(name, F.col("_run") + F.coalesce("_base", F.lit(0))).drop("_v", "_run", "_base", CHUNK)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence, values: dict[str, Column]) -> DataFrame:
    """Several inclusive running sums over one order."""
    if keys_fit(df, keys):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value.cast("long")).over(w) for name, value in values.items()})
    for name, value in values.items():
        df = running_sum(df, keys, order, value, name)
    return df


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """``row_number`` per key. The order must be total for a repeatable answer."""
    return running_sum(df, keys, order, F.lit(1), name)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``ranked`` for a few keys that may each hold most rows: sorted in one go over all tasks and written once.

    A row's place in its piece is written with it. The table of first places has one row per key and piece: as many as there are
    pieces, and one more for each key that begins inside a piece.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*map(F.col, keys), *order]
    c = stable(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()).withColumn(CHUNK, F.spark_partition_id()))
    held = c.groupBy(*keys, CHUNK).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = _across_chunks(keys).rowsBetween(W.unboundedPreceding, -1)
    base = held.withColumn("_base", F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return _carry(c, base.select(*keys, CHUNK, "_base"), keys, "_base").withColumn(name, F.col("_at") - F.col("_base") + 1).drop("_at", "_base", CHUNK)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], name: str = "prev") -> DataFrame:
    """Struct of ``cols`` of the previous row of the key (null on the first row); ascending order."""
    if keys_fit(df, keys):
        return df.withColumn(name, F.lag(F.struct(*cols)).over(W.partitionBy(*keys).orderBy(*order)))
    c = range_chunks(df, keys, order)
    row = F.struct(*cols)
    tails = c.groupBy(*keys, CHUNK).agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    tails = tails.select(*keys, CHUNK, F.lag("_tail").over(_across_chunks(keys)).alias("_tail"))
    c = c.withColumn("_prev", F.lag(row).over(_chunk_window(keys, order)))
    out = _carry(c, tails, keys, "_tail")
    return out.withColumn(name, F.coalesce("_prev", "_tail")).drop("_prev", "_tail", CHUNK)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Latest non-null ``value`` at or before each row of the key; ascending order."""
    if keys_fit(df, keys):
        return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    c = range_chunks(df, keys, order)
    ends = c.filter(F.col(value).isNotNull()).groupBy(*keys, CHUNK).agg(
        F.max_by(value, F.struct(*order)).alias("_end"))
    spans = c.select(*keys, CHUNK).distinct()
    ends = spans.join(ends, [*keys, CHUNK], "left")
    before = _across_chunks(keys).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, CHUNK, F.last("_end", ignorenulls=True).over(before).alias("_end"))
    inside = _chunk_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    out = _carry(c, ends, keys, "_end")
    return out.withColumn(name, F.coalesce("_here", "_end")).drop("_here", "_end", CHUNK)
