"""Structured Streaming jobs: incremental scans, lease expiry, ledger state, late receipts, activity.

Sinks are parquet tables written per batch under the batch id, so a batch that is retried
after a lost executor overwrites its own output and nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx
from ..functions.rules import TEXT_RULES, Rule
from ..operators import patterns as pt


def write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def incremental_scan(files: DataFrame, out: str, checkpoint: str, rules: Sequence[Rule] = TEXT_RULES, **trigger) -> StreamingQuery:
    """New file versions in, rule findings and a receipt per file out; the checkpoint is the resume point."""
    def scan(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        found = pt.scan_files(batch, rules).select(
            "scan_id", "rule", "file", "line", "excerpt", "severity",
            tx.candidate_id(F.col("scan_id"), F.col("rule"), F.col("file"), F.col("line")).alias("candidate_id"))
        write_batch(found, f"{out}/findings", batch_id)
        write_batch(batch.select("scan_id", "path", tx.sha256(F.col("content")).alias("sha256")), f"{out}/receipts", batch_id)
        batch.unpersist()
    return files.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


LEASE_OUT = "task_id string, owner string, expired_at timestamp"
LEASE_STATE = "owner string, expires_ms long"


def lease_expiry(events: DataFrame, lease_seconds: int = 120, delay: str = "10 minutes") -> DataFrame:
    """Claims that ran out: one row per expired claim, driven by event-time timers.

    ``events(task_id, owner, action, at)`` with actions claim, renew and complete; other rows are
    dropped before they reach the state, so a key holds only the few claim rows of one task.
    """
    events = events.filter(F.col("action").isin("claim", "renew", "complete"))
    def expire(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        lease = lease_seconds * 1000
        if state.hasTimedOut:
            owner, expires = state.get
            out.append((key[0], owner, pd.Timestamp(expires, unit="ms")))
            state.remove()
        else:
            rows = sorted((r for f in frames for r in f[["at", "action", "owner"]].itertuples(index=False)), key=lambda r: (r[0], r[1], r[2] or ""))
            held = state.get if state.exists else None
            for at, action, owner in rows:
                now = at.value // 1_000_000  # whole milliseconds
                if held and held[1] <= now:
                    out.append((key[0], held[0], pd.Timestamp(held[1], unit="ms")))
                    held = None
                if action == "complete":
                    held = None
                elif action == "claim" and held is None or action == "renew" and held and held[0] == owner:
                    held = (owner, now + lease)
            if held is None:
                if state.exists:
                    state.remove()
            elif held[1] <= state.getCurrentWatermarkMs():
                out.append((key[0], held[0], pd.Timestamp(held[1], unit="ms")))
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                state.setTimeoutTimestamp(held[1])
        yield pd.DataFrame(out, columns=["task_id", "owner", "expired_at"])
    keyed = events.withWatermark("at", delay).groupBy("task_id")
    return keyed.applyInPandasWithState(expire, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _merged(rows: DataFrame) -> DataFrame:
    """One row per candidate out of partial ones: the newest phase and disposition, the newest time, all rows counted."""
    newest = F.max(F.struct("at", "event_id", "phase", "disposition"))
    return rows.groupBy("candidate_id").agg(newest.alias("last"), F.sum("n_rows").alias("n_rows")).select("candidate_id", "last.phase", "last.disposition", "last.at", "last.event_id", "n_rows")


def finding_state(ledger: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Ledger rows to the latest phase and disposition per candidate; repeated rows within the delay are dropped.

    The stream itself remembers event ids for the delay and nothing else, so its state does not grow with the candidates. Each batch
    writes what it saw of its own candidates; ``current_state`` puts the batches together, ``compact_state`` makes one of many.
    """
    rows = ledger.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(_merged(batch.withColumn("n_rows", F.lit(1).cast("long"))), f"{out}/batches", batch_id)
    return rows.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the whole tables ``folder/name=<number>``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def _state_rows(spark: SparkSession, out: str) -> tuple[DataFrame | None, int]:
    """Partial rows that make the state, and the newest batch among them: the newest compacted table and the batches behind it."""
    merged, batches = _numbers(spark, f"{out}/merged", "through"), _numbers(spark, f"{out}/batches", "batch")
    through = merged[-1] if merged else -1
    parts = [f"{out}/merged/through={through}"] if merged else []
    parts += [f"{out}/batches/batch={b}" for b in batches if b > through]
    return (spark.read.parquet(*parts) if parts else None), max([through, *batches])


def current_state(spark: SparkSession, out: str) -> DataFrame:
    """The state of every candidate: (candidate_id, phase, disposition, at, n_rows). Nothing written yet is an empty table."""
    rows, _ = _state_rows(spark, out)
    if rows is None:
        return spark.createDataFrame([], "candidate_id string, phase string, disposition string, at timestamp, n_rows long")
    return _merged(rows).drop("event_id")


def compact_state(spark: SparkSession, out: str) -> int:
    """Write the state as one table and remove the batches and tables it replaces; the number of the newest batch in it.

    A reader or a stream that runs meanwhile is not disturbed: the new table counts once it is complete, and batches behind it are kept.
    """
    rows, through = _state_rows(spark, out)
    old, batches = _numbers(spark, f"{out}/merged", "through"), _numbers(spark, f"{out}/batches", "batch")
    if rows is None or through in old and not [b for b in batches if b > through]:
        return through
    _merged(rows).write.mode("overwrite").parquet(f"{out}/merged/through={through}")
    conf = spark._jsc.hadoopConfiguration()
    for gone in [f"{out}/merged/through={n}" for n in old if n < through] + [f"{out}/batches/batch={b}" for b in batches if b <= through]:
        path = spark._jvm.org.apache.hadoop.fs.Path(gone)
        path.getFileSystem(conf).delete(path, True)
    return through


def late_receipts(receipts: DataFrame, completed: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Receipts split at their scan's completion, where completions are a table: accepted rows and a side table of refused late ones.

    For a table of completions that grows for ever, ``judged_receipts`` keeps only what the watermark leaves open.
    """
    def split(batch: DataFrame, batch_id: int) -> None:
        j = batch.join(completed.select("scan_id", "completed_at"), "scan_id", "left").persist()
        late = F.col("completed_at").isNotNull() & (F.col("at") > F.col("completed_at"))
        write_batch(j.filter(~late), f"{out}/accepted", batch_id)
        write_batch(j.filter(late), f"{out}/late", batch_id)
        j.unpersist()
    return receipts.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def judged_receipts(receipts: DataFrame, completions: DataFrame, horizon: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Receipts with ``late``: two streams joined on the scan, each with a watermark, so both sides leave the state in time.

    ``receipts(scan_id, at, ...)``, ``completions(scan_id, completed_at)`` with one row a scan. A receipt is late if it comes after its scan's completion, at most
    ``horizon`` after it. Late ones come out at once, the others as soon as the watermark shows that no completion before them can still arrive.
    """
    r = receipts.withWatermark("at", delay)
    c = completions.select(F.col("scan_id").alias("_scan"), "completed_at").withWatermark("completed_at", delay)
    after = (F.col("at") > F.col("completed_at")) & (F.col("at") <= F.col("completed_at") + F.expr(f"interval {horizon}"))
    return r.join(c, (F.col("scan_id") == F.col("_scan")) & after, "leftOuter").withColumn("late", F.col("completed_at").isNotNull()).drop("_scan")


def activity_counts(activity: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per phase and event-time window (tumbling, or sliding with ``slide``); batch or stream."""
    a = activity.withWatermark("at", delay) if activity.isStreaming else activity
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return a.groupBy(w.alias("w"), "phase").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "phase", "n")


def scan_sessions(activity: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per scan; batch or stream."""
    a = activity.withWatermark("at", delay) if activity.isStreaming else activity
    return a.groupBy(F.session_window("at", gap).alias("w"), "scan_id").agg(F.count("*").alias("n")) \
        .select("scan_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
