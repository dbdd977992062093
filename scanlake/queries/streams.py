"""Streaming jobs run to completion over the given tables, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import views as v
from ..scale import ensure_checkpoint_dir
from ..streaming import jobs
from .ledger import PHASE, log
from .registry import query


def _stream(spark, sf, name):
    """The table's own file as a stream source (the bracket makes the path a pattern)."""
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def _place(spark, name):
    """A fresh folder in the shared checkpoint folder for state and output."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    run = f"{base}/stream-{name}-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"


def _activity(df):
    return df.select(F.col("ts").cast("timestamp").alias("at"), F.expr(PHASE).alias("phase"), F.concat(F.lit("u"), "user_id").alias("scan_id"), "event_id", "value")


@query("stream_incremental_scan", r"""
with f as (select source || '/' || doc_id || '.' || lang as file, text as content from documents),
l as (select file, unnest(string_split_regex(content, '\r?\n')) as text, generate_subscripts(string_split_regex(content, '\r?\n'), 1) as line from f),
r(rule, pattern) as (values ('contact-address', '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+'), ('long-number', '[0-9]{6,}'), ('licence-line', '(?i)licen[sc]e|copyright'))
select file, line, rule from l join r on regexp_matches(text, pattern)""")
def stream_incremental_scan(spark, sf):
    from .core import PROSE_RULES
    out, state = _place(spark, "scan")
    files = _stream(spark, sf, "documents").select(F.col("source").alias("scan_id"), F.concat_ws("/", "source", F.concat("doc_id", F.lit("."), "lang")).alias("path"), F.col("text").alias("content"))
    jobs.incremental_scan(files, out, state, PROSE_RULES).awaitTermination()
    return jobs.read_batches(spark, f"{out}/findings").select("file", "line", "rule")


@query("stream_finding_state", f"""
with l as (select user_id || ':' || cast(cast(ts as date) as varchar) as candidate_id, {PHASE} as phase, ts, event_id from events)
select candidate_id, arg_max(phase, (ts, event_id)) as phase, count(*) as n_rows from l group by candidate_id""")
def stream_finding_state(spark, sf):
    out, state = _place(spark, "state")
    e = _stream(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("candidate_id"), F.expr(PHASE).alias("phase"),
                                            F.lit("discovered").alias("disposition"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    jobs.finding_state(e, out, state, delay="40 days").awaitTermination()
    jobs.compact_state(spark, out)
    return jobs.current_state(spark, out).select("candidate_id", "phase", "n_rows")


@query("stream_late_receipts", f"""
with l as (select event_id, 'u' || user_id as scan_id, {PHASE} as phase, ts from events), d as (select scan_id, min(ts) as t from l where phase = 'finalization' group by all)
select event_id, scan_id from l join d using (scan_id) where ts > t""")
def stream_late_receipts(spark, sf):
    out, state = _place(spark, "late")
    done = log(spark, sf).filter("phase = 'finalization'").groupBy("scan_id").agg(F.min("recorded_at").cast("timestamp").alias("completed_at"))
    jobs.late_receipts(_activity(_stream(spark, sf, "events")), done, out, state).awaitTermination()
    return jobs.read_batches(spark, f"{out}/late").select("event_id", "scan_id")


@query("stream_judged_receipts", f"""
with l as (select event_id, 'u' || user_id as scan_id, {PHASE} as phase, ts from events), d as (select scan_id, min(ts) as t from l where phase = 'finalization' group by all)
select event_id, scan_id from l join d using (scan_id) where ts > t and ts <= t + interval 20 days""")
def stream_judged_receipts(spark, sf):
    """Late receipts by two joined streams: completions land as a table of their own and arrive as a stream."""
    out, state = _place(spark, "judged")
    landed = out[: -len("out")] + "completions"
    done = log(spark, sf).filter("phase = 'finalization'").groupBy("scan_id").agg(F.min("recorded_at").cast("timestamp").alias("completed_at"))
    done.write.parquet(landed)
    arriving = spark.readStream.schema(done.schema).parquet(landed)
    judged = jobs.judged_receipts(_activity(_stream(spark, sf, "events")), arriving, "20 days")
    judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(judged.schema).parquet(out).filter("late").select("event_id", "scan_id")


@query("stream_lease_expiry", """
with recursive e as (
  select user_id, epoch_us(ts) // 1000 as now, case event_type when 'signup' then 'claim' when 'click' then 'renew' else 'complete' end as action,
         row_number() over (partition by user_id order by ts) as k
  from events where event_type in ('signup', 'click', 'purchase')),
walk(user_id, k, held, gone) as (
  select distinct user_id, cast(0 as bigint), cast(null as bigint), cast(null as bigint) from e
  union all
  select user_id, k, case when action = 'complete' then null when action = 'claim' and still is null or action = 'renew' and still is not null then now + 21600000 else still end, case when held <= now then held end
  from (select e.user_id, e.k, e.action, e.now, w.held, case when w.held > e.now then w.held end as still from walk w join e on e.user_id = w.user_id and e.k = w.k + 1)),
last as (select w.user_id, w.held from walk w join (select user_id, max(k) as k from walk group by user_id) m using (user_id, k)),
gone as (
  select user_id, gone as till from walk where gone is not null
  union all select user_id, held from last where held < (select max(now) from e) - 600000)
select 't' || user_id as task_id, 'o' || user_id as owner, make_timestamp(till * 1000) as expired_at from gone""")
def stream_lease_expiry(spark, sf):
    """Users claim on signup, renew on click and complete on purchase; expired claims come out."""
    out, state = _place(spark, "lease")
    action = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "purchase", "complete").otherwise("look")
    e = _stream(spark, sf, "events").select(F.concat(F.lit("t"), "user_id").alias("task_id"), F.concat(F.lit("o"), "user_id").alias("owner"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"))
    q = jobs.lease_expiry(e, lease_seconds=6 * 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(jobs.LEASE_OUT).parquet(out).withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz"))


@query("stream_activity_counts", f"""
with e as (select ts, {PHASE} as phase from events where not (event_type = 'error' and ts < timestamp '2024-01-11'))
select * from (select time_bucket(interval 6 hour, ts) as start, phase, count(*) as n from e group by all) where start + interval 6 hour <= (select max(ts) from events) - interval 1 hour""")
def stream_activity_counts(spark, sf):
    """Three arrivals, one run of the stream each; old errors arrive last, behind the watermark, and are refused. Open windows wait."""
    out, state = _place(spark, "activity")
    landed = out[: -len("out")] + "landed"
    events = spark.read.parquet(f"{sf}/events.parquet")
    day = F.col("ts").cast("date")
    arrival = F.when(day >= "2024-01-21", 2).when(day >= "2024-01-11", 1).when(F.col("event_type") == "error", 2).otherwise(0)
    for k in range(3):
        events.filter(arrival == k).write.mode("append").parquet(landed)
        rows = _activity(spark.readStream.schema(events.schema).parquet(landed))
        counts = jobs.activity_counts(rows, "6 hours", delay="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "phase", "n")
        counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("start timestamp_ntz, phase string, n long").parquet(out)


@query("activity_counts", f"""select time_bucket(interval 6 hour, ts) as start, {PHASE} as phase, count(*) as n from events group by all""")
def activity_counts(spark, sf):
    return jobs.activity_counts(_activity(v.table(spark, sf, "events")), "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "phase", "n")


@query("sliding_activity_counts", f"""
with s as (select time_bucket(interval 6 hour, ts) - to_hours(6 * k) as start, {PHASE} as phase from events, (values (0), (1)) o(k)) select start, phase, count(*) as n from s group by all""")
def sliding_activity_counts(spark, sf):
    return jobs.activity_counts(_activity(v.table(spark, sf, "events")), "12 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "phase", "n")


@query("scan_sessions", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 3 hour then 0 else 1 end as new from events),
i as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as island from g)
select 'u' || user_id as scan_id, min(ts) as start, count(*) as n from i group by user_id, island""")
def scan_sessions(spark, sf):
    return jobs.scan_sessions(_activity(v.table(spark, sf, "events")), "3 hours").select("scan_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


