"""Streams over arrivals in several batches: the state stays small, compaction changes nothing, late receipts are told apart."""

import datetime as dt

from scanlake.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def test_finding_state_over_many_batches(spark, tmp_path):
    """A new candidate in each of 24 batches: the stream's state holds the ids of the last hour only; compaction keeps the answer."""
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "candidate_id string, phase string, disposition string, at timestamp, event_id long"
    want, held = {}, []
    for i in range(24):
        rows = [(f"c{i}", "discovery", "open", DAY + dt.timedelta(hours=2 * i), 10 * i), (f"c{i // 2}", f"phase{i}", "seen", DAY + dt.timedelta(hours=2 * i, minutes=1), 10 * i + 1)]
        spark.createDataFrame([*rows, rows[0]], schema).coalesce(1).write.mode("append").parquet(landed)
        for c, phase, disposition, _, _ in rows:
            want[c] = (phase, disposition, want.get(c, (0, 0, 0))[2] + 1)
        q = jobs.finding_state(spark.readStream.schema(schema).parquet(landed), out, state, delay="1 hour")
        q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1:]
        if i == 11:
            assert jobs.compact_state(spark, out) >= 0
    found = {r.candidate_id: (r.phase, r.disposition, r.n_rows) for r in jobs.current_state(spark, out).collect()}
    assert found == want and max(held[2:]) <= 4
    through = jobs.compact_state(spark, out)
    assert jobs.compact_state(spark, out) == through and jobs._numbers(spark, f"{out}/batches", "batch") == [] and jobs._numbers(spark, f"{out}/merged", "through") == [through]
    assert {r.candidate_id: (r.phase, r.disposition, r.n_rows) for r in jobs.current_state(spark, out).collect()} == want
    assert jobs.current_state(spark, str(tmp_path / "none")).count() == 0


def test_judged_receipts(spark, tmp_path):
    receipts, done, out, state = (str(tmp_path / n) for n in ("receipts", "done", "out", "state"))
    at = lambda h: DAY + dt.timedelta(hours=h)
    days = [([("a", at(1), 1), ("b", at(2), 2)], [("a", at(3))]), ([("a", at(30), 3), ("b", at(31), 4)], []), ([("a", at(100), 5), ("c", at(101), 6)], [("b", at(99))]), ([("d", at(400), 7)], [("d", at(401))]), ([("d", at(500), 8)], [("e", at(500))])]
    for r, c in days:
        spark.createDataFrame(r, "scan_id string, at timestamp, n int").coalesce(1).write.mode("append").parquet(receipts)
        spark.createDataFrame(c, "scan_id string, completed_at timestamp").coalesce(1).write.mode("append").parquet(done)
        judged = jobs.judged_receipts(spark.readStream.schema("scan_id string, at timestamp, n int").parquet(receipts), spark.readStream.schema("scan_id string, completed_at timestamp").parquet(done), "2 days")
        judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = {r.n: r.late for r in spark.read.schema(judged.schema).parquet(out).collect()}
    # 3 comes 27 hours after its scan's end, 5 after the horizon; 8 is only 99 hours behind and outside too
    assert {n for n, late in found.items() if late} == {3} and {1, 2, 4, 5, 6} <= {n for n, late in found.items() if not late}
