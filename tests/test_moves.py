"""What is moved, sorted, parsed and read again: plans of jobs whose size matters, on small rows."""

from pyspark.sql import functions as F

from scanlake.operators import patterns as pt, reduce as rd, triage as tr, workflows as wf
from scanlake.scale import placed
from scanlake.sources import manifests

W = ".github/workflows/a.yml"
FLOW = "on:\n  pull_request_target:\njobs:\n  j:\n    steps:\n      - run: |\n          echo \"V=${{ github.event.pull_request.title }}\" >> \"$GITHUB_ENV\"\n      - run: echo \"$V\"\n"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_workflow_lines_are_sorted_once(corpus):
    steps = wf.steps_of(wf.workflow_steps(corpus({W: FLOW})))
    assert sorted((r.job, r.step, r.end_line) for r in steps.collect()) == [("j", 6, 7), ("j", 8, 9)]
    assert sum("Sort [" in x for x in plan(wf.workflow_steps(corpus({W: FLOW})).select("step")).split("\n")) == 1


def test_added_lines_are_read_once(corpus, spark):
    added = spark.createDataFrame([("s", W, 7)], "scan_id string, path string, line int")
    found = wf.workflow_candidates(corpus({W: FLOW}), added)
    assert [(r.rule, r.line) for r in found.collect()] == [("ci-untrusted-event-shell", 7)]
    assert "LeftSemi" not in plan(found)


def test_places_in_a_queue(spark):
    rows = spark.createDataFrame([(i, ("a", "b", None)[i % 3], i % 5) for i in range(60)], "id int, queue string, score int").repartition(5)
    got = {r.id: r["rank"] for r in placed(rows, ["queue"], [F.desc("score"), F.col("id")], "rank").collect()}
    for q in range(3):
        ids = sorted((i for i in range(60) if i % 3 == q), key=lambda i: (-(i % 5), i))
        assert [got[i] for i in ids] == list(range(1, 21))
    ranked = {r.id: r["rank"] for r in tr.stack_rank(rows).collect()}
    assert ranked == {i: None if i % 3 == 2 else n for i, n in got.items()}


def test_reduction_moves_evidence_twice(spark):
    place = F.struct(F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit("x").alias("excerpt"), F.lit("sink").alias("role"))
    raw = spark.range(6).select(F.lit("s").alias("scan_id"), F.concat(F.lit("a-"), F.col("id") % 2).alias("rule"), F.lit("high").alias("severity"), F.concat(F.lit("f"), F.col("id") % 1).alias("file"), (F.col("id") % 1 + 1).cast("int").alias("line"),
                                F.concat(F.lit("x"), F.col("id") % 3).alias("excerpt"), F.lit("why").alias("rationale"), F.lit("CWE-1").alias("cwe"),
                                F.array(pt.evidence("pattern", F.lit("d"), place)).alias("evidence"), F.col("id").alias("ord"))
    found = rd.reduce_candidates(rd.to_findings(rd.dedupe_observations(raw)))
    assert sorted((r.rule_id, r.ord_n) for r in found.select("rule_id", F.size("evidence").alias("ord_n")).collect()) == [("a.0", 3), ("a.1", 3)]
    assert plan(found).count("Exchange hashpartitioning") == 2


def test_a_manifest_is_not_parsed_to_test_it(corpus):
    files = corpus({"a/package.json": '{"dependencies": {"x": "1.0.0"}, "devDependencies": {"x": "2.0.0", "y": "3.1.0"}}', "b/package.json": "no"})
    found = manifests.manifest_dependencies(files)
    assert sorted((r.component, r.version, r.scope) for r in found.collect()) == [("x", "1.0.0", "runtime"), ("y", "3.1.0", "development")]
    assert not [x for x in plan(found).split("\n") if "Filter" in x and "from_json" in x]
