"""Scans that share paths, rules and candidate names stay apart; long objects and far handlers are seen whole."""

import pytest

from scanlake.operators import classify as cl, compare as cp, ledger as lg, pairing as pr, planning as pl, reduce as rd, report as rp, triage as tr

CANDIDATES = "scan_id string, candidate_id string, disposition string, confidence string"


def test_same_candidate_in_two_scans(spark):
    found = spark.createDataFrame([("a", "c", "open", "low"), ("b", "c", "open", "low")], CANDIDATES)
    ledger = spark.createDataFrame([("a", "c", "validation"), ("a", "c", "discovery")], "scan_id string, candidate_id string, phase string")
    assert [(r.scan_id, r.stages) for r in lg.pending(found, ledger).collect()] == [("b", "")]
    assert {r.scan_id for r in cp.receipt_gaps(found, ledger).collect()} == {"b"}
    row = ("a", "c", "reportable", "test", "high", "seen", 1, 1)
    done = spark.createDataFrame([row], "scan_id string, candidate_id string, conclusion string, method string, confidence string, direct_evidence string, recorded_at long, seq long")
    assert {r.scan_id: r.disposition for r in lg.apply_validations(found, done).collect()} == {"a": "reportable", "b": "discovered"}


def test_a_table_without_scans_is_refused(spark):
    found = spark.createDataFrame([("a", "c", "open", "low")], CANDIDATES)
    ledger = spark.createDataFrame([("c", "validation")], "candidate_id string, phase string")
    with pytest.raises(ValueError, match="scan_id"):
        lg.pending(found, ledger)
    assert lg.pending(found.drop("scan_id"), ledger).count() == 0


def test_claims_match_their_own_scan(spark, corpus):
    schema = "scan_id string, id string, families array<string>, locations array<struct<file:string,line:int>>"
    claims = spark.createDataFrame([("a", "k", ["r"], [("x.py", 3)]), ("b", "k", ["r"], [("x.py", 3)])], schema)
    candidates = spark.createDataFrame([("a", "r", "x.py", 3, [("context",)])], "scan_id string, rule string, file string, line int, evidence array<struct<kind:string>>")
    files = corpus({"x.py": ""}, "a").unionByName(corpus({"x.py": ""}, "b"))
    out = tr.triage_status(tr.match_imported(claims, candidates, files))
    assert {r.scan_id: (r.exact_matches, r.status) for r in out.collect()} == {"a": (1, "affected"), "b": (0, "not_affected")}


def test_ranges_and_rewrites_by_scan(spark, corpus):
    files = corpus({"x.py": "verify = False\ntwo"}, "a").unionByName(corpus({"x.py": "verify=False\nzwei"}, "b"))
    asks = spark.createDataFrame([("b", "x.py", 2, 2)], "scan_id string, path string, start_line int, end_line int")
    assert [r.text for r in cl.read_range(files, asks).collect()] == ["zwei"]
    long = corpus({"l.txt": "\n".join(str(i) for i in range(1000))}, "b")
    asks = spark.createDataFrame([("b", "l.txt", 1, 900)], "scan_id string, path string, start_line int, end_line int")
    assert [r.to_line for r in cl.read_range(long, asks).collect()] == [900]
    assert [r.to_line for r in cl.read_range(long, asks, cap=400).collect()] == [400]
    found = spark.createDataFrame([("a", "tls.verification.disabled", "x.py")], "scan_id string, rule_id string, file string")
    assert [(r.scan_id, r.new_content) for r in cp.safe_rewrites(files, found).collect()] == [("a", "verify = True\ntwo")]


def test_long_objects_calls_and_far_handlers(corpus):
    filler = "".join(f'  "key_{i}": "value number {i}",\n' for i in range(400))
    jwt = f'opts = {{\n{filler}  "verify_signature": False,\n}}\nx = jwt.decode(token, options=opts)\ny = jwt.decode(token, {filler} verify=False)\n'
    found = pr.jwt_disabled(corpus({"long.py": jwt})).collect()
    assert sorted(r.line for r in found) == [402, 805]
    notes = "".join(f"# remark {i} on the handler below\n" for i in range(300))
    route = f'app = FastAPI()\n@app.post("/pay")\n{notes}def pay(body):\n    return body\n'
    assert [r.line for r in pr.unguarded_python_routes(corpus({"far.py": route})).collect()] == [2]
    wide = " " * 900
    java = 'class P {{ void f() {{ DocumentBuilderFactory q = DocumentBuilderFactory.newInstance();\n q.setFeature({}"http://x/disallow-doctype-decl", true);\n q.newDocumentBuilder(); }} }}'
    assert pr.unhardened_use(corpus({"P.java": java.format(wide)})).count() == 0
    loose = java.format(wide).replace("disallow-doctype-decl", "other")
    assert [r.line for r in pr.unhardened_use(corpus({"P.java": loose})).collect()] == [3]


def test_open_coverage_is_told_per_worker_and_region(spark):
    work = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "scan_id string, region_id int")
    seen = spark.createDataFrame([("a", "w", 1), ("a", "v", 1), ("a", "v", 2), ("b", "w", 9)], "scan_id string, worker_id string, region_id int")
    put_off = spark.createDataFrame([("a", "w", 2, " x ")], "scan_id string, worker_id string, region_id int, reason string")
    got = {tuple(r) for r in pl.coverage_gaps(work, seen, put_off).collect()}
    assert got == {("b", "w", 9, "outside worklist", 1), ("b", "w", None, "not closed", 1), ("b", None, 1, "not closed by every worker", 1), ("a", "w", 2, "reason required", 1)}
    nobody = pl.coverage_gaps(work, seen.limit(0), put_off.limit(0)).collect()
    assert sorted((r.scan_id, r.region_id, r.n) for r in nobody) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]


def test_jobs_have_rounds_of_their_own(spark):
    rounds = spark.createDataFrame([(j, r, "complete") for j in "xy" for r in (1, 2, 3)], "job_id string, round int, status string")
    seen = spark.createDataFrame([("x", 1, "f"), ("y", 3, "f")], "job_id string, round int, fingerprint string")
    got = {(r.job_id, r.round): (r.novelty, r.state) for r in rd.round_saturation(seen, rounds, stop_after=2).collect()}
    assert got == {("x", 1): (1, "running"), ("x", 2): (0, "running"), ("x", 3): (0, "saturated"),
                   ("y", 1): (0, "running"), ("y", 2): (0, "saturated"), ("y", 3): (1, "running")}


def test_what_was_found_at_each_location(spark, corpus):
    schema = "id string, families array<string>, locations array<struct<file:string,line:int>>"
    claims = spark.createDataFrame([("k", ["r"], [("x.py", 3), ("x.py", 9), ("gone.py", 1), ("x.py", None)]), ("none", [], [("x.py", 3)]), ("bare", ["r"], [])], schema)
    found = spark.createDataFrame([("r", "x.py", 3, [("context",)]), ("r", "x.py", 4, [("pattern",)])], "rule string, file string, line int, evidence array<struct<kind:string>>")
    out = {r.id: r for r in tr.triage_status(tr.match_imported(claims, found, corpus({"x.py": ""}).drop("scan_id"))).collect()}
    assert (out["k"].n_readable, out["k"].exact_matches, out["k"].context_matches, out["k"].status) == (3, 3, 2, "affected")
    assert out["k"].limitations == ["An imported location could not be read.", "Nothing that fits at x.py:9."]
    assert out["k"].evidence_lines == ["x.py:3 holds 1 compatible match(es), 1 with context.", "x.py holds 2 compatible match(es), 1 with context."]
    assert out["none"].limitations == [tr.NO_FAMILY] and out["none"].evidence_lines == []
    assert out["bare"].limitations == [tr.NO_LOCATION] and out["bare"].status == "needs_information"


def test_a_shared_title_costs_one_row_a_ticket(spark):
    tickets = spark.createDataFrame([(f"t{i}", "p", "same") for i in range(50)], "id string, fingerprint string, title string")
    issues = spark.createDataFrame([(f"i{i:02}", "same", "x finding:t7 fingerprint:p -->" if i in (3, 4) else "") for i in range(50)], "id string, title string, body string")
    got = rp.duplicate_tickets(tickets, issues).collect()
    assert len(got) == 51 and {(r.issue_id, r.n_issues) for r in got if r.matched_by == "title"} == {("i00", 50)}
    assert [(r.id, r.issue_id, r.n_issues) for r in got if r.matched_by == "marker"] == [("t7", "i03", 2)]


def test_long_root_causes_that_begin_alike_stay_apart(spark):
    start = "root cause " * 40
    rows = [("r", "f", 1, "e", "w", i, "", start + end) for i, end in enumerate(("one", "two"))]
    reports = spark.createDataFrame(rows, "rule_id string, file string, line int, excerpt string, worker_id string, seq int, remediation_identity string, root_cause string")
    assert rd.merge_reports(reports).count() == 2


def test_preview_stands_in_the_rank_rows(corpus):
    row = pl.rank_input(pl.file_worklist(corpus({"a.py": "def go():\n  pass"}), preview=True)).first()
    assert '"preview":"def go' in row.value
