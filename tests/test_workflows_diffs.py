"""Workflow jobs and diff tables on small texts."""

from scanlake.operators import diffs as df, patterns as pt, workflows as wf

P = ".github/workflows/review.yml"


def rules(frame):
    return sorted((r.rule, r.line) for r in frame.collect())


def head(jobs):
    return "on:\n  pull_request_target:\n" + jobs


def test_direct_permission_and_mutable(corpus):
    src = head('permissions:\n  contents: write\njobs:\n  check:\n    steps:\n      - uses: actions/checkout@main\n      - run: echo "${{ github.event.pull_request.title }}"\n')
    assert rules(wf.workflow_candidates(corpus({P: src}))) == [
        ("ci-mutable-action-ref", 8), ("ci-pull-request-target-write-permissions", 4), ("ci-untrusted-event-shell", 9)]
    # without the privileged trigger only the mutable ref stays
    assert rules(wf.workflow_candidates(corpus({P: src.replace("pull_request_target", "pull_request")}))) == [("ci-mutable-action-ref", 8)]


BRANCH = "${{ github.event.pull_request.head.ref }}"
STEP_ENV = head(f"jobs:\n  label:\n    steps:\n      - run: date\n      - name: tag\n        env:\n          LEVEL: 2\n          BRANCH: {BRANCH}\n        run: |\n          set -e\n          git tag $BRANCH\n")
JOB_ENV = head(f"jobs:\n  label:\n    env:\n      BRANCH: {BRANCH}\n      LEVEL: 2\n    steps:\n      - run: |\n          git tag $BRANCH\n      - env:\n          BRANCH: main\n        run: git tag $BRANCH\n")
LATER = head(f'jobs:\n  label:\n    steps:\n      - run: date\n      - run: |\n          echo "BRANCH={BRANCH}" >> "$GITHUB_ENV"\n      - run: |\n          set -e\n          git tag $BRANCH\n')


def line_of(src, part, last=False):
    rows = [i for i, x in enumerate(src.split("\n"), 1) if part in x]
    return rows[-1 if last else 0]


def test_environment_flows(corpus):
    for src in (STEP_ENV, JOB_ENV, LATER):
        found = wf.workflow_candidates(corpus({P: src})).collect()
        assert [(r.rule, r.line) for r in found] == [("ci-untrusted-event-shell", line_of(src, "git tag $BRANCH"))]
        assert (line_of(src, "head.ref"), "entrypoint") in {(e.location.line, e.location.role) for e in found[0].evidence}


def test_no_environment_flow(corpus):
    """A value set in the step itself, changed on the way, sent to outputs, or set in another job."""
    write = f'          echo "BRANCH={BRANCH}" >> "$GITHUB_ENV"\n'
    src = head("jobs:\n  own_step:\n    steps:\n      - run: |\n" + write + "          git tag $BRANCH\n"
               "  changed:\n    steps:\n      - run: |\n" + write.replace('}}"', '}}.x"') + "      - run: git tag $BRANCH\n"
               "  outputs:\n    steps:\n      - run: |\n" + write.replace("GITHUB_ENV", "GITHUB_OUTPUT") + "      - run: git tag $BRANCH\n"
               "  elsewhere:\n    steps:\n      - run: git tag $BRANCH\n")
    assert wf.workflow_candidates(corpus({P: src})).collect() == []


def test_checkout_and_added_anchor(corpus, spark):
    src = head('jobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n      - name: x\n        run: make\n      - run: make test\n  b:\n    steps:\n      - uses: actions/checkout@v4\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n')
    assert rules(wf.workflow_candidates(corpus({P: src}))) == [("ci-pull-request-target-untrusted-checkout", 8)]
    added = lambda *n: spark.createDataFrame([("s", P, i) for i in n], "scan_id string, path string, line int")
    assert rules(wf.workflow_candidates(corpus({P: src}), added(11))) == [("ci-pull-request-target-untrusted-checkout", 11)]
    assert rules(wf.workflow_candidates(corpus({P: src}), added(1))) == []
    assert rules(wf.workflow_candidates(corpus({P: STEP_ENV}), added(line_of(STEP_ENV, "head.ref")))) == [("ci-untrusted-event-shell", line_of(STEP_ENV, "head.ref"))]


PATCH = """diff --git a/route.ts b/route.ts
index 1..2 100644
--- a/route.ts
+++ b/route.ts
@@ -1,3 +1,3 @@ ctx
-app.post("/admin", requireAuthorization, handler)
-validateRequest(req.body)
-const response = "ok"
+app.post("/admin", handler)
+--- not a header
+system(req.query.code + "x")
@@ -20,2 +20,4 @@
 keep
+++ plus line
+new
 last
\\ No newline at end of file
diff --git a/gone.sh b/gone.sh
--- a/gone.sh
+++ /dev/null
@@ -4 +0,0 @@
-authorize x
diff --git a/run.sh b/run.sh
--- a/run.sh
+++ b/run.sh
@@ -7,0 +8,2 @@
+system("a" + b)
+# user
"""


def patches(spark):
    return spark.createDataFrame([("s", 1, PATCH)], "scan_id string, patch_id int, patch string")


def test_parse(spark):
    rows = {(r.file, r.side, r.old_line, r.new_line, r.text) for r in df.parse_diffs(patches(spark)).collect()}
    assert ("route.ts", "+", 4, 2, "--- not a header") in rows
    assert ("route.ts", "+", 21, 21, "++ plus line") in rows
    assert ("route.ts", " ", 21, 23, "last") in rows
    assert ("gone.sh", "-", 4, 0, "authorize x") in rows
    assert len(rows) == 13


def test_added_and_removed(spark):
    lines = df.parse_diffs(patches(spark))
    assert {(r.rule, r.file, r.line) for r in pt.removed_controls(lines).collect()} == {
        ("removed-authorization-control", "route.ts", 1), ("removed-input-validation-control", "route.ts", 2), ("removed-authorization-control", "gone.sh", 4)}
    found = {(r.rule, r.file, r.line, len(r.evidence)) for r in df.scan_added(lines).collect()}
    # the script file's rule is left to the flow job; the shell file keeps it, with context from the next added line
    assert found == {("shell-command-construction", "run.sh", 8, 2)}
    added = df.added_lines(lines)
    kept = df.touching_added(df.scan_added(lines), added)
    assert kept.count() == 1
    assert df.touching_added(df.scan_added(lines), added.filter("line > 100")).count() == 0


def test_receipts_and_cap(spark):
    got = {(r.path, r.language) for r in df.diff_receipts(patches(spark)).collect()}
    assert got == {("route.ts", "typescript"), ("gone.sh", "shell"), ("run.sh", "shell")}
    cap = df.cap_patches(patches(spark), 40).first()
    assert cap.truncated and cap.patch == PATCH


def test_scan_rows(spark):
    rows = spark.createDataFrame([("a", "auto", None, "h", None, False), ("b", "auto", "main", "h", None, True), ("c", "commit", "c1", "h", "c0", False), ("d", "commit", None, "h", None, False)],
                                 "scan_id string, requested_mode string, base string, head string, parent string, truncated boolean")
    got = {r.scan_id: (r.mode, r.error, r.base_revision, r.head_revision, r.complete) for r in df.diff_scan_rows(rows).collect()}
    assert got == {"a": ("working_tree", None, "h", "h", True), "b": ("branch_diff", None, "main", "h", False),
                   "c": ("commit", None, "c0", "c1", True), "d": ("commit", "base required", None, None, True)}
