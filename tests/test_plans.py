"""End-to-end scans on small corpora: identity across renames, twins, deep passes, diff review, backlog."""

import random

from pyspark.sql import functions as F

from scanlake import scale
from scanlake.functions.versions import in_range, range_intervals, semver
from scanlake.operators import compare as cp, triage
from scanlake.plans.backlog import triage_claims
from scanlake.plans.review import review_diffs
from scanlake.plans.scan import scan_corpus


def key(rows):
    return sorted((r.rule_id, r.file, r.line) for r in rows)


SHOP = {
    "cart.ts": "export const rate = 3\nconst clientSecret = 'cs-55d0a7e1b9f24c'\nfunction total(req) {\n  eval(req.query.formula)\n}\n",
    "mailer.py": 'host = "mail.example.org"\nsmtp_password = "pw-c81f0d27a6e3"\nexample_password = "example-password-value"\n',
    "deploy.sh": "target=$1\nuser=2\nsystem(\"rsync \" + target)\n",
    "package.json": '{"dependencies": {"paper": "2.1.0"}}',
}


def test_scan(spark, corpus):
    """Three scans in one run: a shop, the shop after a rename and added lines, the shop with a copied file."""
    renamed = {**{p: c for p, c in SHOP.items() if p != "mailer.py"}, "post/mailer.py": "# moved\n\n\n" + SHOP["mailer.py"]}
    copied = {**SHOP, "mailer_old.py": SHOP["mailer.py"]}
    files = corpus(SHOP, "first").unionByName(corpus(renamed, "renamed")).unionByName(corpus(copied, "copied"))
    scan = scan_corpus(files.coalesce(1), "shop")
    rows = {}
    for r in scan.findings.collect():
        rows.setdefault(r.scan_id, []).append(r)
    assert key(rows["first"]) == [("dangerous.dynamic.code", "cart.ts", 4), ("hardcoded.secret.marker", "cart.ts", 2), ("hardcoded.secret.marker", "mailer.py", 2), ("shell.command.construction", "deploy.sh", 3)]
    names = {s: {r.id for r in found} for s, found in rows.items()}
    assert len(names["first"]) == 4 and names["renamed"] == names["first"]  # a rename and shifted lines keep identities
    assert len(rows["copied"]) == len(names["copied"]) == 5  # the copied secret is a finding of its own
    (shell,) = [r for r in rows["first"] if r.file == "deploy.sh"]
    assert [e.kind for e in shell.evidence] == ["pattern", "context"]
    assert scan.preflight.first().commands == ["npm test", "npm run build"]
    assert scan.tasks.count() == 13 and scan.receipts.count() == 13
    side = spark.createDataFrame([(r.fingerprint, r.id, r.status, r.line) for r in rows["copied"]], "fingerprint string, id string, status string, ord int")
    assert {r.change for r in cp.compare_scans(side, side).collect()} == {"persisting"}


PATCH = """diff --git a/orders.ts b/orders.ts
--- a/orders.ts
+++ b/orders.ts
@@ -1,4 +1,4 @@
 // orders
-router.post("/refund", requireAuthorization, refund)
-validateRequest(req.body)
-const rate = 3
+router.post("/refund", refund)
+const formula = req.query.formula
+eval(formula)
"""


def test_diff_review(spark, corpus):
    patches = spark.createDataFrame([("s", 1, PATCH)], "scan_id string, patch_id int, patch string")
    now = corpus({"orders.ts": '// orders\nrouter.post("/refund", refund)\nconst formula = req.query.formula\neval(formula)\n', "untouched.py": 'name = request.args.get("name")\nos.system(name)\n'})
    found = review_diffs(patches, now, "shop").collect()
    assert key(found) == [("dangerous.dynamic.code", "orders.ts", 4), ("missing.authorization.route", "orders.ts", 2),
                          ("removed.authorization.control", "orders.ts", 2), ("removed.input.validation.control", "orders.ts", 3)]


def manifest(section, version, dev=False):
    lock = '{"packages": {"node_modules/left": {"version": "%s", "dev": %s}}}' % (version, str(dev).lower())
    return {"package.json": '{"%s": {"left": "%s"}}' % (section, version), "package-lock.json": lock, "SECURITY.md": "The production service is in scope.\n"}


def claim(spark, **kw):
    row = dict(scan_id="s", id="c1", title="High issue in left", description="x", cwe=None, rule_id=None, source_type="advisory", locations=[], component="left", affected_version=">=1.0.0 <2.0.0", impact=None)
    row.update(kw)
    schema = "scan_id string, id string, title string, description string, cwe string, rule_id string, source_type string, locations array<struct<file:string,line:int>>, component string, affected_version string, impact string"
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.replace("struct<file:string,line:int>", "s").split(", "))], schema)


def test_backlog_dependency_verdicts(spark, corpus):
    none = spark.createDataFrame([], "scan_id string, rule string, file string, line int, evidence array<struct<kind:string,detail:string,location:struct<file:string,line:int,excerpt:string,role:string>>>")
    for files, status, verdict in ((manifest("dependencies", "1.4.0"), "affected", "confirmed"), ({"a.sh": "x", "SECURITY.md": "The production service is in scope.\n"}, "not_present", "not_actionable"),
                                   (manifest("dependencies", "2.4.0"), "outside_affected_range", "not_actionable"), (manifest("devDependencies", "1.4.0", True), "non_runtime_only", "needs_review")):
        # a claim without a location has no surface, so a location in product code carries the boundary
        r = triage_claims(claim(spark, locations=[("src/a.ts", None)]), corpus(files), none).first()
        assert (r.dependency_status, r.verdict) == (status, verdict)


def test_ranges_as_intervals(spark):
    """The intervals of a range hold a version exactly if the range test says so."""
    rnd = random.Random(4)
    number = lambda: ".".join(str(rnd.randint(0, 3)) for _ in range(rnd.randint(1, 3)))
    term = lambda: rnd.choice([lambda: rnd.choice([">", ">=", "<", "<=", "=", "^", "~", "~ ", ""]) + rnd.choice(["", "v"]) + number(), lambda: rnd.choice(["*", "x", "1.x", "2.*", "1.2.x", "odd", ""])])()
    branch = lambda: rnd.choice([lambda: " ".join(term() for _ in range(rnd.randint(1, 3))), lambda: f"{number()} - {number()}", lambda: ","])()
    pairs = [(rnd.choice([number(), "v" + number(), number() + "-rc1", "none", None]), " || ".join(branch() for _ in range(rnd.randint(1, 3)))) for _ in range(1500)] + [("1.0.0", None), ("1.0.0", "")]
    df = spark.createDataFrame(pairs, "v string, r string").withColumn("i", range_intervals(F.col("r")))
    held = F.when(semver(F.col("v")).isNotNull() & F.col("i").isNotNull(), F.exists("i", lambda x: (semver(F.col("v")) >= x.lo) & (semver(F.col("v")) < x.hi)))
    rows = df.select("v", "r", "i", in_range(F.col("v"), F.col("r")).alias("a"), held.alias("b")).collect()
    assert not [tuple(r) for r in rows if r.a != r.b]
    assert all(a.hi < b.lo for r in rows if r.i for a, b in zip(r.i, r.i[1:])) and len({r.a for r in rows}) == 3


def test_popular_component_without_pairs(spark, monkeypatch):
    """One component with many versions and many ranges, in one task and cut into pieces: counts as by testing each pair."""
    rnd = random.Random(5)
    versions = [("c", f"{rnd.randint(0, 9)}.{rnd.randint(0, 9)}.{i % 7}", rnd.choice(["runtime", "development", None])) for i in range(400)] + [("c", "odd", "runtime"), ("c", None, "runtime"), ("d", "1.0.0", "runtime")]
    ranges = [("c", f">={rnd.randint(0, 9)}.{rnd.randint(0, 9)} <{rnd.randint(0, 9)}.1 || ^{rnd.randint(0, 9)}.2") for _ in range(60)] + [("d", "<1"), ("d", "*"), ("e", "*")]
    v = spark.createDataFrame(versions, "component string, version string, scope string").distinct()
    r = spark.createDataFrame(ranges, "component string, affected_version string").distinct()
    pairs = r.join(v, "component", "left").withColumn("hit", in_range(F.col("version"), F.col("affected_version")).cast("int"))
    one = lambda s: F.coalesce(F.sum(F.when(F.col("scope") == s, F.col("hit"))), F.lit(0))
    want = {tuple(x) for x in pairs.groupBy("component", "affected_version").agg(F.coalesce(F.sum("hit"), F.lit(0)), one("runtime"), one("development")).collect()}
    for rows in (2_000_000, 50):
        monkeypatch.setattr(scale, "ONE_TASK_ROWS", rows)
        assert {tuple(x) for x in triage.versions_inside(triage.per_value(r, "affected_version", "intervals", range_intervals), triage.per_value(v, "version", "at", semver), ["component"]).collect()} == want
