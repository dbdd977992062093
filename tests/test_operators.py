"""Operators without a SQL twin, against direct computations on small data; hot keys included."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scanlake import scale
from scanlake.functions.rules import Rule
from scanlake.functions.versions import in_range
from scanlake.operators import classify as cl, compare as cp, patterns as pt, planning as pl, policy as po, report as rp
from scanlake.sources import corpus as cs, intake


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows share one key."""
    rng = random.Random(7)
    rows = [("hot" if i % 2 else f"k{rng.randrange(20)}", i, rng.choice([None, "a", "b"])) for i in range(400)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t int, v string").repartition(3)


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((t, v))
    return out


@pytest.mark.parametrize("one_task", [scale.ONE_TASK_ROWS, 0])
def test_rank_lag_last_known_on_hot_key(spark, hot, monkeypatch, one_task):
    monkeypatch.setattr(scale, "ONE_TASK_ROWS", one_task)
    rows, df = hot
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        want = by_key(rows)
        ranked = {(r.k, r.t): r.rank for r in scale.ranked(df, ["k"], [F.desc("t")]).collect()}
        assert ranked == {(k, t): len(v) - i for k, v in want.items() for i, (t, _) in enumerate(v)}
        lag = {(r.k, r.t): (r.prev.t, r.prev.v) if r.prev else None for r in scale.lagged(df, ["k"], ["t"], ["t", "v"]).collect()}
        assert lag == {(k, t): v[i - 1] if i else None for k, v in want.items() for i, (t, _) in enumerate(v)}
        known = {(r.k, r.t): r.last for r in scale.last_known(df, ["k"], ["t"], "v", "last").collect()}
        expect = {}
        for k, v in want.items():
            held = None
            for t, x in v:
                held = x if x is not None else held
                expect[(k, t)] = held
        assert known == expect
        assert scale.range_chunks(df, ["k"], ["t"]).filter("k = 'hot'").select(scale.CHUNK).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


RANGES = [("1.4.0", ">=1.0.0 <2.0.0", True), ("2.4.0", ">=1.0.0 <2.0.0", False), ("v1.2", "1.2.x", True), ("1.2.9", "^1.2.3", True), ("0.3.0", "^0.2.1", False), ("0.0.3", "^0.0.3", True),
          ("1.0.9", "~1", True), ("1.1.0", "~1", False), ("1.5.0", "1.0.0 - 2.0.0", True), ("3.0.0", "<1 || >=3", True), ("1.0.0", ">= 1.0.0", None), ("x", "*", None), ("1.0.0", " ", None),
          ("2.0.0-rc1", "2.0.0", True), ("1.0.0", "latest || <0.5", False), ("9.9.9", "*", True)]


def test_ranges(spark):
    df = spark.createDataFrame([(i, v, r) for i, (v, r, _) in enumerate(RANGES)], "i int, v string, r string")
    got = {r.i: r.x for r in df.select("i", in_range(F.col("v"), F.col("r")).alias("x")).collect()}
    assert got == {i: x for i, (_, _, x) in enumerate(RANGES)}


def test_policy_table(spark):
    rows = [("high", "medium", "remote", True, False), ("high", "high", "localhost", True, False), ("medium", "unknown", "remote", False, False), ("high", "high", "remote", True, True)]
    df = spark.createDataFrame(rows, "impact string, likelihood string, scope string, auth_bypass boolean, unreachable boolean")
    got = [(r.severity, r.priority, r.decision) for r in po.calibrate(df).collect()]
    assert got == [("critical", "P0", "reportable"), ("low", "P3", "reportable"), ("low", "P3", "reportable"), ("ignore", None, "ignore")]


def test_knowledge_base_is_greedy(spark):
    rng = random.Random(3)
    docs = [("w" if i % 3 else "z", f"d{i:03d}" + rng.choice([".md", ".txt", ".pdf"]), "x" * rng.randrange(1, 90)) for i in range(120)]
    df = spark.createDataFrame(docs, "scan_id string, path string, content string")
    got = {(r.scan_id, r.path): r.reason for r in cs.knowledge_base(df, doc_limit=70, max_docs=9, total_limit=200).collect()}
    want = {}
    for ws in ("w", "z"):
        used = taken = 0
        for _, path, text in sorted(d for d in docs if d[0] == ws):
            if len(text) > 70:
                why = "too large"
            elif taken >= 9:
                why = "document limit"
            elif path.endswith(".pdf"):
                why = "unsupported type"
            elif used + len(text) > 200:
                why = "total limit"
            else:
                why, used, taken = None, used + len(text), taken + 1
            want[(ws, path)] = why
    assert got == want


def test_preview_and_outline(spark):
    text = "import os\nclass A:\n  def go(self):\n    pass\nexport const f = (x) => x\nfunc (r *T) Run(a int) {\npublic void stop(int a) {\n" + "\n".join(f"line {i}" for i in range(40))
    r = spark.createDataFrame([(text,), ("a\0b",)], "c string").select(F.array_join(cl.structural_outline(F.col("c")), ",").alias("o"), cl.file_preview(F.col("c"), 90).alias("p")).collect()
    outline = ["class A", "def go", "arrow f", "func Run", "method stop"]
    assert r[0].o == ",".join(outline) and r[1].p == ""
    lines = text.split("\n")
    step = (len(lines) - 1) // 9
    fitted, total = [], 0
    for part in outline + lines[::step][:10]:
        if total + len(part) > 90 and fitted:
            break
        fitted.append(part)
        total += len(part)
        if total >= 90:
            break
    assert r[0].p == "\n".join(fitted)


def test_digests_are_one_algorithm(spark):
    rows = [("s", f"p{i}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(400)]
    digest = lambda rs: cp.snapshot_digest(spark.createDataFrame(rs, "scan_id string, path string, sha256 string")).first().digest
    buckets = {}
    for _, p, h in sorted(rows):
        buckets.setdefault(hashlib.sha256(p.encode()).hexdigest()[:3], []).append(f"{p}\0{h}")
    top = "\n".join(f"{b}:{hashlib.sha256(chr(10).join(e).encode()).hexdigest()}" for b, e in sorted(buckets.items()))
    assert digest(rows) == digest(rows[::-1]) == "scanlake-snapshot/v2:sha256:" + hashlib.sha256(top.encode()).hexdigest()
    assert digest(rows) != digest(rows[1:]) and digest(rows) != digest([("s", "p0", "0" * 64), *rows[1:]])
    schema = "scan_id string, path string, sha256 string, language string, risk_signals array<string>, priority int"
    work = lambda pr: spark.createDataFrame([("s", f"p{i}", "h", "python", ["a"], pr if i == 7 else 100) for i in range(400)], schema)
    seen = set()
    for n in (4, 7):  # the digest follows neither the input's partitions nor the shuffle's
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seen.add(pl.worklist_digest(work(100).repartition(n)).first().digest)
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1 and pl.worklist_digest(work(200)).first().digest not in seen


def test_anchored_and_edge_rules(spark, corpus):
    rule = lambda p: Rule("own-rule", "CWE-1", "low", "x", p)
    files = corpus({"a.py": "x = 1\nimport os\neval(y)\npassword=1\nfoo-bar\n"})
    for pattern, line in ((r"^import os$", 2), (r"\beval\b\(", 3), (r"\bpassword\b=", 4), (r"\bfoo\b-bar", 5), (r"\bimport\b os", 2), (r"os\b", 2), (r"\b[a-z]+-\bbar\b$", 5)):
        found = pt.scan_files(files, [rule(pattern)], {"p": None}, {})
        assert [r.line for r in found.collect()] == [line], pattern
    assert [r.line for r in pt.corpus_search(files, "^IMPORT").collect()] == [2]


def test_sarif_intake(spark):
    rule = {"id": "r1", "shortDescription": {"text": "Short"}, "properties": {"tags": ["x", "CWE-22"]}}
    res = lambda **k: {"ruleId": "r1", "message": {"text": " m "}, "level": "error", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}], **k}
    doc = {"version": "2.1.0", "runs": [{"tool": {"driver": {"rules": [rule]}}, "results": [res(), res(ruleId="r9", locations=[{}])]}, {"results": [res(properties={"cwe": "CWE-9"})]}]}
    text = json.dumps(doc)
    rows = sorted(intake.sarif_findings(spark.createDataFrame([("f", text)], "source_path string, content string")).collect(), key=lambda r: r["index"])
    assert [(r.title, r.cwe, r.description) for r in rows] == [("Short", "CWE-22", "m"), ("r9", None, "m"), ("r1", "CWE-9", "m")]
    assert [len(r.locations) for r in rows] == [1, 0, 1] and rows[0].locations[0].line == 3
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert rows[2].id == "imp_" + hashlib.sha256(f"{sha}:2:r1".encode()).hexdigest()[:24]


def test_generic_intake(spark):
    docs = [("a/list.json", json.dumps([{"title": " T ", "severity": 5, "component": 7}, {"name": "N", "summary": "s"}])), ("a/one.json", json.dumps({"findings": [{"title": "F"}]})), ("a/free.txt", "just text")]
    got = sorted((r.title, r.description, r.severity, r.component, r.source_type) for r in intake.read_findings(spark.createDataFrame(docs, "source_path string, content string")).collect())
    assert got == [("F", '{"title":"F"}', None, None, "generic"), ("N", "s", None, None, "generic"), ("T", '{"component":7,"severity":5,"title":" T "}', None, "7", "generic"), ("free.txt", "just text", None, None, "text")]


def test_files_targets_and_exports(spark, tmp_path):
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "repo" / "big.py").write_text("y" * 100)
    files = cs.read_files(spark, str(tmp_path / "repo"), "s", max_bytes=50)
    assert [(r.path, r.content) for r in files.collect()] == [("src/a.py", "x = 1\n")]
    (tmp_path / "t.csv").write_text('name,path\nx, "b/two" \ny,a/one\nz,\nw,a/one\n')
    assert [r.path for r in cs.read_targets_csv(spark, str(tmp_path / "t.csv")).collect()] == ["a/one", "b/two"]
    (tmp_path / "u.csv").write_text("b\na,1\n")
    assert [r.path for r in cs.read_targets_csv(spark, str(tmp_path / "u.csv")).collect()] == ["a", "b"]
    f = spark.createDataFrame([("s", "i1", "c1", "fp", "a.b", 'T "q", x', "high", "low", "CWE-1", "reportable", "open", "why", "v", "p", "im", "re", [("a.py", 0, "code", "sink")], 1)],
                              "scan_id string, id string, candidate_id string, fingerprint string, rule_id string, title string, severity string, confidence string, cwe string, disposition string, status string, "
                              "root_cause string, validation string, attack_path string, impact string, remediation string, locations array<struct<file:string,line:int,excerpt:string,role:string>>, ord int")
    rp.csv_export(f, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.title == 'T "q", x' and back.file == "a.py" and len(back) == 16
    rp.sarif_export(f, str(tmp_path / "sarif"))
    result = json.loads(spark.read.text(str(tmp_path / "sarif" / "results")).first().value)
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["region"]["startLine"] == 1


def test_lease_expiry_stream(spark, tmp_path):
    from scanlake.streaming import jobs
    rows = [("t1", "a", "claim", "2024-01-01 00:00:00"), ("t2", "b", "claim", "2024-01-01 00:00:00"), ("t2", "b", "complete", "2024-01-01 00:01:00"),
            ("t3", "c", "claim", "2024-01-01 00:00:00"), ("t3", "c", "renew", "2024-01-01 00:01:00"), ("t1", "d", "claim", "2024-01-01 00:05:00"), ("t9", "z", "look", "2024-01-01 06:00:00"), ("t9", "z", "claim", "2024-01-01 06:00:00")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "task_id string, owner string, action string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("task_id string, owner string, action string, at timestamp").parquet(src)
    q = jobs.lease_expiry(stream, 120).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.task_id, r.owner, str(r.expired_at)) for r in spark.read.schema(jobs.LEASE_OUT).parquet(str(tmp_path / "out")).collect())
    assert got == [("t1", "a", "2024-01-01 00:02:00"), ("t1", "d", "2024-01-01 00:07:00"), ("t3", "c", "2024-01-01 00:03:00")]


def test_facts_go_back_as_arrow(corpus):
    """Fact rows leave Python as typed Arrow columns (as pandas objects they cost more than finding them), in batches of bounded size."""
    from scanlake.functions import facts as fa

    files = corpus({"a.c": "f(x, (y));\n" * 3, "b.c": "", "c.c": "g = 1"})
    found = fa.extract(files, {"call": r"\b(f)\s*\(", "name": r"(g)|(h)"}, "[fg]")
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    rows = sorted(found.collect(), key=lambda r: (r.path, r.start))
    assert [(r.path, r.kind, r.line, r.g, r.open, r.close, r.args, r.parens) for r in rows] == [
        ("a.c", "call", 1, ["f"], 1, 8, ["x", "(y)"], []), ("a.c", "call", 2, ["f"], 12, 19, ["x", "(y)"], []), ("a.c", "call", 3, ["f"], 23, 30, ["x", "(y)"], []),
        ("c.c", "name", 1, ["g", ""], None, None, None, [])]


def test_a_preview_splits_its_text_once(spark):
    """The lines of a text are made once, not again for every line that is shown; the sort of the work order reads finished rows."""
    from scanlake.operators import planning as pl

    frame = spark.createDataFrame([("s", "a.py", "\n".join(f"line {i}\x01" for i in range(40))), ("s", "b.py", ""), ("s", "c.py", "class A:\n  x"), ("s", "d.py", None)], "scan_id string, path string, content string")
    assert str(cl.sample_lines(F.col("content"))).count("split(") == 1
    assert str(cl.file_preview(F.col("content"))).count("regexp_replace(") == 1
    got = {r.path: r.p for r in frame.select("path", cl.file_preview(F.col("content")).alias("p")).collect()}
    assert got == {"a.py": "\n".join(f"line {i}" for i in range(0, 40, 4)), "b.py": "", "c.py": "class A\nclass A:\n  x", "d.py": None}
    ranked = pl.rank_input(pl.file_worklist(frame, preview=True))
    assert "regexp_replace" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    assert [r.path for r in ranked.collect()] == ["a.py", "b.py", "c.py", "d.py"]
