"""Steps that Spark or a pattern used to work out more than once: one look per text, and the same rows."""

import random
import re
import time

from pyspark.sql import functions as F

from scanlake.functions import facts, text as tx
from scanlake.operators import graph, patterns as pt, report as rp, taint as tt
from scanlake.sources import intake


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trim_looks_at_the_ends(spark):
    gap = "a" + " " * 200_000 + "b"
    rows = [gap, f"　\t {gap}\r\n﻿", "  ", "", None, "x"]
    started = time.time()
    out = [r.t for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(tx.trim(F.col("t")).alias("t")).collect()]
    assert out == [gap, gap, "", "", None, "x"] and time.time() - started < 10
    blank = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    frame = spark.createDataFrame([(c,) for c in blank], "c string").withColumn("p", F.regexp_replace("c", rf"^{tx.BLANK}+|{tx.BLANK}+\z", ""))
    assert frame.filter(F.col("p") != tx.trim(F.col("c"))).count() == 0


def test_lines_are_split_once(spark, corpus):
    files = corpus({"a": "x\r\n\n", "b": "", "c": None})
    lines = pt.explode_lines(files)
    assert sorted((r.path, r.line, r.text) for r in lines.collect()) == [("a", 1, "x"), ("a", 2, ""), ("a", 3, ""), ("b", 1, "")]
    assert plan(lines).count("split(") == 1


def test_sections_are_folded_once(spark):
    a, b, c = "## A", "## B", "## C"
    rows = [("all", f"{a}  \r\ntext {b}\n\t{b}\n{c}"), ("order", f"{b}\n{a}\n{c}"), ("none", "text"), ("empty", ""), ("null", None)]
    out = rp.section_errors(spark.createDataFrame(rows, "report_id string, content string"), (a, b, c))
    miss = lambda *names: [f"Missing required section: {n}" for n in names]
    want = {"all": [], "order": miss(b), "none": miss(a, b, c), "empty": miss(a, b, c), "null": []}
    got = {k: [] for k in want}
    for r in out.collect():
        got[r.report_id].append(r.error)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert plan(out).count("array_position") == 1


def test_credentials_are_folded_once(spark, corpus):
    files = corpus({
        "a.py": 'note = """one\ntwo"""\nx.api_key = "k1-abcdefgh"\n# token = "abcdefgh1"\n9password: \'multi\nline-1\'\nsecret = "example-value"\nsecret = "short"\ndb_token:="t2-abcdefgh"',
        "b.py": "secret " + "w" * 100_000 + " = 1",
    })
    started = time.time()
    out = pt.embedded_credentials(files)
    got = {(r.file, r.line, r.field, r.value) for r in out.collect()}
    assert got == {("a.py", 3, "api_key", "k1-abcdefgh"), ("a.py", 5, "password", "multi\nline-1"), ("a.py", 9, "db_token", "t2-abcdefgh")}
    assert time.time() - started < 20 and plan(out).count("regexp_extract_all") == 1


def test_alert_instances_are_parsed_once(spark):
    raw = spark.createDataFrame([("r", 0, '{"number":1}'), ("r", 1, '{"number":2}')], "repository string, pos int, alert string")
    spots = [("r", "1", '{"location":{"path":" b ","start_line":2}}'), ("r", "1", '{"path":"a","line":1}'), ("r", "1", '{"path":{"x":1}}'), ("r", "2", "no json")]
    out = intake.normalize_alerts(raw, spark.createDataFrame(spots, "repository string, number string, instance string"), "code_scanning")
    assert {r.input_id: [tuple(x) for x in r.locations] for r in out.collect()} == {"r:code_scanning:1": [("a", 1), ("b", 2)], "r:code_scanning:2": []}
    assert len(re.findall(r"(?:parse_json|parseJson)\(instance", plan(out))) == 1


def test_program_makes_what_is_read(corpus):
    p = tt.program(corpus({"a.py": "def f(x):\n    os.system(x)\nf(1)\n"}), "python")
    assert {(r.line, r.callee) for r in p.edges.collect()} == {(1, "a.py:f"), (3, "a.py:f")}
    assert not {"assigns", "sinks", "spans"} & set(vars(p))


def test_call_rows_are_those_of_the_facts():
    rnd = random.Random(3)
    call = re.compile(tt.CALL)
    bits = ["f(", "a.b(", "x, ", ")", "\n", '"', "'", "[1, 2]", "{", "}", "(", "y", " ", "`", "\r\n", "g(h(1), 2)"]
    for _ in range(500):
        text = "".join(rnd.choices(bits, k=rnd.randrange(40)))
        want = [(line, shown, at, g, args) for _, at, _, line, _, g, _, close, close_line, args, _, _, shown in facts.file_facts(text, {"call": call}) if close is not None and close_line == line]
        assert list(facts._call_rows(text, call)) == want


def test_spread_by_home(spark, monkeypatch):
    rnd = random.Random(5)
    schema = "s string, fn string, p int, s_at string, fn_at string, p_at int"
    monkeypatch.setattr(graph, "LOCAL_EDGES", 6)
    contracted = []
    inner = graph._contracted
    monkeypatch.setattr(graph, "_contracted", lambda e, s: contracted.append(1) or inner(e, s))
    for crossing in (False, True):
        links, given = [], []
        for f in range(6):
            name = lambda i, f=f: f"d/f{f}.py:g{i}"
            links += [("s", name(i), 0, "s", name(i + 1), 0) for i in range(5)]
            given.append(("s", name(rnd.randrange(2, 6)), 0, f"sink{f}"))
        if crossing:
            links += [("s", "d/f0.py:g4", 0, "s", "d/f1.py:g0", 0), ("s", "d/f1.py:g1", 0, "s", "d/f2.py:g2", 0)]
        frame, known = spark.createDataFrame(links, schema), spark.createDataFrame(given, "s string, fn string, p int, sink string")
        keys = ["s", "fn", "p"]
        contracted.clear()
        split = {tuple(r) for r in graph.spread(frame, known, keys, keys, ["sink"], home=lambda fn: F.regexp_replace(fn, r":[^:]*\z", "")).collect()}
        assert bool(contracted) == crossing
        assert split == {tuple(r) for r in graph.spread(frame, known, keys, keys, ["sink"]).collect()} and split
