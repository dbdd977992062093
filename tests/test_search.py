"""Literals that expressions need, the trigram index, and scans of many rules, each against the plain scan."""

import random
import re

import pytest

from scanlake.functions.required import required
from scanlake.operators import patterns as pt, search as sr


@pytest.mark.parametrize("pattern, needs", [
    ("secret|token", [{"secret", "token"}]), ("pass(word)?", [{"pass"}]), (r"\bAKIA[0-9]{16}\b", [{"akia"}]), (r"a.b", []), (r"(?:get|post)_url\s*\(", [{"get", "post"}, {"_url"}]),
    (r"foo(bar)baz", [{"foobarbaz"}]), (r"(?!never)always", [{"always"}]), (r"(abc|d.)xyz", [{"xyz"}]), ("ünder_line", [{"nder_line"}]), (r"x{3}yes", [{"yes"}]), (r"(?i)SELECT\s+\*", [{"select"}]),
    (r"ab", []), (r"(unclosed", []), (r"(abc)+(def)*", [{"abc"}]), (r"[k]ey_", [{"key_"}]),
])
def test_required(pattern, needs):
    assert [set(x) for x in required(pattern)] == needs


def test_required_is_never_too_strict():
    rnd = random.Random(1)
    parts = ["abc", "de", "(fgh|ijk)", "(lm|nop)", "x?", "[q-s]+", ".", r"\w", "(tuv)?", "(wxy)+", "z{2}", "^", "$", r"\b", "(?:aaa|)", "(?=abc)"]
    for _ in range(3000):
        pattern = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
        text = "".join(rnd.choice(["abc", "de", "fgh", "ijk", "lm", "nop", "q", "tuv", "wxy", "zz", "x", " "]) for _ in range(rnd.randint(1, 8)))
        if re.search(pattern, text):
            assert all(any(w in text for w in words) for words in required(pattern)), (pattern, text)


def plain(frame, pattern):
    return [tuple(r) for r in pt.corpus_search(frame, pattern, 1000).collect()]


def test_indexed_search(spark, corpus, monkeypatch):
    files = {f"src/f{i}.py": f"def f{i}():\n    return lookup({i})  # Kİey\n" for i in range(40)}
    files |= {"a/secret.py": "Password = 'x'\nSECRET_TOKEN = 1\n", "a/two.py": "tok\nen = 2", "a/empty.py": "", "a/none.py": None}
    frame = corpus(files)
    index = sr.store_folder(spark, "index")
    sr.add_to_index(frame, index)
    for named in (1000, 1):
        monkeypatch.setattr(sr, "NAMED", named)
        for pattern in ("secret|token", r"f1\d\(", "lookup", "return.*12", "no such thing", "a", r"^\s+return", "(?:password|lookup)\\s*[=(]"):
            assert [tuple(r) for r in sr.indexed_search(frame, index, pattern, 1000).collect()] == plain(frame, pattern), pattern
    assert {r.path for r in sr.candidates(spark, index, "secret|token").collect()} == {"a/secret.py"}
    assert sr.candidates(spark, index, "a.b") is None
    monkeypatch.setattr(sr, "NAMED", 1000)
    found = sr.indexed_search(frame, index, "secret|token")
    assert "a/secret.py" in found._jdf.queryExecution().optimizedPlan().toString() and "a/two.py" not in found._jdf.queryExecution().optimizedPlan().toString()
    # a changed file: old postings make it a candidate in vain, new ones are found
    changed = corpus({"a/secret.py": "nothing\n", "a/new.py": "token = 3\n"})
    sr.add_to_index(changed, index)
    now = corpus({**files, "a/secret.py": "nothing\n", "a/new.py": "token = 3\n"})
    assert [tuple(r) for r in sr.indexed_search(now, index, "secret|token").collect()] == plain(now, "secret|token") == [("a/new.py", 1, "token = 3")]


def test_many_rules(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "42", "Zeta("]
    lines = [(f"p{i}", i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(200)] + [("p", 900, None), ("p", 901, "")]
    rules = [("alpha beta", r"alpha\s+beta"), ("cased", r"(?i)GAMMA"), ("digits", r"\d\d"), ("either", r"(?:delta|zeta\() eps"), ("any case", r"(?i)(?:delta|zeta\() eps"), ("jvm", r"^\p{Alpha}+$"), ("never", "nothing here"), ("null", None)]
    frame = spark.createDataFrame(lines, "path string, line int, text string")
    table = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(rules)], "rule_no int, rule_id string, pattern string")
    want = set()
    for i, (n, p) in enumerate(rules):
        if p:
            want |= {(r.path, r.line, i) for r in frame.filter(frame.text.rlike(p)).collect()}
    for lot in (8 << 20, 100):
        monkeypatch.setattr(sr, "LOT_BYTES", lot)
        found = [(r.path, r.line, r.rule_no) for r in sr.many_rules(frame, table).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert sr.many_rules(frame, table.limit(0)).count() == 0 and sr.many_rules(frame.limit(0), table).count() == 0


def test_many_rules_reads_the_lines_once(spark, monkeypatch):
    """However many rules there are, the lines are read once, and only the literal's hash brings a line and a rule together."""
    monkeypatch.setattr(sr, "LOT_BYTES", 100)
    texts = [f"sold Deal{i} of part{i % 7};" for i in range(60)] + ["deal12\u212a", "Deal7\u0130", "xdeal5", "deal5_", "-deal5-", "abcdefghijklmnopqrst", "xabcdefghijklmnopqrstu"]
    rules = [(i, f"d{i}", rf"(?i)\bdeal{i}\b") for i in range(60)] + [(100 + i, f"p{i}", f"PART{i};") for i in range(7)] + [(200 + i, f"q{i}", f"(?i)PART{i};") for i in range(7)]
    rules += [(300, "long", r"\babcdefghijklmnopqrst\b"), (301, "either", "(?:deal5|part5|sold)"), (302, "two", r"\d\d")]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    table = spark.createDataFrame(rules, "rule_no int, rule_id string, pattern string")
    plain = frame.select("text", *[frame.text.rlike(p).alias(str(i)) for i, _, p in rules])
    want = sorted((r["text"], i) for r in plain.collect() for i, _, _ in rules if r[str(i)])
    found = sr.many_rules(frame, table)
    assert sorted((r.text, r.rule_no) for r in found.collect()) == want
    # one pass that looks for literals, not one for each lot of rules
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow near(") == 1
