"""Turn repair against enumeration, infilling against its definition, repetition counts against plain counting."""
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from scanlake.llm import infill, quality, turn_repair as T

SOUND = re.compile(r"(s?(ua)+)?")


def enumerated(code, most):
    """Least (cost, letters) over all edit sequences with at most ``most`` inserts in a row."""
    inserts = [x for n in range(most + 1) for x in itertools.product("ua", repeat=n)]
    best = []

    def go(i, cost, letters, roles):
        if best and cost > best[0][0]:
            return
        for ins in inserts:
            c, w, r = cost + 2 * len(ins), letters + "I" * len(ins), roles + "".join(ins)
            if i == len(code):
                if SOUND.fullmatch(r):
                    best[:] = [min([(c, w), *best])]
                continue
            go(i + 1, c + 3, w + "D", r)
            if code[i] != "d":
                t = int(code[i].isupper())
                go(i + 1, c + t, w + "K", r + code[i].lower())
                for role in "ua":
                    go(i + 1, c + t + 2, w + "R", r + role)

    go(0, 0, "", "")
    return best[0]


def by_states(code):
    """The same for longer codes, one row after the other over the states of the grammar."""
    def close(b):
        for _ in range(3):
            for s, to in ((0, 2), (1, 2), (2, 3), (3, 2)):
                if s in b:
                    b[to] = min(b.get(to, (1 << 40, "")), (b[s][0] + 2, b[s][1] + "I"))
        return b

    best = close({0: (0, "")})
    for c in code:
        new = {}
        for s, (k, w) in best.items():
            steps = [(s, k + 3, w + "D")]
            if c != "d":
                for e in {0: "su", 1: "u", 2: "a", 3: "u"}[s]:
                    if e == c.lower() or e != "s":
                        steps.append(("sua".index(e) + 1, k + c.isupper() + 2 * (e != c.lower()), w + ("K" if e == c.lower() else "R")))
            for to, cost, letters in steps:
                new[to] = min(new.get(to, (1 << 40, "")), (cost, letters))
        best = close(new)
    return min(best[s] for s in (0, 3) if s in best)


def test_cheapest_equals_enumeration(monkeypatch):
    letters = "suadxSUAX"
    for n in range(4):
        for code in map("".join, itertools.product(letters, repeat=n)):
            found = T.cheapest(code)
            assert (T.cost_of(code, found), found) == enumerated(code, 2), code
    rnd = random.Random(1)
    for block in (1, 2, 3, 5, 128):
        monkeypatch.setattr(T, "BLOCK", block)
        for _ in range(1500):
            code = "".join(rnd.choice("uauauasdUAxSX") for _ in range(rnd.randint(0, 16)))
            found = T.cheapest(code)
            assert (T.cost_of(code, found), found) == by_states(code), (block, code)


def test_long_code_is_linear_in_blocks():
    rnd = random.Random(2)
    code = "".join(rnd.choice("uauauauauasdU") for _ in range(3000))
    found = T.cheapest(code)
    assert (T.cost_of(code, found), found) == by_states(code)


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 3, "user", "Why?"), (1, 5, "assistant", "cut"),
    (2, None, "user", "Null turn."), (2, 4, "user", "Again."), (2, 4, "user", "Again."), (2, 9, None, None), (2, 10, "tool", "x."), (2, 10, "", "y."),
    (None, None, None, None), (None, 1, "user", "No id."), (3, 7, "assistant", " \n\x0b"), (4, 1, "user", "é."), (4, 2, "assistant", "Yes. " * 3000),
    *[(5, i, ("user", "assistant")[i % 3 == 1], f"turn {i % 11}{'.' * (i % 4 > 0)}") for i in range(60)],
]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 9, "z") for r in rows], "conv_id long, turn long, role string, text string, _k string, part long, block string")


def test_repairs_texts_and_counts(spark):
    found = {r.conv_id: r for r in T.repairs(rows_of(spark, TURNS)).collect()}
    assert set(found) == {1, 2, 3, 4, 5, None}
    one = found[1]
    assert one.audit == T.cheapest("suadA") and one.cost == T.cost_of("suadA", one.audit)
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (1, 0, 1, 1, 0)
    assert [(t.edit, t.role, t.text) for t in one.turns][:3] == [("K", "system", "Be kind."), ("K", "user", "Why?"), ("K", "assistant", "So.")]
    two = found[2]
    assert (two.gaps, two.blank, two.duplicate) == (4, 1, 1) and two.turns[0].text == "Null turn."
    assert (found[3].audit, found[3].cost, found[3].blank) == ("D", 3, 1)
    assert found[4].audit == "KK" and found[4].turns[1].text == "Yes. " * 3000
    assert found[None].audit == T.cheapest("du") and [t.role for t in found[None].turns if t.edit != "D"] in ([], ["user", "assistant"])
    for r in found.values():
        assert SOUND.fullmatch("".join(t.role[0] for t in r.turns if t.edit != "D"))
    assert T.repairs(rows_of(spark, TURNS).limit(0)).count() == 0


def test_long_conversations_in_parts_give_the_same(spark, monkeypatch):
    rows = rows_of(spark, TURNS)
    whole = sorted(map(str, T.damage_report(rows).collect()))
    alone = {r.conv_id: [t for t in r.turns] for r in T.repairs(rows).collect()}
    monkeypatch.setattr(T, "LONG_ROWS", 2)
    monkeypatch.setattr(T, "BLOCK", 4)
    assert sorted(map(str, T.damage_report(rows).collect())) == whole
    parts = sorted(T.repairs(rows).collect(), key=lambda r: (r.conv_id or 0, r.part))
    assert sum(r.conv_id == 5 for r in parts) == 15
    joined = collections.defaultdict(list)
    for r in parts:
        joined[r.conv_id] += r.turns
    assert joined == alone


def test_damage_report_keeps_every_id(spark):
    ids = [r.conv_id for r in T.damage_report(rows_of(spark, [(i, 0, "user", "Hi.") for i in range(200)])).collect()]
    assert sorted(ids) == list(range(200))
    empty = [r for r in T.damage_report(rows_of(spark, [(i, 0, "user", "Hi.") for i in range(200)])).collect() if r.audit == ""]
    assert empty and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.cost == 0 for r in empty)


def test_fenwick_descends_to_the_block():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 65):
        counts = rnd.integers(0, 4, n)
        tree = infill.Fenwick(np.stack([counts, np.full(n, 5)], axis=1))
        run = np.cumsum(counts)
        assert tree.total().tolist() == [int(run[-1]), 5 * n]
        for k in range(1, int(run[-1]) + 1):
            block, before = tree.descend(k)
            assert block == int(np.searchsorted(run, k)) and before.tolist() == [int(run[block] - counts[block]), 5 * block]


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_units_end_where_the_expression_says(monkeypatch, unit):
    monkeypatch.setattr(infill, "BLOCK", 5)
    rnd = random.Random(4)
    for _ in range(150):
        text = "".join(rnd.choice("ab é\n𝄞") for _ in range(rnd.randint(0, 60)))
        ends = [m.end() for m in re.finditer(infill.UNITS[unit], text)]
        units = infill.Units(text, infill.UNITS[unit])
        assert units.n == len(ends) and [units.end_of(k) for k in range(len(ends) + 1)] == [0, *ends]


def test_infill_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(77 + i, f"é{i}𝄞<" * 40 + ("<S>" if i == 3 else ""), "en", "s", 1, "x", 1, 1) for i in range(40)], odd_docs.schema))
    found = infill.transform(docs).withColumn("back", infill.restored()).collect()
    assert len(found) == docs.count()
    texts = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id or -1, r.back) for r in found) == texts
    assert {r.form for r in found} == {"plain", "psm", "spm"} and all((r.form == "plain") == (r.middle_chars is None) for r in found)
    assert next(r for r in found if r.doc_id == 80).form == "plain"
    for r in found:
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        a, b = sorted(int(h[i : i + 8], 16) % (r.n + 1) for i in (0, 8))
        t = r.back
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[r.form]
        assert r.output == want and r.n == len(t)
    assert infill.transform(no_docs).count() == 0


def counted(text):
    """Repetition by counting tuples."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(again),
           "dup_line_chars": sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in again)}
    for n in (3, *quality.NGRAM_SHARE):
        seen = collections.defaultdict(list)
        for i in range(len(words) - n + 1):
            seen[tuple(words[i : i + n])].append(i)
        held = {k for at in seen.values() if len(at) > 1 for i in (at if n == 3 else at[1:]) for k in range(i, i + n)}
        out["n_repeat_words" if n == 3 else f"dup_{n}gram_chars"] = len(held) if n == 3 else sum(len(words[k]) for k in held)
    return out


def test_counts_equal_plain_counting():
    rnd = random.Random(5)
    texts = ["", " \n", "a", "a a a a", "x\ny\nx\n x\nx"]
    for _ in range(300):
        few = rnd.choice([2, 3, 10, 200])
        texts.append("".join(f"w{rnd.randrange(few)}é" + rnd.choice([" ", " ", "\n", "\t ", " ", "#| "]) for _ in range(rnd.randint(0, 120))))
    m = quality.measure(texts)
    for i, t in enumerate(texts):
        assert {k: int(m[k][i]) for k in quality.COUNTS} == counted(t), t


def test_colliding_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(quality, "_mixed", lambda x: (x.astype(np.uint64) % np.uint64(2)))
    texts = ["a b c d a b c e a b c d f g h", "a b c d e f g h i j k l a b c"]
    m = quality.measure(texts)
    for i, t in enumerate(texts):
        assert {k: int(m[k][i]) for k in quality.COUNTS} == counted(t)


def test_judge_rows(spark, odd_docs, no_docs):
    rnd = random.Random(6)
    clean = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(300))
    line = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    more = [(500, clean, "en", "s", 1, "x", 1, 1), (501, clean + ("\n" + line) * 12, "en", "s", 1, "x", 1, 1), (502, "word " * 400, "en", "s", 1, "x", 1, 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    found = quality.judge(docs).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[500].kept and not by_id[501].kept and not by_id[501].base_failed and by_id[502].base_failed
    assert all(r.base_failed and not r.kept for r in found if r.n_words == 0)
    assert by_id[6].n_words == 30_000 and by_id[6].n_repeat_words == 30_000
    assert quality.judge(no_docs).count() == 0
