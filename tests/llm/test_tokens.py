"""Token ids and counts against the library, and exact round trips."""
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from scanlake.llm import codec, pieces, tables, token_counts  # noqa: E402
from scanlake.llm.pieces import default_path, vocabulary  # noqa: E402

FIXED = ["", " ", "  a", "a  ", "\n", "a\n", " \n b", "\n\n x", "a \n\n  b", "a▁b", "<s> </s> <0x0A> <unk>", "日本語 テキスト", "é ﬁ 😀😀 x", "\t\ta\tb", " " * 50 + "x" + " " * 33,
         "aaaaaaaaaaaaaaaaaaaa" * 9, "http://a.b/c?d=e&f=g", "\x00\x01", "=====-----____", "the internationalisation of thorough things"]


def texts():
    rnd = random.Random(1)
    return FIXED + ["".join(rnd.choice("abeinrt \n'.-▁éß日😀123") for _ in range(rnd.randint(0, 50))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_path())


def test_ids_are_the_librarys(library):
    for t, ids in zip(texts(), codec.encode_texts(default_path(), texts())):
        assert ids.tolist() == library.encode(t), t
        assert codec.decode_ids(default_path(), ids.tolist()) == library.decode(ids.tolist()), t


def test_encode_decode_odd_rows(spark, odd_docs, no_docs, library):
    rows = codec.encode(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    want = sorted(library.encode(r.text or "") for r in odd_docs.collect())
    assert sorted(r.ids for r in rows) == want
    back = codec.decode(codec.encode(odd_docs)).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in odd_docs.collect())
    assert codec.encode(no_docs).count() == 0 and codec.decode(codec.encode(no_docs)).count() == 0
    assert codec.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None


def test_prefix_counts(spark, library):
    some = [t for t in texts() if len(t) < 80][:120]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    table = token_counts.prefix_table(df)
    for r in table.collect():
        t = some[r.doc_id]
        assert r.prefix_tokens == [len(library.encode(t[:k])) for k in range(len(t) + 1)], t
    asked = table.select("doc_id", token_counts.tokens_within("prefix_tokens", 3).alias("n"), token_counts.chars_within("prefix_tokens", 4).alias("k")).collect()
    for r in asked:
        t = some[r.doc_id]
        counts = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert r.n == counts[min(3, len(t))] and r.k == max(k for k, c in enumerate(counts) if c <= 4)
    for limit in (0, 1, 5):
        for r in token_counts.token_counts(df, limit=limit).collect():
            t = some[r.doc_id]
            counts = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
            assert r.n_tokens == counts[-1] and r.fit_chars == max(k for k, c in enumerate(counts) if c <= limit), (t, limit)


def test_token_counts_odd_rows(odd_docs, no_docs, library):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens) if r.doc_id is not None else (True, -1, r.n_tokens) for r in token_counts.token_counts(odd_docs).collect())
    want = sorted((r.doc_id is None, -1 if r.doc_id is None else r.doc_id, len(library.encode(r.text or ""))) for r in odd_docs.collect())
    assert got == want
    assert token_counts.token_counts(no_docs).count() == 0


def test_memory_that_overflows_changes_nothing(monkeypatch, library):
    held = tables.Recent(5)
    monkeypatch.setattr(codec, "recent", lambda owner, most: held)
    for t in FIXED * 3:
        assert codec.encode_texts(default_path(), [t])[0].tolist() == library.encode(t)
    counts = tables.Recent(5)
    monkeypatch.setattr(token_counts, "recent", lambda owner, most: counts)
    for t in FIXED * 3:
        cut = [vocabulary(default_path()).segments(t)]
        assert sum(token_counts._totals(default_path(), cut)[0]) == len(library.encode(t))
    assert tables.recent(("a",), 5) is tables.recent(("a",), 5) is not tables.recent(("b",), 5) and ("a",) not in tables._RECENT
    assert vocabulary(default_path()).newline_breaks


def test_long_words(monkeypatch, library):
    """Runs without a space go as rows; every kind of guess, blocks of several rows, characters outside the vocabulary."""
    rnd = random.Random(3)
    monkeypatch.setattr(pieces, "LATTICE_CHARS", 2048)
    runs = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(7001)), "a" * 5000, "ab" * 2600, "abc" * 1700, "=-" * 1025, "the" * 1500, "internationalisation" * 260,
            "".join(rnd.choice("日本語😀éß\x01ab") for _ in range(4100)), "01" * 700 + "\n" + "x" * 1500, "\n" + "word" * 900, "x" * 1024, "x" * 1023]
    for t, ids in zip(runs, codec.encode_texts(default_path(), runs)):
        assert ids.tolist() == library.encode(t), t[:40]
    voc = vocabulary(default_path())
    for t, counts in zip(runs, token_counts._totals(default_path(), [voc.segments(t) for t in runs])):
        assert sum(counts) == len(library.encode(t)), t[:40]
    held = tables.recent(("token_counts", default_path()), token_counts.REMEMBERED)
    assert max(map(len, held.young), default=0) <= pieces.LONG_WORD


def test_rows_that_never_agree(monkeypatch, library):
    """Without joint rounds every row is settled from the one before it."""
    monkeypatch.setattr(pieces, "ROUNDS", 1)
    for t in ("abcde" * 900, "a" * 3001, "thethe" * 400):
        assert codec.encode_texts(default_path(), [t])[0].tolist() == library.encode(t)


def test_fit_in_long_words(spark, library):
    rnd = random.Random(5)
    some = ["".join(rnd.choice("abinrt") for _ in range(1500)), "ab " + "xyz" * 600]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for limit in (0, 1, 7, 100):
        for r in token_counts.token_counts(df, limit=limit).collect():
            t = some[r.doc_id]
            assert r.n_tokens == len(library.encode(t))
            assert r.fit_chars == max(k for k in range(min(len(t), 2000) + 1) if len(library.encode(t[:k])) <= limit)
