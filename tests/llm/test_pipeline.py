"""The pipeline's stages against brute force on a small corpus."""
import random

import pytest

pytest.importorskip("ahocorasick")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")

from scanlake.llm.pieces import default_path  # noqa: E402


def words(rnd, n):
    return " ".join("".join(rnd.choice("kato miru sen be ver".split()) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(2)
    plain = [(i, words(rnd, 60)) for i in range(60)]
    item = words(rnd, 40)
    toxic = [(100 + i, words(rnd, 30) + " idiot moron " + words(rnd, 5)) for i in range(30)]
    copies = [(200 + i, plain[i][1]) for i in range(10)]
    leaky = [(300, f"{words(rnd, 20)} {item} {words(rnd, 9)}")]
    secret = [(400, words(rnd, 20) + " password = hunter2hunter2 " + words(rnd, 9))]
    odd = [(500, None), (501, ""), (None, words(rnd, 30)), (plain[3])]
    odd += [(None, "idiot moron " + words(rnd, 30) + " idiot moron"), (None, plain[5][1]), (None, f"{words(rnd, 15)} {item} {words(rnd, 9)}"), (7, "moron idiot " + words(rnd, 30) + " moron idiot")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in plain + toxic + copies + leaky + secret + odd], "doc_id long, text string, lang string, source string, n_chars long, fired string")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 130)) for i, _ in plain + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        left[name] = now.collect()
        if name != "sentencepiece":
            assert now.columns == docs.columns
    ids = {n: sorted((r.doc_id for r in rows if r.doc_id is not None)) for n, rows in left.items()}
    clean = [i for i, _ in plain]
    assert ids["toxicity"] == sorted(clean + [3] + list(range(200, 210)) + [300, 400, 500, 501])
    assert ids["simhash_dedup"] == sorted(clean + [300, 400, 500])
    assert ids["decontamination"] == ids["secret_scan"] == ids["sentencepiece"] == sorted(clean + [400, 500])
    assert sum(r.doc_id is None for r in left["sentencepiece"]) == 1  # the toxic one, the copy and the leak without an id are gone
    twice = sorted(r.text for r in left["decontamination"] if r.doc_id == 3)
    assert twice == sorted([plain[3][1]])
    assert sorted(r.text for r in left["toxicity"] if r.doc_id == 7) == sorted([plain[7][1]])
    (hidden,) = [r for r in left["secret_scan"] if r.doc_id == 400]
    assert "hunter2" not in hidden.text and "[secret]" in hidden.text and hidden.n_chars == len(hidden.text)
    library = sentencepiece.SentencePieceProcessor(model_file=default_path())
    texts = {r.doc_id: r.text for r in left["secret_scan"]}
    assert all(r.ids == library.encode(texts[r.doc_id] or "") for r in left["sentencepiece"])
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()} == {(r.doc_id, tuple(r.ids)) for r in left["sentencepiece"]}


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
