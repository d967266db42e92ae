"""The pipeline's stages on a small corpus with planted cases, and the quality classifier."""

import math
import random

import pytest

import corpus_pipeline
from lakeloom.llm import quality


def test_scores_separate_and_survive_odd_rows(spark):
    random.seed(1)
    good = [" ".join(random.choices("the of and river house walks slowly".split(), k=40)) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in random.choices("buy now cheap pills".split(), k=40)) for _ in range(120)]
    rows = [(i, x, "en") for i, x in enumerate(good + bad)] + [(None, None, None), (900, "", "x"), (901, "a" * 200_000, "x"), (0, good[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)] + [(None, 1, 0), (5, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and all(r.predicted == int(r.doc_id < 120) for r in held)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(i % 40, f"good words in order {i % 40}" if i % 2 else f"bad bad bad {i % 40}", 7, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out int, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert len(quality.training_rows(docs, labels, "doc_id", "text", "quality", lambda k: k >= 0, 500)) == 40
    found = quality.classify(docs, labels)
    assert dict(found.dtypes)["held_out"] == "boolean" and dict(found.dtypes)["predicted"] == "int" and found.count() == 400


def test_scores_agree_with_features(spark):
    """Scoring by words gives what the features of the whole text give."""
    random.seed(2)
    texts = [" ".join(random.choices(["a", "bb", "ccc", "çé", "x" * 300], k=n)) for n in range(60)]
    model = quality.train([(*quality.Features()(x), i % 2) for i, x in enumerate(texts)])
    found = {r.text: r.score for r in quality.score(spark.createDataFrame([(x,) for x in texts], "text string"), model).collect()}
    for x in texts:
        assert abs(found[x] - 1 / (1 + math.exp(-model.logit(*quality.Features()(x))))) < 1e-5


def test_held_out_labels_are_not_learned(spark):
    import zlib

    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    docs = labels.selectExpr("doc_id", "concat('w', doc_id) AS text")
    rows = quality.training_rows(docs, labels, "doc_id", "text", "quality", lambda k: ~quality.held_out(k), 500)
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(3)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("ban", "cor", "dil", "fen", "gor", "hul")]
    say = lambda n: " ".join(random.choices(words, k=n))
    texts = {i: say(90) for i in range(60)}
    texts[60] = texts[3]
    texts[61] = texts[4].replace("loban", "lobar", 1)
    item = say(30)
    texts[62] = say(40) + " " + item + " " + say(20)
    shared = say(20)
    for i in (63, 64, 65):
        texts[i] = say(80) + "\n" + shared
    for i in range(66, 126):
        texts[i] = " ".join(w.upper() + "!!" for w in random.choices(words, k=50))
    texts[126], texts[127] = None, ""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, x, "en", "s", len(x or "")) for i, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 66), 0) for i in range(126) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def test_stages_and_run(spark, corpus):
    folder, texts = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert set(range(66)) <= kept and not kept & set(range(66, 126))
    lines = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs.where("doc_id < 66"), folder).collect()}
    assert 60 not in lines and 61 not in lines
    assert [lines[i].text.count("\n") for i in (63, 64, 65)] == [1, 0, 0] and all(r.n_chars == len(r.text) for r in lines.values())
    near = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs.where("doc_id = 5")), folder).collect()}
    assert 60 not in near and 3 in near and {126, 127} & near == {126}
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, folder).collect()}
    assert clean == set(texts) - {62}
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(range(60)) <= set(last) and not set(last) & ({60, 61, 62} | set(range(66, 126)))
    assert corpus_pipeline.run(spark, folder).columns[0] == "doc_id"


def test_no_swallowed_documents_without_ids(spark):
    rows = [(None, f"text number {i} about something else {i * i}", "en", "s", 1) for i in range(5)] + [(None, "same words here now", "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 6
