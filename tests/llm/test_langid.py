import numpy as np
import pytest

from loomtext.llm import langid, queries

EN = "The committee delivered the new report before the deadline."
FA = "کمیته گزارش تازه را پیش از پایان مهلت تحویل داد."
AR = "سلم المجلس التقرير الجديد قبل انتهاء المهلة في المبنى الرئيسي."


@pytest.mark.parametrize(
    "label,lang",
    [("en", "en"), ("EN", "en"), ("en-US", "en"), ("en_GB", "en"), ("eng", "en"), (" English (UK)", "en"), ("Farsi", "fa"), ("per", "fa"), ("fa-IR", "fa"), ("ar-SA", "ar"), ("ara", "ar"), ("de", "?"), ("German", "?"), (None, None), ("", None), ("  ", None), ("und", None), ("auto", None), ("unknown", None), ("-", None), ("N/A", None)],
)
def test_labels(label, lang):
    assert langid.named_language(label) == lang


def test_segments_cover_the_letters():
    t = f"{EN} {FA}\r\n\n{AR}"
    assert [t[a:b] for a, b in langid.segments(t)] == [EN, FA, AR]
    assert langid.segments("") == [] and langid.segments("\n\n") == []


LARGER = "/root/testdata/sf0.01"  # a few dozen jobs are too few to learn from


@pytest.fixture(scope="module")
def model(spark, sf):
    return langid.fit(spark.read.parquet(f"{LARGER}/jobs.parquet"), "source_language", "source_text")


def sentences(spark, sf, name="documents"):
    df = spark.read.parquet(f"{sf}/{name}.parquet").where("text is not null")
    fold, out = langid.Folder(), []
    for r in df.collect():
        lang = langid.named_language(r["lang"])
        if lang in langid.LANGUAGES:
            out += [(s, lang) for a, b in langid.segments(r["text"]) if len(s := langid.letters_of(r["text"][a:b], fold)) >= 30]
    return out


def test_held_out_accuracy(spark, model):
    seen = sentences(spark, LARGER)  # documents, where the model was trained on jobs
    p = model.probabilities([s for s, _ in seen])
    right = p.argmax(1) == [langid.LANGUAGES.index(x) for _, x in seen]
    assert right.mean() > 0.97, right.mean()
    assert np.allclose(p.sum(1), 1) and (model.weights == 0).mean() > 0.5  # sparse


def test_ngram_counts():
    row, bucket, count = langid.ngram_rows(["aa", "b"])
    assert count[row == 0].sum() == 4 + 3 + 2 + 1 and count[row == 1].sum() == 3 + 2 + 1
    assert len(langid.ngram_rows([])[0]) == 0


def test_no_training_data():
    model = langid.train([], [])
    assert model.probabilities(["x"]).shape == (1, 3)


ROWS = [
    ("a", "en", EN * 3), ("b", None, FA), ("c", "fa", AR), ("d", "und", f"{EN}\n{EN}\n{FA}"), ("e", "en", f"{EN} {EN} این فایل"), ("f", "en", None), ("g", "en", ""), ("h", None, "123 https://x.example/abc"),
    ("i", "de", EN), ("a", "en", EN * 3), (None, "en", EN), ("j", "fa", f"{FA} {FA} Kelid Pro"),
]


def test_defects(spark, model):
    df = spark.createDataFrame(ROWS, "id string, label string, text string").selectExpr("*", "'x' as lang", "1 as k", "2 as t")
    found = langid.detect_languages(df, "id", "text", "label", model)
    rows = {r["id"]: r for r in found.collect()}
    assert rows["a"]["lang"] == "en" and rows["a"]["confidence"] > 0.5 and rows["h"]["lang"] is None and "f" not in rows
    got = {tuple(r) for r in langid.label_defects(found, "id").collect()}
    assert got == {("b", "missing", "fa"), ("c", "wrong", "ar"), ("d", "missing", "en"), ("d", "mixed", "en"), ("d", "mixed", "fa"), ("i", "wrong", "en")}
    assert langid.label_defects(langid.detect_languages(df.where("false"), "id", "text", "label", model), "id").count() == 0


def test_segment_rows(spark, model):
    df = spark.createDataFrame([("d", f"{EN}\n{FA}"), ("n", None)], "id string, text string")
    rows = langid.segment_languages(df, "id", "text", model).orderBy("start_pos").collect()
    assert [(r["id"], r["lang"], r["start_pos"]) for r in rows] == [("d", "en", 0), ("d", "fa", len(EN) + 1)]
    assert all(0 < r["confidence"] <= 1 for r in rows)


def test_fit_on_empty_table(spark):
    empty = spark.createDataFrame([], "l string, t string")
    assert langid.fit(empty, "l", "t").temperature == 1.0


def test_query(spark, sf):
    assert queries.p3_found(spark, sf).columns == ["id", "defect", "lang"]
    assert {r["defect"] for r in queries.p3_found(spark, sf).collect()} <= {"missing", "wrong", "mixed"}
