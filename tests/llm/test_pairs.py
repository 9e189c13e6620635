import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import pairs, queries

EN = "The committee delivered the new report before the deadline."
FA = "کمیته گزارش تازه را پیش از پایان مهلت تحویل داد."


@given(st.text(alphabet="ab", max_size=25), st.text(alphabet="ab", max_size=25), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_suffix_automaton_coverage(s, t, least):
    hit = [False] * len(t)
    for i in range(len(t)):
        for j in range(i + least, len(t) + 1):
            if t[i:j] in s:
                hit[i:j] = [True] * (j - i)
    assert pairs.SuffixAutomaton(s).covered(t, least) == sum(hit)


@pytest.fixture(scope="module")
def judge():
    words = {w: "en" for w in "the before new report deadline committee delivered".split()} | {w: "fa" for w in "را از پیش کمیته گزارش داد تازه".split()} | {w: "ar" for w in "في من على سلم قبل".split()}
    return pairs.PairJudge(words)


@pytest.mark.parametrize(
    "source,target,wanted,defect",
    [
        (EN, None, "fa", "empty"), (EN, "", "fa", "empty"), (EN, " \n​ ", "fa", "empty"), (EN, FA, "fa", None), (FA, EN, "en", None), (EN, EN.upper(), "fa", "copy"), (EN, f"Output: “{EN}”", "fa", "copy"),
        (EN, EN.replace(" ", " ").rstrip("."), "fa", "copy"), ("12.5 / 7", "12.5 / 7", "fa", None), (EN, FA[:30], "fa", "truncated"), (EN, FA[:-1], "fa", "truncated"), ("New report", "گزارش تازه", "fa", None),
        (EN, "I'm sorry, but I can't translate this passage.", "fa", "refusal"), (EN, "متأسفم، به‌عنوان یک مدل زبانی اجازه این کار را ندارم.", "fa", "refusal"), (EN, "عذرا، لا يمكنني ترجمة هذا النص.", "ar", "refusal"),
        ("متأسفم، نمی‌توانم این متن را ترجمه کنم.", "I'm sorry, I can't translate this text.", "en", None), (EN, "سلم المجلس التقرير قبل الموعد في المبنى.", "fa", "language"), (FA, FA.replace("کمیته", "گروه") + " " + FA[::1], "en", "copy"),
        (None, FA, "fa", None), (EN, FA, None, None),
    ],
)
def test_defects(judge, source, target, wanted, defect):
    assert judge.defect(source, target, wanted) == defect


def test_delimiter_stack():
    assert pairs.open_delimiters("«a (b)") == 1 and pairs.open_delimiters("«a» [b]") == 0 and pairs.open_delimiters(")») ") == 0


def test_rows(spark):
    rows = [(1, "en", "fa", EN, FA), (2, "en", "fa", EN, None), (2, "en", "fa", EN, None), (3, "fa", "en", FA, FA), (4, None, None, None, None), (None, "en", "fa", EN, ""), (5, "en", "fa", EN * 300, FA * 300)]
    df = spark.createDataFrame(rows, "pair_id long, sl string, tl string, source string, target string").selectExpr("*", "1 as k", "'x' as s", "'y' as defect")
    got = {tuple(r) for r in pairs.defective_pairs(df, "pair_id", "source", "target", "sl", "tl").collect()}
    assert got == {(2, "empty"), (3, "copy"), (4, "empty"), (None, "empty")}
    assert pairs.defective_pairs(df.where("false"), "pair_id", "source", "target", "sl", "tl").count() == 0


def test_stopwords_by_relative_frequency(spark):
    df = spark.createDataFrame([("en", "the a the"), ("fa", "را the از از"), (None, "x"), ("en", None)], "l string, t string")
    assert {r["w"]: r["l"] for r in pairs.word_languages(df, "l", "t").collect()} == {"the": "en", "a": "en", "را": "fa", "از": "fa"}


def test_query(spark, sf):
    df = queries.p4_found(spark, sf)
    assert df.columns == ["pair_id", "defect"]
    rows = df.collect()
    assert {r["defect"] for r in rows} <= {"empty", "refusal", "copy", "truncated", "language"} and len({r["pair_id"] for r in rows}) == len(rows)
    random.seed(0)


def test_rare_words_vote(spark):
    """A word past the first thousands of its language still votes, and a list too long to be sent gives the same."""
    letters = "abcdefghij"
    many = [f"مو{a}{b}{c}{d}".translate(str.maketrans(letters, "بتثدرسفقلم")) for a in letters for b in letters for c in letters for d in letters]
    rows = [(1, " ".join(many * 2), "x", "fa", "en"), (2, "سلام دوست", "x", "fa", "en"), (3, "hello world.", "سلام دوست.", "en", "ar"), (4, "hello dear friend.", "سلام دوست.", "en", "fa"), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, s string, t string, sl string, tl string")
    assert {(3, "language")} == {(r["k"], r["defect"]) for r in pairs.defective_pairs(df, "k", "s", "t", "sl", "tl").collect() if r["k"] in (3, 4)}


def test_looked_up_words(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/unit_pairs.parquet")
    got = []
    for bound in (50_000, 10):
        monkeypatch.setattr(pairs, "SENT_WORDS", bound)
        got.append(sorted((r["pair_id"], r["defect"]) for r in pairs.defective_pairs(df, "pair_id", "source", "target", "source_language", "target_language").collect()))
    assert got[0] == got[1] and any(d == "language" for _, d in got[0])
