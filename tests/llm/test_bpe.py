import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import bpe, queries

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")
ODD = ["", " ", "\n\n  x", "<|endoftext|> a", "don't WE'LL", "سلام دنیا ۱۲۳", "👩‍💻🏽 é ë", "a" * 300, "  \t x", "日本語の注記", "x_1 = {'k': [1, 2.50e-3]}"]


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBpe()


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_the_library(ours, theirs, text):
    assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip_and_parity(text):
    b = bpe.tokenizer(bpe.DEFAULT_VOCABULARY)
    assert b.decode(b.encode(text)) == text


def test_memo_changes_nothing(theirs):
    random.seed(1)
    small = bpe.ByteBpe(memo=3)
    for _ in range(50):
        t = " ".join(random.choice(["the", "commit", "گزارش", "x9"]) for _ in range(20))
        assert small.encode(t) == theirs.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as k")
    got = bpe.encode_column(df, "doc_id", "text")
    by = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert got.count() == 6 and by[2] == [] and by[3] == [] and len(by[None]) == 1
    back = {r["doc_id"]: r["text"] for r in bpe.decode_column(got, "doc_id").collect()}
    assert back == {1: "a b", 2: "", 3: "", None: "x", 4: "long " * 50_000}
    assert bpe.encode_column(df.where("false"), "doc_id", "text").count() == 0


def test_query(spark, sf, theirs):
    df = queries.p7_ids(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in df.collect():
        assert r["ids"] == (theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids if texts[r["doc_id"]] else [])
