import random
import unicodedata
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import fold, queries

SAME = [
    ("fine", "ﬁne"), ("fine", "ｆｉｎｅ"), ("café", "café"), ("office", "оffiсе"), ("a b", "a b"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​r­d"), ("x", "﻿x‎"),
    ("لا", "ﻻ"), ("کتاب", "كتاب"), ("این", "اين"), ("کسی", "کسى"), ("آب", "آب"), ("إلى", "إلى"),
    ("مسئول", "مسئول"), ("مسئول", "مسیٔول"), ("The", "Τhe"), ("a; b", "a; b"), ("2024", "２０２４"), ("در آمد", "در‌ آمد"),
    ("درآمد", "در‌آمد"), ("مؤلف", "مؤلف"), ("شيء", "شیء"),
]
DIFFERENT = [("Fine", "fine"), ("میرود", "می‌رود"), ("5", "۵"), ("۴", "٤"), ("e", "é"), ("a b", "ab"), ("a\nb", "a b"), ("سر", "ســر"), ("فی", "في"), ("كمك", "كمک"), ("x²", "x2"), ("cat", "cut")]


@pytest.fixture(scope="module")
def folder():
    return fold.Folder()


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(folder, a, b):
    assert a != b and folder(a) == folder(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_difference(folder, a, b):
    assert folder(a) != folder(b)


@given(st.text(alphabet=st.sampled_from("aеéﬁ１ا ىيیك‌‍ًٔ­ \nｆBВля"), max_size=12))
@settings(max_examples=500, deadline=None)
def test_idempotent_and_normal(text):
    f = fold.Folder()
    once = f(text)
    assert f(once) == once
    assert f(unicodedata.normalize("NFD", text)) == once


def test_union_find_is_transitive():
    u = fold.UnionFind()
    u.union("a", "b")
    u.union("c", "d")
    u.union("b", "c")
    assert u.classes() == [["a", "b", "c", "d"]]
    of = {x: c for c in fold.lookalike_classes() for x in c}
    assert of["а"] is of["a"] and of["ａ"] is of["a"]  # Cyrillic, full-width and Latin a are one class


def test_representatives_follow_frequency():
    assert fold.Folder()("аa") == "aa"
    assert fold.Folder({"а": 5, "a": 1})("аa") == "аа"
    assert fold.Folder({"ي": 9, "ی": 1})("این") == "اين"


def test_counts():
    assert fold.count_code_points(["aба", None, ""], frozenset("аa")) == {"a": 1, "а": 1}


def spoil(rnd, t):
    pool = {"a": "а", "e": "е", " ": " ", "o": "ο", "f": "ｆ"}
    return "".join(pool.get(c, c) if rnd.random() < 0.4 else c for c in t)


def test_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["some office code", "a safe place", "other text", "...", "سلام یک"]
    rows = [(rnd.choice("st"), f"k{i:02}", spoil(rnd, rnd.choice(base))) for i in range(60)]
    rows += [("s", "null", None), ("s", "empty", ""), ("s", "dots", ". ."), ("s", "dots2", ". ."), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "scope string, key string, text string").selectExpr("*", "'x' as s", "1 as k", "'y' as form")
    got = {tuple(r) for r in fold.lookalike_pairs(df, "scope", "key", "text").collect()}
    f = fold.Folder()
    want = {(s, *sorted((a, b))) for (s, a, x), (s2, b, y) in combinations(rows, 2) if s == s2 and a != b and x and y and x != y and f(x) == f(y) and any(c.isalnum() for c in x)}
    assert got == want and want
    for part in (1, 3):  # classes and copies in parts
        assert {tuple(r) for r in fold.lookalike_pairs(df, "scope", "key", "text", part=part).collect()} == want
    links, kin = {}, {}
    for s, x, y in want:
        for p, q in ((x, y), (y, x)):
            links[s, p] = links.get((s, p), 0) + 1
            kin.setdefault((s, p), {p}).add(q)
    classes = {(r["scope"], r["key"]): r for r in fold.text_classes(df, "scope", "key", "text").collect()}
    assert {k: r["links"] for k, r in classes.items()} == links
    assert all(classes[s, q]["class"] == r["class"] <= k for (s, k), r in classes.items() for q in kin[s, k])
    assert fold.text_classes(df.where("false"), "scope", "key", "text").count() == 0
    assert fold.lookalike_pairs(df.where("false"), "scope", "key", "text").count() == 0


def test_forms(spark):
    df = spark.createDataFrame([(1, "оffice"), (2, None), (3, ""), (None, "x y")], "id long, text string")
    assert {r["id"]: r["form"] for r in fold.consistent_forms(df, "id", "text", {}).collect()} == {1: "office", 2: None, 3: "", None: "x y"}


def test_query(spark, sf):
    rows = queries.p1_found(spark, sf).collect()
    assert [c for c in queries.p1_found(spark, sf).columns] == ["item_kind", "key_a", "key_b"]
    assert all(r["key_a"] < r["key_b"] for r in rows) and len(set(rows)) == len(rows)


def test_ascii_texts_follow_the_usual_member():
    a, e = "\u0430", "\u0435"  # Cyrillic letters of the shapes a, e
    f = fold.Folder({a: 9, "a": 1, e: 1, "e": 9})
    assert f("tea") == f("te" + a) == f("t" + e + "a") == "te" + a
    assert f("a\tb") == f("a b") and fold.Folder()("a\tb") == fold.Folder()("a\u00a0b") == "a b"
    assert f("ten\n") == "ten\n"
