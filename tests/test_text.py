"""Text functions, quality checks and segments against plain Python and hand-computed rows."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import pytext as P
from loomtext.operators import qa, segments
from loomtext.operators.memory import Protector, alpha, protect_column, restore_column

TEXTS = [
    "", " ", "a1 2 3.5% 12km 1,000 -5 +7 2024-01-02 ۱۲۳٬۴۵۶ ٣٫٥ 10:30", "۵‌متر و ۶‌", "12km", "x_5 5_x 5", "--5", "1.", "a+5", "see https://a.example/x(y) and m.n+o@p-q.example.org.",
    "\x1c\x85 text　", "straße ﬁ", "سلام ۱۲ کتاب", "A" * 90 + " 5", "12́ 7", "½ 5",
]


def python_numbers(t):
    """By the definition: from left to right the longest run, with a sign where there is one, from a digit to a digit over
    signs that may stand within a number, with no word character on either side."""
    word = lambda i: 0 <= i < len(t) and re.match(r"\w", t[i]) is not None
    digit, inner = "0123456789٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", ",٬.٫/⁄:：-"
    out, at = [], 0
    while at < len(t):
        first = at + (t[at] in "+-−")
        end = 0
        if not word(at - 1) and first < len(t) and t[first] in digit:
            ends = [first + 1]
            for j in range(first + 1, len(t)):
                if t[j] in digit:
                    ends.append(j + 1)
                elif t[j] not in inner:
                    break
            end = next((z for z in reversed(ends) if not word(z)), 0)
        out += [t[at:end]] if end else []
        at = end or at + 1
    return [x.translate(str.maketrans(P.LOCAL_SIGNS, P.PLAIN_SIGNS)) for x in out]


def test_functions_follow_python(spark):
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("a1 ۵.,-+/٫_é‌ًb\n@:") for _ in range(30)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    got = df.select("i", P.canonical_numbers(c).alias("n"), P.urls(c).alias("u"), P.emails(c).alias("e"), P.strip(c).alias("s"), P.is_blank(c).alias("b"), P.latin_words(c).alias("l")).collect()
    for r in got:
        t = texts[r["i"]]
        assert r["n"] == python_numbers(t), repr(t)
        assert r["u"] == re.findall(r"https?://[^\s<>()]+", t)
        assert r["e"] == re.findall(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", t)
        assert r["s"] == t.strip() and r["b"] == (not t.strip())
        assert r["l"] == re.findall(r"\b[A-Za-z]{4,}\b", t)


def test_nulls(spark):
    c = F.lit(None).cast("string")
    r = spark.range(1).select(P.canonical_numbers(c).alias("n"), P.is_blank(c).alias("b"), qa.quality_flags(c, c, F.lit("fa")).alias("f")).first()
    assert (r["n"], r["b"], r["f"]) == ([], True, ["empty"])


@pytest.mark.parametrize(
    "source,target,language,flags",
    [
        ("5 apples", "۵ سیب", "fa", []), ("5 apples", "six", "fa", ["numbers"]), ("x 5", "   ", "fa", ["empty"]), ("see https://a.b/c", "see", "en", ["urls"]), ("a@b.org", "b", "en", ["emails"]),
        ("a", "ZXQPHAQXZ", "en", ["placeholder"]), ("a" * 100, "b" * 10, "en", ["length"]), ("word " * 30, "word " * 30, "fa", ["source_leakage"]), ("word " * 30, "word " * 30, "en", []),
    ],
)
def test_quality_flags(spark, source, target, language, flags):
    df = spark.createDataFrame([(source, target, language)], "s string, t string, l string")
    assert df.select(qa.quality_flags(F.col("s"), F.col("t"), F.col("l")).alias("f")).first()["f"] == flags


def test_glossary(spark):
    g = spark.createDataFrame([(0, "AI ", "x", True), (1, "ai", "y", True), (2, "black swan", "قوی سیاه", True), (3, "tree", "درخت", False), (4, " ", "z", True), (5, "q", "", True), (6, None, "n", True), (7, "z", "zz", True)], "prio int, source string, target string, locked boolean")
    terms = qa.locked_terms(g)
    assert {(r["position"], r["source"], r["target"]) for r in terms.collect()} == {(0, "ai", "y"), (2, "black swan", "قوی سیاه"), (7, "z", "zz")}
    pairs = spark.createDataFrame([(1, "A Black Swan event and AI", "رویداد"), (2, "tree z", "x"), (3, None, None), (4, "black swan", "قوی سیاه")], "k int, s string, t string")
    want = {(1, 0, "terminology:ai→y"), (1, 2, "terminology:black swan→قوی سیاه")}
    assert {tuple(r) for r in qa.glossary_flags(pairs, ["k"], "s", "t", terms).collect()} == want
    many = terms.unionByName(spark.createDataFrame([(i + 10, f"{chr(97 + i % 26)}{i}", "none") for i in range(2000)] + [(9, "nt", "yy"), (5000, "😀 tree", "x")], "position int, source string, target string"))
    odd = pairs.unionByName(spark.createDataFrame([(5, "an old 😀 tree", "")], "k int, s string, t string"))
    assert {tuple(r) for r in qa.glossary_flags(odd, ["k"], "s", "t", many).collect()} == want | {(1, 9, "terminology:nt→yy"), (5, 5000, "terminology:😀 tree→x")}


def test_issues_and_blocking(spark):
    terms = spark.createDataFrame([(0, "cat", "گربه")], "position int, source string, target string")
    pairs = spark.createDataFrame([(1, "5 cat", "six", "fa"), (2, "a", "b", "fa"), (3, "cat", "x", "fa")], "k int, s string, t string, l string")
    issues = qa.collect_issues(pairs, ["k"], "s", "t", "l", terms)
    assert {r["k"]: r["flags"] for r in issues.collect()} == {1: ["numbers", "terminology:cat→گربه"], 3: ["terminology:cat→گربه"]}
    assert {r["k"]: r["flags"] for r in qa.blocking_flags(issues, ["k"]).collect()} == {1: ["numbers"]}


@pytest.mark.parametrize("text,limit,pieces", [("aa bb cc", 5, ["aa ", "bb cc"]), ("abcdefgh", 3, ["abc", "def", "gh"]), ("a\n\nb c", 4, ["a\n\n", "b c"]), ("One. Two three.", 9, ["One. Two ", "three."]), ("", 3, []), ("abc", 3, ["abc"])])
def test_semantic_split(text, limit, pieces):
    assert segments.semantic_split(text, limit) == pieces


@given(st.text(max_size=80), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_splits_are_lossless(text, limit):
    pieces = segments.semantic_split(text, limit)
    assert "".join(pieces) == text and all(len(p) <= limit for p in pieces)
    parts = segments.pieces_under_budget(text, 10)
    assert "".join(parts) == text and all(segments.estimate(p) <= 10 or len(p) <= 1 for p in parts)


@pytest.mark.parametrize("text,own,want", [("hello world", ["aa", "bb"], ["hello", " world"]), ("abcd", ["x", "y", "z"], ["a", "bc", "d"]), ("one two three four", ["aaaa", "b", "cccc"], ["one two", " three", " four"]), ("x", [], []), ("x", ["q"], ["x"])])
def test_distribute(text, own, want):
    assert segments.distribute(text, own) == want


@given(st.text(alphabet="ab ", max_size=40), st.lists(st.text(alphabet="xy ", max_size=8), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_distribute_keeps_all(text, own):
    out = segments.distribute(text, own)
    assert len(out) == len(own) and "".join(out) == text


def test_normalize():
    assert segments.normalize_segments(["a", "b"], ["x", "y"], [0]) == (["a", "b"], None)
    assert segments.normalize_segments("ab", ["x", "y"], [0]) == (None, "integrity")
    assert segments.normalize_segments(" ", ["x", "y"], []) == (None, "empty")
    assert segments.normalize_segments(None, ["x"], None) == (None, "empty")
    assert segments.normalize_segments(["ab cd"], ["x", "y"], []) == (["ab", " cd"], None)


def test_prepare_and_reassemble(spark):
    rows = [(1, "u0", ["short"], []), (1, "u1", ["word " * 60, "", "two. " * 50], [1, 2]), (2, "u0", ["x" * 400], None), (2, "u1", None, None)]
    units = spark.createDataFrame(rows, "doc_id long, unit_id string, segments array<string>, protected array<int>")
    parts = segments.prepare_units(units, 60)
    assert all(segments.estimate("".join(r["segments"])) <= 60 for r in parts.collect())
    back = {(r["doc_id"], r["unit_id"]): r["segments"] for r in segments.reassemble_units(parts).collect()}
    assert back == {(r[0], r[1]): r[2] for r in rows[:3]}


def test_alpha():
    assert [alpha(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_alpha_column(spark):
    assert [r[0] for r in spark.range(800).orderBy("id").select(P.alpha_id(F.col("id"))).collect()] == [alpha(n) for n in range(800)]


@given(st.text(alphabet="ab1.5@ x/:", max_size=60))
@settings(max_examples=200, deadline=None)
def test_protection_round_trip(text):
    p = Protector()
    safe, held = p.protect(text)
    assert p.restore(safe, held) == text
    assert not re.search(r"(?<!\w)\d+(?!\w)", safe)


def test_protection_with_terms(spark):
    p = Protector([("black swan", "قوی سیاه"), ("qx", "BAD")])
    safe, held = p.protect("A Black Swan costs 5 at https://x.example/qx")
    assert p.restore(safe, held) == "A قوی سیاه costs 5 at https://x.example/qx"  # no term matches inside a token or link
    df = spark.createDataFrame([("call 5 or a@b.org",), (None,)], "t string").select(protect_column(F.col("t")).alias("p"))
    assert [r[0] for r in df.select(restore_column(F.col("p.protected"), F.col("p.held"))).collect()] == ["call 5 or a@b.org", None]


def test_names_and_html(spark):
    df = spark.createDataFrame([("my file?.docx", "fa"), ("dir/x.tar.gz", "en"), ("...", "ar"), ("plain", "en")], "n string, l string")
    assert [r[0] for r in df.select(P.output_name(F.col("n"), F.col("l"))).collect()][:2] == ["my file_.fa.docx", "x.tar.en.gz"]
    html = spark.range(1).select(P.unit_html(F.lit("a<b>&'\n"), F.lit(5.0), F.lit(255), F.lit("ABCDEF+Times"), F.lit("en"))).first()[0]
    assert html == "<div style=\"font-family:'Times',sans-serif;font-size:7.0pt;color:#0000ff;direction:ltr;text-align:left;line-height:1.3;margin:0 0 .7em 0\">a&lt;b&gt;&amp;&#x27;<br></div>"


def test_word_class_follows_python(spark):
    codes = [c for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, t string")
    got = {r["c"] for r in df.where(F.col("t").rlike(P.W)).collect()}
    odd = {c for c in codes if (c in got) != bool(re.match(r"\w", chr(c)))}
    assert len(odd) <= 40  # all of them letters that the Java machine's older tables lack


def test_emails_are_found_in_linear_time(spark):
    texts = ["a@b.com.d@e.org", "x a.b@c.de,f@g.h i@j.kl.", "@a@b.cc", "a@b", "p@q.rs_t@u.vw", "--@--.ab"] + ["".join(random.Random(i).choice("ab.@_-+c ") for _ in range(25)) for i in range(400)] + ["a" * 200_000, ("a" * 50 + "@") * 2000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.emails(F.col("t")).alias("e")).collect()
    pattern = re.compile(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}")
    for r in got:
        if len(texts[r["i"]]) < 1000:
            assert r["e"] == pattern.findall(texts[r["i"]]), texts[r["i"]]
