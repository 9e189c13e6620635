import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import leak, queries

words = st.lists(st.sampled_from("abc"), max_size=14)


def brute(items, text, n):
    windows = {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}
    return {k for k, w in items.items() if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1))}


@given(st.dictionaries(st.integers(0, 5), words, max_size=5), words, st.integers(1, 4))
@settings(max_examples=500, deadline=None)
def test_against_all_windows(items, text, n):
    a = leak.ItemAutomaton(items.items(), n)
    assert set(a.items_in(text)) == brute(items, text, n)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_longest_matches(item, text):
    got = {i: n for i, n, _ in leak.ItemAutomaton([(0, item)], 1).stream(text)}
    joined = "".join(item)
    for i in range(len(text)):
        best = max((n for n in range(i + 2) if "".join(text[i - n + 1 : i + 1]) in joined), default=0)
        assert got.get(i, 0) == best


def test_words():
    assert leak.words_of("Don’t stop​ping, ＡＢ می‌رود!\n12-x") == ["don", "t", "stopping", "ａｂ", "میرود", "12", "x"]
    t = "a​b, cd"
    w, spans = leak.word_spans(t)
    assert w == ["ab", "cd"] and [t[x:y] for x, y in spans] == ["a​b", "cd"]


ITEM = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, f"before. {ITEM.upper().replace(' ', ', ')} after"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, f"x {ITEM} y"), (5, f"x {ITEM} y"), (None, ITEM), (6, "filler " * 5000 + ITEM[8:]), (7, "one two three four five SIX seven eight nine\nten"),
]


def frames(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as k", "2 as item_id", "3 as windows")
    items = spark.createDataFrame([(10, ITEM), (11, "zero " + ITEM), (12, "too short"), (13, None), (None, ITEM)], "item_id long, text string")
    return docs, items


def test_rows_and_blocks(spark):
    docs, items = frames(spark)
    want = {(d, i) for d in (1, 5, None, 6, 7) for i in (10, 11)}
    for block, scan in ((5, 5), (15, 15), (15, 1000), (1000, 1000)):
        found = leak.find_leaks(docs, "doc_id", "text", items, "item_id", "text", block_words=block, scan_words=scan)
        assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in found.collect()))) == sorted(map(str, want))
    assert leak.find_leaks(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0
    assert leak.find_leaks(docs.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0


def test_removal(spark):
    docs, items = frames(spark)
    got = [leak.remove_leaks(docs, "doc_id", "text", items, "item_id", "text", max_coverage=0.95, block_words=block, scan_words=scan).collect() for block, scan in ((1000, 1000), (5, 5), (5, 1000))]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) == sorted(map(str, got[2])) and len(got[0]) == len(ROWS)
    rows = {r["doc_id"]: r for r in got[0]}
    assert rows[1]["text"] == "before.  after" and rows[1]["removed_words"] == 12
    assert rows[2]["text"] == ROWS[1][1] and rows[3]["text"] is None and not rows[3]["dropped"] and rows[4]["text"] == ""
    assert rows[None]["text"] is None and rows[None]["dropped"]
    assert rows[6]["text"] == "filler " * 5000


def test_blocks_are_bounded(spark):
    rnd = random.Random(2)
    items = spark.createDataFrame([(i % 50, " ".join(rnd.choices("abcdefghij", k=rnd.randint(10, 40)))) for i in range(80)] + [(99, " ".join("abc" * 100))], "item_id long, text string")
    table = leak.block_automata(items, "item_id", "text", 10, 120).collect()
    assert len(table) > 10 and all(r["words"] <= 120 or r["words"] == 300 for r in table)
    assert len(leak.passes(items, "item_id", "text", 10, 120, 500)) >= -(-sum(r["words"] for r in table) // 500)


def test_query(spark, sf):
    docs = {r["doc_id"]: leak.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    items = {r["item_id"]: leak.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()}
    want = {(d, i) for d, w in docs.items() for i in brute(items, w, 10)}
    assert {tuple(r) for r in queries.p8_found(spark, sf).collect()} == want
    random.seed(0)
