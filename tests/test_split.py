import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext import problems
from loomtext.operators.split import boundaries, cell_size, cut, plan, split_files, split_items, split_text


def joined(pieces, overlap):
    out = pieces[0] if pieces else ""
    for p in pieces[1:]:
        assert out.endswith(p[:overlap]) or len(out) < overlap
        out += p[min(overlap, len(out)):]
    return out


@given(st.text(alphabet="ab .\né", max_size=200), st.integers(2, 40), st.data())
@settings(max_examples=300, deadline=None)
def test_pieces_are_small_and_lossless(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = split_text(text, limit, overlap)
    assert all(0 < len(p) <= limit for p in pieces)
    assert joined(pieces, overlap) == text


def test_natural_places():
    assert split_text("One two. Three four. Five", 12) == ["One two. ", "Three four. ", "Five"]
    assert split_text("a\n\nb c d e f", 8) == ["a\n\nb c d ", "e f"] or split_text("a\n\nb c d e f", 8)[0].endswith((" ", "\n"))
    assert split_text("abcdefgh", 3) == ["abc", "def", "gh"]
    assert split_text("", 3) == []
    with pytest.raises(ValueError):
        plan("abc", boundaries("abc"), 0, 3, 2, 2)


def test_marks_stay_with_their_letter():
    assert all(not p.startswith("́") for p in split_text("e" + "é" * 20, 7))


SCHEMA = "k string, text string"


def test_odd_items(spark):
    rows = [("a", "x y " * 50), ("a", "x y " * 50), ("b", None), ("c", ""), ("d", "short"), (None, "z " * 60), ("e", "q" * 250)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as r", "'t' as t", "2 as start_pos")
    got = split_items(df, "k", "text", 100, 10).orderBy("k", "piece_no").collect()
    assert {r["k"] for r in got} == {"a", None, "e"}
    for key, text in (("a", rows[0][1]), (None, rows[5][1]), ("e", rows[6][1])):
        own = [r for r in got if r["k"] == key]
        assert [r["piece_no"] for r in own] == list(range(len(own)))
        assert joined([r["piece"] for r in own], 10) == text
        assert all(r["piece"] == text[r["start_pos"] : r["end_pos"]] for r in own)
    assert split_items(spark.createDataFrame([], SCHEMA), "k", "text", 100, 10).count() == 0


def whole_text(t, limit, overlap):
    """The pieces of a text by its definition: anchors of all cells, then each stretch."""
    cell = cell_size(limit)
    return [t[a:b] for a, b in cut(t, 0, 0, len(t), len(t), cell, limit, overlap)]


def test_the_same_pieces_whatever_the_ranges(spark):
    random.seed(9)
    texts = {f"k{i}": "".join(random.choice(["wort ", "lang. ", "é", "\n\n", "x", "😀", "👍🏽"]) for _ in range(random.randint(900, 2900))) for i in range(4)}
    texts["none"] = "q" * 3000
    texts["marks"] = "e" + "\u0301" * 2500
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    for limit, overlap in ((60, 9), (200, 150), (700, 690)):
        results = []
        for size in (1, cell_size(limit), 1500, 1 << 18):
            got = split_items(df, "k", "text", limit, overlap, range_chars=size).orderBy("k", "piece_no").collect()
            results.append([tuple(r) for r in got])
        assert results[0] == results[1] == results[2] == results[3]
        for k, t in texts.items():
            own = [r for r in got if r["k"] == k]
            assert [r["piece"] for r in own] == whole_text(t, limit, overlap) if len(t) > limit else not own
            assert [r["piece_no"] for r in own] == list(range(len(own)))
            assert all(len(r["piece"]) <= limit and r["piece"] == t[r["start_pos"] : r["end_pos"]] for r in own)
            assert own[0]["start_pos"] == 0 and own[-1]["end_pos"] == len(t)
            for a, b in zip(own, own[1:]):
                assert b["start_pos"] == max(0, a["end_pos"] - overlap)


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))


def test_shuffled_bytes_are_linear_in_the_length(spark):
    """Twice the text in twice the ranges: twice the bytes shuffled."""
    sizes = []
    for n in (1, 2):
        random.seed(n)
        df = spark.createDataFrame([("k", "".join(random.choices("abcdefgh .", k=300_000 * n)))], SCHEMA).union(spark.createDataFrame([("short", "x")], SCHEMA))
        before = shuffled(spark)
        assert split_items(df, "k", "text", 1000, 100, range_chars=16_000).count() > 250 * n
        sizes.append(shuffled(spark) - before)
    assert 100_000 < sizes[0] and 1.8 < sizes[1] / sizes[0] < 2.2


def test_files_by_byte_ranges(spark, tmp_path):
    random.seed(3)
    texts = ["".join(random.choice(["سلام ", "word. ", "é😀 ", "\n\n"]) for _ in range(9000)), "small", "", "é" * 7000]
    raw = [t.encode() for t in texts]
    raw += [b"ab\xff\xfe \x80\x80\x80\x80 cd. " * 2000, b"\xe2\x82" * 5000, b"\xbf" * 9000]
    texts += [r.decode("utf-8", "surrogateescape") for r in raw[4:]]
    paths = []
    for i, r in enumerate(raw):
        p = tmp_path / f"{i}.txt"
        p.write_bytes(r)
        paths.append(p.as_uri() if i % 2 else str(p))
    results = []
    for size in (1, 1 << 13, 1 << 23):
        got = split_files(spark, paths, 300, 20, range_bytes=size).orderBy("path", "piece_no").collect()
        results.append([tuple(r) for r in got])
        for p, t in zip(paths, texts):
            t = "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in t)
            own = [r for r in got if r["path"] == p]
            assert [r["piece_no"] for r in own] == list(range(len(own)))
            assert all(r["piece"] == t[r["start_pos"] : r["end_pos"]] and len(r["piece"]) <= 300 for r in own)
            assert (own[-1]["end_pos"] if own else 0) == len(t)
            for a, b in zip(own, own[1:]):
                assert b["start_pos"] == max(0, a["end_pos"] - 20)
    assert results[0] == results[1] == results[2]
    with pytest.raises(FileNotFoundError):
        split_files(spark, [str(tmp_path / "absent")], 300)


def test_rows_of_a_key_that_differ(spark):
    df = spark.createDataFrame([("a", "x y " * 500), ("a", "z w " * 800), ("a", "z w " * 800)], SCHEMA)
    got = split_items(df, "k", "text", 100, 0, range_chars=1).orderBy("piece_no").collect()
    assert "".join(r["piece"] for r in got) == "z w " * 800


def test_query(spark, sf):
    found = {tuple(r) for r in problems.p6_found(spark, sf).collect()}
    units = spark.read.parquet(f"{sf}/units.parquet").collect()
    jobs = spark.read.parquet(f"{sf}/jobs.parquet").collect()
    want = {("unit", f"{u['doc_id']}/{u['unit_id']}") for u in units if len("".join(u["segments"])) > 600}
    want |= {("job", j["id"]) for j in jobs if j["source_text"] and len(j["source_text"]) > 4000}
    assert found == want
