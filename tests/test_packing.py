import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext import problems
from loomtext.operators.packing import best_fit, pack, pack_texts

SCHEMA = "doc_id long, unit_id string, n int"


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_holds_every_item_within_capacity(histogram):
    got = Counter()
    for times, contents in best_fit(histogram, 50):
        assert times > 0 and sum(k * n for k, n in contents.items()) <= 50
        for k, n in contents.items():
            got[k] += times * n
    assert got == Counter(histogram)


@given(st.lists(st.integers(1, 30), max_size=60))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(30 - n)
    assert sum(t for t, _ in best_fit(Counter(lengths), 30)) == len(rooms)


def check(rows, capacity):
    load, seen = defaultdict(int), set()
    for r in rows:
        key = (r["doc_id"], r["unit_id"])
        assert key not in seen
        seen.add(key)
        load[r["doc_id"], r["request_no"]] += r["n_chars"]
    assert all(v <= capacity for v in load.values())
    return load, seen


def test_odd_rows(spark):
    rows = [(1, "a", 6), (1, "a", 6), (1, "b", 4), (1, "c", None), (1, None, 3), (None, "a", 5), (None, "b", 5), (2, "z", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "n as request_no", "'x' as _g", "1 as _n")
    load, seen = check(pack(df, "doc_id", ["unit_id"], "n", 10).collect(), 10)
    assert seen == {(1, "a"), (1, "b"), (1, "c"), (1, None), (None, "a"), (None, "b"), (2, "z")}
    assert len([k for k in load if k[0] == 1]) == 2 and len([k for k in load if k[0] is None]) == 1 and (2, 0) in load


def test_empty_table_and_too_long_items(spark):
    assert pack(spark.createDataFrame([], SCHEMA), "doc_id", ["unit_id"], "n", 10).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        pack(spark.createDataFrame([(1, "a", 11)], SCHEMA), "doc_id", ["unit_id"], "n", 10).collect()


def test_hot_group_in_many_salts(spark):
    df = spark.range(5000).selectExpr("7L as doc_id", "cast(id as string) as unit_id", "cast(1 + id % 7 as int) as n")
    load, seen = check(pack(df, "doc_id", ["unit_id"], "n", 20, salts=8).collect(), 20)
    assert len(seen) == 5000
    assert len(load) <= math.ceil(sum(1 + i % 7 for i in range(5000)) / 20) + 1


def test_long_texts_are_cut(spark):
    long = "word " * 1000
    df = spark.createDataFrame([(1, "a", long), (1, "b", "short"), (1, "c", ""), (1, "d", None)], "doc_id long, unit_id string, text string")
    rows = pack_texts(df, "doc_id", "unit_id", "text", 2000).collect()
    assert sum(r["n_chars"] for r in rows if r["unit_id"] == "a") == len(long)
    assert sorted(r["piece_no"] for r in rows if r["unit_id"] == "a") == [0, 1, 2]
    assert {r["unit_id"] for r in rows} == {"a", "b", "c", "d"}


def test_query_uses_few_requests(spark, sf):
    rows = problems.p2_requests(spark, sf).collect()
    load, total = defaultdict(int), defaultdict(int)
    for r in rows:
        load[r["doc_id"], r["request_no"]] += r["n_chars"]
        total[r["doc_id"]] += r["n_chars"]
    assert max(load.values()) <= 2000
    assert len(load) <= 1.05 * sum(max(1, math.ceil(n / 2000)) for n in total.values())
    units = spark.read.parquet(f"{sf}/units.parquet").select("doc_id", "unit_id").distinct().count()
    assert len({(r["doc_id"], r["unit_id"]) for r in rows}) == units
