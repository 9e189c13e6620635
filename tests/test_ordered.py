"""Order-dependent operators with small chunks against plain loops, and the job log."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators.checkpoint import digest, overlay, pending, reusable
from loomtext.operators.ordered import changes, greedy_batches, with_position


def greedy(costs, budget, most):
    out, tokens, n, no = [], 0, 0, -1
    for c in costs:
        c = max(1, c if c is not None else 1)
        if n == 0 or tokens + c > budget or n >= most:
            tokens = n = 0
            no += 1
        tokens, n = tokens + c, n + 1
        out.append(no)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_greedy_batches(spark, chunk):
    random.seed(chunk)
    rows, want = [], {}
    for g in range(6):
        costs = [random.choice([1, 2, 3, 5, 9, 12, 0, None]) for _ in range(random.randint(1, 60))]
        orders = sorted(random.sample(range(200), len(costs)))
        rows += [(g, o, c) for o, c in zip(orders, costs)]
        want |= {(g, o): b for o, b in zip(orders, greedy(costs, 10, 4))}
    random.shuffle(rows)
    got = greedy_batches(spark.createDataFrame(rows, "g int, o int, c int"), "g", "o", "c", 10, 4, chunk, fan=3)
    assert {(r["g"], r["o"]): r["batch_no"] for r in got.collect()} == want


def test_greedy_golden_and_empty(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([3, 3, 5, 10, 1])], "g int, o int, c int")
    assert [r["batch_no"] for r in greedy_batches(df, "g", "o", "c", 8, 3).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    assert greedy_batches(df.where("false"), "g", "o", "c", 8, 3).count() == 0
    with pytest.raises(ValueError):
        greedy_batches(df, "g", "o", "c", 0, 3)


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_positions(spark, chunk):
    df = spark.createDataFrame([(g, o) for g in range(3) for o in random.Random(g).sample(range(100), 20)], "g int, o int")
    for g in range(3):
        own = with_position(df, "g", "o", count="n", chunk=chunk).where(F.col("g") == g).orderBy("o").collect()
        assert [r["pos"] for r in own] == list(range(20)) and {r["n"] for r in own} == {20}


@pytest.mark.parametrize("chunk", [1, 5, 1000])
def test_changes(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(f"j{rnd.randint(0, 3)}", i, rnd.choice(["a", "b", None]), rnd.choice([1, None])) for i in range(80)]
    last, want = {}, set()
    for j, i, s, p in rows:
        if j not in last or last[j] != (s, p):
            want.add(i)
        last[j] = (s, p)
    df = spark.createDataFrame(rows + rows[:10], "j string, i long, s string, p int")
    assert {r["i"] for r in changes(df, "j", "i", ["s", "p"], chunk).collect()} == want


def test_checkpoint_and_overlay(spark):
    units = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["y"]), (1, "c", ["z"])], "doc_id long, unit_id string, segments array<string>")
    now = units.select("doc_id", "unit_id", digest(F.col("segments")).alias("digest"), F.lit("r").alias("route"))
    then = now.withColumn("digest", F.when(F.col("unit_id") == "b", "old").otherwise(F.col("digest")))
    drafts = spark.createDataFrame([(1, "a", ["A"]), (1, "b", ["B"])], units.schema)
    assert [r["unit_id"] for r in reusable(drafts, then, now).collect()] == ["a"]
    assert reusable(drafts, then.withColumn("route", F.lit("other")), now).count() == 0
    assert [r["unit_id"] for r in pending(units, drafts).collect()] == ["c"]
    finals = spark.createDataFrame([(1, "a", ["AA"])], units.schema)
    assert {r["unit_id"]: r["segments"] for r in overlay(units, drafts, finals).collect()} == {"a": ["AA"], "b": ["B"], "c": ["z"]}
