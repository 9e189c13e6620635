import json
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomtext.operators import generation as G
from loomtext.operators.segments import estimate


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the backends defined here


@pytest.mark.parametrize("raw,want", [('noise {bad} {"a":1} x', {"a": 1}), ("[1, 2]", None), ('[{"b": {"c": 2}}]', {"b": {"c": 2}}), ("", None), (None, None), ('{"x": "}"}', {"x": "}"})])
def test_first_object(raw, want):
    assert G.first_json_object(raw) == want


@given(st.text(max_size=60), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_longest_prefix(text, budget):
    want = next((text[:n] for n in range(len(text), -1, -1) if estimate(text[:n]) <= budget), "")
    assert G.longest_prefix(text, budget) == (want if budget >= 1 else "")


def test_budget_and_tones(spark):
    df = spark.createDataFrame([(8192, 1000, 1400, 200, "legal"), (1700, 0, 1400, 240, "odd"), (9000, 0, 80, 0, None)], "c int, f int, r int, s int, t string")
    rows = df.select(G.input_budget(F.col("c"), F.col("f"), F.col("r"), F.col("s")).alias("b"), G.tone_guidance(F.col("t")).alias("t")).collect()
    assert [r["b"] for r in rows] == [1120, None, 64] and rows[0]["t"].startswith("Use precise") and rows[1]["t"] == "odd" and rows[2]["t"] is None


class Flaky:
    """Answers well at the second attempt only; refuses long requests; never answers 'no'."""

    id = "flaky"

    def answer(self, messages):
        if len(messages[0]) > 50:
            raise OverflowError
        if messages[0] == "no":
            return "no idea"
        return json.dumps({"n": len(messages)}) if len(messages) > 1 else "{oops"


def test_retries_and_errors(spark):
    df = spark.createDataFrame([(1, "hello"), (2, "no"), (3, "x" * 60)], "k int, q string")
    got = {r["k"]: (r["answer"], r["error"]) for r in G.ask(df, ["k"], "q", Flaky).collect()}
    assert got == {1: ('{"n": 2}', None), 2: (None, "parse"), 3: (None, "capacity")}
    assert {r["error"] for r in G.ask(df, ["k"], "q", Flaky, retries=0).collect()} == {"parse", "capacity"}


class Editor:
    """Edits 'a', leaves 'b' out, breaks the protected unit 'c', gives 'd' as one text, hints at 'a' and at a stranger."""

    id = "editor"

    def answer(self, messages):
        ids = [u["id"] for u in json.loads(messages[0])["units"]]
        if "fail" in ids:
            return "nothing"
        return json.dumps({"translations": {"a": ["A"], "c": ["one"], "d": ["two words"]}, "polish": ["a", "zz"]})


def test_edits(spark):
    rows = [(1, 0, 0, "a", ["x"], ["da"], [], []), (1, 0, 1, "b", ["x"], ["db"], None, None), (1, 1, 2, "c", ["x", "y"], ["dc", "dc2"], [0], []), (1, 1, 3, "d", ["xxxx", "yyyy"], ["dd", "dd2"], [], []), (2, 0, 0, "fail", ["x"], ["df"], [], [])]
    df = spark.createDataFrame(rows, "doc_id long, batch_no int, ord int, unit_id string, source array<string>, draft array<string>, protected array<int>, flags array<string>")
    got = {r["unit_id"]: (r["segments"], r["polish"], r["error"]) for r in G.edit_in_batches(df, Editor).collect()}
    assert got == {"a": (["A"], True, None), "b": (["db"], False, None), "c": (["dc", "dc2"], False, "integrity"), "d": (["two", " words"], False, None), "fail": (["df"], False, "parse")}
