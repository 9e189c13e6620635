"""The suffix window against a loop over the JSON text, job tables, published checkpoints, analysis and resuming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import checkpoint as C
from loomtext.operators import generation, tables
from loomtext.operators.context import clip, suffix_window
from loomtext.operators.segments import estimate
from loomtext.plans import pipeline


def newest(items, budget):
    """By the definition: as many of the newest items as fit as JSON text."""
    for n in range(len(items), 0, -1):
        if estimate(json.dumps([{"source": s or "", "target": t or ""} for s, t in items[-n:]], ensure_ascii=False)) <= budget:
            return n
    return 0


@pytest.mark.parametrize("budget", [12, 25, 60, 200])
def test_suffix_window(spark, budget):
    rnd = random.Random(budget)
    groups = {g: [(rnd.choice(["", None, 'a "b"\n', "x" * rnd.randint(0, 90), "\x01é\\", "سلام"]), "y" * rnd.randint(0, 60)) for _ in range(rnd.randint(1, 12))] for g in range(12)}
    rows = [(g, i * 3, f"u{i}", s, t) for g, items in groups.items() for i, (s, t) in enumerate(items)]
    df = spark.createDataFrame(rows, "g int, o int, u string, s string, t string").selectExpr("*", "1 as source", "2 as _pos")
    got = suffix_window(df.drop("source"), "g", "o", ["u"], "s", "t", budget).collect()
    for g, items in groups.items():
        own = sorted((r["o"], r["source"], r["target"], r["tokens"]) for r in got if r["g"] == g)
        n = newest(items, budget)
        if n:
            assert [(s, t) for _, s, t, _ in own] == [(s or "", t or "") for s, t in items[-n:]]
            assert own[0][3] == estimate(json.dumps([{"source": s, "target": t} for _, s, t, _ in own], ensure_ascii=False))
        else:
            cut = clip(items[-1][0] or "", items[-1][1], budget)
            assert [(s, t) for _, s, t, _ in own] == ([] if cut is None else [cut])
    assert suffix_window(df.drop("source").where("false"), "g", "o", ["u"], "s", "t", budget).count() == 0


def test_clip():
    assert clip("abc", "de", 100) == ("abc", "de") and clip("a", "b", 5) is None
    s, t = clip("s" * 500, '"' * 500, 80)
    assert estimate(json.dumps([{"source": s, "target": t}])) <= 80 and s and t and set(s) == {"s"}


def test_update_and_health(spark):
    base = spark.createDataFrame([("a", "running", 5, 100.0, 0.0), ("b", "completed", 100, 90.0, 95.0), ("c", None, 0, None, None), ("d", "running", 1, 99.0, 99.5), ("e", "pausing", 1, 99.0, 88.0)], "id string, status string, progress int, updated_at double, heartbeat_at double")
    new = spark.createDataFrame([("a", 250, "x"), ("b", None, "y"), ("zz", 7, "z")], "id string, progress int, status string")
    got = {r["id"]: r for r in tables.update(base, new, "id", ["progress", "absent"], {"progress": (0, 100)}).collect()}
    assert got["a"]["progress"] == 100 and got["b"]["progress"] == 100 and got["a"]["status"] == "running" and len(got) == 5
    states = {r["id"]: (r["health_state"], r["is_stalled"], r["progress_age_seconds"]) for r in tables.health(base, 100.0).collect()}
    assert states == {"a": ("working", False, 0.0), "b": ("completed", False, 10.0), "c": ("unknown", False, 100.0), "d": ("working", False, 1.0), "e": ("worker_unresponsive", True, 1.0)}
    assert {r["id"]: r["health_state"] for r in tables.health(base, 230.0, silent=1000).collect()}["d"] == "long_running"
    assert [r["id"] for r in base.where(tables.expired(base, 100.0 + 86400 * 3, 3, ("completed",))).collect()] == ["b"]


def test_published_stages(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "doc_id long, unit_id string, segments array<string>"
    assert C.load(spark, root, "drafts", schema).count() == 0
    first = spark.createDataFrame([(1, "a", ["x"])], schema)
    C.publish(first, root, "drafts")
    assert C.load(spark, root, "drafts", schema).collect() == first.collect()
    again = spark.createDataFrame([(1, "a", ["y"]), (2, "b", [])], schema)
    path = C.publish(again, root, "drafts")
    assert sorted(C.load(spark, root, "drafts", schema).collect()) == sorted(again.collect())
    pointer = tmp_path / "drafts" / "pointer"
    for bad in ("nonsense", json.dumps([1]), json.dumps({"path": path + "x"}), json.dumps({"path": str(tmp_path / "drafts")[:-2]})):
        (tmp_path / "drafts" / ".pointer.crc").unlink(missing_ok=True)
        pointer.write_text(bad)
        assert C.load(spark, root, "drafts", schema).count() == 0


def test_analysis(spark):
    df = spark.createDataFrame([(1, "contractual termination of it all"), (2, "")], "doc_id long, sample string")
    rows = {r["doc_id"]: r for r in generation.analyse(df, generation.GistBackend).collect()}
    assert rows[1]["summary"].startswith("contractual") and [t["source"] for t in rows[1]["terms"]] == ["contractual", "termination"] and rows[2]["terms"] == [] and rows[1]["error"] is None


UNITS = "doc_id long, unit_id string, ord int, segments array<string>, protected array<int>"
GLOSSARY = "prio int, source string, target string, locked boolean"


def test_structured_editors_and_hints(spark):
    """The reviewer hints at a unit without a flag: it is polished; the flags reach the model."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    class Reviewer:
        def answer(self, messages):
            units = json.loads(messages[0])["units"]
            return json.dumps({"translations": {u["id"]: [x + "!" if u["flags"] else x for x in u["draft"]] for u in units}, "polish": ["b", "nobody"]})

    class Polisher:
        def answer(self, messages):
            return json.dumps({"translations": {u["id"]: ["polished"] for u in json.loads(messages[0])["units"]}})

    rows = [(1, "a", 0, ["x"], []), (1, "b", 1, ["y"], []), (1, "c", 2, ["bad"], []), (1, "d", 3, [" "], [])]
    glossary = spark.createDataFrame([(0, "bad", "gut", False)], GLOSSARY)
    units = spark.createDataFrame(rows, UNITS)
    done, _ = pipeline.run(units, "en", "fa", glossary, reviewer=pipeline.Structured(Reviewer), polisher=pipeline.Structured(Polisher, least=700, share=0.3, units=4))
    assert {r["unit_id"]: r["segments"] for r in done.collect()} == {"a": ["X"], "b": ["polished"], "c": ["BAD"], "d": [" "]}
    left = spark.createDataFrame([(1, "c", ["numbers"])], "doc_id long, unit_id string, flags array<string>")
    combined = spark.createDataFrame([(1, u, s) for _, u, _, s, _ in rows], "doc_id long, unit_id string, segments array<string>")
    terms = spark.createDataFrame([], "position int, source string, target string")
    mended, flags = pipeline.repair_loop(units, combined, left, "fa", terms, 1, pipeline.Structured(Reviewer))
    assert {r["unit_id"]: r["segments"] for r in mended.collect()}["c"] == ["bad!"] and flags.count() == 0


def test_resume(spark):
    rows = [(1, "a", 0, ["x"], []), (1, "b", 1, ["y"], []), (1, "gone", 2, [" "], [])]
    had = spark.createDataFrame([(1, "a", ["kept"]), (9, "other", ["z"])], "doc_id long, unit_id string, segments array<string>")
    units, glossary = spark.createDataFrame(rows, UNITS), spark.createDataFrame([], GLOSSARY)
    for stages, want in (({"drafts": had}, "kept"), ({"drafts": had, "finals": had.withColumn("segments", F.array(F.lit("final")))}, "final"), ({"polished": had}, "kept")):
        for mode in ("balanced", "fast"):
            done, _ = pipeline.run(units, "en", "fa", glossary, mode, resume=stages)
            assert {(r["doc_id"], r["unit_id"]): r["segments"] for r in done.collect()} == {(1, "a"): [want], (1, "b"): ["Y"], (1, "gone"): [" "]}, (stages, mode)
    done, _ = pipeline.run(units, "en", "fa", glossary, "strict", resume={"polished": had})
    assert {r["unit_id"]: r["segments"] for r in done.collect()}["a"] == ["kept"]
