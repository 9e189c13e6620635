"""The pipeline against a loop in Python, the memory, the feed as a stream, and every query against its SQL."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.operators.memory import Protector, UpperBackend, cache_key, through_memory
from loomtext.operators.segments import distribute
from loomtext.plans import pipeline
from loomtext.streaming import feed

UNITS = "doc_id long, unit_id string, segments array<string>, protected array<int>"
GLOSSARY = "prio int, source string, target string, locked boolean"
ROWS = [
    (1, "a", ["hello world 5"], []), (1, "b", ["one ", "two"], [1]), (1, "c", ["  "], []), (1, "d", ["see https://x.example/a now", " and more"], []), (2, "a", ["hello world 5"], None), (2, "e", [" كلمة ي "], []), (2, "f", ["w " * 900], []),
]


def expected(mode):
    p, out = Protector(), {}

    def mt(t):
        if not t.strip():
            return t
        safe, held = p.protect(t)
        return p.restore(UpperBackend().translate([safe], "fa")[0], held)

    for d, u, s, prot in ROWS:
        t = "".join(s)
        if not t.strip() or u == "f":
            out[d, u] = s if u != "f" else None
            continue
        draft = [mt(x) for x in s] if prot and len(s) > 1 else distribute(mt(t), s)
        final = draft if mode == "fast" else [x.strip() for x in draft]
        if mode == "strict":
            final = [x.translate(str.maketrans("كي", "کی")) for x in final]
        out[d, u] = final
    return out


@pytest.mark.parametrize("mode", pipeline.MODES)
def test_pipeline(spark, mode):
    units = spark.createDataFrame(ROWS, UNITS)
    done, left = pipeline.run(units, "en", "fa", spark.createDataFrame([], GLOSSARY), mode)
    got = {(r["doc_id"], r["unit_id"]): r["segments"] for r in done.collect()}
    assert set(got) == {(r[0], r[1]) for r in ROWS}
    for k, want in expected(mode).items():
        if want is not None:
            assert got[k] == want, (mode, k)
    assert {r["unit_id"] for r in left.collect()} <= {"f"}


@pytest.mark.parametrize("mode", pipeline.MODES)
@pytest.mark.parametrize("few", (True, False))
def test_pipeline_keeps_locked_terms(spark, monkeypatch, mode, few):
    if not few:
        monkeypatch.setattr(pipeline, "SENT_TERMS", 1)
    rows = [(1, "a", ["The Lease Agreement, no. 5"], []), (1, "b", ["lease"], []), (1, "c", ["a lease ", "agreement"], [1]), (1, "d", ["see https://lease.example/x of x"], []), (1, "e", ["lease agreement " * 300], []), (2, "f", ["draft it"], [])]
    terms = [(0, "lease agreement", "Ijare name", True), (1, "lease", "ijare", True), (2, "x", "ks", True), (3, "draft", "no", False)]
    done, left = pipeline.run(spark.createDataFrame(rows, UNITS), "en", "fa", spark.createDataFrame(terms, GLOSSARY), mode)
    got = {r["unit_id"]: r["segments"] for r in done.collect()}
    assert got["a"] == ["THE Ijare name, NO. 5"] and got["b"] == ["ijare"] and got["d"] == ["SEE https://lease.example/x OF ks"] and got["f"] == ["DRAFT IT"]
    assert [x.strip() for x in got["c"]] == ["A ijare", "AGREEMENT"]
    assert got["e"][0].split() == ["Ijare", "name"] * 300
    # what is left is a term inside a link, or one that stands over the cut between two segments
    assert all(r["unit_id"] in "cd" or (r["unit_id"] in "ae" and r["flags"] == ["terminology:lease→ijare"]) or not any(f.startswith("terminology") for f in r["flags"]) for r in left.collect())


def test_terms_are_in_the_key_and_folded(spark):
    import regex

    from loomtext.operators.memory import _ONE_CASE

    cased = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000 and len({chr(i), chr(i).lower(), chr(i).upper(), chr(i).casefold()}) > 1]
    every = "".join(cased)
    for c in cased:
        for d in regex.findall(regex.escape(c), every, regex.I):
            assert c.translate(_ONE_CASE) == d.translate(_ONE_CASE), (c, d)
    table = spark.createDataFrame([(i, f"term{i}", f"t{i}") for i in range(9)], "position int, source string, target string")
    assert pipeline.terms_digest(table) == pipeline.terms_digest(table.orderBy("target", ascending=False))
    assert pipeline.terms_digest(table) != pipeline.terms_digest(table.withColumn("target", F.upper("target")))


def test_pipeline_arguments(spark):
    units = spark.createDataFrame(ROWS, UNITS)
    for a, b, mode in (("en", "en", "fast"), ("en", "de", "fast"), ("en", "fa", "slow")):
        with pytest.raises(ValueError):
            pipeline.run(units, a, b, spark.createDataFrame([], GLOSSARY), mode)


def test_repair_is_bounded(spark):
    units = spark.createDataFrame([(1, "a", ["five 5 apples"], [])], UNITS)
    _, left = pipeline.run(units, "en", "ar", spark.createDataFrame([], GLOSSARY), "balanced", repairs=2, reviewer=pipeline.Native(lambda c: F.lit("no number")))
    assert left.first()["flags"] == ["numbers"]
    done, left = pipeline.run(units, "en", "ar", spark.createDataFrame([], GLOSSARY), "balanced", repairs=1, reviewer=pipeline.Native(lambda c: F.lit("no number")), repairer=pipeline.Native(lambda c: F.lit("5")))
    assert left.count() == 0 and done.first()["segments"] == ["5"]


def test_memory_is_used(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None), (5, "known")], "k int, text string").withColumn("language", F.lit("fa"))
    items = items.withColumn("cache_key", cache_key(F.col("text"), F.lit("en"), F.lit("fa"), UpperBackend.id))
    known = items.where("k = 5").select("cache_key", F.lit("from memory").alias("translation"))
    done, memory = through_memory(items, known.unionAll(known))
    assert {r["k"]: r["translation"] for r in done.collect()} == {1: "A B", 2: "A B", 3: " ", 4: None, 5: "from memory"}
    assert memory.count() == 4


def test_feed(spark, tmp_path):
    rows = [(1, "j", "queued", "q", 0, None, 1.0), (2, "j", "queued", "q", 0, None, 2.0), (3, "j", "running", "d", 5, "x", 3.0), (4, "k", "queued", "q", 0, None, 3.0), (5, "j", "running", "d", 5, "x", 4.0), (6, "j", "running", "d", None, "x", 5.0), (3, "j", "running", "d", 5, "x", 3.0)]
    src = tmp_path / "src"
    for i in range(0, 7, 2):
        spark.createDataFrame(rows[i : i + 2], feed.EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    for _ in range(2):  # the second start finds nothing new
        feed.feed(feed.read_events(spark, str(src)), str(tmp_path / "check"), str(tmp_path / "out")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4, 6]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as from '{sf}/{f}'")
    return c


def flat(v):
    if isinstance(v, (list, tuple)):
        return tuple(flat(x) for x in v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"p[1345789]_", n)))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    assert rows or name in ("extract_urls",)
    if name in entry.oracle_sql():
        cols = sorted(df.columns)
        result = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        want = sorted(repr([flat(r[names.index(c)]) for c in cols]) for r in result.fetchall())
        assert sorted(repr([flat(r[c]) for c in cols]) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "unit_id", "piece_no", "n_chars", "request_no"]
