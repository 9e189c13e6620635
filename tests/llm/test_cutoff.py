import pytest

from loomtext.llm import cutoff, queries


@pytest.mark.parametrize(
    "text,stop",
    [("A whole text.", "A whole text."), ("A whole text. [7]", "A whole text."), ("Stops mid [cut]", "Stops mid"), ("Stops m…", "Stops m"), ("Stops m...", "Stops m"), ("Stops\n ", "Stops"), ("a b (see annex) ✅", "a b"), ("x y https://a.example/b", "x y"), ("x�", "x"), ("Done. 2", "Done."), ("Done! —", "Done!"), ("row: 572", "row: 572"), ("", "")],
)
def test_what_was_put_behind(text, stop):
    assert cutoff.stop_of(text) == stop


@pytest.mark.parametrize("text,shape", [("One. Two.", "finished"), ("He said “yes.”", "finished"), ("آمد؟", "finished"), ("One ends here. Two sto", "open"), ("Notes on a report", "fragment"), ("12.3 / 45", "fragment"), ("", "blank"), ("— ✅", "blank")])
def test_shapes(text, shape):
    assert cutoff.shape(text)[0] == shape


TEXTS = [
    ("whole", "m", "The committee delivered the report before the deadline."), ("word", "m", "The commit"), ("word2", "n", "The committee delivered the rep [cut]"), ("open", "m", "The report came. The committee"), ("head", "m", "Notes on the report"),
    ("code", "n", "63.0 / 1227"), ("blank", "n", "  "), ("null", None, None), ("dup", "m", "It came. The dead"), ("dup", "m", "It came. The dead"), ("stop", None, "The committee delivered the repo."), ("long", "m", "The report came. " * 3000 + "The comm"), ("src", "n", "The committee delivered"),
]


def test_rows(spark):
    df = spark.createDataFrame(TEXTS, "k string, model string, text string").selectExpr("*", "1 as last", "2 as shape", "3 as n_chars")
    units = spark.createDataFrame([("src", "گزارش آمد."), ("head", "یادداشت درباره گزارش")], "k string, text string")
    found = cutoff.truncated(df, ["k"], "model", "text", units, ["k"])
    rows = {r["k"]: r for r in found.collect()}
    assert {k for k, r in rows.items() if r["is_truncated"]} == {"word", "word2", "open", "dup", "stop", "long", "src"}
    assert "word" in rows["word"]["evidence"] and "sentence" in rows["open"]["evidence"] and rows["src"]["evidence"] == ["source"]
    share = {r["model"]: (r["texts"], r["truncated"]) for r in cutoff.truncation_by_source(found, "model").collect()}
    assert share == {"m": (6, 4), "n": (4, 2), None: (2, 1)}
    assert cutoff.truncated(df.where("false"), ["k"], "model", "text").count() == 0


def test_lengths_at_a_limit(spark):
    rows = [(f"o{i}", "m", ("It came. " + "x y " * 20)[:40]) for i in range(30)] + [("frag", "m", "one two three four five six seven eight n"[:40])]
    found = cutoff.truncated(spark.createDataFrame(rows, "k string, m string, text string"), ["k"], "m", "text")
    assert "length" in found.where("k = 'frag'").first()["evidence"]


def test_trie(spark):
    words = spark.createDataFrame([("abc", 2), ("abd", 1), ("ab", 7), ("x", 1)], "word string, n long")
    assert {r["prefix"]: r["below"] for r in cutoff.trie(words).collect()} == {"a": 10, "ab": 3}
    df = spark.createDataFrame([("a bb a last",), (None,), ("",)], "t string")
    assert {r["word"]: r["n"] for r in cutoff.vocabulary(df, "t").collect()} == {"a": 1, "bb": 1}


def test_a_cut_token_seen_twice_is_still_none(spark):
    """Frequency-aware: what is written whole hundreds of times is not made a word by two cut values."""
    rows = [(f"w{i}", "m", f"The committee signed the termination clause of desk {i}.") for i in range(300)]
    rows += [("cut1", "m", "They signed the terminat [cut] (see annex) and"), ("cut2", "m", "We signed the terminat"), ("cut3", "m", "We hold the terminat… terminat")]
    found = cutoff.truncated(spark.createDataFrame(rows, "k string, m string, text string"), ["k"], "m", "text")
    assert "word" in found.where("k = 'cut2'").first()["evidence"] and "word" in found.where("k = 'cut3'").first()["evidence"]


def test_words_that_never_end_a_text(spark):
    rows = [(f"w{i}", "m", "The committee signed the clause of the report near the archive.") for i in range(700)] + [("cut", "m", "Nobody signed the"), ("head", "m", "Notes on the archive")]
    found = {r["k"]: r["evidence"] for r in cutoff.truncated(spark.createDataFrame(rows, "k string, m string, text string"), ["k"], "m", "text").collect()}
    assert found["cut"] == ["ending"] and found["head"] == []


def test_long_final_tokens():
    assert cutoff.last_word("x " + "y" * 5000) == "y" * 5000 and cutoff.last_word("it is o’clo — ") == "o’clo" and cutoff.last_word("...") == "" and cutoff.last_word("a-'b") == "b"


def test_without_the_rendered_texts(spark, sf):
    """Trie and length alone find nine in ten of what is found with the rendered texts, and nothing else."""
    sf = sf.replace("sf0.001", "sf0.1")
    keys = ["doc_id", "unit_id", "stage"]
    stored = queries.table(spark, sf, "translations").select(*keys, "model_key", queries.F.array_join("segments", "").alias("text"))
    alone = {tuple(r) for r in cutoff.truncated(stored, keys, "model_key", "text").where("is_truncated").select(*keys).collect()}
    found = {tuple(r) for r in queries.p5_found(spark, sf).collect()}
    assert len(alone & found) >= 0.9 * len(found) and len(alone & found) >= 0.95 * len(alone)


def test_query(spark, sf):
    df = queries.p5_found(spark, sf)
    assert df.columns == ["doc_id", "unit_id", "stage"] and df.count() == df.distinct().count()
    assert queries.p5_sources(spark, sf).columns == ["model_key", "texts", "truncated", "share"]
