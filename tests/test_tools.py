import json

import pytest
from pyspark.sql import functions as F

from loomtext import __main__ as cli
from loomtext import config
from loomtext.operators import tables
from loomtext.sources.registry import read_units


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("LT_NAME", "x")
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"paths": {"model_root": "m", "data": "./d"}, "a": ["${MODEL_ROOT}/k.gguf", "$LT_NAME", 3, "plain/slash"], "b": {"c": "${APP_DIR}"}}))
    c = config.load(f)
    assert c["paths"] == {"model_root": str(tmp_path / "m"), "data": str(tmp_path / "d")}
    assert c["a"] == [str(tmp_path / "m" / "k.gguf"), "x", 3, "plain/slash"] and c["b"]["c"] == str(tmp_path)
    assert config.overlay({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}
    for bad in ("[1]", "{"):
        f.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(f)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.json")


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "id int, status string, at int")
    new = spark.createDataFrame([(1, "z", 1), (2, "old", 0), (4, "n", 2)], base.schema)
    assert {r["id"]: r["status"] for r in tables.upsert(base, new, ["id"], "at").collect()} == {1: "z", 2: "b", 3: None, 4: "n"}
    kids = spark.createDataFrame([(1, "x"), (2, "y"), (None, "w")], "job int, v string")
    left, events = tables.delete_cascade(base, "id", F.col("status") == "a", (kids, "job"))
    assert {r["id"] for r in left.collect()} == {2, 3} and {r["v"] for r in events.collect()} == {"y", "w"}
    assert tables.grow(base, {"status": "q", "extra": 0}).where("id = 3").first().asDict() == {"id": 3, "status": None, "at": 1, "extra": 0}


def test_reader_registry(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    rows = read_units(spark, "text", str(tmp_path / "a.txt")).orderBy("ord").collect()
    assert [(r["unit_id"], r["segments"]) for r in rows] == [("text-0", ["one"]), ("text-2", ["two"])]
    with pytest.raises(ValueError):
        read_units(spark, "odt", str(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello 5\n\nsee https://x.example/a", encoding="utf-8")
    assert cli.main(["translate", str(tmp_path / "in"), str(tmp_path / "out"), "--target", "ar"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] == "HELLO 5\n\nSEE https://x.example/a"
    cli.main(["doctor"])
    assert json.loads(capsys.readouterr().out.split("files\n")[1])["probe"] is True
