"""python -m loomtext doctor | translate IN OUT --source en --target fa [--mode balanced]: versions, or text files through the pipeline."""

from __future__ import annotations

import argparse
import importlib.util
import json
import platform
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def doctor() -> dict:
    """What is installed, and whether a session starts and a text goes through the deterministic model."""
    from .operators.memory import UpperBackend

    optional = {m: importlib.util.find_spec(m) is not None for m in ("ahocorasick", "duckdb", "fitz", "numpy", "pandas", "pyarrow", "regex", "tokenizers", "xxhash")}
    spark = SparkSession.builder.getOrCreate()
    return {"python": platform.python_version(), "spark": spark.version, "master": spark.sparkContext.master, "cores": spark.sparkContext.defaultParallelism, "modules": optional, "probe": UpperBackend().translate(["ready"], "en") == ["READY"]}


def translate(source_path: str, out: str, source: str, target: str, mode: str) -> int:
    """Text files to text files, one row of the output table for each; returns how many."""
    from .plans import pipeline
    from .sources import text

    spark = SparkSession.builder.getOrCreate()
    files = spark.read.format("binaryFile").load(source_path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    docs = files.withColumn("doc_id", F.xxhash64("path"))
    units = text.scan_units(docs).withColumn("protected", F.array().cast("array<int>"))
    empty = spark.createDataFrame([], "prio int, source string, target string, locked boolean")
    done, _ = pipeline.run(units, source, target, empty, mode)
    text.rebuild(text.scan_parts(docs), done).join(docs.select("doc_id", "path"), "doc_id").select("path", "text").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    t = sub.add_parser("translate")
    t.add_argument("input")
    t.add_argument("output")
    for name, default in (("--source", "en"), ("--target", "fa"), ("--mode", "balanced")):
        t.add_argument(name, default=default)
    a = p.parse_args(args)
    if a.command == "doctor":
        print(json.dumps(doctor(), indent=2))
    else:
        print(translate(a.input, a.output, a.source, a.target, a.mode), "files")
    return 0


if __name__ == "__main__":
    sys.exit(main())
