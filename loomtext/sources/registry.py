"""One way to units for every kind of input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docx import scan_docx
from .text import scan_units


def _text(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files as texts; bytes that are no UTF-8 are read as U+FFFD."""
    files = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return scan_units(files, "path").withColumn("protected", F.array().cast("array<int>")).withColumn("error", F.lit(None).cast("string"))


def _pdf(spark: SparkSession, path: str) -> DataFrame:
    from .pdf import scan_pdf

    return scan_pdf(spark, path).withColumn("protected", F.array().cast("array<int>"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"text": _text, "docx": scan_docx, "pdf": _pdf}


def read_units(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(path, ord, unit_id, segments, protected, error) of all files of a kind under a path."""
    if kind not in READERS:
        raise ValueError(f"kind must be one of {', '.join(READERS)}")
    return READERS[kind](spark, path).select("path", "ord", "unit_id", "segments", "protected", "error")
