"""Reuse of finished work by digest, pending work, and the overlay of stages."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["doc_id", "unit_id"]


def digest(segments: Column) -> Column:
    """SHA-256 of a unit's segments as compact JSON."""
    return F.sha2(F.to_json(segments), 256)


def reusable(stage: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of a finished stage whose unit has the same digest and route as when it was made.

    ``previous`` and ``current``: (doc_id, unit_id, digest, route)."""
    valid = current.join(previous, [*KEY, "digest", "route"], "left_semi").select(*KEY)
    return stage.join(valid, KEY, "left_semi")


def pending(units: DataFrame, stage: DataFrame) -> DataFrame:
    """Units that a stage lacks."""
    return units.join(stage.select(*KEY), KEY, "left_anti")


def overlay(units: DataFrame, *stages: DataFrame) -> DataFrame:
    """(doc_id, unit_id, segments): of each unit the last stage that has it, else its source segments.  Stages have one row for each key."""
    out = units.select(*KEY, F.col("segments").alias("_0"))
    names = ["_0"]
    for i, s in enumerate(stages, 1):
        out = out.join(s.select(*KEY, F.col("segments").alias(f"_{i}")), KEY, "left")
        names.insert(0, f"_{i}")
    return out.select(*KEY, F.coalesce(*names).alias("segments"))


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def publish(stage: DataFrame, root: str, name: str) -> str:
    """Write a stage under ``root`` as a new version, then let the pointer name it, in one step: a reader sees the old version
    or the new one, never half of one.  Returns the version's path."""
    spark = stage.sparkSession
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    stage.write.parquet(path)
    jvm, files = _files(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/pointer-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(new, flags, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(json.dumps({"path": path}).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/pointer"), options)
    return path


def load(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The published version of a stage; where there is none, or it cannot be read, an empty table of the schema."""
    empty = spark.createDataFrame([], schema)
    try:
        pointer = spark.read.text(f"{root}/{name}/pointer", wholetext=True).first()
        found = json.loads(pointer[0])
        table = spark.read.parquet(found["path"])
    except (AnalysisException, Py4JJavaError, ValueError, TypeError, KeyError):
        return empty
    return table.select(*empty.columns) if set(empty.columns) <= set(table.columns) else empty
