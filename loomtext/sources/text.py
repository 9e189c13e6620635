"""Plain text: paragraphs as units, separators as literal parts, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"\r?\n(?:[ \t]*\r?\n)+"


def scan_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, kind, value): the text's paragraphs ('unit', even positions) and separators ('literal', odd ones); empty paragraphs are left out.  Null texts: no rows."""
    pieces = F.split(text, SEPARATOR, -1)
    rules = F.regexp_extract_all(F.col(text), F.lit(SEPARATOR), F.lit(0))
    units = docs.select(key, F.posexplode(pieces).alias("i", "value")).select(key, (F.col("i") * 2).alias("pos"), F.lit("unit").alias("kind"), "value")
    literals = docs.select(key, F.posexplode(rules).alias("i", "value")).select(key, (F.col("i") * 2 + 1).alias("pos"), F.lit("literal").alias("kind"), "value")
    return units.unionByName(literals).where("value <> ''")


def scan_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, unit_id, segments): units of the text, numbered by their part."""
    parts = docs.select(key, F.posexplode(F.split(text, SEPARATOR, -1)).alias("i", "value")).where("value <> ''")
    return parts.select(key, (F.col("i") * 2).alias("ord"), F.concat(F.lit("text-"), F.col("i") * 2).alias("unit_id"), F.array("value").alias("segments"))


def rebuild(parts: DataFrame, translations: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text): parts in order, units replaced by their translations (missing: ''; none given: as they are)."""
    if translations is not None:
        t = translations.select(key, "unit_id", F.array_join("segments", "").alias("_t"))
        named = parts.withColumn("unit_id", F.concat(F.lit("text-"), "pos"))
        parts = named.join(t, [key, "unit_id"], "left").withColumn("value", F.when(F.col("kind") == "literal", F.col("value")).otherwise(F.coalesce("_t", F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["value"]), "").alias("text"))
