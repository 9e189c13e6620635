"""Queries of the two general problems: 2 (filling containers) and 6 (splitting oversized items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.packing import pack_texts
from .operators.split import cell_size, split_items
from .shared import size_limit, table, unit_texts


def p2_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request number for each unit, or piece of a unit longer than a container, within its document."""
    capacity = size_limit(spark, sf_dir, "unit")["container_chars"]
    return pack_texts(unit_texts(spark, sf_dir), "doc_id", "unit_id", "text", capacity)


def _sized_items(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, dict]]:
    units = unit_texts(spark, sf_dir).select(F.lit("unit").alias("item_kind"), F.concat_ws("/", F.col("doc_id").cast("string"), "unit_id").alias("item_key"), "text")
    jobs = table(spark, sf_dir, "jobs").select(F.lit("job").alias("item_kind"), F.col("id").alias("item_key"), F.col("source_text").alias("text"))
    return [(units, size_limit(spark, sf_dir, "unit")), (jobs, size_limit(spark, sf_dir, "job"))]


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, item_key, piece_no, start_pos, end_pos, piece) of each oversized item.

    The items of these tables are short beside the ranges of the operator: with ranges of one cell, the longest have several."""
    parts = [
        split_items(items, "item_key", "text", limit["max_chars"], limit["overlap_chars"], range_chars=cell_size(limit["max_chars"])).select(F.lit(limit["item_kind"]).alias("item_kind"), "item_key", "piece_no", "start_pos", "end_pos", "piece")
        for items, limit in _sized_items(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that were cut."""
    return p6_pieces(spark, sf_dir).select("item_kind", "item_key").distinct()


QUERIES = {"p2_requests": p2_requests, "p6_found": p6_found, "p6_pieces": p6_pieces}

SQL = {
    "p6_found": """
        SELECT DISTINCT 'unit' AS item_kind, concat(doc_id, '/', unit_id) AS item_key
        FROM units, (SELECT max_chars FROM size_limits WHERE item_kind = 'unit')
        WHERE length(array_to_string(segments, '')) > max_chars
        UNION ALL
        SELECT DISTINCT 'job', id FROM jobs, (SELECT max_chars FROM size_limits WHERE item_kind = 'job')
        WHERE length(source_text) > max_chars""",
}
