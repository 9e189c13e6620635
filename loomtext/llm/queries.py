"""Queries of the problems on text for language models, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table, unit_texts
from . import pii
from .bpe import decode_column, encode_column
from .cutoff import truncated, truncation_by_source
from .fold import consistent_forms, frequencies, lookalike_pairs, text_classes
from .langid import detect_languages, fit, label_defects, segment_languages
from .leak import find_leaks, remove_leaks
from .pairs import defective_pairs


def _lookalike_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs are one scope; the units of each document are another."""
    jobs = table(spark, sf_dir, "jobs").select(F.lit("job").alias("item_kind"), F.lit("").alias("scope"), F.col("id").alias("key"), F.col("source_text").alias("text"))
    units = unit_texts(spark, sf_dir).select(F.lit("unit"), F.col("doc_id").cast("string"), F.concat_ws("/", F.col("doc_id").cast("string"), "unit_id"), "text")
    return jobs.unionAll(units)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, key_a, key_b): jobs, or units of one document, whose texts look the same and differ as stored."""
    texts = _lookalike_texts(spark, sf_dir).withColumn("place", F.struct("item_kind", "scope"))
    pairs = lookalike_pairs(texts, "place", "key", "text")
    return pairs.select("place.item_kind", "key_a", "key_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, key, class, texts, links): each item that looks like another one, with its class and its number of links."""
    texts = _lookalike_texts(spark, sf_dir).withColumn("place", F.struct("item_kind", "scope"))
    return text_classes(texts, "place", "key", "text").select("place.item_kind", "key", "class", "texts", "links")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, key, form): every text in its consistent form."""
    texts = _lookalike_texts(spark, sf_dir)
    keyed = texts.select(F.struct("item_kind", "key").alias("k"), "text")
    return consistent_forms(keyed, "k", "text", frequencies(texts, "text")).select("k.item_kind", "k.key", "form").distinct()


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("id", "source_text", "source_language")
    return detect_languages(jobs, "id", "source_text", "source_language", fit(jobs, "source_language", "source_text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, defect, lang): jobs whose language label is missing or wrong, and those of several languages."""
    return label_defects(_detected(spark, sf_dir), "id")


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lang, confidence): the language of each job with a text."""
    return _detected(spark, sf_dir).select("id", "lang", "confidence")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, start_pos, end_pos, lang, confidence, words): the language of each segment of each job."""
    jobs = table(spark, sf_dir, "jobs").select("id", "source_text", "source_language")
    return segment_languages(jobs, "id", "source_text", fit(jobs, "source_language", "source_text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, defect): pairs whose target is no usable answer."""
    return defective_pairs(table(spark, sf_dir, "unit_pairs"), "pair_id", "source", "target", "source_language", "target_language")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored translation with the evidence of truncation."""
    stored = table(spark, sf_dir, "translations").select("doc_id", "unit_id", "stage", "model_key", F.array_join("segments", "").alias("text"))
    return truncated(stored, ["doc_id", "unit_id", "stage"], "model_key", "text", unit_texts(spark, sf_dir), ["doc_id", "unit_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, unit_id, stage): stored texts that stop before their end."""
    return _stored(spark, sf_dir).where("is_truncated").select("doc_id", "unit_id", "stage")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_key, texts, truncated, share)."""
    return truncation_by_source(_stored(spark, sf_dir), "model_key")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): encoded and decoded again."""
    return decode_column(p7_ids(spark, sf_dir), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents with at least 10 words on end of an evaluation item."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text").select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents): the items that leaked, and into how many documents."""
    return p8_found(spark, sf_dir).groupBy("item_id").count().withColumnRenamed("count", "documents")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, removed_words, dropped): the documents without the passages."""
    return remove_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def _personal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pii.Lexicon, pii.SkipChainModel]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    given = pii.given_name_list(table(spark, sf_dir, "given_names"), "given_name")
    return documents, *pii.fit(documents, "text", given)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, start_pos): every piece of personal information."""
    documents, lexicon, model = _personal(spark, sf_dir)
    return pii.find_personal(documents, "doc_id", "text", lexicon, model).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the documents with typed placeholders."""
    documents, lexicon, model = _personal(spark, sf_dir)
    return pii.redact(documents, "doc_id", "text", lexicon, model)


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_forms": p1_forms, "p3_found": p3_found, "p3_languages": p3_languages, "p3_segments": p3_segments, "p4_found": p4_found, "p5_found": p5_found, "p5_sources": p5_sources, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p8_items": p8_items, "p8_clean": p8_clean, "p9_found": p9_found, "p9_redacted": p9_redacted}

_WINDOWS = r"""SELECT DISTINCT {key}, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 8)) AS i FROM (SELECT {key},
    regexp_extract_all(replace(lower(regexp_replace(text, '[\x{{ad}}\x{{34f}}\x{{61c}}\x{{180e}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{2066}}-\x{{206f}}\x{{fe00}}-\x{{fe0f}}\x{{feff}}]', '', 'g')), 'ß', 'ss'),
    '[\p{{L}}\p{{N}}]+') AS ws FROM {table} WHERE text IS NOT NULL))"""
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_WINDOWS.format(key='doc_id', table='documents')}) JOIN ({_WINDOWS.format(key='item_id', table='eval_items')}) USING (g)"

#: SQL on whole tables; the other problems are tested against brute force, round trips or held-out accuracy.
SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": _LEAKS,
    "p8_items": f"SELECT item_id, count(*) AS documents FROM ({_LEAKS}) GROUP BY item_id",
}
