"""Deterministic quality checks of (source, target) pairs, and locked glossary terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pytext as P
from ..shared import spread

BLOCKING = ("empty", "numbers", "urls", "emails", "placeholder")
#: Terms are found by so many characters that they begin with.
GRAM = 3


def quality_flags(source: Column, target: Column, language: Column) -> Column:
    """Flags of a pair, in a fixed order; a blank target has the flag ``empty`` alone; nulls are empty texts."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    n_s, n_t = F.length(P.strip(s)), F.length(P.strip(t))
    ratio = n_t / F.greatest(F.lit(1), n_s)
    leak = F.size(P.latin_words(t)) >= F.greatest(F.lit(8), F.floor(F.size(P.latin_words(s)) * F.lit(0.65)).cast("int"))
    flags = F.array(
        F.when(F.array_sort(P.canonical_numbers(s)) != F.array_sort(P.canonical_numbers(t)), "numbers"),
        F.when((s.contains("://") | t.contains("://")) & (P.urls(s) != P.urls(t)), "urls"),
        F.when((s.contains("@") | t.contains("@")) & (P.emails(s) != P.emails(t)), "emails"),
        F.when(t.rlike(P.PLACEHOLDER), "placeholder"),
        F.when((n_s > 80) & ((ratio < 0.28) | (ratio > 3.8)), "length"),
        F.when(language.isin(*P.RTL) & (F.length(s) > 100) & leak, "source_leakage"),
    )
    return F.when(P.is_blank(t), F.array(F.lit("empty"))).otherwise(F.array_compact(flags))


def locked_terms(glossary: DataFrame) -> DataFrame:
    """(position, source, target): locked terms with both sides, stripped; of terms equal in folded case, the last one's value at the first one's place.  Ties of ``prio`` are broken by the term's text."""
    kept = glossary.where("locked").select("prio", P.strip(F.col("source")).alias("source"), P.strip(F.col("target")).alias("target")).where("source <> '' and target <> ''")
    latest = F.max_by(F.struct("source", "target"), F.struct("prio", "source", "target")).alias("v")
    return kept.groupBy(P.casefold(F.col("source")).alias("folded")).agg(F.min("prio").alias("position"), latest).select("position", "v.source", "v.target")


def glossary_flags(pairs: DataFrame, keys: list[str], source: str, target: str, terms: DataFrame) -> DataFrame:
    """(keys..., position, flag): a locked term of two letters or more is in the source and its translation is not in the target.

    An equi-join at any size of the glossary: a term is met by the characters it begins with, at every place of the text
    where they stand.  Null texts are empty ones."""
    t = terms.where(F.length("source") >= 2).select("position", F.col("source").alias("_term"), F.col("target").alias("_wanted"), P.casefold(F.col("source")).alias("_find"), P.casefold(F.col("target")).alias("_need"))
    t = t.withColumn("_g", F.substring("_find", 1, GRAM))
    folded = pairs.select(*keys, P.casefold(F.coalesce(F.col(source), F.lit(""))).alias("_s"), P.casefold(F.coalesce(F.col(target), F.lit(""))).alias("_t"))
    at_each = F.concat(*(F.regexp_extract_all("_s", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(2, GRAM + 1)))
    seen = folded.where(F.length("_s") >= 2).withColumn("_g", F.explode(F.array_distinct(at_each)))
    found = seen.join(t, "_g").where(F.col("_s").contains(F.col("_find")) & ~F.col("_t").contains(F.col("_need")))
    flag = F.concat(F.lit("terminology:"), F.col("_term"), F.lit("→"), F.col("_wanted"))
    return found.select(*keys, "position", flag.alias("flag")).distinct()


def collect_issues(pairs: DataFrame, keys: list[str], source: str, target: str, language: str, terms: DataFrame) -> DataFrame:
    """(keys..., flags): quality flags, then glossary flags by position; only pairs with a flag; no flag twice."""
    pairs = spread(pairs.select(*keys, source, target, language))
    own = pairs.select(*keys, F.explode(F.array(quality_flags(F.col(source), F.col(target), F.col(language)))).alias("own"))  # exploded, so that no filter repeats it
    named = glossary_flags(pairs, keys, source, target, terms).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("position", "flag"))).alias("named"))
    both = own.join(named, keys, "left")
    flags = F.array_distinct(F.concat("own", F.coalesce(F.transform("named", lambda x: x["flag"]), F.array().cast("array<string>"))))
    return both.select(*keys, flags.alias("flags")).where(F.size("flags") > 0)


def blocking_flags(issues: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., flags): only flags that block delivery; rows without one drop out."""
    kept = F.filter("flags", lambda f: F.substring_index(f, ":", 1).isin(*BLOCKING))
    return issues.select(*keys, kept.alias("flags")).where(F.size("flags") > 0)


def latest_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
