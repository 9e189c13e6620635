"""Problem 5: stored texts that stop before their end, and how often each source truncates.

The vocabulary of the corpus is a *trie*: a table of nodes (one row for each prefix, keyed by it) with how many texts
hold words that run through it, end in it, and end the text in it; it may grow with the corpus without ever being in one place.  Evidence:

* ``word``: the final token is a proper prefix of known words and no word itself, or one next to never seen beside them.
* ``ending``: the final token is a word that hardly ever ends a text.
* ``sentence``: sentences came before, and the last one lacks its end.
* ``length``: the text stops at a length at which its source keeps stopping.
* ``source``: the text that it renders ends its sentence.  This only confirms a final token that seldom ends a text,
  or no other text.

What was put behind the stop is taken off first.  Headings, cells and codes lack an end of sentence by right.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import durable, returned, sent, sent_type, ship, spread

#: What may follow the place where a text stopped: blanks, signs, short notes in brackets, links, an ellipsis.
_BEHIND = regex.compile(
    r"(?:[\s\p{Cf}\p{Cc}�\p{So}\p{Sk}\p{EMod}️]|\[[^\[\]\n]{0,40}\]|\([^()\n]{0,40}\)|<[^<>\n]{0,40}>|\{[^{}\n]{0,40}\}"
    r"|(?:https?://|www\.)\S+|…|\.\.+|(?<=\s)[—–*†‡|]|(?<=[.!?؟。][\"'”’»)\]]*\s)\p{N}{1,3})+\Z"
)
_TAIL = 4096
_FINISHED = regex.compile(r"[.!?؟。！？۔][\"'”’»)\]]*\Z")
_SENTENCE_BEFORE = regex.compile(r"[\p{L}\p{M}]{2}[\"'”’»)\]]*[.!?؟。۔][\"'”’»)\]]*\s")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[‌'’-][\p{L}\p{M}\p{N}]+)*")
_HAS_DIGIT = regex.compile(r"\p{N}")
_LETTER, _JOINS = regex.compile(r"[\p{L}\p{M}\p{N}]"), "\u200c'’-"

#: A word that fewer texts hold, relative to the longer words that begin with it, is none.
KNOWN_SHARE = 0.01
#: A final word is evidence where so small a share of its texts ends in it; and with the rendered text's, so small a one.
ENDING_SHARE, SELDOM_SHARE = 0.002, 0.05
#: A length is a limit of a source where at least so many unfinished texts stop at it, so many times as many as at the
#: lengths around it (so far away) on average.
LIMIT_ROWS, LIMIT_TIMES, LIMIT_AROUND = 3, 5, 10


def stop_of(text: str) -> str:
    """The text up to the place where it stopped."""
    if text and text[-1].isalnum() and "://" not in text[text.rfind(" ") + 1 :] and not _HAS_DIGIT.match(text[-1]):
        return text
    while len(text) > _TAIL:  # a window at a time: the pattern is searched for from every place
        kept = _BEHIND.sub("", text[-_TAIL:])
        text = text[:-_TAIL] + kept
        if kept:
            return text
    return _BEHIND.sub("", text)


def finished(text: str) -> bool:
    return _FINISHED.search(text) is not None


def last_word(text: str) -> str:
    """The last word, however long; '' without any."""
    z = len(text)
    while z and not _LETTER.match(text[z - 1]):
        z -= 1
    a = z
    while a and (_LETTER.match(text[a - 1]) or (text[a - 1] in _JOINS and a > 1 and _LETTER.match(text[a - 2]))):
        a -= 1
    return text[a:z]


def shape(text: str) -> tuple[str, str, int]:
    """(shape, final token, where it stops): 'blank', 'finished', 'open' (sentences, the last one unfinished) or 'fragment'."""
    body = stop_of(text)
    last = last_word(body)
    if not last:
        return "blank", "", len(body)
    if finished(body):
        return "finished", last, len(body)
    return ("open" if _SENTENCE_BEFORE.search(body) else "fragment"), last, len(body)


def vocabulary(texts: DataFrame, text: str, flush: int = 200_000) -> DataFrame:
    """(word, n): words and how many texts hold them, except as the final one, which may be cut; counted over all texts."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            for t in b["t"]:
                for w in set(WORD.findall(stop_of(t))[:-1]):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > flush:
                yield pd.DataFrame(list(seen.items()), columns=["word", "n"])
                seen = {}
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"])

    counted = spread(texts.select(F.col(text).alias("t")).where("t is not null")).mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def trie(words: DataFrame) -> DataFrame:
    """(prefix, below): the inner nodes of the trie, each with the sum of n over the longer words below it; from (word, n)."""
    spread_out = words.where(F.length("word") > 1).repartition(words.sparkSession.sparkContext.defaultParallelism)
    inner = spread_out.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))")).alias("prefix"), "n")
    return inner.groupBy("prefix").agg(F.sum("n").alias("below"))


def final_words(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(last, no_word, hardly_word, ends, only_here): what the trie says of each final token of ``rows`` (last): whether it
    is no word but a proper prefix of some; whether it is next to none beside them; the share of its texts that end
    in it; whether it stands within texts and ends one only."""
    finals = rows.where("last <> ''").groupBy("last").agg(F.count("*").alias("ended"))
    said = finals.join(known.withColumnRenamed("word", "last"), "last", "left").join(trie(known).withColumnRenamed("prefix", "last"), "last", "left")
    n, below = F.coalesce("n", F.lit(0)), F.coalesce("below", F.lit(0))
    return said.select("last", ((n == 0) & (below > 0)).alias("no_word"), (n < KNOWN_SHARE * below).alias("hardly_word"), (F.col("ended") / (n + F.col("ended"))).alias("ends"), ((n > 0) & (F.col("ended") == 1)).alias("only_here"))


def stopping_lengths(rows: DataFrame, source: str, length: str) -> DataFrame:
    """(_source, _n): lengths at which unfinished texts of a source pile up, relative to the lengths around."""
    bad = rows.where("shape = 'open'").groupBy(F.col(source).alias("_source"), F.col(length).alias("_n")).agg(F.count("*").alias("bad"))
    around = Window.partitionBy("_source").orderBy("_n").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    others = (F.sum("bad").over(around) - F.col("bad")) / (2 * LIMIT_AROUND)
    return bad.withColumn("others", others).where((F.col("bad") >= LIMIT_ROWS) & (F.col("bad") >= LIMIT_TIMES * F.col("others"))).select("_source", "_n")


def truncated(texts: DataFrame, keys: list[str], source: str, text: str, rendered: DataFrame | None = None, rendered_keys: list[str] | None = None) -> DataFrame:
    """(keys..., source, n_chars, is_truncated, evidence): one row for each key.

    ``rendered`` has the text that each value renders, in the column ``text``, by ``rendered_keys``.  Null and blank texts are not
    truncated.  Repeated rows of a key: one row, truncated if any of them is.  A null source is a source of its own.
    Very long texts are read whole.  An empty table: no rows.  Extra columns are not read.
    """
    spark = texts.sparkSession
    ship(spark)
    kinds = ", ".join(f"`{c}` {sent_type(texts, c)}" for c in [*keys, source])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [shape(t) if t else ("blank", "", 0) for t in b["t"]]
            out = b[[*keys, source]].copy()
            out["n_chars"], out["stop"] = [len(t) if t else 0 for t in b["t"]], [n for _, _, n in seen]
            out["shape"], out["last"] = [s for s, _, _ in seen], ["" if _HAS_DIGIT.search(w) else w for _, w, _ in seen]
            yield out

    seen = spread(texts.select(*(sent(texts, c, c) for c in [*keys, source]), F.col(text).alias("t"))).mapInPandas(look, f"{kinds}, n_chars int, stop int, shape string, last string").distinct()
    rows = durable(seen.select(*(returned(texts, c, c) for c in [*keys, source]), "n_chars", "stop", "shape", "last"))

    rows = rows.join(final_words(rows, durable(vocabulary(texts, text))), "last", "left")
    for length, at_limit in (("n_chars", "stored_limit"), ("stop", "stop_limit")):
        limits = stopping_lengths(rows, source, length).withColumn(at_limit, F.lit(True))
        rows = rows.join(limits, F.col(source).eqNullSafe(F.col("_source")) & (F.col(length) == F.col("_n")), "left").drop("_source", "_n")

    if rendered is not None:
        kinds_r = ", ".join(f"`{c}` {sent_type(rendered, c)}" for c in rendered_keys)

        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = b[rendered_keys].copy()
                out["whole"] = [finished(stop_of(t)) for t in b["text"]]
                yield out

        ended = spread(rendered.select(*(sent(rendered, c, c) for c in rendered_keys), "text").where("text is not null")).mapInPandas(ends, f"{kinds_r}, whole boolean")
        whole = ended.select(*(returned(rendered, c, c) for c in rendered_keys), "whole").groupBy(*rendered_keys).agg(F.max("whole").alias("whole"))
        rows = rows.join(whole, rendered_keys, "left")
    else:
        rows = rows.withColumn("whole", F.lit(None).cast("boolean"))
    unfinished = F.col("shape").isin("open", "fragment")
    evidence = F.array_compact(
        F.array(
            F.when(F.col("no_word") | (unfinished & F.col("hardly_word")), "word"),
            F.when(unfinished & (F.col("ends") < ENDING_SHARE), "ending"),
            F.when(F.col("shape") == "open", "sentence"),
            F.when(unfinished & (F.coalesce("stored_limit", F.lit(False)) | F.coalesce("stop_limit", F.lit(False))), "length"),
        )
    )
    confirmed = unfinished & F.col("whole") & ((F.size(evidence) > 0) | (F.col("ends") < SELDOM_SHARE) | F.col("only_here"))
    evidence = F.concat(evidence, F.when(confirmed, F.array(F.lit("source"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select(*keys, source, "n_chars", evidence.alias("evidence"))
    by_key = rows.groupBy(*keys).agg(F.first(source).alias(source), F.max("n_chars").alias("n_chars"), F.max_by("evidence", F.size("evidence")).alias("evidence"))
    return by_key.withColumn("is_truncated", F.size("evidence") > 0)


def truncation_by_source(found: DataFrame, source: str) -> DataFrame:
    """(source, texts, truncated, share)."""
    n = F.count(F.when(F.col("is_truncated"), 1))
    return found.groupBy(source).agg(F.count("*").alias("texts"), n.alias("truncated"), (n / F.count("*")).alias("share"))
