"""Protected spans, the translation memory, and the batched model call over distinct texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pytext as P
from ..shared import ship, vectorised
from .segments import estimate, pieces_under_budget


def _one_case() -> dict[int, str]:
    """Characters that may match each other where case does not count, each to one of them."""
    lead: dict[str, str] = {}

    def find(c: str) -> str:
        while lead.setdefault(c, c) != c:
            c = lead[c]
        return c

    for c in (c for c in map(chr, range(0x20000)) if not c.lower() == c.upper() == c.casefold()):
        for d in (c.lower(), c.upper(), c.title(), c.casefold(), *("iıİ" if c == "I" else "")):
            a, b = sorted((find(c), find(d)), key=lambda x: (len(x), x))
            lead[b] = a
    return {ord(c): find(c) for c in lead if len(c) == 1 and find(c) != c}


_ONE_CASE = _one_case()
#: Terms of a table are found by so many characters that they begin with.
TERM_PREFIX = 3

#: Spans that no model may touch: what ``functions.pytext`` calls a web address, an e-mail address and a number.
_IMMUTABLE = "|".join((r"https?://[^\s<>()]+", P.EMAIL, P.NUMBER))


#: What a protected span becomes, as a model may give it back.
TOKEN = r"ZXQPH[A-Z]+?QXZ|zxqph[a-z]+?qxz"


def alpha(n: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class Protector:
    """Links, e-mail addresses, numbers and locked terms become tokens that a model leaves alone.

    One alternation is walked from left to right, longest terms first, so a term can never match inside a token."""

    def __init__(self, terms: Sequence[tuple[str, str]] = ()) -> None:
        self.terms = {s.casefold(): t for s, t in terms}
        words = "|".join(regex.escape(s) for s, _ in sorted(terms, key=lambda x: -len(x[0])))
        self.pattern = regex.compile(f"(?P<keep>{_IMMUTABLE})" + (f"|(?P<term>{words})" if words else ""), regex.I)

    def protect(self, text: str) -> tuple[str, dict[str, str]]:
        held: dict[str, str] = {}

        def token(m: regex.Match) -> str:
            name = f"ZXQPH{alpha(len(held))}QXZ"
            held[name] = m.group() if m.group("keep") is not None else self.terms.get(m.group().casefold(), m.group())
            return name

        return self.pattern.sub(token, text), held

    @staticmethod
    def restore(text: str, held: dict[str, str]) -> str:
        """Tokens, also in lower case, back to what they stand for; in one pass, so that a value is never rewritten."""
        if not held:
            return text
        back = {**{k.lower(): v for k, v in held.items()}, **held}
        return regex.sub(TOKEN, lambda m: back.get(m.group(), m.group()), text)


class UpperBackend:
    """The deterministic model: ASCII letters in capitals."""

    id = "upper-1"
    _table = {i: i - 32 for i in range(97, 123)}

    def translate(self, texts: Sequence[str], language: str) -> list[str]:
        return [t.translate(self._table) for t in texts]


def cache_key(text: Column, source_language: Column, target_language: Column, backend: str, terms: str = "") -> Column:
    """Digest of everything a translation depends on."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*(part(F.coalesce(c, F.lit(""))) for c in (F.lit(backend), F.lit(terms), source_language, target_language, text))), 256)


def _starts(text: str) -> list[str]:
    """What a term of a text may begin with."""
    t = text.translate(_ONE_CASE)
    return list({t[i : i + n] for n in range(1, TERM_PREFIX + 1) for i in range(len(t) - n + 1)})


def with_own_terms(distinct: DataFrame, terms: DataFrame) -> DataFrame:
    """``distinct`` and ``own``, the terms (source, target) that occur in each text: found by an equi-join on what a term
    begins with, so the terms are never sent along as a whole."""
    one_case = vectorised("string")(lambda s: s.map(lambda x: None if x is None else x.translate(_ONE_CASE)))
    starts = vectorised("array<string>")(lambda s: s.map(lambda x: _starts(x or "")))
    t = terms.select("source", "target", one_case("source").alias("_find")).withColumn("_start", F.substring("_find", 1, TERM_PREFIX))
    begun = distinct.select("cache_key", F.explode(starts("text")).alias("_start")).join(t, "_start").drop("_start")
    held = begun.join(distinct.select("cache_key", one_case("text").alias("_in")), "cache_key").where(F.col("_in").contains(F.col("_find")))
    own = held.groupBy("cache_key").agg(F.sort_array(F.collect_set(F.struct("source", "target"))).alias("own"))
    return distinct.join(own, "cache_key", "left")


def translate_distinct(texts: DataFrame, backend: Callable[[], object] = UpperBackend, terms: Sequence[tuple[str, str]] | DataFrame = (), limit: int = 420, batch: int = 8) -> DataFrame:
    """(cache_key, translation) of distinct (cache_key, text, language): each text goes to the model once.

    Spans are protected before and restored after; a text above ``limit`` tokens goes in pieces whose results, stripped,
    are joined by a space.  Blank texts come back as they are.  ``terms`` may be a table (source, target) of any size."""
    ship(texts.sparkSession)
    distinct = texts.select("cache_key", "text", "language").dropDuplicates(["cache_key"])
    looked_up = isinstance(terms, DataFrame)
    if looked_up:
        distinct, terms = with_own_terms(distinct, terms), ()
    terms = list(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, protector = backend(), Protector(terms)
        for b in batches:
            own = b["own"] if looked_up else [None] * len(b)
            out: dict[int, str] = {}
            waiting: dict[str, list[tuple[int, str, dict[str, str]]]] = {}

            def flush(lang: str) -> None:
                block = waiting.pop(lang, [])
                for (i, _, held), value in zip(block, model.translate([x for _, x, _ in block], lang)):
                    out[i] = protector.restore(value, held)

            for i, (t, lang, some) in enumerate(zip(b["text"], b["language"], own)):
                if not t or not t.strip():
                    out[i] = t
                    continue
                safe, held = (protector if some is None else Protector([(x["source"], x["target"]) for x in some])).protect(t)
                if estimate(safe) > limit:
                    parts = pieces_under_budget(safe, max(64, limit - 12))
                    done = [x for k in range(0, len(parts), batch) for x in model.translate(parts[k : k + batch], lang)]
                    out[i] = protector.restore(" ".join(x.strip() for x in done if x.strip()), held)
                else:
                    waiting.setdefault(lang, []).append((i, safe, held))
                    if len(waiting[lang]) >= batch:
                        flush(lang)
            for lang in list(waiting):
                flush(lang)
            yield pd.DataFrame({"cache_key": b["cache_key"], "translation": [out[i] for i in range(len(b))]})

    return distinct.mapInPandas(run, "cache_key string, translation string")


def through_memory(items: DataFrame, memory: DataFrame | None, backend: Callable[[], object] = UpperBackend, terms: Sequence[tuple[str, str]] | DataFrame = ()) -> tuple[DataFrame, DataFrame]:
    """(items with ``translation``, new memory): known keys are looked up, distinct others translated, both joined back."""
    if memory is None:
        memory = items.sparkSession.createDataFrame([], "cache_key string, translation string")
    known = memory.groupBy("cache_key").agg(F.min("translation").alias("translation"))
    fresh = translate_distinct(items.join(known, "cache_key", "left_anti"), backend, terms)
    both = known.unionByName(fresh)
    return items.join(both, "cache_key", "left"), both


def protect_column(text: Column, terms: Sequence[tuple[str, str]] = ()) -> Column:
    """STRUCT<protected, held MAP>; null gives null."""
    terms = list(terms)

    @vectorised("struct<protected:string,held:map<string,string>>")
    def run(t: pd.Series) -> pd.DataFrame:
        p = Protector(terms)
        rows = [(None, None) if x is None else p.protect(x) for x in t]
        return pd.DataFrame({"protected": [r[0] for r in rows], "held": [r[1] for r in rows]})

    return run(text)


def restore_column(text: Column, held: Column) -> Column:
    """Native inverse of :func:`protect_column`: tokens, also in lower case, in one pass, so that a value is never rewritten."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    between = F.split(text, TOKEN, -1)
    value = lambda t: F.coalesce(F.element_at(held, F.upper(t)), t)
    pairs = F.zip_with(between, tokens, lambda b, t: F.concat(b, F.coalesce(value(t), F.lit(""))))
    return F.array_join(pairs, "")
