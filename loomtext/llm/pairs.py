"""Problem 4: prompt and response pairs whose response is no usable answer, each with its first kind of defect.

* ``empty``: nothing visible.
* ``refusal``: the refusal automaton accepts the response and not the prompt (:mod:`~loomtext.llm.refusal`).
* ``copy``: the response walks through a suffix automaton of the prompt; the share of the prompt that runs of it cover is
  what was copied, whatever was done to case, spaces, punctuation or quotes.
* ``truncated``: the prompt ends its last sentence, the response does not, or leaves delimiters of its stack open.
* ``language``: most of the words that vote are stopwords of another language than the one wanted.  The stopword lists
  are learned from the prompts, whose language is known, by counts over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable, returned, sent, sent_type, ship, spread
from .cutoff import finished, stop_of
from .fold import Folder
from .refusal import RefusalAutomaton

MIN_RUN = 20  # letters of a copied run
COPIED = 0.8  # share of the prompt's letters
#: Words with their languages, up to so many, are sent along; of more, each text gets its own.
SENT_WORDS = 50_000
_INVISIBLE = regex.compile(r"[\s\p{C}\p{Z}\p{M}ㅤ⠀]+")
_NOT_LETTERS = regex.compile(r"[^\p{L}]+")
_NOT_TEXT = regex.compile(r"(?:https?://|www\.)\S+|(?<!\S)\S*@\S+|\b(?=[A-Za-z0-9]{10})[A-Za-z0-9]*?(?:[a-z][A-Z0-9]|[0-9][A-Za-z])[A-Za-z0-9]*")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_CLOSES = {"»": "«", "”": "“", ")": "(", "]": "["}


class SuffixAutomaton:
    """All substrings of one string."""

    def __init__(self, s: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in s:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def covered(self, t: str, min_run: int) -> int:
        """How many characters of ``t`` lie in runs of at least ``min_run`` that the string contains."""
        nxt, link, length = self.next, self.link, self.length
        state = n = total = upto = 0
        for i, c in enumerate(t):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state, n = nxt[state][c], n + 1
            else:
                n = 0
            if n >= min_run:
                total += i + 1 - max(upto, i + 1 - n)
                upto = i + 1
        return total


def copied_share(prompt: str, response: str, min_run: int = MIN_RUN) -> float:
    """Share of the prompt's letters that the response repeats in runs; 0 for a prompt of fewer than 3 letters."""
    p = _NOT_LETTERS.sub("", _NOT_TEXT.sub(" ", prompt)).casefold()
    r = _NOT_LETTERS.sub("", _NOT_TEXT.sub(" ", response)).casefold()
    if len(p) < 3 or not r:
        return 0.0
    alphabet = set(p)
    if sum(c in alphabet for c in r) < COPIED * len(p):  # no runs could cover enough
        return 0.0
    return SuffixAutomaton(p).covered(r, min(min_run, len(p))) / len(p)


def open_delimiters(text: str) -> int:
    """How many delimiters are left on the stack."""
    stack: list[str] = []
    for c in text:
        if c in "«“([":
            stack.append(c)
        elif c in _CLOSES and stack and stack[-1] == _CLOSES[c]:
            stack.pop()
    return len(stack)


def words_of(folded: str) -> list[str]:
    return _WORD.findall(_NOT_TEXT.sub(" ", folded).casefold())


class PairJudge:
    def __init__(self, stopwords: Mapping[str, str]) -> None:
        self.fold, self.stopwords = Folder(), stopwords
        self.refusal = RefusalAutomaton(self.fold)

    def language_of(self, folded: str) -> str | None:
        """The language with most votes; None without any."""
        votes: dict[str, float] = {}
        for w in words_of(folded):
            lang = self.stopwords.get(w)
            if lang is None:
                if w[0] <= "ɏ":
                    lang, weight = "en", 0.5
                elif any(c in "پچژگ" for c in w):
                    lang, weight = "fa", 0.5
                elif any(c in "ةأإ" for c in w) or w.startswith("ال"):
                    lang, weight = "ar", 0.5
                else:
                    continue
                votes[lang] = votes.get(lang, 0) + weight
            else:
                votes[lang] = votes.get(lang, 0) + 1
        return max(votes, key=lambda x: (votes[x], x)) if votes else None

    def defect(self, source: str | None, target: str | None, wanted: str | None) -> str | None:
        if not target or not _INVISIBLE.sub("", target):
            return "empty"
        source = source or ""
        s, t = self.fold(source), self.fold(target)
        if self.refusal.declines(t) and not self.refusal.declines(s):
            return "refusal"
        if copied_share(s, t) >= COPIED:
            return "copy"
        body = stop_of(t)
        if not finished(body):
            whole = stop_of(s)
            if finished(whole) or (open_delimiters(body) > 0 and open_delimiters(whole) == 0):
                return "truncated"
        found = self.language_of(t)
        return "language" if wanted and found and found != wanted else None


def word_languages(pairs: DataFrame, language: str, text: str) -> DataFrame:
    """(w, l): word and the language in which it is relatively most frequent; counted over all texts."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, seen = Folder(), {}
        for b in batches:
            for lang, t in zip(b["l"], b["t"]):
                for w in words_of(fold(t)):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            if len(seen) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["l", "w", "n"])
                seen = {}
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["l", "w", "n"])

    counts = spread(pairs.select(F.col(language).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")).mapInPandas(run, "l string, w string, n long")
    counts = counts.groupBy("l", "w").agg(F.sum("n").alias("n"))
    share = counts.join(counts.groupBy("l").agg(F.sum("n").alias("all")), "l").withColumn("share", F.col("n") / F.col("all"))
    return share.groupBy("w").agg(F.max(F.struct("share", "l"))["l"].alias("l"))


def with_own_words(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (..., t) and ``own``, the languages of the words of each text; found by an equi-join, once for each
    different text."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder()
        for b in batches:
            asked = [(d, w) for d, t in zip(b["d"], b["t"]) for w in set(words_of(fold(t)))]
            yield pd.DataFrame(asked, columns=["d", "w"])

    keyed = rows.withColumn("d", F.sha2("t", 256))
    asked = spread(keyed.select("d", "t").where("t is not null")).mapInPandas(run, "d string, w string").distinct()
    own = asked.join(words, "w").groupBy("d").agg(F.collect_list(F.struct("w", "l")).alias("own"))
    return keyed.join(own, "d", "left").drop("d")


def defective_pairs(pairs: DataFrame, key: str, source: str, target: str, source_language: str, target_language: str) -> DataFrame:
    """(key, defect): one row for each defective pair.

    A null or blank response is ``empty``; a null prompt is an empty text.  A null wanted language: no language defect.
    Repeated rows of a key: once (rows that disagree: the defect first in the alphabet).  Very long texts are read whole.
    An empty table: no rows.  Extra columns are not read.
    """
    spark = pairs.sparkSession
    ship(spark)
    words = durable(word_languages(pairs, source_language, source))
    few = words.limit(SENT_WORDS + 1).collect()
    looked_up = len(few) > SENT_WORDS
    stopwords = spark.sparkContext.broadcast({} if looked_up else {r["w"]: r["l"] for r in few})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = PairJudge(stopwords.value)
        for b in batches:
            rows = []
            for k, s, t, w, own in zip(b["k"], b["s"], b["t"], b["w"], b["own"] if looked_up else [None] * len(b)):
                if looked_up:
                    judge.stopwords = {} if own is None else {x["w"]: x["l"] for x in own}
                if d := judge.defect(s, t, w):
                    rows.append((k, d))
            yield pd.DataFrame(rows, columns=["k", "defect"])

    rows = pairs.select(sent(pairs, key, "k"), F.col(source).alias("s"), F.col(target).alias("t"), F.col(target_language).alias("w"))
    rows = with_own_words(rows, words) if looked_up else spread(rows)
    found = rows.mapInPandas(run, f"k {sent_type(pairs, key)}, defect string")
    return found.groupBy("k").agg(F.min("defect").alias("defect")).select(returned(pairs, key, "k"), "defect")
