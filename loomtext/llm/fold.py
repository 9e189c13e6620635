"""Problem 1: one consistent form for text that looks the same but differs in its characters.

Look-alike classes are the transitive closure (union-find) of links between *strings and code points*: a full-width
form and its plain letter, a ligature and its letters, a precomposed letter and its base with a mark, a Cyrillic or
Greek letter and the Latin one of the same shape.  Each class is rewritten to the member that the corpus uses most
(ties: fewest, then smallest code points), by one pass of a leftmost-longest multi-pattern automaton.  Marks are put
in canonical order, invisible characters are dropped, kinds of space become a space, and three context rules settle
what an automaton over strings cannot see: a non-joiner counts only where it separates letters that would join, and
the Persian and Arabic yeh and kaf have one shape only in some positions of a word.

Nothing here changes letter case, digit shapes, added marks or words: those differences are visible.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import durable, returned, sent, sent_type, ship, spread

#: Letters of one shape in two alphabets (Cyrillic, Greek and others, then the Latin letter).
LOOKALIKES = (
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE ЗƷ КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԜW Ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιı ϳj ϲc ϹC ɑa ɡg "
    "ԍɢ ոn օo սu զq ցg հh լl աw ՏS ՕO"
).split()

#: Punctuation of one shape.
LOOKALIKE_MARKS = ((";", ";"), ("·", "·"), ("‐", "-"), ("‑", "-"), ("`", "`"), ("ʹ", "ʹ"))

#: The yeh with hamza, also spelled with the Persian yeh or alef maksura and a hamza above.
LOOKALIKE_STRINGS = (("\u0626", "\u06cc\u0654"), ("\u0626", "\u0649\u0654"))

#: Characters that show nothing: soft hyphen, zero-width space and joiners of words, marks of direction, byte order.
INVISIBLE = frozenset(
    "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿￼"
) | {chr(c) for c in range(0xFE00, 0xFE10)}

#: Tags of compatibility decompositions that keep the look of a character.
SAME_LOOK_TAGS = frozenset(("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>"))

ZWNJ, ZWJ = "\u200c", "\u200d"
#: Letters of the Arabic script, its marks, and the letters that never join to the next one.
_LETTERS = "\u0620-\u064a\u066e\u066f\u0671-\u06d3\u06d5\u06ee\u06ef\u06fa-\u06fc\u06ff\u0750-\u077f\u08a0-\u08c9"
_MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed\u08ca-\u08e1\u08e3-\u08ff]*"
_NEVER_ON = "\u0621-\u0625\u0627\u0629\u062f-\u0632\u0648\u0671-\u0673\u0675-\u0677\u0688-\u0699\u06c0\u06c3-\u06cb\u06cd\u06cf\u06d2\u06d3\u06d5\u06ee\u06ef"
_BEFORE_LETTER = f"(?={_MARKS}[{_LETTERS}])"
_ZWNJ_BETWEEN = re.compile(f"([{_LETTERS}])({_MARKS}){ZWNJ}+(?=({_MARKS}[{_LETTERS}])?)")
_ZWNJ_ELSEWHERE = re.compile(f"(?<![{_LETTERS}\u0610-\u061a\u064b-\u065f\u0670]){ZWNJ}+")
_ENDS_JOINING = re.compile(f"[{_NEVER_ON}]")
_ZWJ = re.compile(f"(?<=[{_LETTERS}]){ZWJ}+{_BEFORE_LETTER}|(?<=[A-Za-z ]){ZWJ}+|{ZWJ}+(?=[A-Za-z ])")
#: Before a letter the Persian and the Arabic yeh and kaf have one shape; at the end of a word or before a non-joiner the
#: Persian yeh has the shape of alef maksura, and the two kafs differ.
_YEH_INSIDE = re.compile(f"[\u06cc\u064a]{_BEFORE_LETTER}")
_YEH_AT_END = re.compile(f"[\u06cc\u0649](?!{_MARKS}[{_LETTERS}])")
_KAF_INSIDE = re.compile(f"[\u06a9\u0643]{_BEFORE_LETTER}")
_ANY_SPACE = re.compile(r"[^\S \n\r]")
_VISIBLE = regex.compile(r"[\p{L}\p{N}]")


def _keep_separating(m: re.Match) -> str:
    """A non-joiner stays, once, where the letter before it would join to a letter after it."""
    separates = m.group(3) is not None and not _ENDS_JOINING.match(m.group(1))
    return m.group(1) + m.group(2) + (ZWNJ if separates else "")


class UnionFind:
    """Disjoint sets of strings, with path halving and union by size."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}
        self.size: dict[str, int] = {}

    def find(self, x: str) -> str:
        p = self.parent.setdefault(x, x)
        self.size.setdefault(x, 1)
        while p != self.parent[p]:
            self.parent[p] = p = self.parent[self.parent[p]]
        self.parent[x] = p
        return p

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.parent[b] = a
            self.size[a] += self.size[b]

    def classes(self) -> list[list[str]]:
        by_root: dict[str, list[str]] = {}
        for x in self.parent:
            by_root.setdefault(self.find(x), []).append(x)
        return [sorted(v, key=lambda s: (len(s), s)) for v in by_root.values() if len(v) > 1]


@lru_cache(maxsize=1)
def lookalike_classes() -> tuple[tuple[str, ...], ...]:
    """All classes of strings and code points that look the same, from the character database and the fixed values."""
    sets = UnionFind()
    for code in range(0x80, 0x30000):
        ch = chr(code)
        d = unicodedata.decomposition(ch)
        if not d or 0xAC00 <= code <= 0xD7A3:
            continue
        tag, _, rest = d.rpartition("> ")
        tag = f"{tag}>" if tag else ""
        plain = "".join(chr(int(x, 16)) for x in (rest or d).split())
        letters = tag == "<compat>" and plain.isalpha() and (code < 0x250 or 0xFB00 <= code <= 0xFEFF or 0x2160 <= code <= 0x217F)
        if not tag or tag in SAME_LOOK_TAGS or letters:
            full = unicodedata.normalize("NFKD" if tag else "NFD", ch)
            if not full.startswith(" ") and full != ch:  # an isolated mark on a space is not the mark itself
                sets.union(ch, full)
            if tag and plain != full and not plain.startswith(" "):
                sets.union(ch, plain)
            if tag and (c := unicodedata.normalize("NFC", full)) != full:
                sets.union(ch, c)
    for pair in LOOKALIKES:
        sets.union(pair[0], pair[1])
    for a, b in (*LOOKALIKE_MARKS, *LOOKALIKE_STRINGS):
        sets.union(a, b)
    return tuple(tuple(c) for c in sorted(sets.classes()))


def countable() -> frozenset[str]:
    """Single code points whose corpus frequency chooses between the members of a class."""
    return frozenset(x for c in lookalike_classes() for x in c if len(x) == 1) | set("\u06cc\u064a\u0649\u06a9\u0643")


def rewrite_table(frequency: Mapping[str, int] | None = None) -> dict[str, str]:
    """Member -> representative of its class: the most frequent code point, else the shortest and smallest string.

    A class whose members hold several code points is led by its plainest spelling, so that rewriting never needs a
    second pass; letters inside that spelling are replaced by their own representatives."""
    frequency = frequency or {}
    one: dict[str, str] = {}
    many: list[tuple[str, ...]] = []
    for c in lookalike_classes():
        single = [x for x in c if len(x) == 1]
        if single and all(len(x) == 1 for x in c):
            best = min(single, key=lambda x: (-frequency.get(x, 0), ord(x)))
            one.update((x, best) for x in c)
        else:
            many.append(c)
    table = dict(one)
    for c in many:
        longest = [x for x in c if len(x) > 1]
        spelled = {"".join(one.get(ch, ch) for ch in x) for x in longest}
        best = min(spelled, key=lambda x: (-min(frequency.get(ch, 0) for ch in x), len(x), x))
        single = [x for x in c if len(x) == 1]
        if any(len(unicodedata.normalize("NFC", s)) == 1 for s in spelled):  # letters with marks: the usual precomposed form
            best = min(single, key=lambda x: (-frequency.get(x, 0), ord(x)))
        table.update((x, best) for x in (*c, *spelled) if x != best)
    return {k: v for k, v in table.items() if k != v}


class Folder:
    """The rewriting automaton for one choice of representatives; built once in each Python worker."""

    def __init__(self, frequency: Mapping[str, int] | None = None) -> None:
        frequency = frequency or {}
        table = rewrite_table(frequency)
        self.automaton = ahocorasick.Automaton()
        for k, v in table.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.dropped = dict.fromkeys(map(ord, INVISIBLE))
        self.hidden = re.compile("[" + "".join(map(re.escape, sorted(INVISIBLE))) + "]")
        self.begins = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in table if len(k) == 1}))) + "]")
        self.ascii = [*filter(str.isascii, table), *(c for c in map(chr, range(128)) if _ANY_SPACE.match(c))]
        self.marks = regex.compile(r"\p{Mn}")
        often = lambda a, b: a if frequency.get(a, 0) >= frequency.get(b, 0) else b
        self.yeh_inside, self.yeh_at_end, self.kaf_inside = often("\u06cc", "\u064a"), often("\u06cc", "\u0649"), often("\u06a9", "\u0643")

    def __call__(self, text: str) -> str:
        """The consistent form; idempotent; '' for ''."""
        if text.isascii() and not any(k in text for k in self.ascii):
            return text
        once = self._rewrite(text)
        if (ZWNJ in text or ZWJ in text) and self.marks.search(once):  # a mark may have met its letter only now
            return self._rewrite(once)
        return once

    def _rewrite(self, text: str) -> str:
        if self.hidden.search(text):
            text = text.translate(self.dropped)
        marked = self.marks.search(text) is not None
        if marked:
            text = unicodedata.normalize("NFC", text)
        if marked or self.begins.search(text):
            out, at = [], 0
            for end, (n, to) in self.automaton.iter_long(text):
                out.append(text[at : end - n + 1])
                out.append(to)
                at = end + 1
            out.append(text[at:])
            text = unicodedata.normalize("NFC", "".join(out))
        text = _ANY_SPACE.sub(" ", text)
        if ZWNJ in text:
            text = _ZWNJ_ELSEWHERE.sub("", _ZWNJ_BETWEEN.sub(_keep_separating, text))
        if ZWJ in text:
            text = _ZWJ.sub("", text)
        text = _YEH_INSIDE.sub(self.yeh_inside, text)
        text = _YEH_AT_END.sub(self.yeh_at_end, text)
        return _KAF_INSIDE.sub(self.kaf_inside, text)


def has_content(text: str) -> bool:
    return _VISIBLE.search(text) is not None


def count_code_points(texts: Iterable[str | None], wanted: frozenset[str]) -> dict[str, int]:
    """Frequencies of the wanted code points."""
    import numpy as np

    joined = "".join(t for t in texts if t)
    codes, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
    return {chr(c): int(k) for c, k in zip(codes.tolist(), n.tolist()) if chr(c) in wanted}


def frequencies(texts: DataFrame, text: str) -> dict[str, int]:
    """How often the corpus uses each code point of the classes.  All texts are counted, first within partitions; what
    reaches the driver is at most a row for each code point of the table (a few thousand, whatever the corpus)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, total = countable(), {}
        for b in batches:
            for c, n in count_code_points(b["t"], wanted).items():
                total[c] = total.get(c, 0) + n
        yield pd.DataFrame(list(total.items()), columns=["c", "n"])

    rows = spread(texts.select(F.col(text).alias("t")).where("t is not null")).mapInPandas(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {r["c"]: r["n"] for r in rows.collect()}


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def consistent_forms(texts: DataFrame, key: str, text: str, frequency: Mapping[str, int] | None = None) -> DataFrame:
    """(key, form): every text in the one consistent form; null stays null, '' stays ''; a row for each row."""
    ship(texts.sparkSession)
    frequency = frequencies(texts, text) if frequency is None else dict(frequency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder(frequency)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "form": [None if t is None else fold(t) for t in b["t"]]})

    out = spread(texts.select(sent(texts, key, "k"), F.col(text).alias("t"))).mapInPandas(run, f"k {sent_type(texts, key)}, form string")
    return out.select(returned(texts, key, "k"), "form")


#: Texts of a class, or copies of a text, that one task pairs at a time; larger ones are split.
PART = 1_000


def _seen(texts: DataFrame, scope: str, key: str, text: str, frequency: Mapping[str, int] | None) -> DataFrame:
    """(s, k, form, raw): scope and key of each text with a letter or digit, and digests of its form and of itself; written once."""
    ship(texts.sparkSession)
    frequency = frequencies(texts, text) if frequency is None else dict(frequency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Folder(frequency)
        for b in batches:
            rows = [(s, k, digest(f), digest(t)) for s, k, t in zip(b["s"], b["k"], b["t"]) if has_content(f := fold(t))]
            yield pd.DataFrame(rows, columns=["s", "k", "form", "raw"])

    seen = texts.select(sent(texts, scope, "s"), sent(texts, key, "k"), F.col(text).alias("t")).where("t is not null")
    seen = spread(seen).mapInPandas(run, f"s {sent_type(texts, scope)}, k {sent_type(texts, key)}, form binary, raw binary").distinct()
    return durable(seen.select(returned(texts, scope, "s").alias("s"), returned(texts, key, "k").alias("k"), "form", "raw"))


def _variants(seen: DataFrame) -> DataFrame:
    """(s, form, raw, n, v, m, c): each different text of a class of several: how many keys have it, how many texts the
    class has, how many keys, and the least of them."""
    raws = seen.groupBy("s", "form", "raw").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    classes = raws.groupBy("s", "form").agg(F.count("*").alias("v"), F.sum("n").alias("m"), F.min("least").alias("c"))
    return raws.select("s", "form", "raw", "n").join(classes.where("v > 1"), ["s", "form"])


def text_classes(texts: DataFrame, scope: str, key: str, text: str, frequency: Mapping[str, int] | None = None) -> DataFrame:
    """(scope, key, class, texts, links): one row for each key whose text looks like another one: the least key of its class,
    how many different texts the class has, and how many keys of the class have another text than this one.

    Null texts, texts without a letter or digit, and texts that look like no other: no rows.  Repeated rows of a key: once
    (for each different text of it).  An empty table: no rows.  Nothing is paired, so a class may hold any share of the rows.
    """
    seen = _seen(texts, scope, key, text, frequency)
    rows = seen.join(_variants(seen), ["s", "form", "raw"])
    return rows.select(F.col("s").alias(scope), F.col("k").alias(key), F.col("c").alias("class"), F.col("v").alias("texts"), (F.col("m") - F.col("n")).alias("links"))


def lookalike_pairs(texts: DataFrame, scope: str, key: str, text: str, frequency: Mapping[str, int] | None = None, part: int = PART) -> DataFrame:
    """(scope, key_a, key_b), key_a < key_b: keys of one scope whose texts differ as stored and have one consistent form.

    Null texts, and texts without a letter or digit: no pairs.  Equal texts: no pair.  Repeated rows of a key: once.
    An empty table: no rows.  Extra columns are not read.  Only 128-bit digests of texts are shuffled, never texts;
    pairs are formed between *different texts* first and only then carried over to the keys that share them, so a text
    with many copies costs no more than the rows it must give.  The texts of a large class, and the copies of a frequent
    text, are split into parts of about ``part`` that other tasks pair; the rows without their pairs are
    :func:`text_classes`.
    """
    seen = _seen(texts, scope, key, text, frequency)
    raws = durable(_variants(seen))
    parts = lambda n: F.ceil(F.col(n) / part).cast("int")
    one_of = lambda c, n: F.pmod(F.xxhash64(c), parts(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    left = raws.select("s", "form", F.col("raw").alias("ra"), F.col("n").alias("na"), one_of("raw", "v").alias("p"))
    right = raws.select("s", "form", F.col("raw").alias("rb"), F.col("n").alias("nb"), all_of("v").alias("p"))
    pairs = left.join(right, ["s", "form", "p"]).where("ra < rb").drop("p")
    members = seen.join(raws.select("s", "form", "raw", "n"), ["s", "form", "raw"]).select("s", "form", "raw", "k", one_of("k", "n").alias("p"))
    for side in "ab":
        keyed = members.select("s", "form", F.col("raw").alias(f"r{side}"), F.col("k").alias(f"k{side}"), "p")
        pairs = pairs.withColumn("p", all_of(f"n{side}")).join(keyed, ["s", "form", f"r{side}", "p"]).drop("p")
    pairs = pairs.where("ka <> kb")
    return pairs.select(F.col("s").alias(scope), F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
