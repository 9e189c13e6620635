"""Problem 3: the language of every text and of every segment in it, each with a confidence.

A sparse multinomial logistic regression over TF-IDF character n-grams, trained on a bounded sample of labelled
sentences with follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature on sentences
held out.  Labels may be wrong for some texts; the model averages over them.  Letters that look the same are folded
first, so spelling with another alphabet's letters tells nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import returned, sent, sent_type, ship, spread
from .fold import Folder

LANGUAGES = ("ar", "en", "fa")
#: Bound of the training sample: labelled sentences, taken in the order of a hash of their text.
SAMPLE_SENTENCES = 9_000
#: Characters of a sentence that may be in the sample, at least and at most.
SAMPLE_CHARS = (12, 2_000)
BUCKETS = 1 << 17
NGRAMS = (1, 2, 3, 4)
#: A second language counts where a whole sentence of it is at least so certain.
CERTAIN = 0.8
SENTENCE_WORDS, UNENDED_WORDS = 3, 5
REJECTED = 0.3
#: Least number of updates in training, so that a small sample is gone over more often.
STEPS = 1_800

#: Usual codes and English names of the languages, and values that name none.
NAMES = {
    "en": "en eng english anglais englisch",
    "fa": "fa fas per pes prs farsi persian dari parsi",
    "ar": "ar ara arb arz apc ary acm arabic",
}
PLACEHOLDERS = frozenset("und undetermined auto automatic autodetect detect unknown none null nil na nan n/a tbd todo any all mul mis zxx xx xxx zz other undefined default unspecified empty missing lang language ?".split())
_CODES = {code: lang for lang, codes in NAMES.items() for code in codes.split()}

_BREAK = regex.compile(r"(?<!\s)[^\S\r\n  ]*+[\r\n  ]\s*+|(?<=[.!?؟。！？۔][\"'”’»)\]]*)(?<!\s)\s++")
_ENDED = regex.compile(r"[.!?؟。！？۔][\"'”’»)\]]*\s*\Z")
_NOT_TEXT = regex.compile(r"(?:https?://|www\.)\S+|(?<!\S)\S+@\S+|\b(?=\S*[a-zA-Z])(?=\S*[0-9])[A-Za-z0-9]{6,}\b|\b[A-Za-z0-9]{25,}\b|\p{N}+")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}‌]+")


def named_language(label: str | None) -> str | None:
    """The language that a label names: a code of ours, '?' for any other language, None for a placeholder."""
    words = regex.findall(r"\p{L}+|\?", (label or "").lower())
    if not words:
        return None
    if words[0] in _CODES:
        return _CODES[words[0]]
    if words[0] in PLACEHOLDERS or "/".join(words) in PLACEHOLDERS:
        return None
    return "?"


def segments(text: str) -> list[tuple[int, int]]:
    """Places [from, to) of the segments: lines, cut after ends of sentences."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def letters_of(segment: str, fold: Folder) -> str:
    """Words of a segment as the model sees them."""
    return _NOT_LETTERS.sub(" ", _NOT_TEXT.sub(" ", fold(segment))).strip().lower()


def ngram_rows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct hashed n-grams of each text."""
    if not len(texts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    padded = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    keys, h = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(NGRAMS) + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = (h[:m] * np.uint64(0x100000001B3) + codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            if n in NGRAMS:
                same = row[:m] == row[n - 1 :]
                bucket = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)) % np.uint64(BUCKETS)
                keys.append(row[:m][same] * BUCKETS + bucket[same].astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, count.astype(np.float64)


@dataclass
class LanguageModel:
    weights: np.ndarray  # buckets x languages, mostly 0
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, bucket, count = ngram_rows(texts)
        value = (1 + np.log(count)) * self.idf[bucket] if len(row) else count
        norm = np.sqrt(np.bincount(row, value**2, len(texts)))
        return row, bucket, value / np.maximum(norm[row], 1e-12)

    def scores(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        w = self.weights[bucket]
        return np.stack([np.bincount(row, w[:, k] * value, n) for k in range(w.shape[1])], 1) + self.bias

    def probabilities(self, texts: Sequence[str]) -> np.ndarray:
        return softmax(self.scores(*self.features(texts), len(texts)) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


def train(texts: Sequence[str], labels: Sequence[str], rounds: int = 2, epochs: int = 2, batch: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.01) -> LanguageModel:
    """Labels are wrong now and then: after each round, sentences whose label the model rejects are left out of the next."""
    model = _train(texts, labels, epochs, batch, alpha, beta, l1, l2)
    for _ in range(rounds - 1):
        p = model.probabilities(texts)
        kept = [i for i, x in enumerate(labels) if p[i, LANGUAGES.index(x)] >= REJECTED]
        texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
        model = _train(texts, labels, epochs, batch, alpha, beta, l1, l2)
    return model


def _train(texts: Sequence[str], labels: Sequence[str], epochs: int, batch: int, alpha: float, beta: float, l1: float, l2: float) -> LanguageModel:
    """FTRL-proximal over batches in the given order; every fifth sentence is held out for the temperature."""
    held = np.arange(len(texts)) % 5 == 4
    own = [t for t, h in zip(texts, held) if not h]
    y = np.array([LANGUAGES.index(x) for x, h in zip(labels, held) if not h], int)
    row, bucket, _ = ngram_rows(own)
    df = np.bincount(bucket, minlength=BUCKETS)
    model = LanguageModel(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES)), np.log((1 + len(own)) / (1 + df)) + 1)
    if not own:
        return model
    row, bucket, value = model.features(own)
    starts = np.searchsorted(row, np.arange(len(own) + 1))
    z, n = np.zeros((BUCKETS, len(LANGUAGES))), np.zeros((BUCKETS, len(LANGUAGES)))
    zb, nb = np.zeros(len(LANGUAGES)), np.zeros(len(LANGUAGES))

    def solve(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(max(epochs, -(-STEPS * batch // len(own)))):
        for a in range(0, len(own), batch):
            b = min(len(own), a + batch)
            s = slice(starts[a], starts[b])
            used, at = np.unique(bucket[s], return_inverse=True)
            w, bias = solve(z[used], n[used], l1, l2), solve(zb, nb, 0, 0)
            r, v = row[s] - a, value[s]
            p = softmax(np.stack([np.bincount(r, w[at, k] * v, b - a) for k in range(len(LANGUAGES))], 1) + bias)
            e = p - np.eye(len(LANGUAGES))[y[a:b]]
            g = np.stack([np.bincount(at, e[r, k] * v, len(used)) for k in range(len(LANGUAGES))], 1)
            step = (np.sqrt(n[used] + g**2) - np.sqrt(n[used])) / alpha
            z[used] += g - step * w
            n[used] += g**2
            gb = e.sum(0)
            stepb = (np.sqrt(nb + gb**2) - np.sqrt(nb)) / alpha
            zb += gb - stepb * bias
            nb += gb**2
    model.weights, model.bias = solve(z, n, l1, l2).astype(np.float32), solve(zb, nb, 0, 0)
    if held.any():
        test = [t for t, h in zip(texts, held) if h]
        want = np.array([LANGUAGES.index(x) for x, h in zip(labels, held) if h])
        raw = model.scores(*model.features(test), len(test))
        loss = [(-np.log(np.maximum(softmax(raw / t)[np.arange(len(want)), want], 1e-12)).mean(), t) for t in np.geomspace(0.5, 5, 60)]
        model.temperature = float(min(loss)[1])
    return model


def fit(labelled: DataFrame, label: str, text: str, sample: int = SAMPLE_SENTENCES) -> LanguageModel:
    """Train on at most ``sample`` sentences of texts whose label names one of the languages."""
    ship(labelled.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[int, str, str]] = []  # the sentences of the partition with the smallest hashes
        for b in batches:
            for lab, t in zip(b["l"], b["t"]):
                lang = named_language(lab)
                if lang in LANGUAGES:
                    kept += [(xxhash.xxh3_64_intdigest(s) >> 1, s, lang) for x, y in segments(t) if SAMPLE_CHARS[0] <= y - x <= SAMPLE_CHARS[1] for s in (t[x:y],)]
                if len(kept) > 4 * sample:
                    kept = sorted(set(kept))[:sample]
        fold = Folder()
        rows = [(h, lang, letters) for h, s, lang in sorted(set(kept))[:sample] if len(letters := letters_of(s, fold)) >= SAMPLE_CHARS[0]]
        yield pd.DataFrame(rows, columns=["h", "lang", "s"])

    found = spread(labelled.select(F.col(label).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")).mapInPandas(run, "h long, lang string, s string")
    rows = found.orderBy("h", "s", "lang").limit(sample).collect()
    return train([r["s"] for r in rows], [r["lang"] for r in rows])


@dataclass
class Segment:
    start: int
    end: int
    lang: str
    confidence: float
    words: int
    whole: bool


class Detector:
    def __init__(self, model: LanguageModel) -> None:
        self.model, self.fold = model, Folder()

    def __call__(self, texts: Sequence[str]) -> list[list[Segment]]:
        """Segments of each text that have letters, with their languages."""
        places, seen = [], []
        for i, t in enumerate(texts):
            for a, b in segments(t):
                s = letters_of(t[a:b], self.fold)
                if s:
                    places.append((i, a, b, t[a:b]))
                    seen.append(s)
        out: list[list[Segment]] = [[] for _ in texts]
        for c in range(0, len(seen), 4096):
            p = self.model.probabilities(seen[c : c + 4096])
            for (i, a, b, raw), s, q in zip(places[c : c + 4096], seen[c : c + 4096], p):
                k, words = int(q.argmax()), s.count(" ") + 1
                whole = words >= SENTENCE_WORDS and (words >= UNENDED_WORDS or _ENDED.search(raw) is not None)
                out[i].append(Segment(a, b, LANGUAGES[k], float(q[k]), words, whole))
        return out

    def judge(self, found: list[Segment]) -> tuple[str | None, float, list[str]]:
        """(main language, its confidence, languages that have a whole sentence)."""
        words = dict.fromkeys(LANGUAGES, 0.0)
        sure = dict.fromkeys(LANGUAGES, 0.0)
        for s in found:
            words[s.lang] += s.words
            sure[s.lang] += s.words * s.confidence
        main = max(LANGUAGES, key=lambda x: (words[x], x))
        if not words[main]:
            return None, 0.0, []
        langs = sorted({s.lang for s in found if s.whole and s.confidence >= CERTAIN})
        return main, sure[main] / sum(words.values()), langs


def detect_languages(df: DataFrame, key: str, text: str, label: str, model: LanguageModel) -> DataFrame:
    """(key, lang, confidence, named, langs): the main language of each text, the language its label names ('?': another,
    null: none), and the languages of which it has a whole sentence.

    Null texts: no rows.  Texts without letters: lang null, confidence 0.  Repeated rows of a key: once.  An empty table:
    no rows.  Very long texts: read whole.  Extra columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for b in batches:
            judged = [d.judge(s) for s in d(list(b["t"]))]
            yield pd.DataFrame({"k": b["k"], "lang": [j[0] for j in judged], "confidence": [j[1] for j in judged], "named": [named_language(x) for x in b["l"]], "langs": [j[2] for j in judged]})

    rows = df.select(sent(df, key, "k"), F.col(text).alias("t"), F.col(label).alias("l")).where("t is not null")
    found = spread(rows).mapInPandas(run, f"k {sent_type(df, key)}, lang string, confidence double, named string, langs array<string>").dropDuplicates(["k"])
    return found.select(returned(df, key, "k"), "lang", "confidence", "named", "langs")


def segment_languages(df: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """(key, start_pos, end_pos, lang, confidence, words): every segment that has letters."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Detector(shared.value)
        for b in batches:
            rows = [(k, s.start, s.end, s.lang, s.confidence, s.words) for k, found in zip(b["k"], d(list(b["t"]))) for s in found]
            yield pd.DataFrame(rows, columns=["k", "start_pos", "end_pos", "lang", "confidence", "words"])

    rows = df.select(sent(df, key, "k"), F.col(text).alias("t")).where("t is not null")
    found = spread(rows).mapInPandas(run, f"k {sent_type(df, key)}, start_pos long, end_pos long, lang string, confidence double, words int")
    return found.dropDuplicates(["k", "start_pos"]).select(returned(df, key, "k"), "start_pos", "end_pos", "lang", "confidence", "words")


def label_defects(detected: DataFrame, key: str) -> DataFrame:
    """(key, defect, lang): missing or wrong labels with the main language, and a row for each language of a mixed text."""
    lang = F.col("lang")
    one = lambda defect, when: F.when(when, F.array(F.struct(F.lit(defect).alias("defect"), lang.alias("lang"))))
    none = F.array().cast("array<struct<defect:string,lang:string>>")
    label = F.coalesce(one("missing", F.col("named").isNull()), one("wrong", F.col("named") != lang), none)
    mixed = F.when(F.exists("langs", lambda x: x != lang), F.transform("langs", lambda x: F.struct(F.lit("mixed").alias("defect"), x.alias("lang")))).otherwise(none)
    found = detected.where(lang.isNotNull()).select(key, F.explode(F.concat(label, mixed)).alias("d"))
    return found.select(key, "d.defect", "d.lang")
