"""Structured model calls: batches of rows become requests, answers become rows again; a bad answer is an error column."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship, vectorised
from .checkpoint import KEY
from .segments import estimate, normalize_column

#: Guidance for each tone.
TONES = {
    "auto": "Infer and preserve the document's appropriate register.",
    "formal": "Use polished, formal, publication-ready prose.",
    "legal": "Use precise legal language; preserve ambiguity only when it exists in the source.",
    "business": "Use clear, concise, professional business language.",
    "academic": "Use disciplined academic language and stable technical terminology.",
    "literary": "Preserve imagery, rhythm, voice, and emotional effect without adding ideas.",
    "conversational": "Use natural contemporary speech appropriate to the target language.",
    "screenplay": "Write speakable dialogue; preserve character voice, rhythm, subtext, and scene directions.",
}
ONLY_JSON = "Answer with one JSON object and nothing else."
LEAST_INPUT = 64


class JsonBackend(Protocol):
    """A model that answers requests; one is made in each Python worker."""

    id: str

    def answer(self, messages: list[str]) -> str: ...


class KeepBackend:
    """The deterministic reviewer: answers with the drafts it was sent, white space off both ends of each segment."""

    id = "keep-1"

    def answer(self, messages: list[str]) -> str:
        units = json.loads(messages[0]).get("units", [])
        return "Here it is: " + json.dumps({"translations": {u["id"]: [s.strip() for s in u["draft"]] for u in units}, "polish": []}, ensure_ascii=False)


class GistBackend:
    """The deterministic analyst: the beginning of the sample is the summary, its first long words are terms."""

    id = "gist-1"

    def answer(self, messages: list[str]) -> str:
        sample = json.loads(messages[0]).get("sample", "")
        terms = [{"source": w, "target": w, "locked": False} for w in dict.fromkeys(sample.split()) if len(w) > 9][:3]
        return json.dumps({"domain": "general", "summary": sample[:80], "terms": terms}, ensure_ascii=False)


ANALYSIS = "domain string, audience string, summary string, style string, entities array<string>, terms array<struct<source:string,target:string,locked:boolean>>"


def analyse(samples: DataFrame, backend: Callable[[], JsonBackend], instruction: str = "", retries: int = 2) -> DataFrame:
    """(doc_id, domain, audience, summary, style, entities, terms, error) of ``samples`` (doc_id, sample): one request for each
    document.  Without terms in the answer: an empty list."""
    requests = samples.select("doc_id", F.to_json(F.struct(F.lit(instruction).alias("instruction"), "sample")).alias("request"))
    parsed = ask(requests, ["doc_id"], "request", backend, retries).withColumn("a", F.from_json("answer", ANALYSIS))
    own = [F.coalesce("a.terms", F.from_json(F.lit("[]"), "array<struct<source:string,target:string,locked:boolean>>")).alias("terms") if c == "terms" else F.col(f"a.{c}") for c in ("domain", "audience", "summary", "style", "entities", "terms")]
    return parsed.select("doc_id", *own, "error")


def tone_guidance(tone: Column) -> Column:
    """The guidance of a tone; an unknown tone stands for itself."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TONES.items() for x in kv)), tone), tone)


def input_budget(context: Column, fixed: Column, reserved: Column, safety: Column) -> Column:
    """Tokens left for document text, at most four fifths of the answer's; null where that is too little to work with."""
    room = F.least(context - fixed - reserved - safety, F.floor(reserved * F.lit(0.8)).cast("int"))
    return F.when(room >= LEAST_INPUT, room)


def longest_prefix(text: str, budget: int, count: Callable[[str], int] = estimate) -> str:
    """The longest prefix within a budget of tokens, for a count that grows with the text."""
    from bisect import bisect_right

    if budget < 1:
        return ""
    fits = bisect_right(range(len(text) + 1), budget, key=lambda n: count(text[:n]))
    return text[: max(0, fits - 1)]


def prefix_column(text: Column, budget: int) -> Column:
    """The longest prefix within a budget of estimated tokens; null stays null."""
    return F.substring(text, 1, len(longest_prefix(" " * (3 * max(0, budget) + 8), budget)))


def first_json_object(raw: str | None) -> dict | None:
    """The first JSON object in a noisy text, by trying every brace; None without any."""
    at = -1
    while raw is not None and (at := raw.find("{", at + 1)) >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(raw, at)
        except json.JSONDecodeError:
            continue
        if isinstance(value, dict):
            return value
    return None


def extract_json(raw: Column) -> Column:
    """The first JSON object of a text, compact, keys as they come; null without any."""

    @vectorised("string")
    def run(texts: pd.Series) -> pd.Series:
        found = (first_json_object(t) for t in texts)
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found], dtype=object)

    return run(raw)


def ask(requests: DataFrame, key: list[str], request: str, backend: Callable[[], JsonBackend], retries: int = 2) -> DataFrame:
    """(key..., answer, error): the JSON object a model answers each request with.  An answer without one is asked for again,
    ``retries`` times, with a reminder; then ``error`` is ``parse``, or ``capacity`` where the model refused the size."""
    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for b in batches:
            answers, errors = [], []
            for r in b["_request"]:
                messages, found, error = [r], None, "parse"
                for _ in range(retries + 1):
                    try:
                        found = first_json_object(model.answer(messages))
                    except OverflowError:
                        error = "capacity"
                        break
                    if found is not None:
                        break
                    messages = [*messages, ONLY_JSON]
                answers.append(None if found is None else json.dumps(found, ensure_ascii=False))
                errors.append(error if found is None else None)
            yield b[key].assign(answer=answers, error=errors)

    kinds = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in key)
    return requests.select(*key, F.col(request).alias("_request")).mapInPandas(run, f"{kinds}, answer string, error string")


def edit_in_batches(batches: DataFrame, backend: Callable[[], JsonBackend], instruction: str = "", retries: int = 2) -> DataFrame:
    """(doc_id, unit_id, segments, polish, error) of ``batches`` (doc_id, batch_no, ord, unit_id, source, draft, protected, flags).

    A request holds one batch, which the batching operator has bounded.  A unit that the answer lacks, or whose protected
    segments it changed, keeps its draft; so do all units of a request that failed."""
    unit = F.struct("ord", F.col("unit_id").alias("id"), "source", "draft", "protected", "flags")
    packed = batches.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    requests = packed.select("doc_id", "batch_no", F.to_json(F.struct(F.lit(instruction).alias("instruction"), "units"), {"ignoreNullFields": "false"}).alias("request"))
    answered = ask(requests, ["doc_id", "batch_no"], "request", backend, retries)
    parsed = answered.withColumn("a", F.from_json("answer", "translations map<string,array<string>>, polish array<string>"))
    rows = batches.join(parsed.select("doc_id", "batch_no", "a", "error"), ["doc_id", "batch_no"], "left")
    said = F.coalesce(F.element_at("a.translations", F.col("unit_id")), F.col("draft"))
    fitted = rows.withColumn("r", normalize_column(said, F.col("source"), F.col("protected")))
    hint = F.coalesce(F.array_contains("a.polish", F.col("unit_id")), F.lit(False))
    return fitted.select(*KEY, F.coalesce("r.segments", "draft").alias("segments"), hint.alias("polish"), F.coalesce("error", "r.error").alias("error"))
