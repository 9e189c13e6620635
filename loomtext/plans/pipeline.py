"""The dataflow from units to finished segments: draft, checks, review, polish, bounded repair, overlay.

Every stage is a table keyed by (doc_id, unit_id), written once (:func:`~loomtext.shared.durable`), so a lost executor never
costs a finished stage and each round of repair starts from a short lineage.  All units are checked once, after review;
later stages check only what they changed.  Stages of an earlier run are taken over where they are given.

A stage is edited by an *editor*: a column function (:class:`Native`), or a model that answers structured requests, one for
each greedy batch of units (:class:`Structured`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pytext as P
from ..operators import checkpoint as C
from ..operators import generation, ordered, qa
from ..operators.memory import UpperBackend, cache_key, through_memory
from ..operators.segments import distribute_column
from ..shared import durable

MODES = ("fast", "balanced", "strict")
#: Locked terms that are sent along with the drafts; of more, each text gets those that occur in it.
SENT_TERMS = 500
KEY = C.KEY


@dataclass(frozen=True)
class Native:
    """An editor that is a function of a segment's column."""

    edit: Callable[[Column], Column]

    def __call__(self, work: DataFrame, stage: DataFrame, flags: DataFrame | None) -> DataFrame:
        del work, flags
        return stage.select(*KEY, F.transform("segments", self.edit).alias("segments"), F.lit(False).alias("polish"))


@dataclass(frozen=True)
class Structured:
    """A model as an editor.  Units go in greedy batches of their document, in order: at most ``share`` of the model's
    context at two tokens for each of the source, at least ``least``, and at most ``units`` units.  The request holds the flags."""

    backend: Callable[[], generation.JsonBackend]
    instruction: str = ""
    context: int = 8192
    share: float = 0.34
    least: int = 800
    units: int = 6
    retries: int = 2

    def budget(self) -> int:
        return max(self.least, int(self.context * self.share))

    def __call__(self, work: DataFrame, stage: DataFrame, flags: DataFrame | None) -> DataFrame:
        """(doc_id, unit_id, segments, polish) of the units of ``stage``; ``work`` needs their order, ``ord``."""
        rows = work.select(*KEY, "ord", F.col("segments").alias("source"), "protected").join(stage.select(*KEY, F.col("segments").alias("draft")), KEY)
        rows = durable(rows.join(flags, KEY, "left") if flags is not None else rows.withColumn("flags", F.lit(None).cast("array<string>")))
        cost = rows.select("doc_id", "ord", (P.token_estimate(F.array_join("source", "")) * 2).alias("cost"))
        numbered = rows.join(ordered.greedy_batches(cost, "doc_id", "ord", "cost", self.budget(), self.units), ["doc_id", "ord"])
        return generation.edit_in_batches(numbered, self.backend, self.instruction, self.retries).select(*KEY, "segments", "polish")


Editor = Native | Structured

#: The deterministic stand-ins: the reviewer takes white space off both ends, the polisher writes Persian letters for the
#: Arabic ones of the same sound, the repairer keeps what it gets.
REVIEWER = Native(P.strip)
POLISHER = Native(lambda text: F.translate(text, "كي", "کی"))
REPAIRER = Native(lambda text: text)


def few_terms(terms: DataFrame) -> list[tuple[str, str]] | DataFrame:
    """The pairs (source, target) where they are few enough to be sent along, else the table."""
    few = terms.select("position", "source", "target").limit(SENT_TERMS + 1).collect()
    return terms if len(few) > SENT_TERMS else [(r["source"], r["target"]) for r in sorted(few)]


def terms_digest(terms: DataFrame) -> str:
    """A digest of a table of terms, whatever their order: the sums of four parts of each term's digest."""
    own = F.sha2(F.concat(F.length("source").cast("string"), F.lit(":"), "source", "target"), 256)
    parts = [F.sum(F.conv(F.substring(own, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return "terms " + terms.agg(F.concat_ws(" ", F.count("*").cast("string"), *parts).alias("d")).first()["d"]


def draft(units: DataFrame, source_language: str, target_language: str, backend: Callable[[], object] = UpperBackend, terms: Sequence[tuple[str, str]] | DataFrame = (), memory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(stage, memory): drafts of the units.  A unit with protected segments is translated segment by segment, any other as
    a whole and spread over its segments; equal texts are translated once.

    ``terms``: locked terms, as pairs or as the table of :func:`~loomtext.operators.qa.locked_terms`; each comes out as its
    target.  A table of few terms (counted) is sent along; of a larger one, each text gets the terms that occur in it."""
    if isinstance(terms, DataFrame):
        terms = few_terms(terms)
    tag = terms_digest(terms) if isinstance(terms, DataFrame) else "|".join(f"{s}\x1f{t}" for s, t in terms)
    apart = (F.size("protected") > 0) & (F.size("segments") > 1)
    whole = units.where(~F.coalesce(apart, F.lit(False))).select(*KEY, F.lit(-1).alias("k"), F.array_join("segments", "").alias("text"))
    single = units.where(apart).select(*KEY, F.posexplode("segments").alias("k", "text"))
    items = whole.unionByName(single).withColumn("language", F.lit(target_language))
    items = items.withColumn("cache_key", cache_key(F.col("text"), F.lit(source_language), F.lit(target_language), backend.id, tag))
    done, memory = through_memory(items, memory, backend, terms)
    done = durable(done.select(*KEY, "k", "translation"))
    by_segment = done.where("k >= 0").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "translation"))), lambda x: x["translation"]).alias("segments"))
    at_once = units.select(*KEY, F.col("segments").alias("source")).join(done.where("k < 0"), KEY)
    spread = F.when(F.size("source") == 1, F.array("translation")).otherwise(distribute_column(F.col("translation"), F.col("source")))
    return by_segment.unionByName(at_once.select(*KEY, spread.alias("segments"))), memory


def issues(units: DataFrame, stage: DataFrame, language: str, terms: DataFrame) -> DataFrame:
    """(doc_id, unit_id, flags); a unit that the stage lacks counts as empty."""
    pairs = units.select(*KEY, F.array_join("segments", "").alias("source")).join(stage.select(*KEY, F.array_join("segments", "").alias("target")), KEY, "left").withColumn("language", F.lit(language))
    return qa.collect_issues(pairs, KEY, "source", "target", "language", terms)


def recheck(work: DataFrame, flags: DataFrame, before: DataFrame, after: DataFrame, language: str, terms: DataFrame) -> DataFrame:
    """``flags`` of the stage ``before``, brought up to the stage ``after``: only units whose segments differ are checked."""
    old = before.select(*KEY, F.col("segments").alias("_old"))
    changed = durable(after.join(old, KEY, "left").where(~F.col("segments").eqNullSafe(F.col("_old"))).select(*KEY, "segments"))
    again = issues(work.join(changed.select(*KEY), KEY, "left_semi"), changed, language, terms)
    return durable(flags.join(changed.select(*KEY), KEY, "left_anti").unionByName(again))


def repair_loop(work: DataFrame, combined: DataFrame, left: DataFrame, language: str, terms: DataFrame, rounds: int, repairer: Editor = REPAIRER) -> tuple[DataFrame, DataFrame]:
    """(stage, flags) after at most ``rounds`` rounds in which units with a blocking flag are edited; ends early when none has."""
    for _ in range(rounds):
        blocked = durable(qa.blocking_flags(left, KEY))
        if blocked.isEmpty():
            break
        mended = repairer(work, combined.join(blocked.select(*KEY), KEY, "left_semi"), blocked)
        after = durable(C.overlay(work, combined, mended))
        left, combined = recheck(work, left, combined, after, language, terms), after
    return combined, left


def run(units: DataFrame, source_language: str, target_language: str, glossary: DataFrame, mode: str = "balanced", repairs: int = 1, backend: Callable[[], object] = UpperBackend, reviewer: Editor = REVIEWER, polisher: Editor | None = POLISHER, repairer: Editor = REPAIRER, resume: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(finished, issues): segments of every unit, blank ones unchanged, and the flags that are left.

    ``units``: (doc_id, unit_id, segments, protected), one row for each key, and ``ord`` where an editor is structured.  The
    reviewer sees flagged units in the mode ``fast`` and all others; the polisher works for Persian only, on units that are
    flagged or that the reviewer hinted at, or on all in the mode ``strict``.  ``resume``: finished rows of the stages
    ``drafts``, ``finals`` and ``polished`` that still hold (:func:`~loomtext.operators.checkpoint.reusable`); they are kept."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if source_language == target_language or not {source_language, target_language} <= {"fa", "ar", "en"}:
        raise ValueError("two different languages of fa, ar and en are needed")
    done = {name: durable(t.select(*KEY, "segments")) for name, t in (resume or {}).items()}

    def kept(name: str, fresh: Callable[[DataFrame], DataFrame], wanted: DataFrame) -> DataFrame:
        """The rows of a stage: those of an earlier run, and fresh ones of the wanted units that it lacks."""
        if name not in done:
            return fresh(wanted)
        had = done[name].join(work.select(*KEY), KEY, "left_semi")
        return had.unionByName(fresh(wanted.join(had.select(*KEY), KEY, "left_anti")), allowMissingColumns=True)

    work = units.where(~P.is_blank(F.array_join("segments", "")))
    terms = durable(qa.locked_terms(glossary))
    check = lambda stage: durable(issues(work, stage, target_language, terms))
    drafts = durable(kept("drafts", lambda w: draft(w, source_language, target_language, backend, terms)[0], work))
    seen, flagged = drafts, None
    if mode == "fast" or isinstance(reviewer, Structured):
        flagged = check(drafts)
        if mode == "fast":
            seen = drafts.join(flagged.select(*KEY), KEY, "left_semi")
    reviewed = durable(kept("finals", lambda stage: reviewer(work, stage, flagged), seen))
    finals = combined = durable(C.overlay(work, drafts, reviewed)) if mode == "fast" else reviewed.select(*KEY, "segments")
    left = check(finals) if flagged is None else recheck(work, flagged, drafts, finals, target_language, terms)
    if target_language == "fa" and polisher is not None:
        hinted = reviewed.where("polish").select(*KEY)
        chosen = work.select(*KEY) if mode == "strict" else left.select(*KEY).union(hinted).distinct()
        polished = kept("polished", lambda stage: polisher(work, stage, left), finals.join(chosen, KEY, "left_semi"))
        combined = durable(C.overlay(work, finals, polished))
        left = recheck(work, left, finals, combined, target_language, terms)
    combined, left = repair_loop(work, combined, left, target_language, terms, repairs, repairer)
    return C.overlay(units, combined), left
