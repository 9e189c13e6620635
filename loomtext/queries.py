"""Queries of the engine's own operators over the tables of the service, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pytext as P
from .operators import checkpoint as C
from .operators import generation, ordered, qa, segments, tables
from .operators.context import suffix_window
from .operators.memory import UpperBackend, cache_key, protect_column, restore_column
from .plans import pipeline
from .shared import durable, spread, table
from .sources import text as text_source

LANGUAGES = ("en", "fa")  # of the pipeline's queries
REVIEW_BUDGET, REVIEW_UNITS = 2785, 6
NOW = 1_761_700_000.0  # of the queries on jobs, so that they can be repeated
ENDED = ("completed", "failed", "cancelled")

# ---- what the queries share


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, one row for each key, with their text."""
    u = table(spark, sf_dir, "units").select("doc_id", "ord", "unit_id", "segments", "protected", "meta")
    return u.dropDuplicates(["doc_id", "unit_id"]).withColumn("text", F.array_join("segments", ""))


def stage(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    t = table(spark, sf_dir, "translations").where(F.col("stage") == name).select("doc_id", "unit_id", "segments")
    return t.dropDuplicates(["doc_id", "unit_id"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "unit_pairs").select("pair_id", "source", "target", F.col("target_language").alias("language")).dropDuplicates(["pair_id"])


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.locked_terms(table(spark, sf_dir, "glossary"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "job_events").dropDuplicates(["id"])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, the latest row of each."""
    j = table(spark, sf_dir, "jobs")
    latest = j.groupBy("id").agg(F.max_by(F.struct(*[c for c in j.columns if c != "id"]), "updated_at").alias("r"))
    return latest.select("id", "r.*")


# ---- sources and sinks


def scan_text_units(spark, sf_dir):
    return text_source.scan_units(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ord", "unit_id", F.col("segments")[0].alias("text"))


def rebuild_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_source.rebuild(text_source.scan_parts(docs), text_source.scan_units(docs))


def render_unit_html(spark, sf_dir):
    u = units(spark, sf_dir).where("text is not null")
    return u.select("doc_id", "unit_id", P.unit_html(F.col("text"), F.col("meta.size"), F.col("meta.color"), F.col("meta.font"), F.lit("en")).alias("html"))


def output_names(spark, sf_dir):
    j = table(spark, sf_dir, "jobs").where("original_name is not null").select("id", "original_name", "target_language").distinct()
    return j.select("id", P.output_name(F.col("original_name"), F.col("target_language")).alias("name"))


def alnum_forms(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "unit_id", P.alnum_form(F.col("text")).alias("form"))


def units_by_page(spark, sf_dir):
    u = units(spark, sf_dir).where("meta.page is not null")
    return u.groupBy("doc_id", F.col("meta.page").alias("page")).agg(F.count("*").alias("n_units"), F.sum(F.length("text")).alias("n_chars"))


# ---- text functions


def filter_nonblank(spark, sf_dir):
    return units(spark, sf_dir).where(~P.is_blank(F.col("text"))).select("doc_id", "unit_id")


def canonical_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(P.canonical_numbers(F.col("text")), "|").alias("numbers"))


def extract_urls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(P.urls(F.col("text"))).alias("url"))


def extract_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(P.emails(F.col("text"))).alias("email"))


def latin_words(spark, sf_dir):
    return pairs(spark, sf_dir).where("target is not null").select("pair_id", F.size(P.latin_words(F.col("target"))).alias("words"))


def length_ratio(spark, sf_dir):
    s, t = F.length(P.strip(F.col("source"))), F.length(P.strip(F.col("target")))
    return pairs(spark, sf_dir).where("target is not null").select("pair_id", (t / F.greatest(F.lit(1), s)).alias("ratio"))


def token_estimate(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "unit_id", P.token_estimate(F.col("text")).alias("tokens"))


def direction(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("id", P.direction(F.col("target_language")).alias("direction")).distinct()


def alpha_id(spark, sf_dir):
    return units(spark, sf_dir).select("ord").distinct().select("ord", P.alpha_id(F.col("ord")).alias("name"))


# ---- quality


def quality_flags(spark, sf_dir):
    return spread(pairs(spark, sf_dir)).select("pair_id", F.array_join(qa.quality_flags(F.col("source"), F.col("target"), F.col("language")), ",").alias("flags"))


def locked_terms(spark, sf_dir):
    return terms(spark, sf_dir)


def glossary_flags(spark, sf_dir):
    return qa.glossary_flags(pairs(spark, sf_dir), ["pair_id"], "source", "target", terms(spark, sf_dir))


def _issues(spark, sf_dir):
    return qa.collect_issues(pairs(spark, sf_dir), ["pair_id"], "source", "target", "language", terms(spark, sf_dir))


def collect_issues(spark, sf_dir):
    return _issues(spark, sf_dir).select("pair_id", F.array_join("flags", ",").alias("flags"))


def blocking_flags(spark, sf_dir):
    return qa.blocking_flags(_issues(spark, sf_dir), ["pair_id"]).select("pair_id", F.array_join("flags", ",").alias("flags"))


def warning_totals(spark, sf_dir):
    flags = _issues(spark, sf_dir).select(F.explode("flags").alias("flag"))
    return flags.groupBy(F.substring_index("flag", ":", 1).alias("code")).agg(F.count("*").alias("warnings"))


# ---- order-dependent


def _nonblank(spark, sf_dir):
    return units(spark, sf_dir).where(~P.is_blank(F.col("text")))


def fixed_batches(spark, sf_dir, size: int = 8):
    u = ordered.with_position(_nonblank(spark, sf_dir).select("doc_id", "ord", "unit_id"), "doc_id", "ord")
    return u.select("doc_id", "unit_id", F.floor(F.col("pos") / size).cast("int").alias("batch_no"))


def adaptive_batches(spark, sf_dir):
    u = _nonblank(spark, sf_dir).select("doc_id", "ord", (P.token_estimate(F.col("text")) * 2).alias("cost"))
    return ordered.greedy_batches(u, "doc_id", "ord", "cost", REVIEW_BUDGET, REVIEW_UNITS)


def representative_sample(spark, sf_dir, limit: int = 14000):
    u = _nonblank(spark, sf_dir).select("doc_id", "ord", "text")
    placed = ordered.with_position(u.select("doc_id", "ord"), "doc_id", "ord", count="n")
    pos, n = F.col("pos"), F.col("n")
    middle = F.floor(n / 2)
    picked = placed.where((pos < 4) | (pos >= n - 4) | ((n > 8) & ((pos == middle) | (pos == middle - 1))))
    rows = u.join(picked.select("doc_id", "ord"), ["doc_id", "ord"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])  # ten rows of a document at most
    return rows.groupBy("doc_id").agg(F.substring(F.array_join(texts, "\n\n---\n\n"), 1, max(2000, limit)).alias("sample"))


def context_window(spark, sf_dir, budget: int = 3000):
    """The last finished units of each document that fit the context together, and their tokens up to the newest."""
    done = stage(spark, sf_dir, "finals").select("doc_id", "unit_id", F.array_join("segments", "").alias("target"))
    u = units(spark, sf_dir).select("doc_id", "ord", "unit_id", "text").join(done, ["doc_id", "unit_id"])
    return suffix_window(u, "doc_id", "ord", ["unit_id"], "text", "target", budget).select("doc_id", "unit_id", "tokens")


# ---- segments


def semantic_split(spark, sf_dir, max_chars: int = 200):
    u = units(spark, sf_dir).where("text <> ''")
    return u.select("doc_id", "unit_id", F.posexplode(segments.split_column(F.col("text"), max_chars)).alias("piece_no", "piece"))


def budget_pieces(spark, sf_dir, budget: int = 100):
    u = units(spark, sf_dir).where("text <> ''")
    return u.select("doc_id", "unit_id", F.posexplode(segments.budget_column(F.col("text"), budget)).alias("piece_no", "piece"))


def distribute_text(spark, sf_dir):
    u = units(spark, sf_dir).select("doc_id", "unit_id", F.col("segments").alias("own"))
    t = stage(spark, sf_dir, "drafts").select("doc_id", "unit_id", F.array_join("segments", "").alias("text"))
    return u.join(t, C.KEY).select("doc_id", "unit_id", F.posexplode(segments.distribute_column(F.col("text"), F.col("own"))).alias("k", "segment"))


def normalize_segments(spark, sf_dir):
    u = units(spark, sf_dir).select("doc_id", "unit_id", F.col("segments").alias("own"), "protected")
    t = stage(spark, sf_dir, "drafts").select("doc_id", "unit_id", "segments")
    r = u.join(t, C.KEY).select("doc_id", "unit_id", segments.normalize_column(F.col("segments"), F.col("own"), F.col("protected")).alias("r"))
    return r.select("doc_id", "unit_id", F.array_join("r.segments", "").alias("text"), "r.error")


def prepare_units(spark, sf_dir, budget: int = 100):
    p = segments.prepare_units(units(spark, sf_dir), budget)
    return p.select("doc_id", "unit_id", "original_unit_id", "part_index", F.array_join("segments", "").alias("text"))


def reassemble_units(spark, sf_dir, budget: int = 100):
    """Units split under a budget and put together again."""
    back = segments.reassemble_units(segments.prepare_units(units(spark, sf_dir).where("size(segments) > 0"), budget))
    return back.select("doc_id", "unit_id", F.to_json("segments").alias("segments"))


# ---- memory, checkpoints, stages


def protect_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", protect_column(F.col("text")).alias("p"))
    return d.select("doc_id", restore_column(F.col("p.protected"), F.col("p.held")).alias("text"))


def memory_keys(spark, sf_dir):
    u = _nonblank(spark, sf_dir)
    return u.select("doc_id", "unit_id", cache_key(F.col("text"), F.lit("en"), F.lit("fa"), UpperBackend.id).alias("cache_key"))


def memory_dedup(spark, sf_dir):
    """How many units share each text that is translated once."""
    return memory_keys(spark, sf_dir).groupBy("cache_key").agg(F.count("*").alias("units"))


def unit_digests(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "unit_id", C.digest(F.col("segments")).alias("digest"))


def checkpoint_reuse(spark, sf_dir):
    """Drafts that survive when every fifth unit of a document has changed since."""
    now = units(spark, sf_dir).select("doc_id", "unit_id", C.digest(F.col("segments")).alias("digest"), F.lit("r1").alias("route"), "ord")
    then = now.withColumn("digest", F.when(F.col("ord") % 5 == 0, "changed").otherwise(F.col("digest")))
    return C.reusable(stage(spark, sf_dir, "drafts"), then, now.drop("ord")).select("doc_id", "unit_id")


def pending_units(spark, sf_dir):
    return C.pending(units(spark, sf_dir), stage(spark, sf_dir, "polished")).select("doc_id", "unit_id")


def overlay_merge(spark, sf_dir):
    u = units(spark, sf_dir)
    out = C.overlay(u, *(stage(spark, sf_dir, s) for s in ("drafts", "finals", "polished")))
    return out.select("doc_id", "unit_id", F.array_join("segments", "").alias("text"))


def draft_translate(spark, sf_dir):
    out, _ = pipeline.draft(durable(_nonblank(spark, sf_dir)), *LANGUAGES, terms=durable(terms(spark, sf_dir)))
    return out.select("doc_id", "unit_id", F.array_join("segments", "").alias("text"))


def _pipeline(mode: str):
    def query(spark, sf_dir):
        out, _ = pipeline.run(durable(units(spark, sf_dir)), *LANGUAGES, table(spark, sf_dir, "glossary"), mode)
        return out.select("doc_id", "unit_id", F.array_join("segments", "").alias("text"))

    query.__doc__ = f"The whole pipeline in the mode {mode}."
    return query


def memory_lookup(spark, sf_dir):
    """Units whose text is in a memory made of the units with an even place."""
    keys = memory_keys(spark, sf_dir).join(units(spark, sf_dir).select("doc_id", "unit_id", "ord"), C.KEY)
    known = keys.where("ord % 2 = 0").select("cache_key").distinct()
    return keys.join(known, "cache_key", "left_semi").select("doc_id", "unit_id")


def _stage_issues(spark, sf_dir, name):
    return pipeline.issues(_nonblank(spark, sf_dir), stage(spark, sf_dir, name), LANGUAGES[1], terms(spark, sf_dir))


def review_route(spark, sf_dir):
    """Which units the reviewer sees in the mode fast: the flagged ones."""
    u = _nonblank(spark, sf_dir).select("doc_id", "unit_id")
    flagged = _stage_issues(spark, sf_dir, "drafts").select("doc_id", "unit_id", F.lit("review").alias("route"))
    return u.join(flagged, C.KEY, "left").select("doc_id", "unit_id", F.coalesce("route", F.lit("copy")).alias("route"))


def polish_select(spark, sf_dir):
    """Units for the polisher: those with flags after review, and those hinted at (here: every seventh)."""
    hinted = _nonblank(spark, sf_dir).where("ord % 7 = 0").select("doc_id", "unit_id")
    return _stage_issues(spark, sf_dir, "finals").select("doc_id", "unit_id").union(hinted).distinct()


def coverage_check(spark, sf_dir):
    """Whether the final text covers the draft.  Of documents written from right to left: whether it has 55 % of the letters
    and digits, document by document; of others: whether each unit's first and last 32 are in it."""
    form = lambda: P.alnum_form(F.array_join("segments", ""))
    a = stage(spark, sf_dir, "drafts").select("doc_id", "unit_id", form().alias("want"))
    b = stage(spark, sf_dir, "finals").select("doc_id", "unit_id", form().alias("have"))
    language = jobs(spark, sf_dir).where("doc_id is not null").groupBy("doc_id").agg(F.min("target_language").alias("language"))
    both = a.join(b, C.KEY).join(language, "doc_id", "left").withColumn("rtl", F.coalesce(P.direction(F.col("language")) == "rtl", F.lit(False)))
    ends = F.col("have").contains(F.substring("want", 1, 32)) & F.col("have").contains(F.expr("right(want, 32)"))
    units_ = both.where(~F.col("rtl") & (F.length("want") >= 4)).select("doc_id", "unit_id", ends.alias("covered"))
    sums = both.where("rtl").groupBy("doc_id").agg(F.sum(F.length("want")).alias("w"), F.sum(F.length("have")).alias("h"))
    return units_.unionByName(sums.where("w >= 4").select("doc_id", F.lit(None).cast("string").alias("unit_id"), (F.col("h") >= F.col("w") * F.lit(0.55)).alias("covered")))


def protect_text(spark, sf_dir):
    """Units whose locked terms came out as their targets: protected and restored, with nothing done between."""
    t = [(r["source"], r["target"]) for r in sorted(terms(spark, sf_dir).collect())]  # a fixed table
    u = units(spark, sf_dir).where("text is not null").select("doc_id", "unit_id", protect_column(F.col("text"), t).alias("p"))
    u = u.select("doc_id", "unit_id", F.explode(F.array("p")).alias("p"))  # a barrier: one call of Python
    return u.select("doc_id", "unit_id", F.size(F.map_keys("p.held")).alias("held"), restore_column(F.col("p.protected"), F.col("p.held")).alias("text")).withColumn("held", F.col("held") > 0)


def truncate_budget(spark, sf_dir, budget: int = 60):
    return units(spark, sf_dir).where("text is not null").select("doc_id", "unit_id", generation.prefix_column(F.col("text"), budget).alias("text"))


def document_analysis(spark, sf_dir):
    """What the analyst says of each document's sample."""
    a = generation.analyse(representative_sample(spark, sf_dir), generation.GistBackend)
    return a.select("doc_id", "domain", "summary", F.size("terms").alias("n_terms"), "error")


def locked_terms_merged(spark, sf_dir):
    """Configured terms, then those of an analysis (here: swapped sides of every fourth term), by one rule."""
    g = table(spark, sf_dir, "glossary")
    more = g.where("prio % 4 = 0").select((F.col("prio") + 100_000).alias("prio"), F.col("target").alias("source"), F.upper("source").alias("target"), "locked")
    again = g.where("prio % 3 = 0").select((F.col("prio") + 200_000).alias("prio"), F.upper("source").alias("source"), "target", "locked")
    return qa.locked_terms(g.select("prio", "source", "target", "locked").unionByName(more).unionByName(again))


def repair_loop(spark, sf_dir):
    """Flags that are left when the finals with blocking flags are edited by a structured model for one round."""
    work, t = durable(_nonblank(spark, sf_dir)), durable(terms(spark, sf_dir))
    finals = durable(C.overlay(work, stage(spark, sf_dir, "finals")))
    left = durable(pipeline.issues(work, finals, LANGUAGES[1], t))
    _, left = pipeline.repair_loop(work, finals, left, LANGUAGES[1], t, 1, pipeline.Structured(generation.KeepBackend))
    return left.select("doc_id", "unit_id", F.array_join("flags", ",").alias("flags"))


def resumed_drafts(spark, sf_dir):
    """The pipeline in the mode fast, taken up where every third unit has its draft."""
    u = durable(units(spark, sf_dir))
    had = stage(spark, sf_dir, "drafts").join(u.where("ord % 3 = 0").select("doc_id", "unit_id"), C.KEY, "left_semi")
    out, _ = pipeline.run(u, *LANGUAGES, table(spark, sf_dir, "glossary"), "fast", resume={"drafts": had}, reviewer=pipeline.REPAIRER, polisher=None)
    return out.join(had.select("doc_id", "unit_id"), C.KEY, "left_semi").select("doc_id", "unit_id", F.array_join("segments", "").alias("text"))


def tone_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("tone is not null").select("doc_id", generation.tone_guidance(F.col("tone")).alias("guidance"))


def input_budget(spark, sf_dir):
    j = jobs(spark, sf_dir).select("id", F.coalesce(F.length("source_text"), F.lit(0)).alias("fixed"))
    return j.select("id", generation.input_budget(F.lit(8192), F.col("fixed"), F.lit(1400), F.lit(200)).alias("budget"))


def extract_json(spark, sf_dir):
    """Objects behind noise: each event as JSON after a text with a stray brace."""
    e = events(spark, sf_dir).select("id", F.concat(F.lit("so {it} is: "), F.to_json(F.struct("status", "stage")), F.lit(" }")).alias("raw"))
    return e.select("id", generation.extract_json(F.col("raw")).alias("json"))


def review_batches(spark, sf_dir):
    """Drafts reviewed batch by batch through a structured model call."""
    u = durable(_nonblank(spark, sf_dir).select("doc_id", "ord", "unit_id", "segments", "protected", "text"))
    no = ordered.greedy_batches(u.select("doc_id", "ord", (P.token_estimate(F.col("text")) * 2).alias("cost")), "doc_id", "ord", "cost", REVIEW_BUDGET, REVIEW_UNITS)
    d = stage(spark, sf_dir, "drafts").select("doc_id", "unit_id", F.col("segments").alias("draft"))
    rows = u.join(no, ["doc_id", "ord"]).join(d, C.KEY).withColumn("flags", F.array().cast("array<string>")).withColumnRenamed("segments", "source")
    out = generation.edit_in_batches(rows, generation.KeepBackend)
    return out.select("doc_id", "unit_id", F.array_join("segments", "|").alias("text"), "polish", "error")


# ---- jobs and their events


def event_change_log(spark, sf_dir):
    return ordered.changes(events(spark, sf_dir), "job_id", "id", ["status", "stage", "progress", "message"]).select("id", "job_id", "status", "stage", "progress", "message")


def latest_event(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("job_id").agg(F.max_by(F.struct("id", "status", "stage", "progress"), "id").alias("e"))
    return e.select("job_id", "e.id", "e.status", "e.stage", "e.progress")


def job_history(spark, sf_dir, last: int = 30):
    """The last events of each job."""
    from pyspark.sql.window import Window

    newest = Window.partitionBy("job_id").orderBy(F.desc("id"))
    e = events(spark, sf_dir).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= max(1, min(100, last)))
    return e.select("job_id", "id", "place", "status", "message")


def recent_jobs(spark, sf_dir, k: int = 30):
    return jobs(spark, sf_dir).select("id", "status", "created_at").orderBy(F.desc("created_at"), "id").limit(max(1, min(100, k)))


def active_count(spark, sf_dir):
    return jobs(spark, sf_dir).where(F.col("status").isin("queued", "running", "pausing")).agg(F.count("*").alias("active"))


PUBLIC = "id status stage progress message error input_type original_name source_language target_language tone output_name created_at updated_at heartbeat_at paused_from_stage profile_name model_key model_state backend".split()


def job_public(spark, sf_dir):
    return jobs(spark, sf_dir).select(*PUBLIC)


def job_health(spark, sf_dir, now: float = NOW):
    """Ages of the last signs of life, and what they say."""
    return tables.health(jobs(spark, sf_dir), now).select("id", "heartbeat_age_seconds", "progress_age_seconds", "health_state", "is_stalled")


def job_update(spark, sf_dir):
    """Jobs brought to their latest event, its progress between bounds; other columns of events change nothing."""
    newest = events(spark, sf_dir).groupBy("job_id").agg(F.max_by(F.struct("stage", (F.col("progress") * 3 - 100).alias("progress"), "message", F.col("created_at").alias("updated_at"), F.lit("x").alias("backend")), "id").alias("e")).select("job_id", "e.*")
    now = tables.update(jobs(spark, sf_dir), newest.withColumnRenamed("job_id", "id"), "id", ["stage", "progress", "message", "updated_at"], {"progress": (0, 100)})
    return now.select("id", "stage", "progress", "message", "updated_at", "backend")


def job_delete(spark, sf_dir):
    """Events that are left when the jobs that ended are deleted with all that hangs on them."""
    _, left = tables.delete_cascade(jobs(spark, sf_dir), "id", F.col("status").isin(*ENDED, "paused"), (events(spark, sf_dir), "job_id"))
    return left.select("id", "job_id")


def retention_sweep(spark, sf_dir, now: float = NOW, days: int = 60):
    """Jobs that ended and are older than is kept."""
    j = jobs(spark, sf_dir)
    return j.where(tables.expired(j, now, days, ENDED)).select("id", "status", "updated_at")


def progress_curve(spark, sf_dir):
    """Progress behind each fixed batch of drafts of a document: from 12 to 50."""
    b = fixed_batches(spark, sf_dir).select("doc_id", "batch_no").distinct()
    n = b.groupBy("doc_id").agg(F.count("*").alias("n"))
    return b.join(n, "doc_id").select("doc_id", "batch_no", (F.lit(12) + F.call_function("div", F.lit(38) * (F.col("batch_no") + 1), F.col("n"))).cast("int").alias("progress"))


def job_event_counts(spark, sf_dir):
    """Jobs with how many events they have; orphans of either side stay out."""
    e = events(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n_events"))
    return jobs(spark, sf_dir).select(F.col("id").alias("job_id"), "status").join(e, "job_id")


def schema_evolve(spark, sf_dir):
    """Rows of an older job table, without two later columns, brought into the present one with defaults."""
    old = jobs(spark, sf_dir).select("id", "status", "updated_at")
    now = jobs(spark, sf_dir).where("false").select("id", "status", "updated_at", "pause_requested", "model_state")
    return now.unionByName(old, allowMissingColumns=True).fillna({"pause_requested": 0, "model_state": "not_loaded"})


QUERIES = {
    f.__name__: f
    for f in (
        scan_text_units, rebuild_text, render_unit_html, output_names, alnum_forms, units_by_page, filter_nonblank, canonical_numbers, extract_urls, extract_emails, latin_words, length_ratio,
        token_estimate, direction, alpha_id, quality_flags, locked_terms, glossary_flags, collect_issues, blocking_flags, warning_totals, fixed_batches, adaptive_batches, representative_sample,
        context_window, semantic_split, budget_pieces, distribute_text, normalize_segments, prepare_units, reassemble_units, protect_roundtrip, memory_keys, memory_dedup, unit_digests,
        checkpoint_reuse, pending_units, overlay_merge, memory_lookup, review_route, polish_select, coverage_check, tone_lookup, input_budget, extract_json, review_batches, draft_translate, event_change_log, latest_event, job_history, recent_jobs, active_count, job_public, job_health, job_update, job_delete, retention_sweep, progress_curve, job_event_counts, schema_evolve, protect_text, truncate_budget, document_analysis, locked_terms_merged, repair_loop, resumed_drafts,
    )
}
QUERIES |= {f"pipeline_{m}": _pipeline(m) for m in pipeline.MODES}
