"""SQL for DuckDB that gives the same rows as the queries; written for the tables as they are, with RE2's expressions."""

from __future__ import annotations

from .queries import NOW, REVIEW_BUDGET, REVIEW_UNITS

WS = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_URL = r"[^\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<>()]"
D, IN = "[0-9٠-٩۰-۹]", r"[,٬.٫/⁄:：\-]"
UNITS = "(SELECT DISTINCT doc_id, ord, unit_id, segments, protected, meta, array_to_string(segments, '') AS text FROM units)"
PAIRS = "(SELECT DISTINCT pair_id, source, target, target_language AS language FROM unit_pairs)"
EVENTS = "(SELECT DISTINCT * FROM job_events)"
JOBS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM (SELECT DISTINCT * FROM jobs)) WHERE rn = 1)"
KEYS = "doc_id, unit_id"
ALNUM = r"regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '\A{WS}+|{WS}+\z', '', 'g')"


def nonblank(e: str) -> str:
    return f"({strip(e)} <> '')"


def numbers(e: str) -> str:
    masked = rf"regexp_replace(regexp_replace(regexp_replace({e}, '[\p{{L}}\p{{N}}_]*[\p{{L}}_][\p{{L}}\p{{N}}_]*', 'a', 'g'), 'a[+\-−]', 'a ', 'g'), '({D})[+−]', '\1 ', 'g')"
    return rf"list_transform(regexp_extract_all({masked}, '[+\-−]?{D}+(?:{IN}+{D}+)*'), lambda x: translate(x, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹−٬٫⁄：', '01234567890123456789-,./:'))"


def urls(e: str) -> str:
    return f"regexp_extract_all({e}, 'https?://{NOT_URL}+')"


def emails(e: str) -> str:
    return rf"regexp_extract_all({e}, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}')"


def latin(e: str) -> str:
    return rf"list_filter(regexp_extract_all({e}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{{4,}}'))"


def casefold(e: str) -> str:
    return f"replace(lower({e}), 'ß', 'ss')"


def tokens(e: str) -> str:
    return f"greatest(1, CAST(floor(length({e}) / 2.6::DOUBLE) AS INT) + 8)"


def flags(s: str, t: str, language: str) -> str:
    """A list of flags; ``s`` and ``t`` must be cheap expressions without nulls."""
    ns, nt = f"length({strip(s)})", f"length({strip(t)})"
    ratio = f"({nt} / greatest(1, {ns}))"
    return f"""CASE WHEN {strip(t)} = '' THEN ['empty'] ELSE list_filter([
        CASE WHEN list_sort({numbers(s)}) <> list_sort({numbers(t)}) THEN 'numbers' END,
        CASE WHEN {urls(s)} <> {urls(t)} THEN 'urls' END,
        CASE WHEN {emails(s)} <> {emails(t)} THEN 'emails' END,
        CASE WHEN regexp_matches({t}, 'ZXQPH[A-Z]+QXZ') THEN 'placeholder' END,
        CASE WHEN {ns} > 80 AND ({ratio} < 0.28::DOUBLE OR {ratio} > 3.8::DOUBLE) THEN 'length' END,
        CASE WHEN {language} IN ('fa', 'ar') AND length({s}) > 100 AND len({latin(t)}) >= greatest(8, CAST(floor(len({latin(s)}) * 0.65::DOUBLE) AS INT)) THEN 'source_leakage' END
    ], lambda x: x IS NOT NULL) END"""


TERMS = f"""terms AS (
    SELECT min(prio) AS position, arg_max({{'s': s, 't': t}}, {{'prio': prio, 's': s, 't': t}}) AS v
    FROM (SELECT prio, {strip('source')} AS s, {strip('target')} AS t FROM glossary WHERE locked) WHERE s <> '' AND t <> '' GROUP BY {casefold('s')})"""


def named(rows: str, keys: str) -> str:
    """Glossary flags of ``rows`` (keys, s, t)."""
    return f"""SELECT DISTINCT {keys}, position, concat('terminology:', v.s, '→', v.t) AS flag FROM {rows}, terms
        WHERE length(v.s) >= 2 AND contains({casefold('s')}, {casefold('v.s')}) AND NOT contains({casefold('t')}, {casefold('v.t')})"""


def issues(rows: str, keys: str) -> str:
    """(keys, flags) of ``rows`` (keys, s, t, language); only rows with flags."""
    return f"""SELECT {keys}, f AS flags FROM (
        SELECT {keys}, list_concat(own, coalesce(n, [])) AS f FROM (SELECT {keys}, {flags('s', 't', 'language')} AS own FROM {rows})
        LEFT JOIN (SELECT {keys}, list(flag ORDER BY position, flag) AS n FROM ({named(rows, keys)}) GROUP BY ALL) USING ({keys})) WHERE len(f) > 0"""


_P = f"p AS (SELECT pair_id, coalesce(source, '') AS s, coalesce(target, '') AS t, language FROM {PAIRS})"
_ISSUES = f"WITH {TERMS}, {_P}, i AS ({issues('p', 'pair_id')})"
_BLOCKING = "list_filter(flags, lambda x: split_part(x, ':', 1) IN ('empty', 'numbers', 'urls', 'emails', 'placeholder'))"


def stage(name: str) -> str:
    return f"(SELECT DISTINCT doc_id, unit_id, segments FROM translations WHERE stage = '{name}')"


SQL = {
    "scan_text_units": r"""SELECT doc_id, CAST(2 * (i - 1) AS INT) AS ord, concat('text-', 2 * (i - 1)) AS unit_id, p[i] AS text
        FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n(?:[ \t]*\r?\n)+') AS p FROM documents WHERE text IS NOT NULL)) WHERE p[i] <> ''""",
    "rebuild_text": "SELECT doc_id, text FROM documents WHERE text <> ''",
    "render_unit_html": rf"""SELECT doc_id, unit_id, concat('<div style="font-family:''', replace(CASE WHEN regexp_replace(coalesce(meta.font, ''), '^[A-Z]{{6}}\+', '') = '' THEN 'Noto Sans'
        ELSE regexp_replace(meta.font, '^[A-Z]{{6}}\+', '') END, '''', ''), ''',sans-serif;font-size:', greatest(7.0::DOUBLE, coalesce(meta.size, 11.0::DOUBLE)), 'pt;color:#', lower(lpad(to_hex(coalesce(meta.color, 0) & 16777215), 6, '0')),
        ';direction:ltr;text-align:left;line-height:1.3;margin:0 0 .7em 0">', replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>'), '</div>') AS html
        FROM {UNITS} WHERE text IS NOT NULL""",
    "output_names": r"""SELECT id, concat(CASE WHEN s = '' THEN 'translation' ELSE s END, '.', target_language, suffix) AS name FROM (
        SELECT id, target_language, suffix, regexp_replace(regexp_replace(left(original_name, length(original_name) - length(suffix)), '[^\p{L}\p{N}_. -]+', '_', 'g'), '\A[ .]+|[ .]+\z', '', 'g') AS s
        FROM (SELECT DISTINCT id, original_name, target_language, regexp_extract(original_name, '[^.](\.[^.]+)\z', 1) AS suffix FROM jobs WHERE original_name IS NOT NULL))""",
    "alnum_forms": rf"SELECT doc_id, unit_id, {casefold(ALNUM)} AS form FROM {UNITS}",
    "units_by_page": f"SELECT doc_id, meta.page AS page, count(*) AS n_units, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {UNITS} WHERE meta.page IS NOT NULL GROUP BY ALL",
    "filter_nonblank": f"SELECT {KEYS} FROM {UNITS} WHERE {nonblank('text')}",
    "canonical_numbers": f"SELECT doc_id, array_to_string({numbers('text')}, '|') AS numbers FROM documents WHERE text IS NOT NULL",
    "extract_urls": f"SELECT doc_id, unnest({urls('text')}) AS url FROM documents WHERE text IS NOT NULL",
    "extract_emails": f"SELECT doc_id, unnest({emails('text')}) AS email FROM documents WHERE text IS NOT NULL",
    "latin_words": f"SELECT pair_id, CAST(len({latin('target')}) AS INT) AS words FROM {PAIRS} WHERE target IS NOT NULL",
    "length_ratio": f"SELECT pair_id, length({strip('target')}) / greatest(1, length({strip('source')})) AS ratio FROM {PAIRS} WHERE target IS NOT NULL",
    "token_estimate": f"SELECT {KEYS}, {tokens('text')} AS tokens FROM {UNITS}",
    "direction": "SELECT DISTINCT id, CASE WHEN target_language IN ('fa', 'ar') THEN 'rtl' WHEN target_language = 'en' THEN 'ltr' END AS direction FROM jobs",
    "alpha_id": f"""WITH RECURSIVE a AS (SELECT DISTINCT ord, ord + 1 AS left_over, '' AS name FROM {UNITS}
        UNION ALL SELECT ord, (left_over - 1) // 26, concat(chr(65 + (left_over - 1) % 26), name) FROM a WHERE left_over > 0) SELECT ord, name FROM a WHERE left_over = 0""",
    "quality_flags": f"WITH {_P} SELECT pair_id, array_to_string({flags('s', 't', 'language')}, ',') AS flags FROM p",
    "locked_terms": f"WITH {TERMS} SELECT position, v.s AS source, v.t AS target FROM terms",
    "glossary_flags": f"WITH {TERMS}, {_P} {named('p', 'pair_id')}",
    "collect_issues": f"{_ISSUES} SELECT pair_id, array_to_string(flags, ',') AS flags FROM i",
    "blocking_flags": f"{_ISSUES} SELECT pair_id, array_to_string({_BLOCKING}, ',') AS flags FROM i WHERE len({_BLOCKING}) > 0",
    "warning_totals": f"{_ISSUES} SELECT split_part(flag, ':', 1) AS code, count(*) AS warnings FROM (SELECT unnest(flags) AS flag FROM i) GROUP BY 1",
    "fixed_batches": f"SELECT {KEYS}, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 8 AS INT) AS batch_no FROM {UNITS} WHERE {nonblank('text')}",
    "adaptive_batches": f"""WITH RECURSIVE u AS (SELECT doc_id, ord, 2 * {tokens('text')} AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM {UNITS} WHERE {nonblank('text')}),
        b AS (SELECT doc_id, ord, r, cost AS held, 1 AS n, 0 AS batch_no FROM u WHERE r = 1 UNION ALL
        SELECT u.doc_id, u.ord, u.r, CASE WHEN b.held + u.cost > {REVIEW_BUDGET} OR b.n >= {REVIEW_UNITS} THEN u.cost ELSE b.held + u.cost END,
        CASE WHEN b.held + u.cost > {REVIEW_BUDGET} OR b.n >= {REVIEW_UNITS} THEN 1 ELSE b.n + 1 END, b.batch_no + CASE WHEN b.held + u.cost > {REVIEW_BUDGET} OR b.n >= {REVIEW_UNITS} THEN 1 ELSE 0 END
        FROM b JOIN u ON u.doc_id = b.doc_id AND u.r = b.r + 1) SELECT doc_id, ord, batch_no FROM b""",
    "representative_sample": f"""SELECT doc_id, left(string_agg(text, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY ord), 14000) AS sample FROM (
        SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM {UNITS} WHERE {nonblank('text')})
        WHERE pos < 4 OR pos >= n - 4 OR (n > 8 AND pos IN (n // 2, n // 2 - 1)) GROUP BY doc_id""",
    "context_window": f"""SELECT doc_id, unit_id, tokens FROM (SELECT doc_id, unit_id, CAST(greatest(1, floor((sum(30 + length(to_json(text)) - 2 + length(to_json(target)) - 2) OVER (PARTITION BY doc_id ORDER BY ord DESC)) / 2.6::DOUBLE) + 8) AS INT) AS tokens
        FROM (SELECT u.doc_id, u.unit_id, u.ord, u.text, array_to_string(f.segments, '') AS target FROM {UNITS} u JOIN {stage('finals')} f USING (doc_id, unit_id))) WHERE tokens <= 3000""",
    "semantic_split": rf"""WITH RECURSIVE p AS (SELECT doc_id, unit_id, -1 AS piece_no, '' AS piece, text AS rest FROM {UNITS} WHERE text <> ''
        UNION ALL SELECT doc_id, unit_id, piece_no + 1, left(rest, n), substr(rest, n + 1) FROM (SELECT *, CASE WHEN length(rest) <= 200 THEN length(rest) ELSE coalesce(nullif(greatest(
            length(regexp_extract(left(rest, 201), '\A([\s\S]*{WS})[^\t-\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', 1)),
            length(regexp_extract(left(rest, 201), '\A([\s\S]*\n{WS}*\n)[^\n]', 1))), 0), 200) END AS n FROM p WHERE rest <> ''))
        SELECT doc_id, unit_id, piece_no, piece FROM p WHERE piece_no >= 0""",
    "distribute_text": f"""WITH RECURSIVE t AS (SELECT u.doc_id, u.unit_id, array_to_string(d.segments, '') AS text, list_transform(u.segments, lambda x: greatest(1, CASE WHEN {strip('x')} = '' THEN length(x) ELSE length({strip('x')}) END)) AS w
            FROM {UNITS} u JOIN {stage('drafts')} d USING (doc_id, unit_id) WHERE len(u.segments) > 0),
        s AS (SELECT *, list_filter(range(0, length(text)), lambda i: text[i + 1] = ' ') AS spaces FROM t),
        c AS (SELECT doc_id, unit_id, text, w, spaces, 0 AS k, 0::BIGINT AS a, 0::BIGINT AS z FROM s
            UNION ALL SELECT doc_id, unit_id, text, w, spaces, k + 1, z, CASE WHEN k + 1 = len(w) THEN length(text) WHEN goal <= 0 OR goal >= length(text) THEN goal
                ELSE coalesce(list_min(list_transform(list_filter([list_max(list_filter(spaces, lambda p: p >= z AND p <= goal)), list_min(list_filter(spaces, lambda p: p >= goal))], lambda p: p > z AND p < length(text)), lambda p: abs(p - goal) * 1000000 + p)) % 1000000, goal) END
            FROM (SELECT *, least(length(text), greatest(z, CAST(round_even(length(text)::DOUBLE * list_sum(w[1:k + 1]) / list_sum(w), 0) AS BIGINT))) AS goal FROM c WHERE k < len(w)))
        SELECT doc_id, unit_id, CAST(k - 1 AS INT) AS k, text[a + 1:z] AS segment FROM c WHERE k > 0""",
    "document_analysis": rf"""SELECT doc_id, 'general' AS domain, left(sample, 80) AS summary, CAST(least(3, len(list_distinct(list_filter(regexp_extract_all(sample, '[^\t-\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: length(x) > 9)))) AS INT) AS n_terms, CAST(NULL AS VARCHAR) AS error
        FROM (@SAMPLE@)""",
    "normalize_segments": f"""SELECT doc_id, unit_id, CASE WHEN len(u.segments) = len(d.segments) THEN array_to_string(d.segments, '') WHEN len(u.protected) > 0 OR {strip("array_to_string(d.segments, '')")} = '' THEN NULL ELSE {strip("array_to_string(d.segments, '')")} END AS text,
        CASE WHEN len(u.segments) = len(d.segments) THEN NULL WHEN len(u.protected) > 0 THEN 'integrity' WHEN {strip("array_to_string(d.segments, '')")} = '' THEN 'empty' END AS error FROM {UNITS} u JOIN {stage('drafts')} d USING (doc_id, unit_id)""",
    "reassemble_units": f"SELECT doc_id, unit_id, CAST(to_json(segments) AS VARCHAR) AS segments FROM {UNITS} WHERE len(segments) > 0",
    "protect_roundtrip": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "memory_keys": f"SELECT {KEYS}, sha256(concat('7:upper-1', '0:', '2:en', '2:fa', length(text), ':', text)) AS cache_key FROM {UNITS} WHERE {nonblank('text')}",
    "memory_dedup": f"SELECT sha256(concat('7:upper-1', '0:', '2:en', '2:fa', length(text), ':', text)) AS cache_key, count(*) AS units FROM {UNITS} WHERE {nonblank('text')} GROUP BY 1",
    "unit_digests": f"SELECT {KEYS}, sha256(CAST(to_json(segments) AS VARCHAR)) AS digest FROM {UNITS}",
    "checkpoint_reuse": f"SELECT {KEYS} FROM {stage('drafts')} d SEMI JOIN (SELECT {KEYS} FROM {UNITS} WHERE ord % 5 <> 0) USING (doc_id, unit_id)",
    "pending_units": f"SELECT {KEYS} FROM {UNITS} u ANTI JOIN {stage('polished')} p USING (doc_id, unit_id)",
    "overlay_merge": f"""SELECT {KEYS}, array_to_string(coalesce(p.segments, f.segments, d.segments, u.segments), '') AS text FROM {UNITS} u LEFT JOIN {stage('drafts')} d USING (doc_id, unit_id)
        LEFT JOIN {stage('finals')} f USING (doc_id, unit_id) LEFT JOIN {stage('polished')} p USING (doc_id, unit_id)""",
    "memory_lookup": f"""WITH k AS (SELECT {KEYS}, ord, text FROM {UNITS} WHERE {nonblank('text')}) SELECT {KEYS} FROM k WHERE text IN (SELECT text FROM k WHERE ord % 2 = 0)""",
    "review_route": f"""WITH {TERMS}, p AS (SELECT u.doc_id, u.unit_id, u.text AS s, coalesce(array_to_string(d.segments, ''), '') AS t, 'fa' AS language FROM {UNITS} u LEFT JOIN {stage('drafts')} d USING (doc_id, unit_id) WHERE {nonblank('u.text')}),
        i AS ({issues('p', KEYS)}) SELECT {KEYS}, CASE WHEN i.flags IS NULL THEN 'copy' ELSE 'review' END AS route FROM p LEFT JOIN i USING ({KEYS})""",
    "polish_select": f"""WITH {TERMS}, p AS (SELECT u.doc_id, u.unit_id, u.text AS s, coalesce(array_to_string(d.segments, ''), '') AS t, 'fa' AS language FROM {UNITS} u LEFT JOIN {stage('finals')} d USING (doc_id, unit_id) WHERE {nonblank('u.text')}),
        i AS ({issues('p', KEYS)}) SELECT {KEYS} FROM i UNION SELECT {KEYS} FROM {UNITS} WHERE {nonblank('text')} AND ord % 7 = 0""",
    "coverage_check": f"""WITH b AS (SELECT doc_id, unit_id, coalesce(language IN ('fa', 'ar'), false) AS rtl,
        {casefold(ALNUM.replace('text', "array_to_string(d.segments, '')"))} AS want, {casefold(ALNUM.replace('text', "array_to_string(f.segments, '')"))} AS have
        FROM {stage('drafts')} d JOIN {stage('finals')} f USING (doc_id, unit_id) LEFT JOIN (SELECT doc_id, min(target_language) AS language FROM {JOBS} WHERE doc_id IS NOT NULL GROUP BY 1) USING (doc_id))
        SELECT doc_id, unit_id, contains(have, left(want, 32)) AND contains(have, right(want, 32)) AS covered FROM b WHERE NOT rtl AND length(want) >= 4
        UNION ALL SELECT doc_id, NULL, sum(length(have)) >= sum(length(want)) * 0.55::DOUBLE FROM b WHERE rtl GROUP BY doc_id HAVING sum(length(want)) >= 4""",
    "tone_lookup": """SELECT doc_id, CASE tone
        WHEN 'auto' THEN 'Infer and preserve the document''s appropriate register.'
        WHEN 'formal' THEN 'Use polished, formal, publication-ready prose.'
        WHEN 'legal' THEN 'Use precise legal language; preserve ambiguity only when it exists in the source.'
        WHEN 'business' THEN 'Use clear, concise, professional business language.'
        WHEN 'academic' THEN 'Use disciplined academic language and stable technical terminology.'
        WHEN 'literary' THEN 'Preserve imagery, rhythm, voice, and emotional effect without adding ideas.'
        WHEN 'conversational' THEN 'Use natural contemporary speech appropriate to the target language.'
        WHEN 'screenplay' THEN 'Write speakable dialogue; preserve character voice, rhythm, subtext, and scene directions.'
        ELSE tone END AS guidance FROM documents WHERE tone IS NOT NULL""",
    "protect_text": rf"""WITH {TERMS}, m AS (SELECT string_agg(regexp_replace(v.s, '([^\p{{L}}\p{{N}} ])', '\\\1', 'g'), '|' ORDER BY length(v.s) DESC, position) AS words, map_from_entries(list(({casefold('v.s')}, v.t))) AS t FROM terms),
        p AS (SELECT {KEYS}, text, t, regexp_extract_all(text, concat('(?is)https?://{NOT_URL}+|[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}|', words, '|.')) AS ps FROM {UNITS}, m WHERE text IS NOT NULL)
        SELECT {KEYS}, list_bool_or(list_transform(ps, lambda x: length(x) > 1)) IS TRUE OR len({numbers('text')}) > 0 AS held, array_to_string(list_transform(ps, lambda x: coalesce(t[{casefold('x')}], x)), '') AS text FROM p""",
    "truncate_budget": f"SELECT {KEYS}, left(text, (SELECT CAST(max(n) AS BIGINT) FROM range(0, 1000) r(n) WHERE floor(n / 2.6::DOUBLE) + 8 <= 60)) AS text FROM {UNITS} WHERE text IS NOT NULL",
    "locked_terms_merged": f"""WITH glossary AS (SELECT * FROM main.glossary UNION ALL SELECT prio + 100000, target, upper(source), locked FROM main.glossary WHERE prio % 4 = 0 UNION ALL SELECT prio + 200000, upper(source), target, locked FROM main.glossary WHERE prio % 3 = 0),
        {TERMS} SELECT position, v.s AS source, v.t AS target FROM terms""",
    "repair_loop": f"""WITH {TERMS}, p AS (SELECT u.doc_id, u.unit_id, u.text AS s, coalesce(f.segments, u.segments) AS seg, array_to_string(coalesce(f.segments, u.segments), '') AS t, 'fa' AS language FROM {UNITS} u LEFT JOIN {stage('finals')} f USING (doc_id, unit_id) WHERE {nonblank('u.text')}),
        i AS ({issues('p', KEYS)}), blocked AS (SELECT {KEYS} FROM i WHERE len({_BLOCKING}) > 0),
        q AS (SELECT {KEYS}, s, CASE WHEN b.unit_id IS NULL THEN t ELSE array_to_string(list_transform(seg, lambda x: {strip('x')}), '') END AS t, language FROM p LEFT JOIN blocked b USING ({KEYS})),
        j AS ({issues('q', KEYS)}) SELECT {KEYS}, array_to_string(flags, ',') AS flags FROM j""",
    "resumed_drafts": f"SELECT {KEYS}, array_to_string(CASE WHEN {nonblank('u.text')} THEN d.segments ELSE u.segments END, '') AS text FROM {stage('drafts')} d JOIN {UNITS} u USING (doc_id, unit_id) WHERE ord % 3 = 0",
    "review_batches": f"""SELECT {KEYS}, array_to_string(list_transform(d.segments, lambda x: {strip('x')}), '|') AS text, false AS polish, CAST(NULL AS VARCHAR) AS error FROM {UNITS} u JOIN {stage('drafts')} d USING (doc_id, unit_id) WHERE {nonblank('u.text')}""",
    "input_budget": f"SELECT id, CASE WHEN b >= 64 THEN b END AS budget FROM (SELECT id, CAST(least(8192 - coalesce(length(source_text), 0) - 1400 - 200, 1120) AS INT) AS b FROM {JOBS})",
    "extract_json": f"""SELECT id, concat('{{"status":', to_json(status), ',"stage":', to_json(stage), '}}') AS json FROM {EVENTS}""",
    "event_change_log": f"""SELECT id, job_id, status, stage, progress, message FROM (SELECT *, row_number() OVER w AS r, lag(status) OVER w AS s, lag(stage) OVER w AS g, lag(progress) OVER w AS p, lag(message) OVER w AS m
        FROM {EVENTS} WINDOW w AS (PARTITION BY job_id ORDER BY id)) WHERE r = 1 OR s IS DISTINCT FROM status OR g IS DISTINCT FROM stage OR p IS DISTINCT FROM progress OR m IS DISTINCT FROM message""",
    "latest_event": f"SELECT job_id, max(id) AS id, arg_max(status, id) AS status, arg_max(stage, id) AS stage, arg_max(progress, id) AS progress FROM {EVENTS} GROUP BY job_id",
    "job_history": f"SELECT job_id, id, CAST(place AS INT) AS place, status, message FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id DESC) AS place FROM {EVENTS}) WHERE place <= 30",
    "recent_jobs": f"SELECT id, status, created_at FROM {JOBS} ORDER BY created_at DESC, id LIMIT 30",
    "active_count": f"SELECT count(*) AS active FROM {JOBS} WHERE status IN ('queued', 'running', 'pausing')",
    "job_public": f"""SELECT id, status, stage, progress, message, error, input_type, original_name, source_language, target_language, tone, output_name, created_at, updated_at,
        heartbeat_at, paused_from_stage, profile_name, model_key, model_state, backend FROM {JOBS}""",
    "job_health": f"""SELECT id, round_even(h, 1) AS heartbeat_age_seconds, round_even(p, 1) AS progress_age_seconds, s AS health_state, s IN ('worker_unresponsive', 'long_running') AS is_stalled FROM (
        SELECT id, h, p, CASE WHEN status IN ('running', 'pausing') THEN CASE WHEN h > 10 THEN 'worker_unresponsive' WHEN p > 120 THEN 'long_running' ELSE 'working' END WHEN coalesce(status, '') = '' THEN 'unknown' ELSE status END AS s
        FROM (SELECT id, status, greatest(0::DOUBLE, {NOW}::DOUBLE - CASE WHEN coalesce(heartbeat_at, 0) = 0 THEN coalesce(updated_at, 0) ELSE heartbeat_at END) AS h, greatest(0::DOUBLE, {NOW}::DOUBLE - coalesce(updated_at, 0)) AS p FROM {JOBS}))""",
    "job_update": f"""SELECT j.id, coalesce(e.stage, j.stage) AS stage, coalesce(CAST(least(100, greatest(0, e.progress * 3 - 100)) AS INT), j.progress) AS progress, coalesce(e.message, j.message) AS message, coalesce(e.created_at, j.updated_at) AS updated_at, j.backend
        FROM {JOBS} j LEFT JOIN (SELECT * FROM {EVENTS} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id DESC) = 1) e ON e.job_id = j.id""",
    "job_delete": f"SELECT id, job_id FROM {EVENTS} e WHERE NOT EXISTS (SELECT 1 FROM {JOBS} j WHERE j.id = e.job_id AND j.status IN ('completed', 'failed', 'cancelled', 'paused'))",
    "retention_sweep": f"SELECT id, status, updated_at FROM {JOBS} WHERE updated_at < {NOW}::DOUBLE - 60 * 86400 AND status IN ('completed', 'failed', 'cancelled')",
    "progress_curve": f"""SELECT doc_id, batch_no, CAST(12 + (38 * (batch_no + 1)) // count(*) OVER (PARTITION BY doc_id) AS INT) AS progress
        FROM (SELECT DISTINCT doc_id, CAST((r - 1) // 8 AS INT) AS batch_no FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM {UNITS} WHERE {nonblank('text')}))""",
    "job_event_counts": f"SELECT j.id AS job_id, j.status, e.n_events FROM {JOBS} j JOIN (SELECT job_id, count(*) AS n_events FROM {EVENTS} GROUP BY 1) e ON e.job_id = j.id",
    "schema_evolve": f"SELECT id, status, updated_at, 0 AS pause_requested, 'not_loaded' AS model_state FROM {JOBS}",
}

SQL["document_analysis"] = SQL["document_analysis"].replace("@SAMPLE@", SQL["representative_sample"])
