"""The registered queries once more, as plain SQL for another engine.

Everything is written from the given tables up, without use of the library,
apart from the raw model answers, which are an input that both sides share.
"""

from __future__ import annotations

import re

from filewright.functions import prompts
from filewright.functions.text import WHITESPACE, WHITESPACE_RUN
from filewright.workload import corpus

SPACE = "'" + WHITESPACE + "'"
SETTINGS = corpus.SETTINGS
# Fixed values once more: rules, words and folder names as the given settings have them.
NOT_WORD = r"($|[^\p{L}\p{N}_])"
RULES = (
    (r"invoice|receipt|bill|nota fiscal|boleto", "Finance", "Invoices", 0.92, "Matched finance rule"),
    (rf"resume|curriculum|cv{NOT_WORD}", "Career", "Resumes", 0.95, "Matched resume rule"),
    (r"slide|presentation|deck", "Knowledge", "Presentations", 0.88, "Matched presentation rule"),
    (rf"\.py{NOT_WORD}|def |class |import ", "Engineering", "Code", 0.84, "Matched code rule"),
)
PORTUGUESE = rf"(^|[^\p{{L}}\p{{N}}_])(nao|para|uma|documento|arquivo){NOT_WORD}"
STOP = "'this','that','with','from','have','your','para','como','mais','will','they'"
TECHNICAL = "'_Unprocessed','_Ignored','_NeedsReview','_Unsupported','_Duplicates','_FailedExtraction'"
RESERVED = r"""'[<>:"/\\|?*\x00-\x1f]+'"""


def strip(e: str) -> str:
    return f"trim({e}, {SPACE})"


def collapse(e: str) -> str:
    return f"regexp_replace({strip(e)}, '{WHITESPACE_RUN}', ' ', 'g')"


def quality(e: str) -> str:
    n = f"length({strip(e)})"
    return (
        f"CASE WHEN coalesce({e}, '') = '' THEN 0.0 WHEN {n} >= 4000 THEN 0.95 WHEN {n} >= 1000 THEN 0.8"
        f" WHEN {n} >= 250 THEN 0.6 WHEN {n} >= 50 THEN 0.35 ELSE 0.15 END::DOUBLE"
    )


def summary(e: str) -> str:
    s = strip(e)
    return f"nullif(CASE WHEN length({s}) > 240 THEN left({s}, 240) || '...' ELSE {s} END, '')"


def language(e: str) -> str:
    return f"CASE WHEN regexp_matches(lower({e}), '{PORTUGUESE}') THEN 'pt-BR' ELSE 'en' END"


def rule(e: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({e}, '{pattern}') THEN {i}" for i, (pattern, *_) in enumerate(RULES))
    return f"CASE {cases} END"


def verdict(index: str, field: int) -> str:
    cases = []
    for i, row in enumerate(RULES):
        value = row[field]
        cases.append(f"WHEN {i} THEN " + (f"'{value}'" if isinstance(value, str) else f"{value}::DOUBLE"))
    return f"CASE {index} {' '.join(cases)} END"


def rule_index(name: str, text: str) -> str:
    return f"least({rule(f'lower({name})')}, {rule(f'lower(left({text}, 1000))')})"


def sanitize(e: str, fallback: str) -> str:
    kept = f"trim(regexp_replace(coalesce({e}, ''), {RESERVED}, '', 'g'), {SPACE})"
    short = f"left(regexp_replace({kept}, '{WHITESPACE_RUN}', ' ', 'g'), 100)"
    return f"coalesce(nullif({short}, ''), '{fallback}')"


def sanitize_name(e: str, ext: str) -> str:
    """``ext`` is a SQL expression."""
    dashed = rf"regexp_replace({e}, '[\\/]+', '-', 'g')"
    cleaned = rf"""trim(regexp_replace({dashed}, '[\x00-\x1f<>:"|?*]+', '', 'g'), {SPACE})"""
    base = f"CASE WHEN coalesce({e}, '') = '' THEN 'file' ELSE {cleaned} END"
    parts = r"'(?s)^(.*[^.].*)(\.[^.]*)$'"
    return (
        f"(SELECT left(CASE WHEN ends_with(lower(b), lower({ext})) THEN b WHEN regexp_matches(b, {parts})"
        f" THEN regexp_extract(b, {parts}, 1) || {ext} ELSE b || {ext} END, 200) FROM (SELECT {base} AS b))"
    )


def cut(e: str, limit: int, head: int, tail: int, mark: str) -> str:
    return f"CASE WHEN length({e}) > {limit} THEN left({e}, {head}) || {mark} || right({e}, {tail}) ELSE {e} END"


def preview(e: str, limit: int) -> str:
    head = int(limit * 0.6)
    return cut(collapse(e), limit, head, limit - head, "' ... [CONTENT SKIPPED] ... '")


SKIPPED_LINE = "chr(10) || '... [CONTENT SKIPPED] ...' || chr(10)"
HEAD_TAIL = cut("text", 20000, 14500, 5000, SKIPPED_LINE)


def alias(e: str, own: dict[str, str]) -> str:
    merged = {**own, **SETTINGS.aliases}
    cases = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in merged.items())
    return f"CASE lower({e}) {cases} ELSE {e} END"


def normalized(l1: str, l2: str) -> tuple[str, str]:
    first = sanitize(f"coalesce(nullif({l1}, ''), 'General')", "General")
    second = sanitize(f"coalesce(nullif({l2}, ''), 'Unsorted')", "Unsorted")
    return alias(first, SETTINGS.level1_aliases), alias(second, SETTINGS.level2_aliases)


def technical(l1: str, l2: str, review: str, has_text: str) -> str:
    return (
        f"CASE WHEN {l1} = '_Duplicates' THEN '_Duplicates' WHEN {review} THEN '_NeedsReview'"
        f" WHEN NOT {has_text} THEN '_FailedExtraction'"
        f" WHEN coalesce({l1}, '') = '' OR coalesce({l2}, '') = '' THEN '_NeedsReview' END"
    )


def numbered(name: str, number: str) -> str:
    stem, ext = rf"regexp_extract({name}, '(?s)^(.+)(\.[^.]+)$', 1)", rf"regexp_extract({name}, '(?s)^.+(\.[^.]+)$', 1)"
    return f"CASE WHEN {number} = 0 THEN {name} ELSE {stem} || '_' || {number} || {ext} END"


def seconds_after(day: str) -> str:
    return f"TIMESTAMP '{day}' + to_seconds(doc_id)"


def unique(requests: str, prefix: str) -> dict[str, str]:
    """CTEs that name ``document_id, source_path, folder, filename`` requests apart from the ``ledger``."""
    numbered_name = r"'(?s)^(.+)_([1-9][0-9]*)(\.[^.]+)$'"
    return {
        f"{prefix}_placed": "SELECT regexp_extract(destination_path, '^/organized/(.*)/[^/]*$', 1) AS folder,"
        " regexp_extract(destination_path, '[^/]*$') AS filename FROM ledger",
        f"{prefix}_reserved": f"""SELECT DISTINCT folder, filename, 0::BIGINT AS number FROM {prefix}_placed
            UNION SELECT folder, regexp_extract(filename, {numbered_name}, 1) || regexp_extract(filename, {numbered_name}, 3),
                try_cast(regexp_extract(filename, {numbered_name}, 2) AS BIGINT)
            FROM (SELECT folder, filename FROM {requests} UNION SELECT folder, filename FROM {prefix}_placed)
            WHERE regexp_matches(filename, {numbered_name})""",
        f"{prefix}_steps": "SELECT folder, filename, number - (row_number() OVER (PARTITION BY folder, filename ORDER BY number) - 1) AS at"
        f" FROM {prefix}_reserved",
        f"{prefix}_ranked": "SELECT *, row_number() OVER (PARTITION BY folder, filename ORDER BY source_path) - 1 AS rank"
        f" FROM {requests}",
        f"{prefix}_numbers": f"""SELECT r.document_id, any_value(r.folder) AS folder, any_value(r.filename) AS filename,
            any_value(r.rank) + count(s.at) AS number
            FROM {prefix}_ranked r LEFT JOIN {prefix}_steps s
            ON r.folder = s.folder AND r.filename = s.filename AND s.at <= r.rank GROUP BY r.document_id""",
        f"{prefix}_named": f"""SELECT document_id, {numbered('filename', 'number')} AS unique_name,
            '/organized/' || folder || '/' || {numbered('filename', 'number')} AS destination_path FROM {prefix}_numbers""",
    }


_INBOX_FILES = r"""SELECT doc_id, name AS filename, lower(regexp_extract(name, '(\.[^.]+)$', 1)) AS extension, text,
    CAST(octet_length(encode(text)) AS BIGINT) AS file_size, md5(text) AS file_hash
    FROM (SELECT doc_id, coalesce(text, '') AS text, CASE doc_id % 4 WHEN 0 THEN '_plan-' || doc_id || '.txt'
        WHEN 1 THEN doc_id || '._COPYING_' ELSE 'doc-' || doc_id || '.md' END AS name FROM documents WHERE doc_id % 4 <> 2)"""
_STEMS = ", ".join(f"'{stem}'" for stem in corpus.STEMS)
_EXTENSIONS = ", ".join(f"'{extension}'" for extension in corpus.EXTENSIONS)
_HISTORY = ", ".join(f"'{source}'" for source in corpus.HISTORY_SOURCES)
_KEY = "prompt_version = 'v3' AND understanding_model = 'qwen3.5:4b' AND classification_model = 'qwen3.5:4b'"
_DECISION = "summary, keywords, language, document_type, category_l1, category_l2, confidence, reason, needs_review"
_ANSWERED = "regexp_extract(raw, '(?s)\\{.*\\}')"
NORMAL_L1, NORMAL_L2 = normalized("raw_l1", "raw_l2")

CTES: dict[str, str] = {
    "named": f"""SELECT *, '/inbox/' || doc_id || '/' || filename AS source_path,
        CASE WHEN source IN ({_HISTORY}) THEN 'run-1' ELSE 'run-2' END AS run_id
        FROM (SELECT *, list_extract([{_STEMS}], doc_id % 10 + 1) || '_' || (doc_id % 50)
            || list_extract([{_EXTENSIONS}], (doc_id // 10) % 6 + 1) AS filename FROM documents)""",
    "ids": r"""SELECT *, sha256(run_id || '|' || source_path) AS document_id, md5(text) AS file_hash,
        lower(regexp_extract(filename, '^.+(\.[^.]+)$', 1)) AS extension FROM named""",
    "files": f"""SELECT *, octet_length(encode(text)) AS file_size,
        CASE extension WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.csv' THEN 'text/csv'
            WHEN '.html' THEN 'text/html' WHEN '.pdf' THEN 'application/pdf' END AS mime_type,
        CASE WHEN extension IN ('.txt', '.md', '.csv', '.html') THEN 'text' WHEN extension = '.pdf' THEN 'pdf'
            ELSE 'unsupported' END AS extractor_name,
        CASE WHEN extension IN ('.txt', '.md', '.csv', '.html') THEN nullif({strip('text')}, '') END AS extracted_text,
        CASE WHEN extension = '.pdf' THEN 'PDF text must be precomputed'
            WHEN extension = '.xyz' THEN 'Unsupported file type: .xyz' END AS error FROM ids""",
    "ruled": f"SELECT *, {rule_index('filename', 'text')} AS rule FROM ids",
    "ledger": f"""SELECT doc_id AS event_id, run_id, document_id, source_path, filename, file_hash,
        {verdict('rule', 1)} AS category_l1, {verdict('rule', 2)} AS category_l2,
        '/organized/' || coalesce({verdict('rule', 1)} || '/' || {verdict('rule', 2)}, '_NeedsReview') || '/'
            || {numbered('filename', '(doc_id // 300)')} AS destination_path
        FROM ruled WHERE source IN ({_HISTORY})""",
    "filed_rows": """SELECT file_hash, filename, category_l2 FROM ledger
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY event_id DESC) = 1""",
    "precomputed": "SELECT source_path, CASE WHEN lang IN ('en', 'fr') THEN text ELSE '' END AS text FROM ids"
    " WHERE extension = '.pdf'",
    "decisions": f"""SELECT file_hash, CASE WHEN quality = 1 THEN 'v3' ELSE 'v2' END AS prompt_version,
        'qwen3.5:4b' AS understanding_model, 'qwen3.5:4b' AS classification_model,
        'Cached ' || doc_id AS summary, lang || ',' || source AS keywords, lang AS language, 'report' AS document_type,
        {corpus.ANSWER_LEVEL1} AS category_l1, {corpus.ANSWER_LEVEL2} AS category_l2,
        (doc_id % 100) / 100 AS confidence, 'Cached answer' AS reason, toxic = 1 AS needs_review,
        {seconds_after('2024-01-10')} AS cached_at FROM ids JOIN labels USING (doc_id)""",
    "decided": f"""SELECT file_hash, {_DECISION} FROM decisions WHERE {_KEY}
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY cached_at DESC) = 1""",
    "extractions": f"""SELECT file_hash, CASE WHEN lang = 'de' THEN 'glm-ocr:q8_0' ELSE 'none' END AS ocr_model,
        {strip('text')} AS extracted_text, lang AS metadata, {quality('text')} AS extraction_quality,
        extension = '.pdf' AS ocr_used, false AS conversion_used, {seconds_after('2024-01-11')} AS cached_at
        FROM ids WHERE lang <> 'en'""",
    "extracted": """SELECT * FROM extractions WHERE ocr_model = 'glm-ocr:q8_0'
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY cached_at DESC) = 1""",
    "responses": f"""SELECT document_id, 'understand' AS stage, {corpus.UNDERSTAND_RAW} AS raw FROM ids
        UNION ALL SELECT document_id, 'classify', {corpus.CLASSIFY_RAW} FROM ids
        UNION ALL SELECT document_id, 'rename', {corpus.RENAME_RAW} FROM ids""",
    "payloads": f"""SELECT document_id, stage, CASE WHEN json_valid(raw) THEN raw::JSON
        WHEN json_valid({_ANSWERED}) THEN {_ANSWERED}::JSON END AS payload FROM responses""",
    "kinds": """SELECT *, json_type(payload) AS kind,
        json_type(payload) IS NULL OR json_type(payload) = 'NULL' OR payload::VARCHAR IN ('{}', '[]', '""', '0', 'false') AS is_empty
        FROM payloads""",
    "understood": """SELECT document_id,
        CASE WHEN is_empty THEN 'empty' WHEN kind = 'OBJECT' AND coalesce(json_type(payload, '$.keywords'), '') <> 'NULL'
            THEN 'object' ELSE 'invalid' END AS state, payload FROM kinds WHERE stage = 'understand'""",
    "understanding": """SELECT document_id, state,
        CASE WHEN state = 'object' THEN payload->>'$.summary' END AS summary,
        CASE WHEN state = 'object' THEN payload->>'$.language' END AS language,
        CASE WHEN state = 'object' THEN payload->>'$.document_type' END AS document_type,
        CASE WHEN state = 'object' THEN array_to_string((payload->>'$.keywords[*]')[1:8], ',') END AS keywords,
        CASE WHEN state = 'object' THEN array_to_string((payload->>'$.content_signals[*]')[1:8], ',') END AS content_signals
        FROM understood""",
    "classification": """SELECT document_id, state,
        CASE WHEN state = 'object' THEN payload->>'$.category_l1' END AS category_l1,
        CASE WHEN state = 'object' THEN payload->>'$.category_l2' END AS category_l2,
        CASE WHEN state = 'object' THEN payload->>'$.reason' END AS reason,
        CASE WHEN state = 'object' THEN (payload->>'$.confidence')::DOUBLE END AS confidence,
        CASE WHEN state = 'object' THEN CASE json_type(payload, '$.needs_review') WHEN 'VARCHAR'
            THEN payload->>'$.needs_review' <> '' ELSE coalesce((payload->>'$.needs_review')::BOOLEAN, false) END END AS needs_review
        FROM (SELECT *, CASE WHEN is_empty THEN 'empty' WHEN kind = 'OBJECT' THEN 'object' ELSE 'invalid' END AS state
            FROM kinds WHERE stage = 'classify')""",
    "taxonomy": f"""SELECT DISTINCT split_part(destination_path, '/', 3) AS category_l1, split_part(destination_path, '/', 4) AS category_l2
        FROM ledger WHERE split_part(destination_path, '/', 3) NOT IN ({TECHNICAL})""",
    "words": f"""SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id,
        unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{3,}}')) AS w FROM documents)
        WHERE w NOT IN ({STOP}) GROUP BY ALL""",
    "keywords": """SELECT doc_id, coalesce(k, []) AS keywords FROM documents LEFT JOIN (SELECT doc_id,
        list(w ORDER BY n DESC, w)[1:8] AS k FROM words GROUP BY doc_id) USING (doc_id)""",
    "moved": """SELECT event_id AS id, '/inbox/file_' || user_id || '.txt' AS original_path,
        'file_' || user_id || '.txt' AS original_filename, event_type AS category, ts AS processed_date,
        CASE WHEN event_type <> 'error' THEN '/organized/' || event_type || '/file_' || user_id || '.txt' END AS new_path,
        md5(props) AS file_hash, octet_length(encode(props)) AS file_size, user_id % 2 = 0 AS cached,
        value AS processing_time_seconds FROM events""",
    # The run. Each step follows the order of checks on one document.
    "inbox": f"SELECT * FROM files WHERE source NOT IN ({_HISTORY})",
    "copies": "SELECT file_hash, count(*) AS copies, min(source_path) AS first_path FROM inbox GROUP BY file_hash",
    "looked_up": f"""SELECT i.document_id, i.run_id, i.doc_id, i.source_path, i.filename, i.file_hash, i.error AS own_error,
        c.first_path, f.file_hash IS NOT NULL AS is_filed, f.filename AS filed_name, f.category_l2 AS filed_l2,
        d.file_hash IS NOT NULL AS is_cached, d.summary AS d_summary, d.language AS d_language,
        d.document_type AS d_type, d.category_l1 AS d_l1, d.category_l2 AS d_l2, d.confidence AS d_confidence,
        d.reason AS d_reason, d.needs_review AS d_review,
        CASE WHEN p.text <> '' THEN 'opendataloader' WHEN x.file_hash IS NOT NULL THEN 'extraction_cache' ELSE 'extractor' END AS text_source,
        CASE WHEN p.text <> '' THEN p.text WHEN x.file_hash IS NOT NULL THEN x.extracted_text ELSE i.extracted_text END AS chosen,
        CASE WHEN p.text <> '' THEN NULL ELSE x.extraction_quality END AS x_quality,
        CASE WHEN p.text <> '' THEN false ELSE coalesce(x.ocr_used, false) END AS ocr_used
        FROM inbox i LEFT JOIN copies c USING (file_hash) LEFT JOIN filed_rows f USING (file_hash)
        LEFT JOIN decided d USING (file_hash) LEFT JOIN extracted x USING (file_hash)
        LEFT JOIN precomputed p USING (source_path)""",
    "facts": f"""SELECT * EXCLUDE (chosen), coalesce(chosen, '') <> '' AS has_text, coalesce(x_quality, {quality('chosen')}) AS extraction_quality,
        {rule_index('filename', 'chosen')} AS rule, {summary('chosen')} AS t_summary, {language('chosen')} AS t_language
        FROM looked_up""",
    "answered": """SELECT t.*, u.state = 'object' AS u_ok, c.state = 'object' AS c_ok,
        CASE WHEN u.state = 'object' THEN u.summary ELSE t_summary END AS r_summary,
        CASE WHEN u.state = 'object' THEN u.language ELSE t_language END AS r_language,
        CASE WHEN u.state = 'object' THEN u.document_type ELSE 'document' END AS r_type,
        c.category_l1 AS c_l1, c.category_l2 AS c_l2, c.confidence AS c_confidence, c.reason AS c_reason, c.needs_review AS c_review,
        CASE WHEN is_filed THEN 'duplicate' WHEN is_cached THEN 'cache'
            WHEN text_source = 'extractor' AND NOT has_text THEN 'no_text'
            WHEN u.state = 'invalid' THEN 'unread' WHEN rule IS NULL AND c.state = 'invalid' THEN 'unsorted' ELSE 'sorted' END AS path
        FROM facts t LEFT JOIN understanding u USING (document_id) LEFT JOIN classification c USING (document_id)""",
    "verdicts": f"""SELECT *, rule IS NULL AND c_ok AS by_model,
        CASE WHEN rule IS NOT NULL THEN {verdict('rule', 1)} WHEN c_ok THEN c_l1 ELSE 'General' END AS v_l1,
        CASE WHEN rule IS NOT NULL THEN {verdict('rule', 2)} WHEN c_ok THEN c_l2 ELSE coalesce(nullif(r_type, ''), 'Unsorted') END AS v_l2,
        CASE WHEN rule IS NOT NULL THEN {verdict('rule', 3)} WHEN c_ok THEN c_confidence
            WHEN coalesce(r_summary, '') <> '' THEN 0.4 ELSE 0.2 END::DOUBLE AS v_confidence,
        CASE WHEN rule IS NOT NULL THEN {verdict('rule', 4)} WHEN c_ok THEN c_reason ELSE 'Fallback heuristic classification' END AS v_reason,
        CASE WHEN rule IS NOT NULL THEN false WHEN c_ok THEN c_review ELSE true END AS v_review FROM answered""",
    "raw_outcomes": """SELECT *,
        CASE path WHEN 'duplicate' THEN 'duplicate' WHEN 'cache' THEN 'classified' WHEN 'no_text' THEN 'review'
            WHEN 'sorted' THEN 'classified' ELSE 'failed' END AS state,
        CASE path WHEN 'duplicate' THEN '_Duplicates' WHEN 'cache' THEN d_l1 WHEN 'sorted' THEN v_l1 END AS raw_l1,
        CASE path WHEN 'duplicate' THEN coalesce(nullif(filed_l2, ''), 'KnownDuplicate') WHEN 'cache' THEN d_l2 WHEN 'sorted' THEN v_l2 END AS raw_l2,
        CASE path WHEN 'duplicate' THEN 1.0 WHEN 'cache' THEN d_confidence WHEN 'sorted' THEN v_confidence ELSE 0.0 END::DOUBLE AS confidence,
        CASE path WHEN 'duplicate' THEN 'Duplicate of ' || filed_name WHEN 'cache' THEN d_reason
            WHEN 'no_text' THEN 'Extraction produced no usable text'
            WHEN 'sorted' THEN CASE WHEN v_confidence >= 0.55 THEN v_reason WHEN coalesce(v_reason, '') = '' THEN 'Below review threshold'
                ELSE v_reason || ' | Below review threshold' END END AS reason,
        CASE path WHEN 'cache' THEN d_review WHEN 'no_text' THEN true WHEN 'sorted' THEN v_review OR v_confidence < 0.55 ELSE false END AS needs_review,
        path = 'cache' OR (path = 'sorted' AND has_text) AS routable,
        CASE path WHEN 'cache' THEN d_summary WHEN 'sorted' THEN r_summary WHEN 'unsorted' THEN r_summary END AS summary,
        CASE path WHEN 'cache' THEN d_language WHEN 'sorted' THEN r_language WHEN 'unsorted' THEN r_language END AS language,
        CASE path WHEN 'cache' THEN d_type WHEN 'sorted' THEN r_type WHEN 'unsorted' THEN r_type END AS document_type
        FROM verdicts""",
    "outcomes": f"""SELECT *, state <> 'failed' AND ({technical('raw_l1', 'raw_l2', 'needs_review', 'routable')}) IS NULL AS is_filed_away
        FROM raw_outcomes""",
    "normal": f"""SELECT *, CASE WHEN is_filed_away THEN {NORMAL_L1} END AS n_l1, CASE WHEN is_filed_away THEN {NORMAL_L2} END AS n_l2
        FROM outcomes""",
    "known_l1": "SELECT lower(category_l1) AS key_l1, min(category_l1) AS known_l1 FROM taxonomy GROUP BY ALL",
    "known_l2": "SELECT category_l1 AS known_l1, lower(category_l2) AS key_l2, min(category_l2) AS known_l2 FROM taxonomy GROUP BY ALL",
    "aligned": """SELECT n.*, CASE WHEN is_filed_away THEN coalesce(a.known_l1, n_l1) ELSE raw_l1 END AS l1,
        CASE WHEN is_filed_away THEN coalesce(b.known_l2, n_l2) ELSE raw_l2 END AS l2
        FROM normal n LEFT JOIN known_l1 a ON lower(n_l1) = a.key_l1
        LEFT JOIN known_l2 b ON a.known_l1 = b.known_l1 AND lower(n_l2) = b.key_l2""",
    # A content counts as filed from the first file on that gets a place.
    "leads": """SELECT file_hash, source_path AS lead_path, filename AS lead_name, l2 AS lead_l2 FROM aligned WHERE state NOT IN ('failed', 'duplicate')
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY source_path) = 1""",
    "followed": """SELECT a.*, coalesce(source_path > lead_path, false) AND state <> 'duplicate' AS follows,
        lead_name, coalesce(nullif(lead_l2, ''), 'KnownDuplicate') AS follow_l2 FROM aligned a LEFT JOIN leads l USING (file_hash)""",
    "settled": """SELECT document_id, run_id, source_path, filename, file_hash, ocr_used, extraction_quality,
        follows OR state <> 'failed' AS is_moved,
        CASE WHEN follows OR path = 'duplicate' THEN 'duplicate' WHEN path = 'cache' THEN 'cache' WHEN path = 'sorted' THEN 'llm' ELSE text_source END AS decision_source,
        CASE WHEN follows THEN '_Duplicates' ELSE l1 END AS category_l1, CASE WHEN follows THEN follow_l2 ELSE l2 END AS category_l2,
        CASE WHEN follows THEN 1.0 ELSE confidence END::DOUBLE AS confidence, NOT follows AND needs_review AS needs_review,
        CASE WHEN follows THEN 'Duplicate of ' || lead_name ELSE reason END AS reason, NOT follows AND path = 'cache' AS cached,
        CASE WHEN NOT follows THEN summary END AS summary, CASE WHEN NOT follows THEN language END AS language,
        CASE WHEN NOT follows THEN document_type END AS document_type, routable,
        CASE WHEN NOT follows AND path IN ('sorted', 'unsorted') AND u_ok THEN 'qwen3.5:4b' END AS understanding_model,
        CASE WHEN NOT follows AND path = 'sorted' AND by_model THEN 'qwen3.5:4b' END AS classification_model,
        CASE WHEN NOT follows AND path IN ('sorted', 'unsorted') THEN 'v3' END AS prompt_version,
        CASE WHEN follows THEN '' ELSE concat_ws(chr(10), CASE WHEN text_source = 'extractor' THEN own_error END,
            CASE path WHEN 'unread' THEN 'Unusable understanding answer' WHEN 'unsorted' THEN 'Unusable classification answer' END) END AS errors
        FROM followed""",
    "run_requests": f"""SELECT document_id, source_path, filename,
        coalesce({technical('category_l1', 'category_l2', 'needs_review', 'routable')}, category_l1 || '/' || category_l2) AS folder
        FROM settled WHERE is_moved""",
    **unique("run_requests", "run"),
    "plan": """SELECT s.*, n.destination_path, CASE WHEN is_moved THEN 'moved' ELSE 'failed' END AS status
        FROM settled s LEFT JOIN run_named n USING (document_id)""",
    "expected": """SELECT source_path, CASE WHEN toxic = 1 THEN 'Finance' END AS expected_category_l1,
        NULL::VARCHAR AS expected_category_l2, quality = 0 AS expected_needs_review FROM ids JOIN labels USING (doc_id)""",
    "cases": """SELECT e.*, p.category_l1 AS actual_category_l1, p.category_l2 AS actual_category_l2,
        p.needs_review AS actual_needs_review, coalesce(p.status, 'missing') AS status
        FROM expected e LEFT JOIN plan p USING (source_path)""",
    "scored": f"""SELECT document_id, filename, CASE WHEN source = 'src7' THEN '_Duplicates' WHEN source <> 'src8' THEN {corpus.ANSWER_LEVEL1} END AS category_l1,
        CASE WHEN source = 'src9' THEN '' ELSE {corpus.ANSWER_LEVEL2} END AS category_l2, (doc_id % 100) / 100 AS confidence,
        CASE lang WHEN 'fr' THEN '' WHEN 'en' THEN 'Because' END AS reason, source = 'src10' AS needs_review, lang <> 'de' AS has_text FROM ids""",
    "records": """SELECT source AS run_id, TIMESTAMP '2024-03-01' + to_seconds(substr(source, 4)::INT) AS started_at,
        CASE WHEN source <> 'src18' THEN TIMESTAMP '2024-03-02' + to_seconds(substr(source, 4)::INT) END AS completed_at,
        source = 'src19' AS dry_run, count(*) AS total_files, count(*) FILTER (lang = 'en') AS processed_files,
        count(*) FILTER (lang = 'de') AS failed_files, count(*) FILTER (lang = 'fr') AS review_files,
        sum(n_chars) / count(*) AS avg_confidence FROM documents GROUP BY source""",
}
def _references(sql: str, names: list[str]) -> list[str]:
    return [name for name in names if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def with_ctes(final: str, extra: dict[str, str] | None = None) -> str:
    """A query with the steps it needs in front."""
    steps = {**CTES, **(extra or {})}
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in _references(sql, list(steps)):
            if name not in needed:
                add(steps[name])
                needed.append(name)

    add(final)
    if not needed:
        return final
    listed = ",\n".join(f"{name} AS ({steps[name]})" for name in needed)
    return f"WITH {listed}\n{final}"


def _prompt(template: str, *values: str) -> str:
    """The template as a SQL concatenation."""
    parts = template.split("%s")
    pieces = ["'" + parts[0].replace("'", "''") + "'"]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [f"coalesce({value}, '')", "'" + part.replace("'", "''") + "'"]
    return "concat(" + ", ".join(pieces) + ")"


_UNDERSTAND = _prompt(prompts.UNDERSTAND, "filename", "source_path", preview("text", 40000))
_TAXONOMY_LINE = """(SELECT string_agg(entry, '; ' ORDER BY entry) FROM (SELECT category_l1 || ': '
    || string_agg(category_l2, ', ' ORDER BY category_l2) AS entry FROM taxonomy GROUP BY category_l1))"""
_CLASSIFY = _prompt(
    prompts.CLASSIFY,
    _TAXONOMY_LINE,
    "filename",
    "source_path",
    summary("text"),
    "array_to_string(keywords, ', ')",
    "'document'",
    language("text"),
    preview("text", 40000),
)
_RULED_FOLDER = f"coalesce({verdict('rule', 1)} || '/' || {verdict('rule', 2)}, '_NeedsReview')"
_NAME_RULED = f"SELECT *, {rule('lower(filename)')} AS rule FROM ids"
_ROUTE = technical("category_l1", "category_l2", "needs_review", "has_text")
_SCORED_L1, _SCORED_L2 = normalized("category_l1", "category_l2")
_COUNTERS = """count(*) AS total_cases,
    count(*) FILTER (status <> 'missing' AND (expected_category_l1 IS NULL OR expected_category_l1 = actual_category_l1)) AS matched_level1,
    count(*) FILTER (status <> 'missing' AND (expected_category_l2 IS NULL OR expected_category_l2 = actual_category_l2)) AS matched_level2,
    count(*) FILTER (status <> 'missing' AND (expected_needs_review IS NULL OR expected_needs_review = actual_needs_review)) AS matched_review_flag,
    count(*) FILTER (status <> 'missing' AND (expected_category_l1 IS NULL OR expected_category_l1 = actual_category_l1)
        AND (expected_category_l2 IS NULL OR expected_category_l2 = actual_category_l2)
        AND (expected_needs_review IS NULL OR expected_needs_review = actual_needs_review)) AS full_matches,
    count(*) FILTER (status = 'missing') AS failures"""
_LEGACY = {
    "proposals": """SELECT document_id, CASE WHEN kind = 'OBJECT' AND json_type(payload, '$.category') = 'VARCHAR'
            THEN nullif(payload->>'$.category', '') END AS proposed,
        CASE WHEN kind = 'OBJECT' AND json_type(payload, '$.new_filename') = 'VARCHAR'
            THEN nullif(payload->>'$.new_filename', '') END AS new_name FROM kinds WHERE stage = 'rename'""",
    "category_cache": """SELECT file_hash, category_l1 AS known FROM decisions WHERE needs_review
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY cached_at DESC) = 1""",
    "tried": f"""SELECT i.document_id, i.source_path, i.filename, i.file_hash, i.file_size, i.extracted_text IS NOT NULL AS has_text,
        CASE WHEN i.extracted_text IS NOT NULL AND proposed IS NOT NULL THEN {sanitize('proposed', '_Unprocessed')} END AS own, known
        FROM inbox i LEFT JOIN proposals USING (document_id) LEFT JOIN category_cache USING (file_hash)""",
    "first_tries": """SELECT file_hash, source_path AS first_path, own AS first_own FROM tried WHERE own IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY source_path) = 1""",
    "single": """SELECT t.*, coalesce(source_path > first_path, false) AS after_first,
        coalesce(known, CASE WHEN coalesce(source_path > first_path, false) THEN first_own ELSE own END) AS category
        FROM tried t LEFT JOIN first_tries USING (file_hash)""",
    "single_requests": f"""SELECT document_id, source_path, filename, {sanitize('category', '_Unprocessed')} AS folder
        FROM single WHERE category IS NOT NULL""",
    **unique("single_requests", "single"),
    "rename_requests": f"""SELECT document_id, source_path, filename AS original_filename, {sanitize('proposed', '_Unprocessed')} AS folder,
        {sanitize_name('new_name', 'extension')} AS filename
        FROM files JOIN proposals USING (document_id)
        WHERE extracted_text IS NOT NULL AND proposed IS NOT NULL AND new_name IS NOT NULL""",
    **unique("rename_requests", "rename"),
    "aside_requests": "SELECT document_id, source_path, original_filename AS filename, '_Processed' AS folder FROM rename_requests",
    **unique("aside_requests", "aside"),
}
_WANTED = {
    "wanted": f"SELECT document_id, source_path, filename, {_RULED_FOLDER} AS folder FROM ({_NAME_RULED})",
    **unique("wanted", "wanted"),
}
_STREAM = {
    "arrived": f"""SELECT '/inbox/' || doc_id || '/' || source || '.txt' AS source_path, source || '.txt' AS filename, md5(text) AS file_hash,
        sha256('arrivals-batch-0|/inbox/' || doc_id || '/' || source || '.txt') AS document_id,
        nullif({strip('text')}, '') AS chosen FROM documents""",
    "stream_firsts": "SELECT file_hash, min(source_path) AS first_path FROM arrived GROUP BY file_hash",
    "stream_ruled": f"""SELECT *, {rule_index('filename', 'chosen')} AS rule FROM arrived JOIN stream_firsts USING (file_hash)""",
    "stream_own": f"""SELECT *, CASE WHEN chosen IS NULL THEN NULL WHEN rule IS NULL THEN 'General' ELSE {verdict('rule', 1)} END AS l1,
        CASE WHEN chosen IS NULL THEN NULL WHEN rule IS NULL THEN 'document' ELSE {verdict('rule', 2)} END AS l2,
        CASE WHEN chosen IS NULL THEN 'Extraction produced no usable text' WHEN rule IS NULL
            THEN 'Fallback heuristic classification | Below review threshold' ELSE {verdict('rule', 4)} END AS own_reason FROM stream_ruled""",
    "stream_leads": "SELECT file_hash, filename AS lead_name, l2 AS lead_l2 FROM stream_own WHERE source_path = first_path",
    "stream_done": """SELECT source_path, document_id, filename, CASE WHEN source_path <> first_path THEN '_Duplicates' ELSE l1 END AS category_l1,
        CASE WHEN source_path <> first_path THEN coalesce(nullif(lead_l2, ''), 'KnownDuplicate') ELSE l2 END AS category_l2,
        CASE WHEN source_path <> first_path THEN 'Duplicate of ' || lead_name ELSE own_reason END AS reason,
        CASE WHEN source_path <> first_path THEN '_Duplicates' WHEN chosen IS NULL OR rule IS NULL THEN '_NeedsReview' ELSE l1 || '/' || l2 END AS folder
        FROM stream_own JOIN stream_leads USING (file_hash)""",
    "ledger": "SELECT NULL::VARCHAR AS destination_path WHERE false",
    **unique("stream_done", "stream"),
}

_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_AMOUNTS, "l_returnflag", "l_linestatus", "l_shipdate")
_CELLS = ", ".join(f"nullif(trim(CAST({f'CAST({c} AS DECIMAL(18,2))' if c in _AMOUNTS else c} AS VARCHAR)), '')" for c in _LINE)

FINALS: dict[str, str | tuple[str, dict[str, str]]] = {
    "ingest_envelopes": "SELECT document_id, run_id, source_path, filename, extension, mime_type, file_size, file_hash FROM files",
    "ingest_limit": "SELECT doc_id, source_path FROM ids ORDER BY source_path LIMIT 100",
    "text_decode": rf"""SELECT doc_id, CASE WHEN lang <> 'en' AND regexp_full_match(text, '[\x00-\x{{ff}}]*')
        AND regexp_matches(text, '[\x{{80}}-\x{{ff}}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding,
        nullif({strip('text')}, '') AS extracted_text, {quality(strip('text'))} AS extraction_quality FROM documents""",
    "extraction_dispatch": "SELECT document_id, extension, mime_type, extractor_name, error FROM files",
    "html_strip": f"SELECT page_id, {strip(chr(34) + 't' + chr(34))} AS text FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages)",
    "precomputed_attach": f"""SELECT sha256('run-2|' || source_path) AS document_id, coalesce(p.text, '') <> '' AS odl_batch,
        CASE WHEN p.text <> '' THEN {quality('p.text')} END AS extraction_quality, false AS ocr_used
        FROM files LEFT JOIN precomputed p USING (source_path)""",
    "extraction_candidates": "SELECT document_id, source_path FROM files WHERE extension = '.pdf' AND file_hash NOT IN (SELECT file_hash FROM decided)",
    "rows_as_text": f"SELECT l_orderkey, l_linenumber, concat_ws(' | ', {_CELLS}) AS line FROM lineitem",
    "benchmark_load": "SELECT * FROM expected",
    "taxonomy_scan": "SELECT * FROM taxonomy",
    "ledger_rows": """SELECT row_number() OVER (ORDER BY source_path) AS event_id, run_id, document_id, source_path, destination_path, filename, status,
        category_l1, category_l2, confidence, reason, needs_review, file_hash, prompt_version, understanding_model, classification_model,
        ocr_used, false AS conversion_used, false AS dry_run, nullif(errors, '') AS error_message, TIMESTAMP '2024-02-01' AS created_at FROM plan""",
    "runs_current": """SELECT run_id, started_at, completed_at, dry_run,
        CASE WHEN completed_at IS NULL THEN 0 ELSE total_files END AS total_files, CASE WHEN completed_at IS NULL THEN 0 ELSE processed_files END AS processed_files,
        CASE WHEN completed_at IS NULL THEN 0 ELSE failed_files END AS failed_files, CASE WHEN completed_at IS NULL THEN 0 ELSE review_files END AS review_files,
        round(CASE WHEN completed_at IS NULL THEN 0 ELSE avg_confidence END, 6) AS avg_confidence FROM records""",
    "cache_merge": """SELECT * FROM decisions
        QUALIFY row_number() OVER (PARTITION BY file_hash, prompt_version, understanding_model, classification_model ORDER BY cached_at DESC) = 1""",
    "extraction_cache_merge": "SELECT * FROM extractions QUALIFY row_number() OVER (PARTITION BY file_hash, ocr_model ORDER BY cached_at DESC) = 1",
    "document_report": """SELECT document_id, filename, source_path, status, decision_source, category_l1, category_l2, confidence, needs_review, reason,
        destination_path, mime_type, document_type, cached, plan.ocr_used, false AS conversion_used, errors
        FROM plan JOIN (SELECT document_id, mime_type FROM files) USING (document_id)""",
    "organized_write": """SELECT run_id, document_id, destination_path, split_part(destination_path, '/', 3) AS folder_l1,
        CASE WHEN len(string_split(destination_path, '/')) = 5 THEN split_part(destination_path, '/', 4) END AS folder_l2, extracted_text
        FROM (SELECT 'run-2' AS run_id, document_id, destination_path FROM plan
            UNION ALL SELECT 'run-3', document_id, destination_path FROM plan WHERE category_l1 = '_Duplicates')
        JOIN (SELECT document_id, extracted_text FROM files) USING (document_id) WHERE destination_path IS NOT NULL""",
    "movement_rows": """SELECT original_path, original_filename, new_path, CASE WHEN new_path IS NOT NULL THEN original_filename END AS new_filename, category,
        CASE WHEN new_path IS NOT NULL THEN file_hash END AS file_hash, CASE WHEN new_path IS NOT NULL THEN file_size END AS file_size,
        CASE WHEN new_path IS NOT NULL THEN processing_time_seconds END AS processing_time_seconds,
        new_path IS NOT NULL AND cached AS cached, CASE WHEN new_path IS NULL THEN 'Move failed' END AS error_message FROM moved""",
    "route_destination": f"SELECT document_id, coalesce({_ROUTE}, category_l1 || '/' || category_l2) AS folder FROM scored",
    "review_gate": """SELECT document_id, confidence, CASE WHEN confidence >= 0.55 THEN reason WHEN coalesce(reason, '') = '' THEN 'Below review threshold'
        ELSE reason || ' | Below review threshold' END AS reason, needs_review OR confidence < 0.55 AS needs_review FROM scored""",
    "extraction_gate": """SELECT document_id, 'review' AS state, 'extractor' AS decision_source, 'Extraction produced no usable text' AS reason,
        true AS needs_review FROM files WHERE extracted_text IS NULL""",
    "model_workload": """SELECT document_id, text_source FROM facts WHERE NOT is_filed AND NOT is_cached
        AND (text_source <> 'extractor' OR has_text) AND source_path = first_path""",
    "duplicate_lookup": """SELECT document_id, '_Duplicates' AS category_l1, coalesce(nullif(f.category_l2, ''), 'KnownDuplicate') AS category_l2,
        'Duplicate of ' || f.filename AS reason FROM ids JOIN filed_rows f USING (file_hash)""",
    "history_lookup": (
        """SELECT document_id, coalesce(nullif(f.category_l2, ''), 'KnownDuplicate') AS category_l2, 'Duplicate of ' || f.filename AS reason
        FROM (SELECT document_id, file_hash FROM ids) JOIN kept f USING (file_hash)""",
        {
            "kept": """SELECT file_hash, filename, category_l2 FROM ledger
            WHERE event_id % 5 < 3 OR (event_id % 5 = 3 AND (event_id // 5) % 2 = 1)
            QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY event_id % 5 DESC, event_id DESC) = 1"""
        },
    ),
    "history_runs_read": (
        """SELECT 'run-' || r AS run_id, CAST(coalesce(shared, 0) AS BIGINT) AS shared, coalesce(shared, 0) > 0 AS read
        FROM (SELECT DISTINCT event_id % 5 AS r FROM ledger) LEFT JOIN (SELECT r, count(DISTINCT place) AS shared FROM kept JOIN
            (SELECT substr(file_hash, 1, 6) AS place FROM ids WHERE doc_id % 3 = 0 AND source = 'src1') USING (place) GROUP BY r) USING (r)""",
        {
            "kept": """SELECT event_id % 5 AS r, substr(file_hash, 1, 6) AS place FROM ledger
            WHERE event_id % 5 < 3 OR (event_id % 5 = 3 AND (event_id // 5) % 2 = 1)"""
        },
    ),
    "inbox_scan": (
        f"""SELECT filename, extension, file_size, file_hash, CASE WHEN extension <> '._copying_' THEN nullif({strip('text')}, '') END AS extracted_text,
        CASE WHEN extension = '._copying_' THEN 'Unsupported file type: ._copying_' ELSE '' END AS error FROM inbox_files""",
        {"inbox_files": _INBOX_FILES},
    ),
    "inbox_arrivals": (
        "SELECT filename, file_size, file_hash, CAST((doc_id // 4) % 2 AS INTEGER) AS batch FROM inbox_files",
        {"inbox_files": _INBOX_FILES},
    ),
    "duplicates_in_run": """SELECT document_id, copies, first_path FROM ids JOIN (SELECT file_hash, count(*) AS copies, min(source_path) AS first_path
        FROM ids GROUP BY file_hash) USING (file_hash) WHERE source_path <> first_path""",
    "cache_lookup": f"SELECT document_id, {_DECISION} FROM (SELECT document_id, file_hash FROM ids) JOIN decided USING (file_hash)",
    "extraction_cache_lookup": f"""SELECT document_id, extraction_quality, coalesce(extracted_text, '') <> '' AS has_text, {summary('extracted_text')} AS summary, ocr_used
        FROM (SELECT document_id, file_hash FROM ids) JOIN extracted USING (file_hash)""",
    "taxonomy_align": (
        """SELECT document_id, coalesce(a.known_l1, l1) AS category_l1, coalesce(b.known_l2, l2) AS category_l2
        FROM spelled LEFT JOIN known_l1 a ON lower(l1) = a.key_l1 LEFT JOIN known_l2 b ON a.known_l1 = b.known_l1 AND lower(l2) = b.key_l2""",
        {
            "spelled": f"""SELECT document_id, upper({verdict('rule', 1)}) AS l1,
            CASE WHEN lang = 'en' THEN lower({verdict('rule', 2)}) ELSE 'My ' || {verdict('rule', 2)} END AS l2 FROM ({_NAME_RULED}) WHERE rule IS NOT NULL"""
        },
    ),
    "taxonomy_normalize": f"SELECT document_id, {_SCORED_L1} AS category_l1, {_SCORED_L2} AS category_l2 FROM scored",
    "benchmark_cases": "SELECT * FROM cases",
    "benchmark_missing": "SELECT source_path FROM cases WHERE status = 'missing'",
    "undo_plan": r"""SELECT event_id, run_id, document_id, destination_path, CASE WHEN lang = 'en'
        THEN regexp_replace(source_path, '(\.[^./]+)$', '_restored\1') ELSE source_path END AS restore_path
        FROM ledger JOIN (SELECT document_id, lang FROM ids) USING (document_id)""",
    "responses_attach": "SELECT document_id, raw FROM inbox JOIN responses USING (document_id) WHERE stage = 'classify'",
    "run_metrics": """SELECT run_id, count(*) AS total_files, count(*) FILTER (status = 'moved') AS processed_files,
        count(*) FILTER (status = 'failed') AS failed_files, count(*) FILTER (needs_review) AS review_files,
        round(avg(confidence), 6) AS avg_confidence FROM plan GROUP BY run_id""",
    "benchmark_report": f"SELECT {_COUNTERS} FROM cases",
    "stage_metrics": """SELECT 'decided' AS stage, count(*) AS files, count(*) FILTER (path = 'duplicate') AS duplicates, count(*) FILTER (path = 'cache') AS cached,
        count(*) FILTER (needs_review) AS review, count(*) FILTER (state = 'failed') AS failed FROM raw_outcomes
        UNION ALL SELECT 'planned', count(*), count(*) FILTER (category_l1 = '_Duplicates'), count(*) FILTER (cached), count(*) FILTER (needs_review), count(*) FILTER (status = 'failed') FROM plan""",
    "stats_by_category": "SELECT category, count(*) AS count FROM moved WHERE new_path IS NOT NULL GROUP BY category",
    "stats_overall": """SELECT count(new_path) AS total_processed,
        round(count(*) FILTER (new_path IS NOT NULL AND cached) / count(new_path) * 100.0, 6) AS cache_hit_rate,
        round(avg(processing_time_seconds), 6) AS avg_processing_time, count(*) FILTER (new_path IS NULL) AS total_failed,
        round(sum(processing_time_seconds) / count(*), 6) AS seconds_per_file FROM moved""",
    "category_counts": """SELECT category AS category_name, count(*) AS file_count, min(processed_date) AS created_date FROM moved
        WHERE new_path IS NOT NULL GROUP BY category""",
    "category_state": """SELECT category AS category_name, count(*) AS file_count, min(processed_date) AS created_date FROM moved
        WHERE new_path IS NOT NULL AND NOT (id % 5 = 4 AND (id // 5) % 2 = 0) GROUP BY category""",
    "folder_state": r"""SELECT split_part(destination_path, '/', 3) AS category_l1,
        CASE WHEN destination_path LIKE '/%/%/%/%' THEN split_part(destination_path, '/', 4) END AS category_l2,
        count(*) AS files, min(TIMESTAMP '2024-01-01' + to_days(CAST(event_id % 5 AS INTEGER))) AS first_at FROM ledger
        WHERE event_id % 5 < 3 OR (event_id % 5 = 3 AND (event_id // 5) % 2 = 1) GROUP BY ALL""",
    "taxonomy_state": "SELECT category_l1, category_l2 FROM taxonomy",
    "file_history": "SELECT id, original_path, new_path, category, processed_date, cached FROM moved ORDER BY processed_date DESC, id DESC LIMIT 100",
    "keywords_topk": "SELECT doc_id, array_to_string(keywords, ',') AS keywords FROM keywords",
    "taxonomy_index": "SELECT category_l1, string_agg(category_l2, ',' ORDER BY category_l2) AS category_l2 FROM taxonomy GROUP BY category_l1",
    "extraction_success": """SELECT count(*) AS candidates, count(*) FILTER (p.text <> '') AS with_text FROM files JOIN precomputed p USING (source_path)
        WHERE file_hash NOT IN (SELECT file_hash FROM decided)""",
    "new_categories": f"""SELECT DISTINCT category_l1 FROM plan WHERE category_l1 IS NOT NULL AND category_l1 NOT IN ({TECHNICAL})
        AND category_l1 NOT IN (SELECT category_l1 FROM taxonomy)""",
    "unique_destinations": ("SELECT document_id, destination_path FROM wanted_named", _WANTED),
    "unique_destinations_kept": ("SELECT document_id, destination_path FROM wanted_named", _WANTED),
    "latest_run": "SELECT run_id, started_at FROM records WHERE NOT dry_run ORDER BY started_at DESC, run_id DESC LIMIT 1",
    "run_documents": "SELECT event_id, document_id, source_path, destination_path FROM ledger",
    "content_hash": "SELECT document_id, file_hash, file_size FROM files",
    "quality_score": f"SELECT doc_id, {quality('text')} AS extraction_quality FROM documents",
    "smart_preview": f"SELECT doc_id, {preview('text', 501)} AS preview FROM documents",
    "legacy_preview": f"""SELECT doc_id, {HEAD_TAIL} AS head_tail, {collapse(HEAD_TAIL)} AS collapsed,
        {collapse(cut('text', 1000, 666, 334, SKIPPED_LINE))} AS two_thirds FROM documents""",
    "sanitize_component": f"SELECT page_id, {sanitize('url', 'General')} AS from_url, {sanitize('html', '_Unprocessed')} AS from_html FROM pages",
    "sanitize_filename": f"""SELECT page_id, {sanitize_name('url', "'.html'")} AS from_url, {sanitize_name('html', "'.Html'")} AS from_html FROM pages""",
    "rule_classify": f"""SELECT doc_id, {verdict('rule', 1)} AS category_l1, {verdict('rule', 2)} AS category_l2, {verdict('rule', 3)} AS confidence,
        {verdict('rule', 4)} AS reason FROM ruled""",
    "rule_table_classify": (
        """SELECT doc_id, 'L' || substr(d, 2, 1) AS category_l1, 'M' || substr(d, 3, 2) AS category_l2, length(word) / 100 AS confidence,
        'Matched ' || word AS reason FROM (SELECT doc_id, word, d FROM heads JOIN word_rules ON contains(head, word) OR contains(name, word)
            WHERE substr(d, 1, 1) NOT IN ('0', '1') OR regexp_matches(head, word || bound) OR regexp_matches(name, word || bound)
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY substr(d, 1, 15)) = 1)""",
        {
            "heads": "SELECT doc_id, lower(left(text, 1000)) AS head, lower(filename) AS name FROM named",
            "word_rules": f"""SELECT DISTINCT word, md5(word) AS d, '{NOT_WORD}' AS bound FROM (
                SELECT unnest(regexp_extract_all(lower(left(text, 1000)), '[a-z]{{7,}}')) AS word FROM documents)""",
        },
    ),
    "understand_fallback": f"""SELECT doc_id, {summary('text')} AS summary, array_to_string(keywords, ',') AS keywords, {language('text')} AS language,
        'document' AS document_type, array_to_string(keywords[1:5], ',') AS content_signals FROM documents JOIN keywords USING (doc_id)""",
    "classify_fallback": f"""SELECT doc_id, 'General' AS category_l1, CASE WHEN lang <> 'de' THEN lang ELSE 'Unsorted' END AS category_l2,
        CASE WHEN {summary('text')} IS NOT NULL THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence, 'Fallback heuristic classification' AS reason,
        true AS needs_review FROM documents""",
    "parse_response": f"""SELECT document_id, stage, CASE kind WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind,
        CASE WHEN kind = 'OBJECT' AND json_type(payload, '$.category') = 'VARCHAR' AND payload->>'$.category' <> ''
            THEN {sanitize("(payload->>'$.category')", '_Unprocessed')} END AS category FROM kinds""",
    "typed_understanding": "SELECT * REPLACE (coalesce(keywords, '') AS keywords, coalesce(content_signals, '') AS content_signals) FROM understanding",
    "typed_classification": "SELECT * FROM classification",
    "build_prompts": f"SELECT document_id, {_UNDERSTAND} AS understand_prompt, {_CLASSIFY} AS classify_prompt FROM ids JOIN keywords USING (doc_id)",
    "taxonomy_line": (
        """SELECT string_agg(entry, '; ' ORDER BY entry) || CASE WHEN any_value(total) > 5 THEN '; and ' || (any_value(total) - 5) || ' more' ELSE '' END AS taxonomy
        FROM (SELECT l1 || ': ' || string_agg(l2, ', ' ORDER BY l2) || CASE WHEN any_value(held) > 5 THEN ', and ' || (any_value(held) - 5) || ' more' ELSE '' END AS entry,
            any_value(total) AS total FROM used JOIN (SELECT l1, count(*) AS held, count(*) OVER () AS total FROM used GROUP BY l1
                ORDER BY sum(files) DESC, l1 LIMIT 5) USING (l1) WHERE place <= 5 GROUP BY l1)""",
        {
            "used": """SELECT l1, l2, count(*) AS files, row_number() OVER (PARTITION BY l1 ORDER BY count(*) DESC, l2) AS place
            FROM (SELECT w[1] AS l1, w[2] AS l2 FROM (SELECT regexp_extract_all(lower(left(text, 200)), '[a-z]{2,}') AS w FROM documents))
            WHERE l2 IS NOT NULL GROUP BY l1, l2"""
        },
    ),
    "warm_cache_missing": """SELECT '/inbox/gone/' || doc_id || '/' || filename AS source_path, expected_category_l1, expected_needs_review
        FROM expected JOIN (SELECT source_path, doc_id, filename FROM named) USING (source_path) WHERE doc_id % 5 = 0""",
    "prompt_audit": f"""SELECT document_id, length(prompt) AS prompt_chars, left(prompt, 500) || CASE WHEN length(prompt) > 500 THEN '...' ELSE '' END AS excerpt
        FROM (SELECT document_id, {_UNDERSTAND} AS prompt FROM ids)""",
    "organize_run": """SELECT document_id, run_id, source_path, filename, file_hash, status, decision_source, category_l1, category_l2, confidence,
        needs_review, reason, destination_path, cached, summary, language, document_type, ocr_used, extraction_quality,
        understanding_model, classification_model, prompt_version, errors FROM plan""",
    "dry_run": """SELECT row_number() OVER (ORDER BY source_path) AS event_id, document_id, destination_path,
        CASE WHEN status = 'moved' THEN 'planned' ELSE status END AS status, true AS dry_run, nullif(errors, '') AS error_message FROM plan""",
    "decision_cache_rows": """SELECT file_hash, raw_l1 AS category_l1, raw_l2 AS category_l2, confidence, reason, needs_review, summary,
        TIMESTAMP '2024-02-01' AS cached_at FROM followed WHERE path = 'sorted' AND NOT follows""",
    "benchmark_flow": (
        "SELECT * REPLACE (CASE WHEN status = 'moved' THEN 'planned' ELSE status END AS status) FROM cases",
        {"inbox": CTES["inbox"] + " AND doc_id IN (SELECT doc_id FROM labels)"},
    ),
    "warm_cache": f"""SELECT file_hash, 'glm-ocr:q8_0' AS ocr_model, chosen AS extracted_text, {quality('chosen')} AS extraction_quality,
        TIMESTAMP '2024-02-01' AS cached_at FROM (SELECT *, coalesce(nullif(p.text, ''), extracted_text) AS chosen
            FROM (SELECT * EXCLUDE (text) FROM files) LEFT JOIN precomputed p USING (source_path))
        WHERE doc_id IN (SELECT doc_id FROM labels) AND chosen IS NOT NULL AND file_hash NOT IN (SELECT file_hash FROM extracted)
            AND file_hash NOT IN (SELECT file_hash FROM filed_rows) AND file_hash NOT IN (SELECT file_hash FROM decided)
        QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY source_path) = 1""",
    "legacy_organize": (
        """SELECT source_path AS original_path, filename AS original_filename, destination_path AS new_path,
        CASE WHEN category IS NOT NULL THEN unique_name END AS new_filename, coalesce(category, 'ERROR') AS category,
        CASE WHEN category IS NOT NULL THEN file_hash END AS file_hash, CASE WHEN category IS NOT NULL THEN file_size END AS file_size,
        category IS NOT NULL AND (known IS NOT NULL OR after_first) AS cached,
        CASE WHEN category IS NULL THEN CASE WHEN has_text THEN 'AI classification failed for ' || filename ELSE 'Empty content or unsupported file type' END END AS error_message
        FROM single LEFT JOIN single_named USING (document_id)""",
        _LEGACY,
    ),
    "rename_plan": (
        """SELECT document_id, source_path, folder AS category, destination_path AS new_path, unique_name AS new_filename,
        '/inbox/_Processed/' || aside AS processed_path FROM rename_requests JOIN rename_named USING (document_id)
        JOIN (SELECT document_id, unique_name AS aside FROM aside_named) USING (document_id)""",
        _LEGACY,
    ),
    "model_hook": f"""SELECT document_id, 'understand' AS stage, '{{"summary": "' || length({_UNDERSTAND}) || ' characters"}}' AS raw FROM ids""",
    "streaming_state": (
        """SELECT CASE WHEN source_path < '/inbox/4' THEN 'arrivals-batch-0' ELSE 'arrivals-batch-1' END AS run_id, source_path, destination_path,
        'moved' AS status, category_l1, category_l2 FROM stream_done JOIN stream_named USING (document_id)""",
        _STREAM,
    ),
    "streaming_organize": (
        """SELECT row_number() OVER (ORDER BY source_path) AS event_id, 'arrivals-batch-0' AS run_id, source_path, destination_path, 'moved' AS status,
        category_l1, category_l2, reason FROM stream_done JOIN stream_named USING (document_id)""",
        _STREAM,
    ),
}


def _strict() -> str:
    """The cases of a run with a higher threshold and no aliases, as one derived table."""
    level1 = sanitize("coalesce(nullif(raw_l1, ''), 'General')", "General")
    level2 = sanitize("coalesce(nullif(raw_l2, ''), 'Unsorted')", "Unsorted")
    other = {
        "raw_outcomes": CTES["raw_outcomes"].replace("0.55", "0.9"),
        "normal": f"""SELECT *, CASE WHEN is_filed_away THEN {level1} END AS n_l1,
            CASE WHEN is_filed_away THEN {level2} END AS n_l2 FROM outcomes""",
    }
    return with_ctes("SELECT * FROM cases", other)


def oracle_sql() -> dict[str, str]:
    made = {}
    counted = "total_cases, matched_level1, matched_level2, matched_review_flag, full_matches, failures"
    made["benchmark_compare"] = (
        f"SELECT 'default' AS config, {counted} FROM (SELECT {_COUNTERS} FROM ({with_ctes('SELECT * FROM cases')}))"
        f" UNION ALL SELECT 'strict', {counted} FROM (SELECT {_COUNTERS} FROM ({_strict()}))"
    )
    for name, final in FINALS.items():
        made[name] = with_ctes(final) if isinstance(final, str) else with_ctes(*final)
    return made
