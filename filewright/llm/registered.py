"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filewright.llm import blocking, crosspolytope, extraction, golay, language, order_minhash, packing, pii, repair, sharding, suffixes, toxicity, winnowing


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text", "lang")
    return language.languages(docs).withColumnRenamed("id", "doc_id")


def op3_crosspolytope(spark: SparkSession, folder: str) -> DataFrame:
    found = crosspolytope.near_duplicates(_table(spark, folder, "embeddings", "vec_id", "embedding"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, folder, "documents", "doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(_table(spark, folder, "documents", "doc_id", "text"))
    return pii.digest(found).withColumnRenamed("id", "doc_id")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shards(_table(spark, folder, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.contamination(
        _table(spark, folder, "documents", "doc_id", "text"), _table(spark, folder, "benchmark", "item_id", "text")
    )
    return winnowing.digest(found).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return toxicity.toxicity(docs, _table(spark, folder, "labels", "doc_id", "toxic")).withColumnRenamed("id", "doc_id")


def op9_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(_table(spark, folder, "pages", "page_id", "url", "html"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = golay.near_duplicates(_table(spark, folder, "documents", "doc_id", "text"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), text.alias("fingerprint"), F.col("component").alias("component_id"))


def op11_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = order_minhash.edited(_table(spark, folder, "documents", "doc_id", "text"))
    return order_minhash.digest(found).withColumnRenamed("id", "doc_id")


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damage_summary(_table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


def op13_blocking(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    ranked = blocking.rank(docs, _table(spark, folder, "benchmark", "item_id", "text"))
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_crosspolytope": op3_crosspolytope,
    "op4_suffixes": op4_suffixes,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_extraction": op9_extraction,
    "op10_simhash": op10_simhash,
    "op11_order_minhash": op11_order_minhash,
    "op12_repair": op12_repair,
    "op13_blocking": op13_blocking,
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TERMS = WORDS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")

BLANK = r"[\x20\x09-\x0D]"


def _least(*offers: str) -> str:
    """The cheapest edits of several, the least audit among equal costs."""
    return f"list_sort([{', '.join(offers)}], 'ASC', 'NULLS LAST')[1]"


def _edit(state: str, when: str, cost: str, letter: str, line: str = "''") -> str:
    """The edits up to ``state`` and one more, if there are any and it is allowed."""
    more = f"{{'c': ({state}).c + ({cost}), 'a': ({state}).a || '{letter}', 'o': ({state}).o || {line}}}"
    return f"CASE WHEN ({state}) IS NOT NULL AND ({when}) THEN {more} END"


def _turn(state: str, initial: str, role: str) -> str:
    """A turn after ``state`` that has or gets a role."""
    keep = _edit(state, f"may AND initial = '{initial}'", "cut", "K", "chr(10) || role || ':' || text")
    if initial == "s":
        return keep
    return _least(keep, _edit(state, "may", "3 + cut", "R", f"chr(10) || '{role}:' || text"))


def _insert(state: str, role: str) -> str:
    return _edit(state, "true", "3", "I", f"chr(10) || '{role}:'")


_DROP = ("true", "4", "D")
REPAIR_SQL = f"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
), faulty AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    )) % 20 AS f FROM raw
), damaged AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM faulty
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
        regexp_replace(text, '{BLANK}+$', '') AS seen FROM damaged
), marked AS (
    SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM numbered
), messages AS (
    SELECT conv_id, k, turn, role, text, left(role, 1) AS initial, blank, again, NOT blank AND NOT again AS may,
        NOT blank AND NOT again AND right(seen, 1) NOT IN ('.', '!', '?') AS truncated,
        CASE WHEN right(seen, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS previous
    FROM marked
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count_if(blank) AS blank, count_if(again) AS duplicate, count_if(truncated) AS truncated,
        count_if(previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM messages GROUP BY conv_id
), walk(conv_id, k, x0, x1, x2, x3) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'o': ''}}, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)),
        CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)), CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR))
    FROM messages
    UNION ALL
    SELECT conv_id, k, {_edit("x0", *_DROP)}, {_least(_edit("x1", *_DROP), _turn("x0", "s", ""))},
        {_least(_edit("z2", *_DROP), _turn("x0", "u", "user"), _turn("x1", "u", "user"), _turn("z3", "u", "user"))},
        {_least(_edit("z3", *_DROP), _turn("z2", "a", "assistant"))}
    FROM (
        SELECT *, {_least("x3", _insert("z2", "assistant"))} AS z3
        FROM (
            SELECT m.conv_id, m.k, m.role, m.text, m.initial, m.may, m.cut, x0, x1, x3,
                {_least("x2", _insert("x0", "user"), _insert("x1", "user"), _insert("x3", "user"))} AS z2
            FROM walk AS w JOIN messages AS m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1
        )
    )
), ended AS (
    SELECT c.*, {_least("x0", "x3", _insert("x2", "assistant"), _insert(_insert("x1", "user"), "assistant"))} AS best
    FROM walk AS w JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
    sha256(coalesce(substr(best.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN ended AS e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op12_repair": REPAIR_SQL,
    "op3_crosspolytope": f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {crosspolytope.THRESHOLD}
), reached(x, y) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reached AS r JOIN links AS l ON r.y = l.x
), counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT r.x AS vec_id, CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM reached AS r LEFT JOIN counted AS c ON r.x = c.x GROUP BY r.x
""",
    "op6_sharding": f"""
WITH k AS (
    SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
    FROM documents
), p AS (
    SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, key >> (60 - depth) AS prefix FROM k, range(0, 41) AS t(depth)
), cells AS (
    SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY depth, prefix
), fits AS (
    SELECT p.*, shard_bytes, shard_rows FROM p JOIN cells USING (depth, prefix)
    WHERE shard_bytes <= {sharding.SHARD_BYTES} OR shard_rows = 1
)
SELECT doc_id, n_bytes, depth, depth || '-' || prefix AS shard, shard_bytes, shard_rows
FROM fits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hits AS (SELECT doc_id, s, n, item FROM dw JOIN iw USING (n, win)),
covered AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op13_blocking": f"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
i AS (SELECT DISTINCT item_id, {TERMS} AS t FROM benchmark),
total AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
asked AS (SELECT DISTINCT item_id, t AS item, unnest(t) AS term FROM i),
tf AS (SELECT rowid_ AS doc, doc_id, n, term, count(*) AS tf FROM (
    SELECT row_number() OVER () AS rowid_, doc_id, len(t) AS n, unnest(t) AS term FROM d
) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scores AS (
    SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS score
    FROM tf JOIN w USING (term), total
), ranked AS (
    SELECT item_id, item, doc, doc_id, CAST(sum(score) AS BIGINT) AS score
    FROM asked JOIN scores USING (term) GROUP BY item_id, item, doc, doc_id HAVING sum(score) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM ranked QUALIFY rank <= 50
""",
}
