"""Personal data by weak supervision, in DataFrame and SQL functions only.

Four base patterns give spans that always stay. Wider patterns give further
candidates. For each span labelers vote for, against or not at all: its format,
a checksum or range, a gazetteer, the words before it and the characters around it.
Expectation-maximisation over the vote patterns, a table whose size does not depend
on the data, estimates how reliable each labeler is. The resulting chances train a
naive Bayes classifier over features of the span, which decides on the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filewright.llm.store import attach, fresh, stage

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "id", "name")

# Base patterns. The possessive forms match the same strings as greedy ones, without backtracking or recursion;
# a run of characters that failed from its start is not tried again from its middle.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Wider patterns, one alternation; the shape of a match tells its kind.
SECRET = r"(?<=(?:token|secret|passwd|password|api_key|apikey)[\x20]{0,2}[=:][\x20]{0,2}[\"']?)[A-Za-z0-9_/+-]{16,}+"
WRITTEN_MAIL = r"[A-Za-z0-9_%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}){1,4}"
LOCAL_PHONE = r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"
NUMBERED = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b"
NAMED = r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{L}{1,30}(?: \p{Lu}\p{L}{1,30})?"
WIDER = "|".join((SECRET, WRITTEN_MAIL, LOCAL_PHONE, NUMBERED, NAMED))
WIDER_HINT = r"[Tt]oken|[Ss]ecret|[Pp]assw|api_?key|[\[(]at[\])]|[0-9]{3}[)\x20.-]|[A-Z]{2}[0-9]{2}|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|M[ao]|Se)"

# Words that tell of the kind before a span, top-level domains, and first names: short gazetteers.
HINTS = {
    "email": r"(?i)\b(?:e?-?mail|contact|write|kontakt|correo|courriel|address)\W*$",
    "ip": r"(?i)\b(?:ip|host|server|addr|address)\W*$",
    "card": r"(?i)\b(?:card|visa|master|amex|karte|tarjeta|carte|payment|account)\W*$",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|teléfono|téléphone|ruf)\W*$",
    "secret": r"(?i)\b(?:token|secret|passwd|password|api_?key)\s*[=:]\s*[\"']?$",
    "id": r"(?i)\b(?:ssn|iban|id|passport|konto|cuenta|compte|number|no)\W*$",
    "name": r"(?i)\b(?:dear|from|by|name|signed|liebe|lieber|querido|cher|chère)\W*$",
}
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
FIRST_NAMES = r"\b(?:James|Mary|John|Anna|Peter|Maria|Hans|Julia|Pierre|Marie|Juan|Carmen|Paul|Laura|Thomas|Sarah)\b"

PART = "pattern:string,at:int,gap:bigint,match:string,before:string,head:string"
LABELERS = ("format", "checksum", "gazetteer", "context", "edges")
ROUNDS = 25
# What the estimate starts from and is drawn to: chance of personal data, and of a right vote by each labeler.
START_CHANCE, START_RELIABLE, PSEUDO_COUNT = 0.5, 0.8, 4.0
ACCEPT = 0.5


def _found(text: Column, pattern: str, kind: str, when: Column) -> Column:
    """The gaps between matches with the match after each, NULL after the last; empty without a match or where ``when`` is false."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )
    rows = F.transform(
        parts,
        lambda x, at: F.struct(
            F.lit(kind).alias("pattern"),
            at.alias("at"),
            F.length(x["gap"]).cast("long").alias("gap"),
            x["match"].alias("match"),
            F.substring(x["gap"], -40, 40).alias("before"),
            F.substring(x["gap"], 1, 1).alias("head"),
        ),
    )
    rows = F.filter(rows, lambda x: x["match"].isNotNull() | (x["at"] > 0))
    return F.coalesce(F.when(when, rows), F.array().cast(f"array<struct<{PART}>>"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(places, lambda d: d != ""),
            lambda d, at: F.when(at % 2 == 0, d.cast("int")).otherwise(
                d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda sum_, d: sum_ + d,
    )
    return total % 10 == 0


def _matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per match of any pattern, with its place in code points."""
    text = F.col("text")
    read = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")
    ).select(
        "id",
        "digest",
        F.monotonically_increasing_id().alias("row"),
        F.concat(
            _found(text, EMAIL, "email", text.contains("@")),
            _found(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]")),
            _found(text, CARD, "card", text.rlike("[0-9]")),
            _found(text, PHONE, "phone", text.contains("+")),
            _found(text, WIDER, "wider", text.rlike(WIDER_HINT)),
        ).alias("found"),
    )
    rows = stage(read.where(F.size("found") > 0).select("id", "digest", "row", F.inline("found")), "matches")
    upto = Window.partitionBy("row", "pattern").orderBy("at")
    end = F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(upto)
    placed = rows.withColumn("end", end).withColumn("after", F.lead("head", 1, "").over(upto)).where("match IS NOT NULL")
    return placed.withColumn("start", F.col("end") - F.length("match"))


def _judged(matches: DataFrame) -> DataFrame:
    """Spans with their kind, whether they are base spans, and the votes (1, -1 or 0) of the labelers."""
    match, pattern = F.col("match"), F.col("pattern")
    digits = _digits(match)
    size = F.length(digits)
    kind = F.when(pattern != "wider", pattern)
    kind = (
        kind.when(match.rlike("^(?:" + WRITTEN_MAIL + ")$"), "email")
        .when(match.rlike(r"^[0-9(][0-9) .-]*[0-9]$") & (size == 10), "phone")
        .when(match.rlike(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9 ]+)$"), "id")
        .when(match.rlike(r"^(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\b"), "name")
        .otherwise("secret")
    )
    kind = F.when((kind == "id") & F.col("before").rlike(HINTS["secret"]), "secret").otherwise(kind)
    card = F.coalesce(size.between(16, 19) & _luhn(digits), F.lit(False))
    base = (
        F.when(pattern == "email", True)
        .when(pattern == "ip", match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
        .when(pattern == "card", card)
        .when(pattern == "phone", size.between(8, 15))
        .otherwise(False)
    )
    named = matches.withColumn("kind", kind).withColumn("base", base).withColumn("size", size)
    # A long run of digits that is no number of a card by its length, and failed numbers of other kinds, are no candidates.
    named = named.where(F.col("base") | (pattern == "wider") | ((pattern == "card") & size.between(16, 19)))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    kind = F.col("kind")
    last, first = F.substring("before", -1, 1), F.col("after")
    hint = F.lit(False)
    for name, words in HINTS.items():
        hint = F.when(kind == name, F.col("before").rlike(words)).otherwise(hint)
    mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return named.select(
        "id",
        "digest",
        "row",
        "kind",
        "base",
        "start",
        "end",
        F.when(kind.isin("name", "secret"), F.length(match)).otherwise(F.col("size")).alias("size"),
        match.rlike(r"[\x20().-]").alias("grouped"),
        last.rlike(r"[\p{L}\p{N}]").alias("glued"),
        vote(F.col("base") | (kind == "secret") & mixed | (pattern == "wider") & (kind != "secret"), ~F.col("base") & (pattern == "card")).alias("format"),
        vote((kind == "card") & F.col("base"), (kind == "card") & ~F.col("base")).alias("checksum"),
        vote((kind == "email") & match.rlike(DOMAINS) | match.rlike(FIRST_NAMES), (kind == "secret") & ~mixed).alias("gazetteer"),
        vote(hint, F.lit(False)).alias("context"),
        vote(F.lit(False), last.rlike(r"[\p{L}\p{N}_]") | first.rlike(r"[\p{L}\p{N}_]")).alias("edges"),
    )


def reliabilities(spans: DataFrame) -> DataFrame:
    """(kind, chance, reliable) by expectation-maximisation over the counts of each pattern of votes.

    There are at most 3 to the power of five patterns a kind, so a kind's patterns fit one row.
    """
    patterns = spans.groupBy("kind", *LABELERS).agg(F.count("*").cast("double").alias("n"))
    votes = F.array(*(F.col(name).cast("double") for name in LABELERS))
    rows = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(votes.alias("v"), "n"))).alias("patterns"))
    places = range(len(LABELERS))
    likely = lambda state, sign: " * ".join(
        f"CASE x.v[{j}] WHEN {sign} THEN {state}.r[{j}] WHEN {-sign} THEN 1 - {state}.r[{j}] ELSE 1D END" for j in places
    )
    posterior = f"(s.c * {likely('s', 1)}) / (s.c * {likely('s', 1)} + (1 - s.c) * {likely('s', -1)})"
    judged = f"transform(patterns, x -> struct(x.v AS v, x.n AS n, {posterior} AS p))"
    total = lambda rows, value: f"aggregate({rows}, 0D, (t, y) -> t + {value})"
    update = f"""transform(array({judged}), q -> struct(
        ({total('q', 'y.n * y.p')} + {PSEUDO_COUNT * START_CHANCE}D) / ({total('q', 'y.n')} + {PSEUDO_COUNT}D) AS c,
        array({', '.join(f'''least(0.99D, greatest(0.5D, ({total('q', f"y.n * CASE y.v[{j}] WHEN 1 THEN y.p WHEN -1 THEN 1 - y.p ELSE 0D END")} + {PSEUDO_COUNT * START_RELIABLE}D)
            / ({total('q', f"y.n * abs(y.v[{j}])")} + {PSEUDO_COUNT}D)))''' for j in places)}) AS r))[0]"""
    start = f"named_struct('c', {START_CHANCE}D, 'r', array_repeat({START_RELIABLE}D, {len(LABELERS)}))"
    estimate = F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, round) -> {update})")
    return rows.select("kind", estimate.alias("e")).select("kind", F.col("e.c").alias("chance"), F.col("e.r").alias("reliable"))


FEATURES = ("f_size", "f_grouped", "f_glued", "f_votes")


def _described(spans: DataFrame) -> DataFrame:
    """Features of a span, each with few values."""
    size = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("string")
    return (
        spans.withColumn("f_size", size)
        .withColumn("f_grouped", F.col("grouped").cast("string"))
        .withColumn("f_glued", F.col("glued").cast("string"))
        .withColumn("f_votes", F.concat_ws(",", *(F.col(name).cast("string") for name in LABELERS)))
    )


def classify(spans: DataFrame) -> DataFrame:
    """``spans`` with the chance that each is personal data, by naive Bayes trained on the estimated chances."""
    known = reliabilities(spans)
    right, wrong = F.col("chance"), 1 - F.col("chance")
    for j, name in enumerate(LABELERS):
        reliable = F.col("reliable")[j]
        right = right * F.when(F.col(name) == 1, reliable).when(F.col(name) == -1, 1 - reliable).otherwise(1.0)
        wrong = wrong * F.when(F.col(name) == -1, reliable).when(F.col(name) == 1, 1 - reliable).otherwise(1.0)
    described = _described(spans.join(known, "kind").withColumn("posterior", right / (right + wrong)).drop("chance", "reliable"))
    cells = described.groupBy("kind", *FEATURES).agg(
        F.sum("posterior").alias("yes"), F.sum(1 - F.col("posterior")).alias("no")
    )
    listed = cells.select(
        "kind", "yes", "no", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES))).alias("x")
    )
    counts = listed.groupBy("kind", "x.feature", "x.value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    totals = cells.groupBy("kind").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    odds = F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 1)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 1))
    key = F.concat_ws("=", "feature", "value")
    model = (
        counts.join(totals, "kind")
        .groupBy("kind")
        .agg(
            F.map_from_entries(F.collect_list(F.struct(key, odds))).alias("odds"),
            F.first(F.log((F.col("all_yes") + 0.5) / (F.col("all_no") + 0.5))).alias("prior"),
        )
    )
    total = F.col("prior")
    for feature in FEATURES:
        total = total + F.coalesce(F.element_at("odds", F.concat(F.lit(f"{feature}="), F.col(feature))), F.lit(0.0))
    return described.join(model, "kind").withColumn("score", 1 / (1 + F.exp(-total))).drop("odds", "prior", *FEATURES)


def spans_by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, spans): the spans of every text that has any, base or accepted, in the order of kind and start."""
    judged = stage(_judged(_matches(docs, id_col, text_col)), "judged-spans")
    scored = classify(judged).where(F.col("base") | (F.col("score") >= ACCEPT))
    order = F.array_position(F.array(*(F.lit(kind) for kind in KINDS + EXTRA_KINDS)), F.col("kind")).cast("int")
    span = F.struct(order.alias("order"), "start", "end", "kind", "base")
    rows = scored.groupBy("id", "digest", "row").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    return rows.drop("row").dropDuplicates(["id", "digest"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, base) of every row of ``docs``: arrays of all spans and of the base spans.

    Places are in code points, ends exclusive. NULL and empty texts have no spans. Rows
    that share id and text share their result. An empty table gives no rows. Where
    a kind has no span, nothing is estimated for it.
    """
    found = spans_by_document(docs, id_col, text_col).withColumnsRenamed({"id": "i", "digest": "d"})
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    none = F.array().cast("array<struct<order:int,start:bigint,end:bigint,kind:string,base:boolean>>")
    rows = keys.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    spans = F.coalesce("spans", none)
    return rows.select("id", spans.alias("spans"), F.filter(spans, lambda x: x["base"]).alias("base"))


def digest(found: DataFrame) -> DataFrame:
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.select("id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    found = spans_by_document(docs, id_col, text_col)
    one, two, sought, mark = (fresh(docs, name) for name in ("pii_id", "pii_digest", "pii_spans", "text_digest"))
    facts = stage(found, "pii-spans").toDF(one, two, sought)
    joined = attach(docs.withColumn(mark, F.xxhash64(text_col)), [id_col, mark], facts, [one, two])
    text = f"`{text_col}`"
    cut = F.expr(f"""aggregate(array_sort(transform(`{sought}`, x -> struct(x.start AS s, x.end AS e, x.kind AS k))),
        named_struct('at', 0L, 'out', ''),
        (t, x) -> named_struct('at', greatest(t.at, x.e),
            'out', CASE WHEN x.s < t.at THEN t.out
                ELSE concat(t.out, substring({text}, cast(t.at + 1 AS int), cast(x.s - t.at AS int)), '<', x.k, '>') END),
        t -> concat(t.out, substring({text}, cast(t.at + 1 AS int))))""")
    out = F.when(F.col(sought).isNotNull(), cut).otherwise(F.col(text_col))
    return joined.select(*(out.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
