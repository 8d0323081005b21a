"""Text expressions. All are row-local and stay in the JVM.

Short ones are built from columns. Those that a run applies to several texts
take the name of a text column and are written as SQL, which Spark parses in
one go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of every character that counts as white space.
_SPACES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(point) for low, high in _SPACES for point in range(low, high + 1))
WHITESPACE_RUN = "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in _SPACES) + "]+"

# The marks put where a preview leaves text out.
SKIPPED = " ... [CONTENT SKIPPED] ... "
SKIPPED_LINE = "\n... [CONTENT SKIPPED] ...\n"

# Smallest stripped length and the score it earns.
QUALITY_STEPS = ((4000, 0.95), (1000, 0.8), (250, 0.6), (50, 0.35))
QUALITY_FLOOR = 0.15

# The shape of a keyword and the words that mark Portuguese.
KEYWORD_PATTERN = r"[a-z][a-z0-9_-]{3,}"
PORTUGUESE_WORDS = ("nao", "para", "uma", "documento", "arquivo")


def literal(value: str) -> str:
    """A string as a SQL literal."""
    plain = "".join(c if " " <= c <= "~" and c not in "'\\" else f"\\u{ord(c):04x}" for c in value)
    return f"'{plain}'"


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), WHITESPACE_RUN, " ")


def quality_score(text: str) -> Column:
    """Score by stripped length; 0 for no text, the lowest step for white space."""
    steps = " ".join(f"WHEN size >= {least} THEN {value}D" for least, value in QUALITY_STEPS)
    score = f"CASE {steps} ELSE {QUALITY_FLOOR}D END"
    length = f"length(btrim({text}, {literal(WHITESPACE)}))"
    return F.expr(f"CASE WHEN coalesce({text}, '') = '' THEN 0D ELSE transform(array({length}), size -> {score})[0] END")


def _cut(text: Column, limit: int, head: int, tail: int, mark: str) -> Column:
    short = F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > limit, short).otherwise(text)


def preview(text: Column, limit: int) -> Column:
    """Collapsed text; a long one keeps 60 % head and 40 % tail of the limit."""
    head = int(limit * 0.6)
    return _cut(collapse(F.coalesce(text, F.lit(""))), limit, head, limit - head, SKIPPED)


def preview_head_tail(text: Column, limit: int = 20_000, head: int = 14_500, tail: int = 5_000) -> Column:
    """Preview of the first generation: no collapsing."""
    return _cut(text, limit, head, tail, SKIPPED_LINE)


def preview_head_tail_collapsed(text: Column) -> Column:
    return collapse(preview_head_tail(text))


def preview_two_thirds(text: Column, limit: int) -> Column:
    head = limit * 2 // 3
    return collapse(_cut(text, limit, head, limit - head, SKIPPED_LINE))


def excerpt(text: Column, limit: int) -> Column:
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("..."))).otherwise(cut)


def summary(text: str) -> Column:
    """Stripped text, its first 240 characters if longer; NULL when nothing is left."""
    stripped = f"btrim({text}, {literal(WHITESPACE)})"
    short = f"concat(left({stripped}, 240), '...')"
    return F.expr(f"nullif(CASE WHEN length({stripped}) > 240 THEN {short} ELSE {stripped} END, '')")


def guess_language(text: str) -> Column:
    # Most texts hold none of the words, which a plain search finds out faster.
    present = " OR ".join(f"contains(lower({text}), '{word}')" for word in PORTUGUESE_WORDS)
    pattern = literal(rf"(?U)\b({'|'.join(PORTUGUESE_WORDS)})\b")
    return F.expr(f"CASE WHEN ({present}) AND lower({text}) RLIKE {pattern} THEN 'pt-BR' ELSE 'en' END")


def strip_html(html: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 when they are valid UTF-8, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def top_keywords(text: str, stop_words: Sequence[str], k: int = 8) -> Column:
    """The k most frequent words, ties in alphabetical order.

    Words are counted inside the row: the sorted word array is cut where the
    word changes, and the distance between cuts is the count. Nothing is
    shuffled, and the work per row is that of one sort.

    ``transform(array(x), v -> ...)[0]`` names a value, so that it is made once.
    """
    words = f"sort_array(regexp_extract_all(lower({text}), {literal(KEYWORD_PATTERN)}, 0))"
    places = "CASE WHEN size(s) > 0 THEN sequence(0, size(s) - 1) ELSE cast(array() AS array<int>) END"
    ends = f"filter({places}, at -> NOT get(s, at) <=> get(s, at + 1))"
    counts = "transform(e, (at, i) -> struct(coalesce(get(e, i - 1), -1) - at AS minus_count, get(s, at) AS word))"
    # Only the stop words can be dropped, so k + their number is enough to look at.
    leaders = f"transform(slice(sort_array({counts}), 1, {k + len(stop_words)}), c -> c.word)"
    dropped = f"array({', '.join(literal(word) for word in stop_words)})"
    kept = f"filter({leaders}, w -> NOT array_contains({dropped}, w))" if stop_words else leaders
    picked = f"transform(array({words}), s -> transform(array({ends}), e -> slice({kept}, 1, {k}))[0])[0]"
    return F.expr(f"coalesce({picked}, cast(array() AS array<string>))")


def rows_as_text(*columns: Column) -> Column:
    """One table row as ``a | b | c`` without empty cells; NULL when all are empty."""
    cells = [F.when(c.cast("string") != "", strip(c.cast("string"))) for c in columns]
    return F.nullif(F.concat_ws(" | ", *cells), F.lit(""))
