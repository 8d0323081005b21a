"""Path, file-name and category-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.text import WHITESPACE_RUN, strip
from filewright.settings import UNPROCESSED

# Characters that may not stand in a folder or file name.
RESERVED = r'[<>:"/\\|?*\x00-\x1f]+'
RESERVED_IN_FILENAME = r'[\x00-\x1f<>:"|?*]+'

_SUFFIX = r"(?s)^.+(\.[^.]+)$"
_SPLIT_EXT = r"(?s)^(.*[^.].*)(\.[^.]*)$"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def suffix_of(filename: Column) -> Column:
    """The last dot and what follows; empty for ``.name`` and ``name.``."""
    return F.regexp_extract(filename, _SUFFIX, 1)


def stem_of(filename: Column) -> Column:
    return F.left(filename, F.length(filename) - F.length(suffix_of(filename)))


def extension_of(filename: Column) -> Column:
    return F.lower(suffix_of(filename))


def sanitize_component(name: Column, fallback: str) -> Column:
    kept = strip(F.regexp_replace(F.coalesce(name, F.lit("")), RESERVED, ""))
    short = F.substring(F.regexp_replace(kept, WHITESPACE_RUN, " "), 1, 100)
    return F.when(short == "", fallback).otherwise(short)


def sanitize_category(name: Column) -> Column:
    return sanitize_component(name, UNPROCESSED)


def sanitize_filename(name: Column, original_ext: Column) -> Column:
    """Safe file name of at most 200 characters that ends in the original extension."""
    dashed = F.regexp_replace(name, r"[\\/]+", "-")
    cleaned = strip(F.regexp_replace(dashed, RESERVED_IN_FILENAME, ""))
    base = F.when(name.isNull() | (name == ""), "file").otherwise(cleaned)
    root = F.when(base.rlike(_SPLIT_EXT), F.regexp_extract(base, _SPLIT_EXT, 1)).otherwise(base)
    named = F.when(F.endswith(F.lower(base), F.lower(original_ext)), base).otherwise(F.concat(root, original_ext))
    return F.substring(named, 1, 200)


def restored_name(filename: Column) -> Column:
    return F.concat(stem_of(filename), F.lit("_restored"), suffix_of(filename))


def with_number(filename: Column, number: Column) -> Column:
    """``name.ext`` for 0, ``name_3.ext`` for 3."""
    numbered = F.concat(stem_of(filename), F.lit("_"), number.cast("string"), suffix_of(filename))
    return F.when(number == 0, filename).otherwise(numbered)
