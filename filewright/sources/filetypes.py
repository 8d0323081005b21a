"""What is known about a file from its extension."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.paths import stem_of, suffix_of

# Extension and the extractor that reads it.
EXTRACTOR_BY_EXTENSION = {
    ".pdf": "pdf",
    ".docx": "docx",
    ".doc": "doc",
    ".pptx": "pptx",
    ".ppt": "ppt",
    ".xlsx": "xlsx",
    ".xls": "xls",
    ".eml": "eml",
    ".msg": "msg",
    ".txt": "text",
    ".md": "text",
    ".csv": "text",
    ".log": "text",
    ".json": "text",
    ".xml": "text",
    ".html": "text",
    ".htm": "text",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
}

# Extractors whose text arrives from elsewhere, as precomputed text.
EXTERNAL_EXTRACTORS = ("pdf", "image", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "eml", "msg")


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{key}', '{value}'" for key, value in mapping.items()) + ")")


def extractor_name(extension: Column) -> Column:
    return F.coalesce(F.try_element_at(_literal_map(EXTRACTOR_BY_EXTENSION), extension), F.lit("unsupported"))


def unsupported_error(extension: Column) -> Column:
    shown = F.coalesce(F.nullif(extension, F.lit("")), F.lit("<none>"))
    return F.concat(F.lit("Unsupported file type: "), shown)


def mime_type(filename: Column) -> Column:
    """Standard type of the extension; a compression suffix is looked through."""
    table = mimetypes.MimeTypes()
    compressed = list(table.encodings_map)
    expanded = F.lit(None).cast("string")
    for short, long in table.suffix_map.items():
        expanded = F.when(F.lower(suffix_of(filename)) == short, F.substring_index(F.lit(long[1:]), ".", 1)).otherwise(
            expanded
        )
    inner = F.when(expanded.isNotNull(), F.concat(F.lit("."), expanded)).when(
        suffix_of(filename).isin(*compressed), suffix_of(stem_of(filename))
    )
    types = {ext: name for ext, name in table.types_map[True].items()}
    return F.try_element_at(_literal_map(types), F.lower(F.coalesce(inner, suffix_of(filename))))
