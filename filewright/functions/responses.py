"""Model answers: JSON out of raw text, then typed fields.

An answer is one of three things. ``empty`` (no JSON, or an empty value) means
the fallback decides. ``object`` with usable fields is taken as it is. All else
is ``invalid``, and the document fails with an error.

Each step adds plain columns, so that a value used many times is made once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filewright.functions.text import WHITESPACE, literal

UNDERSTANDING_TEXTS = ("summary", "language", "document_type")
UNDERSTANDING_LISTS = ("keywords", "content_signals")
CLASSIFICATION_TEXTS = ("category_l1", "category_l2", "reason")

# Fixed value: how many keywords and signals of an answer are kept.
LIST_LIMIT = 8


def parse_answer(raw: str) -> Column:
    """The whole text as JSON, else the slice from the first ``{`` to the last ``}``."""
    braces = literal(r"(?s)\{.*\}")
    return F.expr(f"coalesce(try_parse_json({raw}), try_parse_json(regexp_extract({raw}, {braces}, 0)))")


def with_fields(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the variant of each field of ``payload``, and its JSON type as ``<name>_type``.

    The type is NULL for an absent field. ``payload_type`` is added as well.
    """
    values = [f"try_variant_get(payload, '$.{name}', 'variant') AS {name}" for name in names]
    kinds = [f"schema_of_variant({name}) AS {name}_type" for name in ("payload", *names)]
    return rows.selectExpr("*", *values).selectExpr("*", *kinds)


def _as(name: str, shape: str) -> str:
    return f"try_variant_get({name}, '$', '{shape}')"


def _stripped(name: str) -> str:
    return f"btrim({_as(name, 'string')}, {literal(WHITESPACE)})"


def truthy(name: str, parse_bool_strings: bool = False) -> str:
    """SQL: empty and zero values are false, as is an absent one."""
    worded = f"lower({_stripped(name)}) NOT IN ('false', 'no', '0', '')"
    text = worded if parse_bool_strings else f"{_as(name, 'string')} != ''"
    return f"""coalesce(CASE
        WHEN {name}_type = 'VOID' THEN false
        WHEN {name}_type = 'STRING' THEN {text}
        WHEN {name}_type = 'BOOLEAN' THEN {_as(name, 'boolean')}
        WHEN {name}_type LIKE 'ARRAY%' THEN size({_as(name, 'array<variant>')}) > 0
        WHEN {name}_type LIKE 'OBJECT%' THEN {name}_type != 'OBJECT<>'
        ELSE {_as(name, 'double')} != 0 END, false)"""


def _text(name: str) -> str:
    return f"CASE WHEN {name}_type = 'STRING' THEN {_as(name, 'string')} END"


def _list(name: str) -> str:
    kind, plain = "schema_of_variant(item)", _as("item", "string")
    item = f"""CASE
        WHEN {kind} = 'VOID' THEN 'None'
        WHEN {kind} = 'BOOLEAN' THEN initcap({plain})
        WHEN {kind} LIKE 'ARRAY%' OR {kind} LIKE 'OBJECT%' THEN to_json(item)
        ELSE {plain} END"""
    text = _as(name, "string")
    return f"""slice(CASE
        WHEN {name}_type LIKE 'ARRAY%' THEN transform({_as(name, 'array<variant>')}, item -> {item})
        WHEN {name}_type = 'STRING' AND {text} != '' THEN split({text}, '')
        WHEN {name}_type LIKE 'OBJECT%' THEN json_object_keys(to_json({name}))
        ELSE cast(array() AS array<string>) END, 1, {LIST_LIMIT})"""


def _confidence(name: str) -> str:
    """SQL: number or numeric text; empty values are 0; NULL when unusable."""
    return f"""CASE
        WHEN NOT {truthy(name)} THEN 0D
        WHEN {name}_type = 'STRING' THEN try_cast({_stripped(name)} AS double)
        WHEN {name}_type = 'BOOLEAN' THEN 1D
        WHEN {name}_type NOT LIKE 'ARRAY%' AND {name}_type NOT LIKE 'OBJECT%' THEN {_as(name, 'double')} END"""


def _usable_text(name: str) -> str:
    return f"coalesce({name}_type IN ('STRING', 'VOID'), true)"


def _usable_list(name: str) -> str:
    return f"coalesce({name}_type = 'STRING' OR {name}_type LIKE 'ARRAY%' OR {name}_type LIKE 'OBJECT%', true)"


def _state(*usable: str) -> str:
    good = " AND ".join(f"({condition})" for condition in usable)
    return f"""CASE
        WHEN NOT {truthy('payload')} THEN 'empty'
        WHEN payload_type LIKE 'OBJECT%' AND {good} THEN 'object'
        ELSE 'invalid' END"""


def _typed(rows: DataFrame, name: str, state: str, fields: dict[str, str]) -> DataFrame:
    """Add a struct of the state and the fields, which are NULL unless the answer is usable."""
    values = ", ".join(f"CASE WHEN state = 'object' THEN {sql} END AS {field}" for field, sql in fields.items())
    typed = with_fields(rows, list(fields)).selectExpr("*", f"{state} AS state")
    return typed.selectExpr(*rows.columns, f"struct(state, {values}) AS {name}")


def typed_understanding(rows: DataFrame) -> DataFrame:
    """Add the struct ``understood`` to rows with a ``payload``."""
    texts, lists = UNDERSTANDING_TEXTS, UNDERSTANDING_LISTS
    state = _state(*map(_usable_text, texts), *map(_usable_list, lists))
    fields = {**{name: _text(name) for name in texts}, **{name: _list(name) for name in lists}}
    return _typed(rows, "understood", state, fields)


def typed_classification(rows: DataFrame, parse_bool_strings: bool = False) -> DataFrame:
    """Add the struct ``classified`` to rows with a ``payload``."""
    texts = CLASSIFICATION_TEXTS
    state = _state(*map(_usable_text, texts), f"{_confidence('confidence')} IS NOT NULL")
    fields = {
        **{name: _text(name) for name in texts},
        "confidence": _confidence("confidence"),
        "needs_review": truthy("needs_review", parse_bool_strings),
    }
    return _typed(rows, "classified", state, fields)


def answered_text(name: str) -> Column:
    """A field of ``payload`` that must be a non-empty string, else NULL.

    Use on rows that went through ``with_fields``.
    """
    return F.expr(f"CASE WHEN payload_type LIKE 'OBJECT%' THEN nullif({_text(name)}, '') END")
