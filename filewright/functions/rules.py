"""Ordered classification rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from filewright.functions.text import literal
from filewright.settings import Rule

# Fixed value: how much of the text the rules look at.
RULE_HEAD = 1000

VERDICT = "struct<category_l1:string,category_l2:string,confidence:double,reason:string>"


def _condition(text: str, pattern: str) -> str:
    """SQL: whether a pattern is found in lower-cased text, whatever the case of the pattern.

    An alternative that is plain text, but for word boundaries and escaped dots,
    is looked for as text first. That is several times faster than a regular
    expression, which then only has to settle the boundaries.
    """
    if re.search(r"[()\[\]{}*+?^$]", pattern):
        return f"{text} RLIKE {literal('(?iU)' + pattern)}"
    found = []
    for alternative in pattern.split("|"):
        matches = f"{text} RLIKE {literal('(?iU)' + alternative)}"
        plain = alternative.replace(r"\b", "").replace(r"\.", ".").lower()
        special = alternative.replace(r"\b", "").replace(r"\.", "")
        if not plain or not plain.isascii() or "\\" in special or "." in special:
            found.append(matches)
        elif r"\b" in alternative:
            found.append(f"(contains({text}, {literal(plain)}) AND {matches})")
        else:
            found.append(f"contains({text}, {literal(plain)})")
    return "(" + " OR ".join(found) + ")"


def first_rule(text: str, rules: Sequence[Rule]) -> Column:
    """Index of the first rule that matches a SQL text expression, NULL when none does."""
    # Two letters equal an ASCII letter when case is ignored, yet are lower case themselves.
    folded = f"replace(replace(lower({text}), '\u0131', 'i'), '\u017f', 's')"
    cases = [f"WHEN {_condition('t', rule.pattern)} THEN {index}" for index, rule in enumerate(rules)]
    if not cases:
        return F.lit(None).cast("int")
    return F.expr(f"transform(array({folded}), t -> CASE {' '.join(cases)} END)[0]")


def rule_for_name(filename: str, rules: Sequence[Rule]) -> Column:
    return first_rule(filename, rules)


def rule_for_text(text: str, rules: Sequence[Rule]) -> Column:
    return first_rule(f"left({text}, {RULE_HEAD})", rules)


def rule_verdict(index: str, rules: Sequence[Rule]) -> Column:
    """The verdict struct of a rule index, NULL for NULL."""
    cases = [
        f"WHEN {position} THEN named_struct('category_l1', {literal(rule.category_l1)}, 'category_l2',"
        f" {literal(rule.category_l2)}, 'confidence', {rule.confidence}D, 'reason', {literal(rule.reason)})"
        for position, rule in enumerate(rules)
    ]
    nothing = f"cast(NULL AS {VERDICT})"
    return F.expr(f"CASE {index} {' '.join(cases)} ELSE {nothing} END" if cases else nothing)
