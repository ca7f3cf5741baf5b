"""Condition rules compiled to columns.

A rule is a dict: a leaf {"column", "op", "value" | "values", "cast"?, "case_sensitive"?} or one of {"all": [...]}, {"any": [...]}, {"not": rule}.
A compiled rule is a struct (matched, issues): a missing column, a blank value or a value that does not cast makes a leaf false with an issue, ``not``
over an issue is false, and groups pass their members' issues on. Rules become column expressions, so they are pushed to scans and pruned as any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparison operators, texts that are truth values, and issues from the one that explains most.
ORDERED = ("<", "<=", ">", ">=", "between")
OPS = ("==", "!=", "in", "not_in", *ORDERED)
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
ISSUES = ("cast_error", "missing_value", "missing_column")
NO_MATCH, AMBIGUOUS, MATCHED = "no_matching_condition", "ambiguous_condition_match", "matched_condition"


class RuleError(ValueError):
    """A rule that does not mean anything."""


def validate(rule: dict) -> dict:
    """The rule itself, if it is well formed."""
    groups = [k for k in ("all", "any", "not") if k in rule]
    if groups:
        if len(groups) != 1 or len(rule) != 1:
            raise RuleError(f"a group has exactly one of all, any, not: {rule}")
        inner = [rule["not"]] if groups == ["not"] else rule[groups[0]]
        if not inner:
            raise RuleError("a group needs members")
        for x in inner:
            validate(x)
        return rule
    if not str(rule.get("column", "")).strip() or rule.get("op") not in OPS:
        raise RuleError(f"a leaf needs a column and one of {', '.join(OPS)}: {rule}")
    several = rule["op"] in ("in", "not_in", "between")
    if ("value" in rule) == ("values" in rule) or several != ("values" in rule):
        raise RuleError(f"{rule['op']} takes {'values' if several else 'value'}")
    if rule["op"] == "between" and len(rule["values"]) != 2:
        raise RuleError("between takes two values")
    if rule["op"] in ORDERED and cast_of(rule) not in ("int", "float"):
        raise RuleError(f"{rule['op']} compares numbers")
    return rule


def cast_of(rule: dict) -> str:
    """The leaf's own cast, else what its values are: all truth values, all numbers, or text."""
    if rule.get("cast"):
        return rule["cast"]
    values = rule["values"] if "values" in rule else [rule["value"]]
    if all(isinstance(v, bool) for v in values):
        return "bool"
    return "float" if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values) else "str"


def referenced_columns(rule: dict) -> set[str]:
    if "not" in rule:
        return referenced_columns(rule["not"])
    for k in ("all", "any"):
        if k in rule:
            return set().union(*map(referenced_columns, rule[k]))
    return {rule["column"]}


def to_bool(text: Column) -> Column:
    word = F.lower(F.trim(text))
    number = word.try_cast("double")
    return F.when(word.isin(*TRUE) | (number == 1), True).when(word.isin(*FALSE) | (number == 0), False)


def to_float(text: Column) -> Column:
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def to_int(text: Column) -> Column:
    """Whole numbers, written as such or with a zero fraction."""
    x = to_float(text)
    return F.when(x == F.floor(x), x.cast("long"))


def _literal(value: object, cast: str, fold: bool) -> object:
    if cast == "bool":
        word = str(value).strip().lower()
        return word in TRUE
    if cast == "str":
        return str(value).strip().lower() if fold else str(value).strip()
    return int(value) if cast == "int" else float(value)


def _leaf(rule: dict, columns: Iterable[str]) -> Column:
    if rule["column"] not in columns:
        return _result(F.lit(False), F.array(F.lit("missing_column")))
    text = F.col(rule["column"]).cast("string")
    cast, fold = cast_of(rule), not rule.get("case_sensitive", False)
    value = {"bool": to_bool, "float": to_float, "int": to_int}.get(cast, lambda t: F.lower(F.trim(t)) if fold else F.trim(t))(text)
    given = [_literal(v, cast, fold) for v in (rule["values"] if "values" in rule else [rule["value"]])]
    first = given[0]
    test = {
        "==": lambda: value == first, "!=": lambda: value != first, "<": lambda: value < first, "<=": lambda: value <= first, ">": lambda: value > first,
        ">=": lambda: value >= first, "in": lambda: value.isin(given), "not_in": lambda: ~value.isin(given), "between": lambda: value.between(first, given[-1]),
    }[rule["op"]]()
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    issue = F.when(blank, F.array(F.lit("missing_value"))).when(value.isNull(), F.array(F.lit("cast_error"))).otherwise(F.array().cast("array<string>"))
    return _result(F.coalesce(test, F.lit(False)) & ~blank, issue)


def _result(matched: Column, issues: Column) -> Column:
    return F.struct(matched.alias("matched"), issues.alias("issues"))


def compile_rule(rule: dict, columns: Iterable[str]) -> Column:
    """The struct (matched, issues) of a rule over a table with these columns."""
    columns = list(columns)
    if "not" in rule:
        inner = compile_rule(rule["not"], columns)
        return _result(~inner["matched"] & (F.size(inner["issues"]) == 0), inner["issues"])
    for kind in ("all", "any"):
        if kind in rule:
            parts = [compile_rule(r, columns) for r in rule[kind]]
            matched = parts[0]["matched"]
            for p in parts[1:]:
                matched = matched & p["matched"] if kind == "all" else matched | p["matched"]
            return _result(matched, F.array_distinct(F.concat(*(p["issues"] for p in parts))))
    return _leaf(rule, columns)


def matches(rule: dict, columns: Iterable[str]) -> Column:
    """Strict: matched, and without any issue."""
    c = compile_rule(validate(rule), columns)
    return c["matched"] & (F.size(c["issues"]) == 0)


def classify(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """``label`` of the one condition ({"label", "when"}) that a row matches, and ``reason``."""
    compiled = [(c["label"], compile_rule(validate(c["when"]), df.columns)) for c in conditions]
    labels = F.array_compact(F.array(*(F.when(c["matched"], F.lit(name)) for name, c in compiled)))
    issues = F.array_distinct(F.concat(*(c["issues"] for _, c in compiled)))
    why = F.lit(NO_MATCH)
    for issue in reversed(ISSUES):
        why = F.when(F.array_contains("_issues", issue), F.lit(issue)).otherwise(why)
    rows = df.withColumns({"_labels": labels, "_issues": issues})
    n = F.size("_labels")
    return rows.withColumns({"label": F.when(n == 1, F.get("_labels", F.lit(0))), "reason": F.when(n == 1, F.lit(MATCHED)).when(n > 1, F.lit(AMBIGUOUS)).otherwise(why)}).drop("_labels", "_issues")


def keep_flag(column: Column | str) -> Column:
    """False for a falsey word; blank and unknown keep."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(~F.lower(F.trim(c)).isin(*FALSE), F.lit(True))
