"""Filter rules as one Column."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EPSILON, ascii_lower, blank
from .cells import as_number, as_text
from .patterns import java_pattern

#: Values of an `in` rule that are compared one after another, at most; and characters of a list that is sent to every task, at most.
LIST_VALUES, BROADCAST_CHARACTERS = 100, 4 << 20


@dataclass(frozen=True)
class Rule:
    """A column's name, an operator's, and a value as text."""

    column: str
    operator: str
    value: str = ""


def parse_number(text: str) -> float | None:
    """A rule's value as a double, by the rule that cells follow."""
    text = text.strip()
    return float(text) if re.fullmatch(r"(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)", text) else None


def members(value: str) -> list[str]:
    """The list of an `in` rule: a JSON array of strings, or parts between commas, trimmed."""
    try:
        found = json.loads(value)
        if isinstance(found, list) and all(isinstance(x, str) for x in found):
            return found
    except ValueError:
        pass
    return [p.strip() for p in value.split(",")]


def _condition(df: DataFrame, rule: Rule) -> Column:
    text, value, false = as_text(df, rule.column), rule.value, F.lit(False)
    k = parse_number(value)
    number = as_number(df, rule.column)
    comparable = k is not None and not math.isnan(k)
    same = ascii_lower(text) == ascii_lower(F.lit(value))
    if rule.operator == "equals":
        return same
    if rule.operator in ("contains", "starts_with", "ends_with"):
        method = {"contains": "contains", "starts_with": "startswith", "ends_with": "endswith"}[rule.operator]
        return getattr(F.lower(text), method)(F.lower(F.lit(value)))
    if rule.operator == "is_empty":
        return blank(text)
    if rule.operator == "regex":
        pattern = java_pattern(df.sparkSession, value)
        return text.rlike(pattern) if pattern is not None else false
    gap = F.abs(number - F.lit(k)) if k is not None else None
    if rule.operator == "eq":
        return (gap < EPSILON) & ~F.isnan(gap) if comparable else false
    if rule.operator in ("ne", "neq", "not_equals", "!="):
        if k is None:
            return ~same
        return F.when(number.isNotNull(), (gap >= EPSILON) & ~F.isnan(gap)).otherwise(~same)
    if rule.operator in ("gt", "lt"):
        if not comparable:
            return false
        # no number gives null, which passes no row; written so that a plain column's comparison reaches the scan
        found = number > k if rule.operator == "gt" else number < k
        return found & ~F.isnan(number)
    if rule.operator == "in":
        some = list(dict.fromkeys(members(value)))
        return F.lower(text).isin([F.lower(F.lit(x)) for x in some]) if some else false
    return false


def _long(rule: Rule) -> list[str] | None:
    """The values of an `in` rule that has many."""
    if rule.operator != "in" or len(rule.value) < LIST_VALUES:
        return None
    some = list(dict.fromkeys(members(rule.value)))
    return some if len(some) > LIST_VALUES else None


def _members_frame(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """One column, the lower-cased values. They are in the rule, so in the driver, and their size is known."""
    frame = spark.createDataFrame(pd.DataFrame({name: values}), T.StructType([T.StructField(name, T.StringType())])).select(F.lower(name).alias(name)).distinct()
    return F.broadcast(frame) if sum(map(len, values)) <= BROADCAST_CHARACTERS else frame


def passed(df: DataFrame, rules: Sequence[Rule], conjunction: str = "AND") -> DataFrame:
    """The rows that rules pass, as compile_rules has it; lists of many values are joined to and not compared one after another.

    Where all rules have to pass, a long list is a semi join. Where one is enough, its join
    marks the rows and the mark stands in the condition.
    """
    some = [r for r in rules if r.column in df.columns]
    lists = {n: values for n, r in enumerate(some) if (values := _long(r))}
    if not lists:
        return df.where(compile_rules(df, some, conjunction))
    short = [r for n, r in enumerate(some) if n not in lists]
    out, marks = df.where(compile_rules(df, short)) if conjunction != "OR" else df, []
    for n, values in lists.items():
        name = next(x for k in range(len(df.columns) + 1) if (x := f"_in_{n}_{k}") not in df.columns)
        same, frame = F.lower(as_text(df, some[n].column)) == F.col(name), _members_frame(df.sparkSession, values, name)
        out = out.join(frame, same, "left" if conjunction == "OR" else "left_semi")
        if conjunction == "OR":
            marks.append(F.col(name).isNotNull())
    if not marks:
        return out
    rest = [compile_rules(df, short, "OR")] if short else []
    return out.where(reduce(lambda a, b: a | b, [*rest, *marks])).select(*(F.col(f"`{c}`") for c in df.columns))


def compile_rules(df: DataFrame, rules: Sequence[Rule], conjunction: str = "AND") -> Column:
    """"OR" passes rows that any rule passes, everything else those that all pass. Rules on unknown columns are left out, no rules pass all rows, an unknown operator passes none."""
    each = [_condition(df, r) for r in rules if r.column in df.columns]
    if not each:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if conjunction == "OR" else (lambda a, b: a & b), each)


def checklist_rule(rules: Sequence[Rule], name: str, values: Sequence[str], checked: Sequence[str]) -> list[Rule]:
    """The rules with those on a column replaced by one `in` rule of the checked values; by none if all are checked."""
    rest = without_column(rules, name)
    return rest if set(checked) >= set(values) else [*rest, Rule(name, "in", json.dumps(list(checked)))]


def without_column(rules: Sequence[Rule], name: str) -> list[Rule]:
    return [r for r in rules if r.column != name]
