"""Declarative business rules: violation report, compliance share, quarantine.

One compiled predicate per rule feeds every output, and all rules of a table are
checked in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import parse_timestamp
from ..functions.hashing import distinct_text
from ..functions.numbers import comparable, inside, missing, number
from ..functions.schema import col, is_number, is_text, is_time, require, type_of
from ..functions.text import java_pattern

NO_RULES_COMPLIANCE = 0.8  # fixed value: compliance of a table without rules
BAD_VALUE_EXAMPLES = 5  # fixed value: bad categories shown

RELATIONS = {
    "greater_than": lambda a, b: a > b,
    "greater_or_equal": lambda a, b: a >= b,
    "less_than": lambda a, b: a < b,
    "less_or_equal": lambda a, b: a <= b,
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
}


@dataclass(frozen=True)
class Rule:
    """One constraint; ``kind`` says which of the other fields apply."""

    kind: str
    column: str = ""
    low: object = float("-inf")
    high: object = float("inf")
    pattern: str = ""
    allowed: tuple = ()
    column_a: str = ""
    column_b: str = ""
    relation: str = "greater_than"
    description: str = ""

    @property
    def label(self) -> str:
        return f"{self.column_a},{self.column_b}" if self.kind == "cross_column" else self.column

    def columns(self) -> list[str]:
        return [self.column_a, self.column_b] if self.kind == "cross_column" else [self.column]


def value_range(column: str, low: object = float("-inf"), high: object = float("inf"), description: str = "") -> Rule:
    """Numbers, dates or timestamps from ``low`` to ``high``; compared in the type of the column."""
    return Rule("range", column, low=low, high=high, description=description)


def not_null(column: str, description: str = "") -> Rule:
    return Rule("not_null", column, description=description)


def pattern(column: str, regex: str, description: str = "") -> Rule:
    """Text must match ``regex`` from its start; the end is free."""
    return Rule("pattern", column, pattern=regex, description=description)


def categorical(column: str, allowed: Sequence, description: str = "") -> Rule:
    return Rule("categorical", column, allowed=tuple(allowed), description=description)


def cross_column(a: str, b: str, relation: str = "greater_than", description: str = "") -> Rule:
    return Rule("cross_column", column_a=a, column_b=b, relation=relation, description=description)


def rule_from_dict(d: dict) -> Rule:
    """A rule from the plain form ``{"type": ..., "column": ..., "min": ..., ...}``."""
    same = {"column", "pattern", "column_a", "column_b", "relation", "description"}
    fields = {k: v for k, v in d.items() if k in same}
    if "min" in d:
        fields["low"] = d["min"]
    if "max" in d:
        fields["high"] = d["max"]
    if "allowed_values" in d:
        fields["allowed"] = tuple(d["allowed_values"])
    return Rule(d["type"], **fields)


def checked_and_ok(df: DataFrame, rule: Rule) -> tuple[Column, Column] | None:
    """(the rule applies to the row, the row obeys it); None when a column is absent."""
    if any(c not in df.columns for c in rule.columns()):
        return None
    if rule.kind == "range":
        ok = inside(df, rule.column, rule.low, rule.high)
        return ok.isNotNull(), ok
    if rule.kind == "not_null":
        return F.lit(True), ~missing(df, rule.column)
    if rule.kind == "pattern":
        text = col(rule.column).cast("string")
        return text.isNotNull(), text.rlike(f"^(?:{java_pattern(rule.pattern)})")
    if rule.kind == "categorical":
        return ~missing(df, rule.column), col(rule.column).isin(list(rule.allowed))
    if rule.kind == "cross_column":
        if rule.relation not in RELATIONS:
            raise ValueError(f"unknown relation {rule.relation!r}; use one of {list(RELATIONS)}")
        return _related(df, rule)
    raise ValueError(f"unknown rule kind {rule.kind!r}")


def _related(df: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """A cross-column rule in the common type of its columns.

    Numbers meet as numbers and times as times; text is read as whatever the other side
    is, and two texts as numbers or else as dates. Anything else has no common order.
    """
    names, compare = (rule.column_a, rule.column_b), RELATIONS[rule.relation]
    types = [type_of(df, n) for n in names]
    times = [is_time(t) for t in types]
    texts = [is_text(t) for t in types]
    numbers = [is_number(t) or isinstance(t, T.BooleanType) for t in types]
    if any(times):
        if not all(time or text for time, text in zip(times, texts)):
            raise ValueError(f"columns {names} of types {[t.simpleString() for t in types]} cannot be compared")
        a, b = (col(n).cast("timestamp_ntz") if time else parse_timestamp(col(n)) for n, time in zip(names, times))
    elif all(numbers) or any(numbers) and any(texts):
        a, b = (comparable(df, n) for n in names)
    elif all(texts):
        (a, b), (s, t) = [number(df, n) for n in names], [parse_timestamp(col(n)) for n in names]
        are_numbers, are_times = a.isNotNull() & b.isNotNull(), s.isNotNull() & t.isNotNull()
        return are_numbers | are_times, F.when(are_numbers, compare(a, b)).otherwise(compare(s, t))
    else:
        raise ValueError(f"columns {names} of types {[t.simpleString() for t in types]} cannot be compared")
    return a.isNotNull() & b.isNotNull(), compare(a, b)


def _violated(df: DataFrame, rule: Rule) -> Column | None:
    compiled = checked_and_ok(df, rule)
    return None if compiled is None else compiled[0] & ~compiled[1]


def rule_counts(df: DataFrame, rules: Sequence[Rule]) -> list[Column]:
    """Aggregates ``c0, v0, c1, v1, ...``: rows checked and violations of each rule.

    They fit a plain ``agg`` as well as a grouped one (for example per time window).
    """
    out = []
    for i, rule in enumerate(rules):
        compiled = checked_and_ok(df, rule)
        checked, bad = (F.lit(False), F.lit(False)) if compiled is None else (
            compiled[0], compiled[0] & ~compiled[1]
        )
        out += [F.count_if(checked).alias(f"c{i}"), F.count_if(bad).alias(f"v{i}")]
    return out


def counts_to_rows(rules: Sequence[Rule]) -> Column:
    """The aggregates of :func:`rule_counts` as an array with one struct per rule."""
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule_id"),
            F.lit(r.kind).alias("type"),
            F.lit(r.label).alias("column"),
            F.col(f"c{i}").alias("checked"),
            F.col(f"v{i}").alias("violations"),
            F.try_divide(F.col(f"c{i}") - F.col(f"v{i}"), F.col(f"c{i}")).alias("pass_rate"),
        )
        for i, r in enumerate(rules)
    ])


def rules_report(df: DataFrame, rules: Sequence[Rule], *, only_violated: bool = False) -> DataFrame:
    """One row per rule: rows checked, violations, pass rate, distinct bad categories.

    One scan: rows are counted per combination of bad categories (for most rows there
    is none), and the few combinations give both the totals and the distinct values.
    """
    if not rules:
        raise ValueError("no rules given")
    bad_values = {
        i: F.when(bad, distinct_text(col(r.column), type_of(df, r.column))).alias(f"b{i}")
        for i, r in enumerate(rules)
        if r.kind == "categorical" and (bad := _violated(df, r)) is not None
    }
    grouped = df.groupBy(*bad_values.values()).agg(*rule_counts(df, rules))
    counts = [f"{kind}{i}" for i in range(len(rules)) for kind in "cv"]
    totals = grouped.agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in counts],
        *[F.count_distinct(f"b{i}").alias(f"b{i}") for i in bad_values],
    )
    distinct = F.array(*[
        F.col(f"b{i}") if i in bad_values else F.lit(None).cast("bigint") for i in range(len(rules))
    ])
    rows = totals.select(F.explode(F.arrays_zip(counts_to_rows(rules).alias("r"), distinct.alias("n"))).alias("z"))
    rows = rows.select("z.r.*", F.col("z.n").alias("bad_values"))
    return rows.filter("violations > 0") if only_violated else rows


def invalid_categories(
    df: DataFrame, column: str, allowed: Sequence | DataFrame, examples: int | None = None
) -> DataFrame:
    """Distinct values of ``column`` that are not allowed, with their row counts.

    ``allowed`` is a short list or a one-column table of any size. Values are counted
    before they are matched, so a frequent value costs one row per task.
    """
    require(df, column)
    counted = (
        df.filter(~missing(df, column))
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if isinstance(allowed, DataFrame):
        known = allowed.toDF("value").distinct()
        bad = counted.join(known, "value", "left_anti")
    else:
        bad = counted.filter(~F.col("value").isin(list(allowed)))
    return bad if examples is None else bad.orderBy("value").limit(examples)


def compliance_share(
    df: DataFrame, rules: Sequence[Rule], rows: Column, prefix: str = ""
) -> Column:
    """Mean share of obeying rows over the rules, from the counts of :func:`rule_counts`.

    A rule without any row to check adds 0, except not-null on an empty table (1).
    """
    if not rules:
        return F.lit(NO_RULES_COMPLIANCE)
    total = F.lit(0.0)
    for i, r in enumerate(rules):
        checked, bad = F.col(f"{prefix}c{i}"), F.col(f"{prefix}v{i}")
        nothing = F.lit(0.0)
        if r.kind == "not_null" and r.column in df.columns:
            nothing = F.when(rows == 0, 1.0).otherwise(0.0)
        total = total + F.coalesce(F.try_divide(checked - bad, checked), nothing)
    return total / F.lit(float(len(rules)))


def rules_compliance(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row: the compliance score of the table."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *rule_counts(df, rules))
    return counted.select(compliance_share(df, rules, F.col("rows")).alias("compliance"))


def with_violations(df: DataFrame, rules: Sequence[Rule], name: str = "violated_rules") -> DataFrame:
    """Add the array of positions (in ``rules``) of the rules each row breaks."""
    hits = []
    for i, r in enumerate(rules):
        bad = _violated(df, r)
        if bad is not None:
            hits.append(F.when(bad, F.lit(i)))
    empty = F.array().cast("array<int>")
    return df.withColumn(name, F.array_compact(F.array(*hits)) if hits else empty)


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that obey every rule, other rows with the rules they break)."""
    marked = with_violations(df, rules)
    good = marked.filter(F.size("violated_rules") == 0).drop("violated_rules")
    return good, marked.filter(F.size("violated_rules") > 0)
