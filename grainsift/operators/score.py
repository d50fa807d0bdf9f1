"""Eight-dimension quality score of a table against its known-clean truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import side_by_side
from ..functions.numbers import clamp, missing
from .compare import accuracy_by_key, accuracy_by_position, common_columns, golden_report, type_share
from .dedup import group_sizes
from .rules import Rule, compliance_share, rule_counts

# The dimensions and their weights.
WEIGHTS = {
    "missing_fixed": 0.20,
    "duplicates_removed": 0.15,
    "type_correctness": 0.15,
    "value_accuracy": 0.20,
    "data_preservation": 0.10,
    "constraint_compliance": 0.10,
    "step_efficiency": 0.05,
    "golden_row_integrity": 0.05,
}
# Bounds of the composite score.
LOWEST, HIGHEST = 0.001, 0.999
# Fixed values of step efficiency: slope, floor, and the value without a budget.
EFFICIENCY_SLOPE, EFFICIENCY_FLOOR, EFFICIENCY_UNKNOWN = 1.5, 0.1, 0.5
# Fixed values of the bounded step effect: factor, bonus, largest gain and loss, dead zone.
EFFECT_FACTOR, EFFECT_BONUS, MAX_GAIN, MAX_LOSS, DEAD_ZONE, NO_EFFECT = 2.0, 0.03, 0.15, -0.20, -0.01, 0.001


def table_facts(df: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """One row: rows, missing cells, duplicate rows, and the counts of each rule.

    One scan and one shuffle serve all of it.
    """
    gone = sum((missing(df, c).cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    counts = [f"{kind}{i}" for i in range(len(rules)) for kind in "cv"]
    per_row = group_sizes(df, extra=[F.sum(gone).alias("__gone"), *rule_counts(df, rules)])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return per_row.agg(
        total("__n").alias("rows"),
        total("__gone").alias("missing_cells"),
        total(F.col("__n") - 1).alias("duplicates"),
        *[total(c).alias(c) for c in counts],
    )


def progress(base: Column, current: Column, truth: Column) -> Column:
    """Share of the surplus over the truth that is gone; 1 when there was none."""
    gone = F.greatest(base - current, F.lit(0)) / F.nullif(base - truth, F.lit(0))
    return F.when(base > truth, F.least(F.lit(1.0), gone)).otherwise(1.0)


def preservation(current_rows: Column, truth_rows: Column) -> Column:
    """Share of the expected rows that are present, at most 1."""
    share = F.try_divide(current_rows, truth_rows)
    return F.when(current_rows >= truth_rows, 1.0).otherwise(share)


def step_efficiency(steps: int, budget: int) -> float:
    """More unused budget is better; neutral when steps or budget are not known."""
    if steps <= 0 or budget <= 0:
        return EFFICIENCY_UNKNOWN
    return max(EFFICIENCY_FLOOR, min(1.0, EFFICIENCY_SLOPE * (1.0 - steps / budget)))


def golden_share(report: DataFrame) -> DataFrame:
    """Found golden rows per golden row; 1 when there are none."""
    return report.select(
        F.coalesce(F.try_divide("found", "golden_rows"), F.lit(1.0)).alias("share")
    )


def score(
    current: DataFrame, truth: DataFrame, baseline: DataFrame, *,
    key: Sequence[str] = (), order_by: Sequence[str] = (),
    rules: Sequence[Rule] = (), golden: DataFrame | None = None, golden_key: str | None = None,
    steps: int = 0, budget: int = 0, weights: Mapping[str, float] = WEIGHTS, **options,
) -> DataFrame:
    """One row: the eight dimensions, the composite, and what lies outside the truth.

    ``baseline`` is the table before cleaning. Rows are paired by ``key`` or, without
    one, by position in ``order_by``. Each part is a one-row aggregate; no table is
    collected or crossed. ``current`` is read three times, so write it out first
    (:func:`grainsift.session.materialized`) when it is expensive to compute.
    """
    if key:
        accuracy = accuracy_by_key(current, truth, key, **options)
    elif order_by:
        accuracy = accuracy_by_position(current, truth, order_by, **options)
    else:
        raise ValueError("score needs a key or an order_by to pair rows")
    tables = {
        "b": table_facts(baseline), "c": table_facts(current, rules), "t": table_facts(truth),
        "a": accuracy,
    }
    golden_part = F.lit(1.0)
    if golden is not None:
        tables["g"] = golden_share(golden_report(current, golden, golden_key or key[0], **options))
        golden_part = F.col("g.share")
    facts = side_by_side(tables)
    parts = {
        "missing_fixed": progress(*[F.col(f"{p}.missing_cells") for p in "bct"]),
        "duplicates_removed": progress(*[F.col(f"{p}.duplicates") for p in "bct"]),
        "type_correctness": F.lit(type_share(current, truth)),
        "value_accuracy": F.col("a.accuracy"),
        "data_preservation": preservation(F.col("c.rows"), F.col("t.rows")),
        "constraint_compliance": compliance_share(current, rules, F.col("c.rows"), "c."),
        "step_efficiency": F.lit(step_efficiency(steps, budget)),
        "golden_row_integrity": golden_part,
    }
    shared = common_columns(current, truth)
    return facts.select(
        *[p.cast("double").alias(name) for name, p in parts.items()],
        F.greatest(F.col("c.rows") - F.col("t.rows"), F.lit(0)).alias("extra_rows"),
        F.lit(len(truth.columns) - len(shared)).alias("dropped_columns"),
        F.lit(len(current.columns) - len(shared)).alias("extra_columns"),
    ).withColumn("composite", composite(weights))


def composite(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the dimension columns, kept inside (0, 1)."""
    total = sum((F.col(d) * F.lit(w) for d, w in weights.items()), F.lit(0.0))
    return clamp(total, LOWEST, HIGHEST)


def score_report(scores: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """A score row as rows (dimension, weight, score, weighted), the composite last."""
    lines = [
        F.struct(
            F.lit(d).alias("dimension"), F.lit(w).alias("weight"),
            F.col(d).alias("score"), (F.col(d) * F.lit(w)).alias("weighted"),
        )
        for d, w in weights.items()
    ]
    last = F.struct(
        F.lit("composite").alias("dimension"), F.lit(sum(weights.values())).alias("weight"),
        F.col("composite").alias("score"), F.col("composite").alias("weighted"),
    )
    return scores.select(F.explode(F.array(*lines, last)).alias("s")).select("s.*")


def bounded_effect(gain: Column) -> Column:
    """Effect of a step from its composite gain: rewarded up to 0.15, punished to -0.20."""
    return (
        F.when(gain > 0, F.least(F.lit(MAX_GAIN), gain * EFFECT_FACTOR + EFFECT_BONUS))
        .when(gain < DEAD_ZONE, F.greatest(F.lit(MAX_LOSS), gain * EFFECT_FACTOR))
        .otherwise(NO_EFFECT)
    )


def quality_delta(before: DataFrame, after: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Two score rows as (dimension, before, after, delta, effect); effect only in total."""
    names = [*weights, "composite"]
    both = side_by_side({"b": before.select(*names), "a": after.select(*names)})
    lines = [
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(f"b.{d}").alias("before"),
            F.col(f"a.{d}").alias("after"),
            (F.col(f"a.{d}") - F.col(f"b.{d}")).alias("delta"),
        )
        for d in names
    ]
    rows = both.select(F.explode(F.array(*lines)).alias("d")).select("d.*")
    effect = F.when(F.col("dimension") == "composite", bounded_effect(F.col("delta")))
    return rows.withColumn("effect", effect)
