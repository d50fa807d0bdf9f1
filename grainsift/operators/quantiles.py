"""Exact quantiles by repeated narrowing, with bounded work per task.

The built-in exact ``percentile`` gathers every distinct value in one task. That is
fine for small inputs and used there; larger ones are narrowed first: an approximate
quantile gives two values around the wanted rank, exact counts say on which side the
rank lies, and the rows in between are narrowed again until few enough remain.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import number

MAX_VALUES = 1_000_000
ACCURACY = 10_000


def quantiles(
    df: DataFrame, column: str, probs: Sequence[float], *,
    approx: bool = False, max_values: int = MAX_VALUES,
) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours; NULLs are ignored.

    Runs small jobs at once and returns plain numbers (None for an empty column).
    """
    x = df.select(number(df, column).alias("x")).filter("x IS NOT NULL")
    if approx:
        found = x.agg(F.percentile_approx("x", list(probs), ACCURACY)).first()[0]
        return list(found) if found else [None] * len(probs)
    n = x.count()
    if n == 0:
        return [None] * len(probs)
    if n <= max_values:
        return list(x.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0])
    wanted = [(n - 1) * p for p in probs]
    ranks = {r for h in wanted for r in (math.floor(h), math.ceil(h))}
    value = values_at_ranks(x, ranks, n, max_values)
    out = []
    for h in wanted:
        low, high = value[math.floor(h)], value[math.ceil(h)]
        out.append(low + (h - math.floor(h)) * (high - low) if high != low else low)
    return out


class _Range:
    """An open value range around one rank: rows below it and rows inside."""

    def __init__(self, inside: int):
        self.low, self.high, self.below, self.inside = None, None, 0, inside

    def ends(self) -> tuple[float | None, float | None]:
        return self.low, self.high


def _inside(ends: tuple[float | None, float | None]) -> Column:
    low, high = ends
    x, inside = F.col("x"), F.lit(True)
    if low is not None:
        inside = inside & (x > low)
    if high is not None:
        inside = inside & (x < high)
    return inside


def values_at_ranks(x: DataFrame, ranks: set[int], n: int, max_values: int) -> dict[int, float]:
    """The values at 0-based ranks of the single column ``x`` (no NULLs, ``n`` rows)."""
    ranges = {r: _Range(n) for r in ranks}
    found: dict[int, float] = {}
    while wide := [r for r in ranges if r not in found and ranges[r].inside > max_values]:
        cuts = _cut_values(x, {r: ranges[r] for r in wide})
        counts = _counts(x, {(ranges[r].ends(), cuts[r]) for r in wide})
        for r in wide:
            _narrow(r, ranges[r], cuts[r], counts[ranges[r].ends(), cuts[r]], found)
    final: dict[tuple, list[int]] = {}
    for r in ranges.keys() - found.keys():
        final.setdefault((ranges[r].ends(), ranges[r].below), []).append(r)
    for (ends, below), members in final.items():
        found |= _values_inside(x, ends, below, members)
    return found


def _cut_values(x: DataFrame, ranges: dict[int, _Range]) -> dict[int, tuple[float, float]]:
    """Two values around each rank; ranks in one range share one sketch."""
    slack = 2 / ACCURACY
    wanted: dict[tuple, list[int]] = {}
    for r, rng in ranges.items():
        wanted.setdefault(rng.ends(), []).append(r)
    aggs = []
    for ends, members in wanted.items():
        around = []
        for r in members:
            # coarse rounding gives neighbouring ranks the same cut
            at = round((r - ranges[r].below + 0.5) / ranges[r].inside, 6)
            around += [max(0.0, at - slack), min(1.0, at + slack)]
        aggs.append(F.percentile_approx(F.when(_inside(ends), F.col("x")), around, ACCURACY))
    row = x.agg(*aggs).first()
    return {
        r: (row[i][2 * m], row[i][2 * m + 1])
        for i, members in enumerate(wanted.values())
        for m, r in enumerate(members)
    }


def _counts(x: DataFrame, cuts: set[tuple]) -> dict[tuple, tuple]:
    """Rows under, at and between each pair of cut values, inside their range."""
    aggs, v = [], F.col("x")
    for ends, (low, high) in cuts:
        inside = _inside(ends)
        aggs += [
            F.count_if(inside & (v < low)),
            F.count_if(v == low),
            F.count_if((v > low) & (v < high)),
            F.count_if((v == high) & (v > low)),
        ]
    row = list(x.agg(*aggs).first())
    return {cut: tuple(row[4 * i : 4 * i + 4]) for i, cut in enumerate(cuts)}


def _narrow(r: int, rng: _Range, cut: tuple, counts: tuple, found: dict) -> None:
    (low, high), (under, at_low, between, at_high) = cut, counts
    local = r - rng.below
    if local < under:
        rng.high, rng.inside = low, under
    elif local < under + at_low:
        found[r] = low
    elif local < under + at_low + between:
        rng.low, rng.high = low, high
        rng.below, rng.inside = rng.below + under + at_low, between
    elif local < under + at_low + between + at_high:
        found[r] = high
    else:
        below = under + at_low + between + at_high
        rng.low, rng.below, rng.inside = high, rng.below + below, rng.inside - below


def _values_inside(x: DataFrame, ends: tuple, below: int, ranks: list[int]) -> dict[int, float]:
    """Final step on at most ``max_values`` rows, copies collapsed."""
    counted = x.filter(_inside(ends)).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(
        Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = counted.withColumn("upto", F.lit(below) + upto)
    wanted = F.array(*[F.lit(r) for r in ranks])
    covers = F.exists(wanted, lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    rows = placed.filter(covers).collect()  # one row per rank at most
    return {
        r: row["x"] for r in ranks for row in rows if row["upto"] - row["n"] <= r < row["upto"]
    }
