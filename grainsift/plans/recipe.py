"""A recipe is a list of steps folded over a table, with a log of what each step did.

DataFrames are immutable, so undoing a step means running the steps before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import cell_equal
from ..functions.frames import side_by_side
from ..functions.schema import col
from ..operators import columns as C, dedup, fill, rows as R
from ..session import materialized


@dataclass(frozen=True)
class Operation:
    """How a step treats the table.

    kind is ``column`` (changes one column, keeps all rows), ``rows`` (removes rows),
    ``schema``, ``order``, ``custom`` (anything) or ``read`` (changes nothing).
    """

    kind: str
    apply: Callable[..., DataFrame]


def _unchanged(df: DataFrame, **_: object) -> DataFrame:
    return df


OPERATIONS = {
    "fill_missing": Operation("column", fill.fill_missing),
    "fix_dtype": Operation("column", C.fix_dtype),
    "replace": Operation("column", C.replace_value),
    "regex_replace": Operation("column", C.regex_replace),
    "standardize": Operation("column", C.standardize),
    "clip": Operation("column", C.clip),
    "remove_duplicates": Operation("rows", dedup.remove_duplicates),
    "remove_rows": Operation("rows", R.remove_rows),
    "rename_column": Operation("schema", C.rename_column),
    "drop_column": Operation("schema", C.drop_column),
    "sort": Operation("order", R.sort_rows),
    **{
        name: Operation("read", _unchanged)
        for name in (
            "view", "profile", "profile_column", "find_missing", "find_duplicates",
            "find_outliers", "check_rules", "history", "validate",
        )
    },
}
UNDO = "undo"


@dataclass(frozen=True)
class Step:
    op: str
    args: dict = field(default_factory=dict)
    function: Callable[[DataFrame], DataFrame] | None = None

    def operation(self) -> Operation:
        if self.function is not None:
            return Operation("custom", lambda df, **_: self.function(df))
        if self.op not in OPERATIONS:
            raise ValueError(f"unknown operation {self.op!r}; use one of {[*OPERATIONS, UNDO]}")
        return OPERATIONS[self.op]

    def apply(self, df: DataFrame) -> DataFrame:
        return self.operation().apply(df, **self.args)

    def text(self) -> str:
        return json.dumps({"op": self.op, **self.args}, default=str)


def step(op: str, **args: object) -> Step:
    """A named operation with its keyword arguments."""
    return Step(op, args)


def custom(name: str, function: Callable[[DataFrame], DataFrame]) -> Step:
    """Any DataFrame function as a step."""
    return Step(name, {}, function)


def steps_from_json(text: str) -> list[Step]:
    """Steps from ``[{"op": "clip", "column": "x", "lower": 0, "upper": 9}, ...]``."""
    return [Step(d["op"], {k: v for k, v in d.items() if k != "op"}) for d in json.loads(text)]


def effective(steps: Sequence[Step]) -> list[Step]:
    """The steps left after each ``undo`` has removed the latest one that changes data."""
    return [steps[i] for i in _histories(steps)[-1]] if steps else []


def _histories(steps: Sequence[Step]) -> list[tuple[int, ...]]:
    """For each step, the positions of the data steps in force after it."""
    out, now = [], ()
    for i, s in enumerate(steps):
        if s.op == UNDO and s.function is None:
            now = now[:-1]
        elif s.operation().kind != "read":
            now = (*now, i)
        out.append(now)
    return out


def undo(steps: Sequence[Step], n: int = 1) -> list[Step]:
    """The recipe without its last ``n`` steps that change data; ``undo`` steps in it are resolved first."""
    left = _histories(steps)[-1] if steps else ()
    gone = {i for h in _histories(steps) for i in h} - set(left[: max(0, len(left) - n)])
    return [s for i, s in enumerate(steps) if i not in gone and not (s.op == UNDO and s.function is None)]


def run(
    df: DataFrame, steps: Sequence[Step], *, materialize_after: Sequence[str] = ()
) -> DataFrame:
    """Fold the steps over the table.

    A step that looks up a fill value reads everything before it, and so does every
    later use of the result. ``materialize_after`` names operations (such as
    ``remove_duplicates``) whose result is written to the shared folder once.
    """
    for s in effective(steps):
        df = s.apply(df)
        if s.op in materialize_after:
            df = materialized(df, s.op)
    return df


def lineage(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """One row per step: op, command, modified, rows before and after, changed cells.

    Cells of a column whose type changes are compared by value; the new type alone counts
    as a modification, not as changed cells. What a custom step does to cells is not known:
    its changed cells are NULL, and so is ``modified`` unless the number of rows changes.
    An ``undo`` is modifying if there was a step to undo; it reports no changed cells.

    Consecutive column steps are counted together: each keeps its old column beside
    the new one, so one pass serves all steps up to the next one that removes rows.
    """
    return _Lineage(df, steps, ()).table()


def run_with_log(
    df: DataFrame, steps: Sequence[Step], *, materialize_after: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The results of :func:`run` and :func:`lineage`, sharing what is materialised."""
    logged = _Lineage(df, steps, materialize_after)
    return logged.frame(logged.after[-1]), logged.table()


class _Lineage:
    def __init__(self, df: DataFrame, steps: Sequence[Step], materialize_after: Sequence[str]):
        if not steps:
            raise ValueError("no steps given")
        self.steps, self.materialize_after = list(steps), materialize_after
        self.frames: dict[tuple[int, ...], DataFrame] = {(): df}
        self.after = _histories(self.steps)
        self.before = [(), *self.after[:-1]]
        self.facts: dict[str, DataFrame] = {}  # one-row aggregates by name
        self.rows_in: dict[tuple[int, ...], str] = {}  # where the row count of a history is
        self.cells_in: dict[int, str] = {}  # where the changed cells of a step are

    def table(self) -> DataFrame:
        by_base: dict[tuple[int, ...], set[tuple[int, ...]]] = {}
        for h in {*self.before, *self.after}:
            by_base.setdefault(self._base(h), set()).add(h)
        for base in sorted(by_base):
            self._measure(base, by_base[base])
        one = side_by_side(self.facts)
        entries = F.array(*[self._entry(i) for i in range(len(self.steps))])
        changed = (
            F.col("e.schema_changed")
            | (F.col("e.rows_before") != F.col("e.rows_after"))
            | (F.col("e.cells_changed") > 0)  # NULL for a custom step: not known
        )
        return one.select(F.explode(entries).alias("e")).select(
            "e.step", "e.op", "e.command", changed.alias("modified"),
            "e.rows_before", "e.rows_after", "e.cells_changed",
        )

    def _kind(self, i: int) -> str:
        s = self.steps[i]
        return UNDO if s.op == UNDO and s.function is None else s.operation().kind

    def _base(self, history: tuple[int, ...]) -> tuple[int, ...]:
        """The history up to the last step that can change the number of rows."""
        cuts = [p + 1 for p, i in enumerate(history) if self._kind(i) in ("rows", "custom")]
        return history[: cuts[-1] if cuts else 0]

    def _measure(self, base: tuple[int, ...], histories: set[tuple[int, ...]]) -> None:
        """Count rows and changed cells of all histories that share ``base``.

        The longest history contains the others unless an undo branched off.
        """
        frame = self.frame(base)
        leaves = [h for h in histories if not any(o != h and o[: len(h)] == h for o in histories)]
        for h in sorted(leaves):
            name = f"f{len(self.facts)}"
            changed, counts = self._counting(frame, h[len(base) :], name)
            if base not in self.rows_in:
                self.rows_in[base] = name
                counts.append(F.count(F.lit(1)).alias("rows"))
            if counts:
                self.facts[name] = changed.agg(*counts)

    def frame(self, history: tuple[int, ...]) -> DataFrame:
        """The table after the steps of a history."""
        if history not in self.frames:
            s = self.steps[history[-1]]
            made = s.apply(self.frame(history[:-1]))
            self.frames[history] = (
                materialized(made, s.op) if s.op in self.materialize_after else made
            )
        return self.frames[history]

    def _counting(self, frame: DataFrame, tail: Sequence[int], name: str):
        """The steps applied, with a 0/1 column per column step for a changed cell."""
        counts = []
        for i in tail:
            if self._kind(i) != "column" or i in self.cells_in:
                frame = self.steps[i].apply(frame)
                continue
            self.cells_in[i] = name
            cell = col(self.steps[i].args["column"])
            frame = frame.withColumn(f"__old{i}", cell)
            old_type = frame.schema[f"__old{i}"].dataType
            frame = self.steps[i].apply(frame)
            old, new_type = F.col(f"__old{i}"), frame.schema[self.steps[i].args["column"]].dataType
            retyped = new_type != old_type
            same = cell_equal(old, old_type, cell, new_type, dates=True) if retyped else cell.eqNullSafe(old)
            hit = F.when(same, 0).otherwise(1)
            frame = frame.withColumn(f"__hit{i}", hit).drop(f"__old{i}")
            counts.append(F.coalesce(F.sum(f"__hit{i}"), F.lit(0)).alias(f"c{i}"))
            counts.append(F.lit(retyped).alias(f"t{i}"))
        return frame, counts

    def _entry(self, i: int) -> Column:
        kind = self._kind(i)
        rows_before, rows_after = (
            F.col(f"{self.rows_in[self._base(h)]}.rows") for h in (self.before[i], self.after[i])
        )
        cells, schema_changed = F.lit(0).cast("bigint"), F.lit(kind in ("schema", "order"))
        if kind == "column":
            cells = F.col(f"{self.cells_in[i]}.c{i}")
            schema_changed = F.col(f"{self.cells_in[i]}.t{i}")
        if kind == "custom":
            cells = F.lit(None).cast("bigint")  # the function may rewrite any cell
        if kind == UNDO:
            schema_changed = F.lit(self.before[i] != self.after[i])  # an undo of nothing changes nothing
        return F.struct(
            F.lit(i + 1).alias("step"),
            F.lit(self.steps[i].op).alias("op"),
            F.lit(self.steps[i].text()).alias("command"),
            schema_changed.alias("schema_changed"),
            rows_before.alias("rows_before"),
            rows_after.alias("rows_after"),
            cells.alias("cells_changed"),
        )


def lineage_summary(log: DataFrame) -> DataFrame:
    """One row: steps, read-only and modifying steps, undos, rows removed."""
    undone = F.col("op") == UNDO
    delta = F.when(~undone, F.col("rows_after") - F.col("rows_before")).otherwise(0)
    return log.agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(~F.col("modified")).alias("read_only_steps"),  # steps of unknown effect are in neither
        F.count_if("modified").alias("modifying_steps"),
        F.count_if(undone).alias("undo_steps"),
        F.coalesce(F.sum(delta), F.lit(0)).alias("row_delta"),
    )
