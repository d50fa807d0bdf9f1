"""Reproducible error injection: a clean table in, a dirty table and its issues out.

Which cells are hit depends only on the row key, a seed and the position of the
injection, so the result is the same on any cluster and after any retry.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import literal_rows
from ..functions.hashing import digest, draw, selected, unit
from ..functions.numbers import number
from ..functions.schema import col, is_text, require, type_of

# (table, key, seed, tag) -> (cell can be hit, new value)
Maker = Callable[[DataFrame, Column, int, str], tuple[Column, Column]]


@dataclass(frozen=True)
class Injection:
    """One kind of cell error for about ``rate`` of the rows."""

    kind: str
    column: str
    rate: float
    make: Maker
    to_text: bool = False  # the dirty column becomes text


def nulls(column: str, rate: float) -> Injection:
    def make(df, key, seed, tag):
        return F.lit(True), F.lit(None).cast(type_of(df, column))

    return Injection("missing", column, rate, make)


def variants(column: str, rate: float, spellings: Mapping[str, Sequence[str]], kind: str = "typo") -> Injection:
    """Known values get one of their listed spellings (typos, category variants)."""

    def make(df, key, seed, tag):
        entries = []
        for value, ways in spellings.items():
            entries += [F.lit(value), F.array(*[F.lit(w) for w in ways])]
        ways = F.try_element_at(F.create_map(*entries), col(column))
        return ways.isNotNull(), _pick(ways, key, seed, tag)

    return Injection(kind, column, rate, make)


def respell(column: str, rate: float, ways: Sequence[Callable[[Column], Column]]) -> Injection:
    """Text rewritten by one of several expressions (lower case, sign spelled out, ...)."""

    def make(df, key, seed, tag):
        made = F.array(*[w(col(column)) for w in ways])
        return F.lit(True), _pick(made, key, seed, tag)

    return Injection("category_variant", column, rate, make)


def spelled_sign(c: Column) -> Column:
    """``A+`` -> ``A positive``, ``A-`` -> ``A negative``."""
    return F.replace(F.replace(c, F.lit("+"), F.lit(" positive")), F.lit("-"), F.lit(" negative"))


def without_second_letter(c: Column) -> Column:
    """A misspelling by rule: the second character is lost."""
    return F.concat(F.left(c, F.lit(1)), F.substring(c, 3, 2**31 - 1))


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def currency_text(column: str, rate: float, symbol: str = "$") -> Injection:
    """Numbers turned into text with a currency symbol; the column becomes text."""

    def make(df, key, seed, tag):
        return F.lit(True), F.concat(F.lit(symbol), col(column).cast("string"))

    return Injection("type_error", column, rate, make, to_text=True)


def date_formats(column: str, rate: float, formats: Sequence[str]) -> Injection:
    """ISO dates rewritten in one of the formats; the column becomes text."""

    def make(df, key, seed, tag):
        day = col(column)
        if is_text(type_of(df, column)):
            # the shape test keeps text that is no date away from the parser
            day = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
        day = day.cast("date")
        made = F.array(*[F.date_format(day, f) for f in formats])
        return day.isNotNull(), _pick(made, key, seed, tag)

    return Injection("date_format", column, rate, make, to_text=True)


def sign_flip(column: str, rate: float) -> Injection:
    def make(df, key, seed, tag):
        return F.lit(True), (-F.abs(col(column))).cast(type_of(df, column))

    return Injection("negative_value", column, rate, make)


def outliers(column: str, rate: float, low: float, high: float, digits: int = 2) -> Injection:
    """Numbers replaced by extreme ones between ``low`` and ``high``."""

    def make(df, key, seed, tag):
        value = F.lit(float(low)) + F.lit(float(high) - float(low)) * unit(key, seed, f"{tag}v")
        return number(df, column).isNotNull(), F.round(value, digits).cast(type_of(df, column))

    return Injection("outlier", column, rate, make)


def logic_error(column: str, base: str, rate: float, low: int = 10, high: int = 40) -> Injection:
    """``column`` set to ``base`` plus ``low..high``, so that base > column fails."""

    def make(df, key, seed, tag):
        step = F.lit(low) + F.pmod(draw(key, seed, f"{tag}v"), F.lit(high - low + 1))
        return col(base).isNotNull(), (col(base) + step).cast(type_of(df, column))

    return Injection("logic_error", column, rate, make)


def _pick(choices: Column, key: Column, seed: int, tag: str) -> Column:
    at = F.pmod(draw(key, seed, f"{tag}v"), F.size(choices).cast("bigint"))
    return F.try_element_at(choices, (at + 1).cast("int"))


@dataclass(frozen=True)
class Dirtied:
    """A dirtied table and the list of what was changed in it."""

    table: DataFrame
    issues: DataFrame


def inject(
    df: DataFrame, key: str, injections: Sequence[Injection], seed: int = 42, *,
    duplicate_rate: float = 0.0, copies_first: bool = False,
) -> Dirtied:
    """Apply cell errors in order and copy rows; missing cells are never hit.

    Copies are made after the cell errors, so they are exact; with ``copies_first``
    the source row alone gets the errors and some copies differ. Issues have the
    columns row_key, column, kind, original and injected, all text.
    """
    require(df, key, *[i.column for i in injections])
    columns, row_key = df.columns, F.col("__key")
    df = df.withColumn("__key", col(key))  # the key cell itself may be hit
    copy = F.lit(False)
    if duplicate_rate:
        df = _copies(df, key, duplicate_rate, seed, "duplicate")
        copy = F.col("__copy") == 1
    spoiled = ~copy if copies_first else F.lit(True)
    notes = []
    for i, injection in enumerate(injections):
        tag = f"{injection.kind}{i}"
        cell = col(injection.column)
        possible, value = injection.make(df, row_key, seed, tag)
        hit = selected(row_key, seed, tag, injection.rate) & cell.isNotNull() & spoiled
        hit = hit & F.coalesce(possible, F.lit(False))
        note = _note(row_key, injection.column, injection.kind, cell, value)
        # the note is taken before the cell changes
        df = df.withColumn(f"__note{i}", F.when(hit & ~copy, note))
        kept = cell.cast("string") if injection.to_text else cell
        df = df.withColumn(injection.column, F.when(hit, value).otherwise(kept))
        notes.append(F.col(f"__note{i}"))
    if duplicate_rate:
        none = F.lit(None).cast("string")
        notes.append(F.when(copy, _note(row_key, None, "duplicate", none, none)))
    found = df.select(F.explode(F.array(*notes)).alias("n")).filter("n IS NOT NULL").select("n.*")
    return Dirtied(df.select(*[col(c) for c in columns]), found)


def _note(key: Column, column: str | None, kind: str, original: Column, injected: Column) -> Column:
    return F.struct(
        key.cast("string").alias("row_key"),
        F.lit(column).cast("string").alias("column"),
        F.lit(kind).alias("kind"),
        original.cast("string").alias("original"),
        injected.cast("string").alias("injected"),
    )


def _copies(df: DataFrame, key: str, rate: float, seed: int, tag: str) -> DataFrame:
    """Selected rows twice, told apart by ``__copy`` 0 and 1; one scan, no union."""
    last = F.when(selected(col(key), seed, tag, rate), 1).otherwise(0)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(0), last)))


def inject_duplicates(df: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """Append an exact copy of about ``rate`` of the rows."""
    require(df, key)
    return _copies(df, key, rate, seed, "duplicate").drop("__copy")


def name_variants(name: Column) -> list[Column]:
    """Four near copies of a two-part name: initial, double blank, lower case, cut end."""
    first, last = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    return [
        F.concat(F.substring(first, 1, 1), F.lit(". "), last),
        F.concat(first, F.lit("  "), last),
        F.concat(F.lower(first), F.lit(" "), F.lower(last)),
        F.concat(first, F.lit(" "), F.left(last, F.length(last) - 1)),
    ]


def inject_near_duplicates(
    df: DataFrame, key: str, name: str, rate: float, new_key: Callable[[Column], Column],
    seed: int = 42, ways: Callable[[Column], list[Column]] = name_variants,
) -> Dirtied:
    """Append rows with a re-spelled name and a new key; rows without such a name are skipped."""
    require(df, key, name)
    made = F.array(*ways(col(name)))
    tag = "near_duplicate"
    variant = _pick(made, col(key), seed, tag)
    two_parts = F.coalesce(F.size(F.split(col(name), r"\s+")) >= 2, F.lit(False))
    chosen = selected(col(key), seed, tag, rate) & two_parts
    both = df.withColumn(
        "__copy", F.explode(F.sequence(F.lit(0), F.when(chosen, 1).otherwise(0)))
    )
    copied = F.col("__copy") == 1
    fresh = new_key(col(key)).cast(type_of(df, key))
    out = both.select(*[
        F.when(copied, {key: fresh, name: variant}[c]).otherwise(col(c)).alias(c)
        if c in (key, name) else col(c)
        for c in df.columns
    ])
    issues = both.filter(copied).select(
        _note(col(key), name, tag, col(name), variant).alias("n")
    ).select("n.*")
    return Dirtied(out, issues)


def add_odd_rows(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """Append given valid-but-odd rows, which a careful cleaning must keep."""
    names = df.columns
    if not rows:
        return df
    for r in rows:
        if unknown := [k for k in r if k not in names]:
            raise ValueError(f"unknown columns {unknown}; available: {names}")
    literal = [tuple(r.get(c) for c in names) for r in rows]
    return df.unionByName(literal_rows(df.sparkSession, literal, df.schema))


def surviving_rows(df: DataFrame, rows: Sequence[dict], key: str) -> DataFrame:
    """One row: how many of the given odd rows exist and how many are still present."""
    keys = [r[key] for r in rows]
    found = F.count_distinct(F.when(col(key).isin(keys), col(key)))
    return df.agg(F.lit(len(set(keys))).cast("bigint").alias("odd_rows"), found.alias("surviving"))


def pick_golden(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows chosen by the hash of their key."""
    require(df, key)
    return df.orderBy(digest(col(key), seed, "golden"), col(key)).limit(k)
