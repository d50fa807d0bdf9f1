"""The cleaning expressions as functions for SQL text, defined in SQL.

They are expanded into the query that calls them, so they run where built-in expressions run:
no Python worker takes part, and filters on their arguments are pushed down as usual. All are
temporary functions of the session; names carry a prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dates import DATE_FORMATS, format_shape
from .numbers import NON_NUMBER_CHARS, NUMERIC_TEXT
from .text import WHITE_SPACE

PREFIX = "gs_"


def _text(value: str) -> str:
    """A string literal; escapes are written out, so it is read the same in every setting."""
    return "'" + "".join(c if c.isascii() and c.isprintable() and c not in "'\\" else f"\\u{ord(c):04x}" for c in value) + "'"


def _stripped(c: str) -> str:
    return f"btrim({c}, {_text(WHITE_SPACE)})"


def _parsed(c: str, fmt: str) -> str:
    if "HH" in fmt:  # the two standard forms
        made = f"try_cast({c} AS TIMESTAMP_NTZ)"
    else:
        made = f"CAST(try_to_date({c}, {_text(fmt)}) AS TIMESTAMP_NTZ)"
    return f"CASE WHEN {c} RLIKE {_text(format_shape(fmt))} THEN {made} END"


def definitions(prefix: str = PREFIX) -> dict[str, str]:
    """The statement that makes each function, by name."""
    number = "try_cast(trim(value) AS DOUBLE)"
    plain = f"CASE WHEN value RLIKE {_text(NUMERIC_TEXT)} AND abs({number}) < DOUBLE('Infinity') THEN {number} END"
    digits = f"regexp_replace(value, {_text(NON_NUMBER_CHARS)}, '')"
    letters = _text(r"(\p{L}+|\P{L}+)")
    runs = f"regexp_extract_all(value, {letters}, 1)"
    title = f"array_join(transform({runs}, r -> concat(upper(substring(r, 1, 1)), lower(substring(r, 2)))), '')"
    times = ", ".join(_parsed(_stripped("value"), f) for f in DATE_FORMATS)
    bodies = {
        "number_or_null": ("DOUBLE", plain),
        "number_in_text": ("DOUBLE", plain.replace("value", digits)),
        "strip": ("STRING", _stripped("value")),
        "title": ("STRING", title),
        "parse_time": ("TIMESTAMP_NTZ", f"coalesce({times})"),
    }
    return {prefix + name: f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(value STRING) RETURNS {kind} RETURN {body}"
            for name, (kind, body) in bodies.items()}


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Define number_or_null, number_in_text, strip, title and parse_time; returns their names."""
    made = definitions(prefix)
    for statement in made.values():
        spark.sql(statement)
    return list(made)


def register_report(report: DataFrame, name: str, threshold: str = "pass_rate") -> None:
    """A table function over a report with one row per rule (or column): ``name(below)``.

    It returns the rows whose ``threshold`` column is below the argument, by default all. The
    report is computed when the function is called, in the same query.
    """
    spark = report.sparkSession
    report.createOrReplaceTempView(f"{name}_rows")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in report.schema.fields)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(below DOUBLE DEFAULT NULL) RETURNS TABLE ({columns})
        RETURN SELECT * FROM {name}_rows WHERE below IS NULL OR `{threshold}` < below""")
