"""Text clean-up expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

# every character that counts as white space, including the ASCII separators
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def title(c: Column) -> Column:
    """Capitalise each run of letters: ``usb-c`` -> ``Usb-C``, ``3rd`` -> ``3Rd``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    capital = lambda run: F.concat(
        F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2)))
    )
    return F.array_join(F.transform(runs, capital), "")


def java_pattern(pattern: str) -> str:
    """Named groups in the ``(?P<name>...)`` spelling, rewritten for Java regexes."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def java_replacement(replacement: str) -> str:
    r"""``\1`` and ``\g<1>`` references as ``$1``; other dollar signs are literal."""
    dollars = replacement.replace("$", r"\$")
    named = re.sub(r"\\g<(\d+)>", r"$\1", dollars)
    named = re.sub(r"\\g<([A-Za-z]\w*)>", r"${\1}", named)
    return re.sub(r"\\([1-9]\d?)", r"$\1", named)


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Raise ``ValueError`` now when Spark cannot compile the pattern."""
    probe = spark.sql("SELECT regexp_replace('', :pattern, '')", args={"pattern": pattern})
    try:
        probe.collect()
    except Exception as err:  # the JVM error names the pattern
        raise ValueError(f"invalid regular expression {pattern!r}") from err
