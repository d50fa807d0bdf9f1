"""Tolerant date parsing over an explicit, ordered list of formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import strip

# The four spellings used in dirty data, and the two standard forms with a
# time of day; no text fits two of them.
DATE_FORMATS = (
    "yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yyyy", "dd MMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
_STANDARD = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")

# Text shape of each pattern letter run; used to skip parsers that cannot match.
_SHAPES = {
    "yyyy": r"\d{4}",
    "MMM": r"\p{L}{3}",
    "MM": r"\d{2}",
    "dd": r"\d{2}",
    "HH": r"\d{2}",
    "mm": r"\d{2}",
    "ss": r"\d{2}",
}


def parse_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to TIMESTAMP_NTZ by the first format that fits, else NULL."""
    text = strip(c)
    return F.coalesce(*[_parse_one(text, f) for f in formats])


def _parse_one(text: Column, fmt: str) -> Column:
    if fmt in _STANDARD:
        parsed = text.try_cast("timestamp_ntz")  # no session time zone takes part
    elif re.search(r"[HhKkamsSnN]", re.sub(r"'[^']*'", "", fmt)):
        parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    else:
        # the date parser does not touch the session time zone
        parsed = F.try_to_date(text, fmt).cast("timestamp_ntz")
    shape = format_shape(fmt)
    # a failed parse costs an exception inside the JVM; the shape test is far cheaper
    return F.when(text.rlike(shape), parsed) if shape else parsed


def format_shape(fmt: str) -> str | None:
    """The format as a regular expression; None when it has letters not listed above."""
    out = []
    for match in re.finditer(r"'([A-Za-z]+)'|([A-Za-z])\2*|[^A-Za-z]", fmt):
        piece = match.group(0)
        if match.group(1):
            out.append(match.group(1))
        elif piece in _SHAPES:
            out.append(_SHAPES[piece])
        elif piece.isalpha() or piece == "'":
            return None
        else:
            out.append(re.escape(piece))
    return "^" + "".join(out) + "$"
