"""Keys for joins by edit distance: texts within a distance agree on one of their keys.

Lengths and positions are in code points. Keys are 64-bit hashes, so long texts are never
moved for a key; a clash of hashes only makes a candidate more, which is then measured.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def within_distance(a: Column, b: Column, distance: int) -> Column:
    """The edit distance of two texts, or NULL beyond ``distance``."""
    d = F.levenshtein(a, b, distance)
    return F.when(d >= 0, d)


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (0-based) and size of the i-th of ``parts`` segments of a text of that length."""
    size, longer = F.floor(length / parts).cast("int"), length % parts  # the last ones are longer by one
    start = F.lit(i) * size + F.greatest(F.lit(0), F.lit(i - parts) + longer)
    return start, size + F.when(F.lit(i) >= F.lit(parts) - longer, 1).otherwise(0)


def _key(length: Column, i: int, piece: Column, kind: int) -> Column:
    return F.xxhash64(F.lit(kind), length, F.lit(i), piece)


def segment_keys(text: Column, distance: int) -> Column:
    """The keys of a text that is looked for: one for each of its ``distance`` + 1 segments.

    An edit changes one segment, so ``distance`` edits leave one as it is (the pigeonhole
    principle). Only for texts longer than ``distance``.
    """
    length, keys = F.char_length(text), []
    for i in range(distance + 1):
        start, size = _segment(length, i, distance + 1)
        keys.append(_key(length, i, F.substr(text, start + 1, size), 1))
    return F.array(*keys)


def substring_keys(text: Column, distance: int, least: int = 0, most: int | None = None) -> Column:
    """The keys of the texts that may be found: those ``least`` to ``most`` (``distance``) characters shorter.

    The i-th segment of a shorter text can only be where i edits before it and the others
    behind it may have moved it, which bounds the substrings to look at.
    """
    length, keys = F.char_length(text), []
    for less in range(least, (distance if most is None else most) + 1):
        short = length - less
        for i in range(distance + 1):
            start, size = _segment(short, i, distance + 1)
            low, high = max(-i, less - (distance - i)), min(i, less + (distance - i))
            for shift in range(low, high + 1):
                at = start + shift
                inside = (at >= 0) & (at + size <= length) & (short > distance)
                keys.append(F.when(inside, _key(short, i, F.substr(text, at + 1, size), 1)))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _layers(text: Column, distance: int) -> list[Column]:
    """What is left of the text without 0, 1, ... ``distance`` of its characters."""

    def shorter(texts: Column) -> Column:
        cut = lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))),
            lambda i: F.concat(F.left(t, i - 1), F.substr(t, i + 1)))
        return F.array_distinct(F.flatten(F.transform(texts, cut)))

    layers = [F.array(text)]
    for _ in range(distance):
        layers.append(shorter(layers[-1]))
    return layers


def deletions(text: Column, distance: int) -> Column:
    """The text and all that is left of it without up to ``distance`` of its characters.

    Two texts within the distance share one of these. The number grows with the length to
    the power of the distance: for words, not for documents.
    """
    return F.array_distinct(F.concat(*_layers(text, distance)))


def deletion_keys(text: Column, distance: int) -> Column:
    return F.transform(deletions(text, distance), lambda t: F.xxhash64(F.lit(2), t))


def whole_deletion_keys(text: Column, distance: int) -> Column:
    """The keys of what is left without exactly ``distance`` characters.

    A longer text within the distance has one of these in common with the ``deletion_keys`` of
    the shorter one for ``distance`` - 1: a character that both keep can be taken out of both.
    """
    return F.transform(_layers(text, distance)[-1], lambda t: F.xxhash64(F.lit(2), t))
