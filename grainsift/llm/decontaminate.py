"""Benchmark decontamination: which words of a document belong to a passage of a test item.

Words are lower-cased (A to Z only) runs of letters, digits and characters beyond ASCII. An
item's windows are its runs of ``width`` consecutive words; an item with fewer words, but not
none, is one window. The windows are put into a set of hashes that every task gets. A task
turns each text into word numbers of the test vocabulary, looks up the hashes of all its
windows at once and verifies hits by comparing the words themselves.

A test set beyond ``MAX_BENCHMARK_BYTES`` is not broadcast whole: its items are dealt into
blocks of that size, and each block is held against all documents. The hit words of the
blocks are united for each document.

Null and empty texts have no words: documents without words are never contaminated, items
without words have no window. Repeated documents give repeated rows; items with the same id
count as one. A null item id is no item. Only id and text columns are read. An empty test
set contaminates nothing.
"""

from __future__ import annotations

import functools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import at_release, free_name, map_arrow, refuse_clash

WIDTH = 10
MAX_BENCHMARK_BYTES = 16 << 20

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TO_LOWER = {i: i + 32 for i in range(65, 91)}
FOUND = ("n_words", "hit_words", "items")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(TO_LOWER)) if text else []


class Windows:
    """Hash sets of the test windows, one for each window length."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.number: dict[str, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], list[str]]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            length = min(width, len(ids))
            windows = self.by_length.setdefault(length, {}) if ids else {}
            for window in {tuple(ids[i:i + length]) for i in range(len(ids) - length + 1)} if ids else ():
                windows.setdefault(window, []).append(item)
        self.hashes = {n: np.sort(self._hash(np.array(list(w), np.uint64), n)) for n, w in self.by_length.items()}

    @staticmethod
    def _hash(windows: np.ndarray, length: int) -> np.ndarray:
        """Of each row of word numbers."""
        out = np.zeros(len(windows), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length):
                out = out * np.uint64(0x9E3779B97F4A7C15) + windows[:, i] + np.uint64(1)
                out ^= out >> np.uint64(29)
        return out

    def find(self, words: list[str]) -> tuple[list[int], list[str]]:
        """Positions of the words that windows cover, and the items whose windows occur."""
        number = self.number
        ids = np.fromiter((number.get(w, 0) for w in words), np.uint64, len(words))
        if not ids.any():
            return [], []
        hit, items = np.zeros(len(ids), bool), set()
        for length, windows in self.by_length.items():
            if len(ids) < length:
                continue
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            hashes = self._hash(ids[starts[:, None] + np.arange(length)], length)
            at = np.searchsorted(self.hashes[length], hashes)
            at[at == len(self.hashes[length])] = 0
            for start in starts[self.hashes[length][at] == hashes].tolist():
                found = windows.get(tuple(ids[start:start + length].tolist()))
                if found:  # the words themselves are equal
                    hit[start:start + length] = True
                    items.update(found)
        return np.flatnonzero(hit).tolist(), sorted(items)


_WINDOWS: dict[tuple, Windows] = {}
at_release(_WINDOWS.clear)


def _find_batches(batches, shared, mark, width, text_at, drop_text):
    """The last three columns hold what earlier blocks of items found."""
    if mark not in _WINDOWS:
        _WINDOWS.clear()
        _WINDOWS[mark] = Windows(shared.value, width)
    windows = _WINDOWS[mark]
    for batch in batches:
        n_words, hits, items = [], batch.column(-2).to_pylist(), batch.column(-1).to_pylist()
        for i, text in enumerate(batch.column(text_at).to_pylist()):
            words = words_of(text)
            n_words.append(len(words))
            hit, found = windows.find(words)
            if hit:
                hits[i] = sorted({*hits[i], *hit})
                items[i] = sorted({*items[i], *found})
        columns = dict(zip(batch.schema.names[:-3], batch.columns))
        if drop_text:
            del columns[batch.schema.names[text_at]]
        names = [*columns, *batch.schema.names[-3:]]
        yield pa.RecordBatch.from_arrays(
            [*columns.values(), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())),
             pa.array(items, pa.list_(pa.string()))], names)


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int):
    """Calls that fetch item lists, each of a bounded size; together they are the whole test set."""
    items = (benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
             .filter("item is not null"))
    n_bytes = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-n_bytes * 2 // block_bytes)) if n_bytes > block_bytes else 1
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield lambda block=block: [(r.item, r.text) for r in block.collect()]  # its size is checked above


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_column: str = "text",
                  item_column: str = "item_id", item_text_column: str = "text", names: tuple[str, str, str] = FOUND,
                  block_bytes: int = MAX_BENCHMARK_BYTES, drop_text: bool = False) -> DataFrame:
    """The documents' columns and, named by ``names``: number of words, positions of hit words, items.

    The items are ids as text, sorted. ``names`` that a column of the documents has are refused.
    """
    refuse_clash(docs.columns, *names)
    spark = docs.sparkSession
    out = docs.withColumns({names[0]: F.lit(0).cast("bigint"), names[1]: F.array().cast("array<int>"),
                            names[2]: F.array().cast("array<string>")})
    text_at = docs.columns.index(text_column)
    blocks = list(_blocks(benchmark, item_column, item_text_column, block_bytes))
    for k, block in enumerate(blocks):
        drop = drop_text and k == len(blocks) - 1
        work = functools.partial(_find_batches, shared=spark.sparkContext.broadcast(block()), mark=uuid.uuid4().hex,
                                 width=width, text_at=text_at, drop_text=drop)
        schema = T.StructType([f for f in out.schema.fields if not (drop and f.name == text_column)])
        out = map_arrow(out, work, schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of a test item occurs, with their own columns."""
    names = tuple(free_name(docs.columns, n) for n in FOUND)
    found = find_passages(docs, benchmark, names=names, **options)
    return found.filter(F.size(names[1]) == 0).drop(*names)


def remove_passages(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents with the hit words cut out of their texts; other text stays as it was."""
    names = tuple(free_name(docs.columns, n) for n in FOUND)
    found = find_passages(docs, benchmark, names=names, text_column=text_column, **options)
    work = functools.partial(_cut_batches, text_at=docs.columns.index(text_column))
    return map_arrow(found, work, docs.schema)


def _cut_batches(batches, text_at):
    for batch in batches:
        texts = []
        for text, hit in zip(batch.column(text_at).to_pylist(), batch.column(-2).to_pylist()):
            if hit:
                gone, kept, at = set(hit), [], 0
                for k, m in enumerate(WORD.finditer(text.translate(TO_LOWER))):
                    if k in gone:
                        kept.append(text[at:m.start()])
                        at = m.end()
                text = "".join(kept) + text[at:]
            texts.append(text)
        columns = batch.columns[:-3]
        columns[text_at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-3])
