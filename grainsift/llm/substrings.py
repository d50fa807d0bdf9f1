"""Removal of passages that repeat between documents, by cells of minimizers and window hashes.

A suffix begins at a word and is followed for ``width`` words, which is all that matters: a
node at that depth with leaves in two documents is a repeat, and every longer (maximal)
repeat is a run of such nodes. No tree is built: such a node is the hash of a window of
``width`` words, and suffixes are dealt by minimizers of a fixed half of the width:

1. Every suffix of full depth is filed under a prefix inside it: of all runs of half the
   width in it, the one with the least fingerprint. Neighbouring suffixes mostly share that
   prefix; such a run of suffixes is a cell, and a cell is one row. Prefixes are counted with
   partial aggregation; one that lies in a single document has no deep node and goes.
2. Cells with the same words are aggregated to their smallest document. In any later document
   all suffixes of the cell are repeats, whatever the number of copies.
3. Only where different cells share a prefix are single suffixes looked at: the first
   copy of each such cell is spread into its suffixes, which are told apart by their full
   depth, aggregated to the smallest document and joined back.

Texts of documents that may be concerned are found by a Bloom filter of bounded size; only
these are moved. A fuller filter lets more through and changes no result.

Words are runs of anything but ASCII white space, unchanged. A word goes if a run of ``width``
words over it also starts in a document with a smaller id. Nodes are told apart by 128 bits:
the fingerprints of their words and of their prefix.

Null, empty and short texts have no repeats and keep all words. Documents with a null id
take no part. Rows with the same id are one document in the order of ids: they lose nothing
to each other. Repeated rows give repeated results. Only id and text columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, maybe_rows, small_batches, stored
from .fingerprints import sliding, span_hashes, text_hashes, window_hashes

WIDTH = 50


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # bytes split at ASCII white space alone


def cells(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell of a text: its prefix, its own fingerprint, its first and last suffix."""
    depth = width // 2
    if len(hashes) < width:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    grams = window_hashes(hashes, depth)
    order = np.argsort(grams, kind="stable")  # of equal prefixes the first
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    place = order[sliding(rank, width - depth + 1, np.minimum)]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    return grams[place[first]], span_hashes(hashes, first, last + width), first, last


def _cell_batches(batches, width):
    for batch in small_batches(batches):
        rows, prefix, cell = [], [], []
        for i, hashes in enumerate(text_hashes(batch.column(2).to_pylist())):
            if len(hashes) >= width:
                p, c, _, _ = cells(hashes, width)
                c, one = np.unique(c, return_index=True)
                rows.append(np.full(len(c), i))
                prefix.append(p[one])
                cell.append(c)
        yield _taken(batch, rows, prefix, cell)


def _taken(batch, rows, *columns):
    at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    arrays = [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in columns]
    arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in arrays]
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *arrays],
                                      ["doc_id", "mark", *"abc"[:len(arrays)]])


def _suffix_batches(batches, width):
    """The suffixes of the cells that are listed for a text."""
    for batch in small_batches(batches):
        rows, prefix, node, starts = [], [], [], []
        for i, (hashes, wanted) in enumerate(zip(text_hashes(batch.column(2).to_pylist()), batch.column(3))):
            p, c, first, last = cells(hashes, width)
            nodes = window_hashes(hashes, width)
            for k in np.flatnonzero(np.isin(c.view(np.int64), wanted.values.to_numpy(zero_copy_only=False))):
                own = np.arange(first[k], last[k] + 1)
                rows.append(np.full(len(own), i))
                prefix.append(np.full(len(own), p[k]))
                node.append(nodes[own])
                starts.append(own.astype(np.int32))
        yield _taken(batch, rows, prefix, node, starts)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.select("doc_id", "mark", "text", F.xxhash64("doc_id", "mark").alias("key"))


def _maybe(rows: DataFrame, wanted: DataFrame, inside: bool = True) -> DataFrame:
    return maybe_rows(rows, wanted.select(F.xxhash64("doc_id", "mark")), inside)


def repeats(rows: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, gone (cells all of whose suffixes start in a smaller document), starts (others that do)."""
    known = rows.filter("doc_id is not null and text is not null")
    filed = stored(map_arrow(known, functools.partial(_cell_batches, width=width),
                             "doc_id bigint, mark bigint, prefix bigint, cell bigint"), "cells")
    parts = (filed.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                                         F.min("cell").alias("c1"), F.max("cell").alias("c2"))
             .filter("low < high").select("prefix", (F.col("c1") != F.col("c2")).alias("mixed")))
    shared = stored(filed.join(parts, "prefix"), "shared")
    lowest = shared.groupBy("prefix", "cell").agg(F.min("doc_id").alias("low"))
    listed = stored(
        shared.join(lowest, ["prefix", "cell"]).filter("doc_id > low or mixed").groupBy("doc_id", "mark")
        .agg(F.collect_set(F.when(F.col("doc_id") > F.col("low"), F.col("cell"))).alias("gone"),
             F.collect_set(F.when(F.col("doc_id") == F.col("low"), F.col("cell"))).alias("split")), "listed")
    split = listed.filter(F.size("split") > 0).select("doc_id", "mark", "split")
    texts = _maybe(known, split).drop("key").join(split, ["doc_id", "mark"]).select("doc_id", "mark", "text", "split")
    leaves = stored(map_arrow(texts, functools.partial(_suffix_batches, width=width),
                              "doc_id bigint, mark bigint, prefix bigint, node bigint, start int"), "suffixes")
    nodes = (leaves.groupBy("prefix", "node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
             .filter("low < high").select("prefix", "node", "low"))
    starts = (leaves.join(nodes, ["prefix", "node"]).filter("doc_id > low")
              .groupBy("doc_id", "mark").agg(F.collect_set("start").alias("starts")))
    gone = listed.filter(F.size("gone") > 0).select("doc_id", "mark", "gone")
    return stored(gone.join(starts, ["doc_id", "mark"], "full"), "repeats")


def _cut_batches(batches, width):
    for batch in small_batches(batches):
        n_words, n_removed, kept = [], [], []
        texts = batch.column(1).to_pylist()
        hashed = text_hashes([t if gone.is_valid else None for t, gone in zip(texts, batch.column(2))])
        for text, hashes, gone, starts in zip(texts, hashed, batch.column(2), batch.column(3)):
            words = words_of(text)
            n_words.append(len(words))
            change = np.zeros(len(words) + 1, np.int64)
            if gone.is_valid:
                _, c, first, last = cells(hashes, width)
                hit = np.isin(c.view(np.int64), gone.values.to_numpy(zero_copy_only=False))
                np.add.at(change, first[hit], 1)
                np.add.at(change, last[hit] + width, -1)
            if starts.is_valid:
                at = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(change, at, 1)
                np.add.at(change, at + width, -1)
            if change.any():
                words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    rows = _keyed(docs, id_column, text_column)
    found = repeats(rows, width)
    none = F.lit(None)
    whole = _maybe(rows, found, inside=False).select("doc_id", "text", none.cast("array<bigint>").alias("gone"),
                                                     none.cast("array<int>").alias("starts"))
    cut = _maybe(rows, found).join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "gone", "starts")
    work, schema = functools.partial(_cut_batches, width=width), "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return map_arrow(whole, work, schema).union(map_arrow(cut, work, schema))
