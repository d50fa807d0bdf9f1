"""Lines that many documents share, by sorted hash ranges; the result is a bitmap per document.

A line's key is the line without ASCII white space at both ends, with A to Z in lower case.
Keys of at least ``min_chars`` code points that lie in at least ``least`` documents lose all
their lines everywhere; the other lines stay.

1. One pass over the texts yields a row (hash of the key, document, position) for each line.
2. These rows are partitioned into ranges of (hash, document) and sorted by hash, document
   and position. A task streams its range: of a key that is not decided yet it holds the
   lines of fewer than ``least`` documents, and with the first line of the last one needed all
   are known to go, so those that follow are passed on at once. A frequent key spans as many
   ranges as it needs, since ranges also cut by document.
3. Only the first and the last key of a range may go on in its neighbours. Where such a key is
   not decided inside the range its lines are handed on as open ones (of fewer than ``least``
   documents each), and a count over these, by key, decides them.
4. The lines that go are gathered per document into a keep bitmap: one bit for each line, the
   first in the lowest bit of the first byte, 1 for lines that stay, compressed by zlib.

Documents that lose nothing have no bitmap. ``drop_lines`` applies the bitmaps: in one pass
over the texts, a Bloom filter of bounded size lets documents that have none pass with their
result, and only texts that may have one are moved to meet it.

Keys are told apart by 128 bits of BLAKE2b. Null and empty texts are one empty line, whose key
is too short to go (as that of every blank line, if ``min_chars`` is at least 1). Rows that
share an id are one document in the count, and a row without an id is told by its text;
repeated rows get the same result. Texts of any length are read whole, each by one task. Only
id and text columns are read.
"""

from __future__ import annotations

import functools
import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import key_filter, map_arrow, stored

LEAST, MIN_CHARS = 10, 1
HELD = 10_000  # lines of an undecided key; beyond that they are handed on as open ones

LINES = "h1 bigint, h2 bigint, doc bigint, unnamed boolean, mark bigint, place int, n_lines int"
SEEN = "kind int, " + LINES
GOES, OPEN, FREQUENT = 0, 1, 2
EMIT_ROWS = 100_000


def key_of(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes, both are ASCII alone


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _line_batches(batches, min_chars):
    """One row for each line that is long enough; batches: doc_id, mark, text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            lines = lines_of(text)
            for place, line in enumerate(lines):
                key = key_of(line)
                if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                    digest = blake2b(key, digest_size=16).digest()
                    row = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True),
                           mark if doc is None else doc, doc is None, mark, place, len(lines))
                    for column, value in zip(out, row):
                        column.append(value)
            if len(out[0]) >= EMIT_ROWS:
                yield _line_rows(out)
                out = [[] for _ in range(7)]
        yield _line_rows(out)


def _line_rows(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                      ["h1", "h2", "doc", "unnamed", "mark", "place", "n_lines"])


class Stream:
    """Decides the keys of one sorted range; rows are columns (h1, h2, doc, unnamed, mark, place, n_lines)."""

    def __init__(self, least: int):
        self.least = least
        self.key: tuple[int, int] | None = None  # of the run that is not over
        self.docs: set[tuple[int, int]] = set()  # fewer than ``least`` while it is undecided
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.frequent = False
        self.at_border = True  # it began with the range
        self.out: list[tuple[int, np.ndarray]] = []

    def add(self, rows: np.ndarray) -> None:
        """The next rows (an int64 matrix), in order."""
        keys = rows[:, :2]
        heads = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        ends = np.append(heads[1:], len(rows))
        fresh = np.concatenate(([True], (rows[1:, :4] != rows[:-1, :4]).any(1)))
        n_docs = np.add.reduceat(fresh, heads, dtype=np.int64)
        first, last = 0, len(heads) - 1
        self._go_on(rows[heads[first]:ends[first]])
        if last == first:
            return
        self._close(False)
        inner = n_docs >= self.least  # runs that begin and end inside these rows
        inner[[first, last]] = False
        self.out.append((GOES, rows[np.repeat(inner, ends - heads)]))
        self._go_on(rows[heads[last]:ends[last]])

    def _go_on(self, rows: np.ndarray) -> None:
        """More rows of the run that is not over, or the first of a new one."""
        key = (int(rows[0, 0]), int(rows[0, 1]))
        if key != self.key:
            if self.key is not None:
                self._close(False)
            self.key = key
        if not self.frequent:
            fresh = np.concatenate(([True], (rows[1:, 2:4] != rows[:-1, 2:4]).any(1)))
            for doc in rows[fresh][:2 * self.least, 2:4].tolist():  # the first may be known already
                if len(self.docs) < self.least:
                    self.docs.add(tuple(doc))
            if len(self.docs) >= self.least:
                self.frequent = True
                self.out += [(GOES, part) for part in self.held]
                self.held, self.n_held = [], 0
                self.out.append((FREQUENT, rows[:1]))
        if self.frequent:
            self.out.append((GOES, rows))
        elif self.n_held + len(rows) > HELD:
            self.at_border = True  # its lines are open, even if it ends here
            self.out += [(OPEN, part) for part in (*self.held, rows)]
            self.held, self.n_held = [], 0
        else:
            self.held.append(rows)
            self.n_held += len(rows)

    def _close(self, last: bool) -> None:
        """The run is over, or the range is (``last``)."""
        if not self.frequent and (self.at_border or last):
            self.out += [(OPEN, part) for part in self.held]
        self.key, self.docs, self.held, self.n_held, self.frequent, self.at_border = None, set(), [], 0, False, False

    def end(self) -> None:
        if self.key is not None:
            self._close(True)

    def taken(self) -> pa.RecordBatch:
        """What has been decided so far."""
        rows = np.concatenate([r for _, r in self.out]) if self.out else np.zeros((0, 7), np.int64)
        kind = np.repeat([k for k, _ in self.out], [len(r) for _, r in self.out]).astype(np.int32) if self.out else np.zeros(0, np.int32)
        self.out = []
        columns = [pa.array(rows[:, k]) for k in range(7)]
        columns[3] = columns[3].cast(pa.bool_())
        columns[5:] = [c.cast(pa.int32()) for c in columns[5:]]
        return pa.RecordBatch.from_arrays([pa.array(kind), *columns],
                                          ["kind", "h1", "h2", "doc", "unnamed", "mark", "place", "n_lines"])


def _stream_batches(batches, least):
    stream = Stream(least)
    for batch in batches:
        if batch.num_rows:
            columns = [c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns]
            stream.add(np.stack(columns, axis=1))
            yield stream.taken()
    stream.end()
    yield stream.taken()


def frequent_lines(rows: DataFrame, least: int, min_chars: int) -> DataFrame:
    """doc, unnamed, mark, place and n_lines of all lines that go; rows: doc_id, mark, text."""
    lines = stored(map_arrow(rows, functools.partial(_line_batches, min_chars=min_chars), LINES), "lines")
    dealt = (lines.repartitionByRange("h1", "h2", "unnamed", "doc")
             .sortWithinPartitions("h1", "h2", "unnamed", "doc", "mark", "place"))
    seen = stored(map_arrow(dealt, functools.partial(_stream_batches, least=least), SEEN), "seen")
    open_ = seen.filter(F.col("kind") == OPEN)
    decided = (seen.filter(F.col("kind") != GOES).groupBy("h1", "h2")
               .agg(F.count_distinct(F.struct("unnamed", "doc")).alias("n"), F.max("kind").alias("kind"))
               .filter((F.col("n") >= least) | (F.col("kind") == FREQUENT)).select("h1", "h2"))
    columns = ["doc", "unnamed", "mark", "place", "n_lines"]
    return (seen.filter(F.col("kind") == GOES).select(*columns)
            .union(open_.join(decided, ["h1", "h2"], "left_semi").select(*columns)))


def pack(n_lines: int, gone: np.ndarray) -> bytes:
    """The keep bitmap of a document with so many lines, without those at the positions."""
    keep = np.ones(n_lines, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack(n_lines: int, keep: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _bitmap_batches(batches):
    for batch in batches:
        n_lines, gone = batch.column(3).to_pylist(), batch.column(4)
        keep = [pack(n, gone[k].values.to_numpy(zero_copy_only=False)) for k, n in enumerate(n_lines)]
        n_dropped = pa.array([len(gone[k]) for k in range(len(n_lines))], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n_lines, pa.int64()), n_dropped, pa.array(keep, pa.binary())],
            ["doc", "unnamed", "mark", "n_lines", "n_dropped", "keep"])


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _bitmaps(rows: DataFrame, least: int, min_chars: int) -> DataFrame:
    lost = (frequent_lines(rows, least, min_chars).groupBy("doc", "unnamed", "mark")
            .agg(F.max("n_lines").alias("n_lines"), F.collect_set("place").alias("gone")))  # of one document's lines
    return map_arrow(lost, _bitmap_batches,
                     "doc bigint, unnamed boolean, mark bigint, n_lines bigint, n_dropped bigint, keep binary")


def line_bitmaps(docs: DataFrame, least: int = LEAST, min_chars: int = MIN_CHARS, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_lines, n_dropped and keep, of documents that lose a line."""
    found = _bitmaps(_keyed(docs, id_column, text_column), least, min_chars)
    return found.select(F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "mark", "n_lines", "n_dropped", "keep")


def _settle_batches(batches, bloom):
    """Texts that have no bitmap are done: their lines are counted; the others are passed on."""
    for batch in batches:
        may = bloom.value.may_hold(batch.column(3).to_numpy()).tolist()
        texts = batch.column(2).to_pylist()
        plain = [None if m else t or "" for m, t in zip(may, texts)]
        n_lines = [None if t is None else t.count("\n") + 1 for t in plain]
        pending = [t if m else None for m, t in zip(may, texts)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(n_lines, pa.int64()), pa.array(plain, pa.string()), pa.array(pending, pa.string())],
            ["doc_id", "mark", "n_lines", "kept", "text"])


def _apply_batches(batches):
    """Columns doc_id, n_lines and kept of the settled, text of the others, n_dropped and keep of bitmaps."""
    for batch in batches:
        doc_ids, n_lines, kept, texts, n_dropped, keeps = (c.to_pylist() for c in batch.columns)
        for k, text in enumerate(texts):
            if n_lines[k] is None:
                lines = (text or "").split("\n")
                n_lines[k] = len(lines)
                if keeps[k] is None:
                    kept[k] = text or ""
                else:
                    stays = unpack(len(lines), keeps[k])
                    kept[k] = "\n".join([line for line, stay in zip(lines, stays.tolist()) if stay])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array([n or 0 for n in n_dropped], pa.int64()),
             pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])


def drop_lines(docs: DataFrame, least: int = LEAST, min_chars: int = MIN_CHARS, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept (the lines that stay, joined by line feeds) of every row."""
    rows = _keyed(docs, id_column, text_column)
    bitmaps = stored(_bitmaps(rows, least, min_chars), "bitmaps")
    ident = lambda doc: F.xxhash64(doc, "mark")
    named = F.when(~F.col("unnamed"), F.col("doc"))
    bloom = docs.sparkSession.sparkContext.broadcast(key_filter(bitmaps.select(ident(named).alias("key"))))  # 8 MB at most
    asked = rows.select("doc_id", "mark", "text", ident("doc_id").alias("ident"))
    settled = map_arrow(asked, functools.partial(_settle_batches, bloom=bloom),
                        "doc_id bigint, mark bigint, n_lines bigint, kept string, text string")
    maps = bitmaps.select(named.alias("b_doc"), F.col("mark").alias("b_mark"), "n_dropped", "keep")
    met = settled.join(maps, settled.doc_id.eqNullSafe(F.col("b_doc")) & (settled.mark == F.col("b_mark")), "left")
    return map_arrow(met.select("doc_id", "n_lines", "kept", "text", "n_dropped", "keep"), _apply_batches,
                     "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")
