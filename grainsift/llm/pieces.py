"""SentencePiece BPE encoding and decoding by a table of last tokens.

For every prefix of a piece of text there is exactly one token that ends its encoding. It is
found from left to right: among the vocabulary entries that end at a position (an automaton
lists them) it is the one that begins where a prefix ends whose own last token is compatible
with it, that is, the two tokens alone would be encoded as just these two. The ids are then
recovered from the end. Work is linear in the text, whatever its length or repetition.

Merges never cross the start of a run of spaces or a character that no entry holds, so the
text is cut there and the ids of the short parts are kept in a bounded table.

Null and empty texts encode to the begin and end ids alone and decode to an empty text. Rows
are independent, so repeated rows and repeated ids give repeated results. Only the id and
text columns are read; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CACHE_ENTRIES, at_release, map_arrow

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = "normal", "unknown", "control", "byte"
MARKS = ".,;:!?*#&$%|)"  # an end of these is encoded apart where no entry spans the seam
KEPT_PARTS, KEPT_PAIRS, KEPT_LENGTH = CACHE_ENTRIES // 2, CACHE_ENTRIES, 48

SCHEMA = "key bigint, n_tokens bigint, ids binary, decoded string"


class Parts(dict):
    """Packed ids of short parts: the last ones used and, when these are many, those before."""

    def __init__(self, encode, joins: set[str]):
        super().__init__()
        self.encode, self.joins, self.before = encode, joins, {}

    def __missing__(self, part: str) -> bytes:
        packed = self.before.get(part)
        if packed is None:
            head = part.rstrip(MARKS)
            if 0 < len(head) < len(part) and part[len(head) - 1:len(head) + 1] not in self.joins:
                return self[head] + self[part[len(head):]]
            ids = self.encode(part)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT_PARTS:
                self.before = dict(self)
                self.clear()
            self[part] = packed
        return packed


class PieceTable:
    """The vocabulary, ready to encode and decode. entries: (piece, score, kind) by id."""

    def __init__(self, entries: list[tuple[str, float, str]], bos: int, eos: int, unk: int):
        self.bos, self.eos, self.unk = bos, eos, unk
        self.surface = [p for p, _, _ in entries]
        self.score = {p: s for p, s, kind in entries if kind == NORMAL}
        self.number = {p: i for i, (p, _, kind) in enumerate(entries) if kind == NORMAL}
        self.byte_ids = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(entries) if kind == BYTE}
        letters = {c for p in self.number for c in p}
        for c in sorted(letters - self.number.keys()):  # can be merged but has no id of its own
            self.number[c] = len(self.surface)
            self.surface.append(c)
        self.n_real = len(entries)
        self.matches = ahocorasick.Automaton()
        for p, i in self.number.items():
            self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        known = "".join(sorted(re.escape(c) for c in letters))
        self.runs = re.compile(f"[{known}]+|[^{known}]", re.S)
        # a part may end behind a letter or digit unless an entry goes on with the next mark
        joined = {p[i + 1] for p in self.number for i in range(len(p) - 1)
                  if re.match(r"\w", p[i]) and re.match(r"\W", p[i + 1])} - {SPACE}
        more = f"(?:[{''.join(re.escape(c) for c in sorted(joined))}][^{SPACE}\\w]*\\w*)*" if joined else ""
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\\w]*\\w*{more}")
        self.joins = {p[i:i + 2] for p in self.number for i in range(len(p) - 1)}
        self.parts = Parts(self._encode_part, self.joins)
        self.pairs: dict[int, bool] = {}
        self.whole = {i for p, i in self.number.items() if len(self.merged(p)) == 1}
        self.out = [
            b"" if kind == CONTROL else bytes([int(p[3:-1], 16)]) if kind == BYTE
            else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, kind in entries
        ]

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and then leftmost; only for one or two tokens."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, left: int, right: int) -> bool:
        a, b = self.surface[left], self.surface[right]
        fit = right in self.whole and self.merged(a + b) == [a, b]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = fit
        return fit

    def _encode_run(self, run: str) -> list[int]:
        last = [-1] * (len(run) + 1)
        pairs, whole = self.pairs, self.whole
        for end, (token, length) in self.matches.iter(run):
            end += 1
            if last[end] < 0:
                left = last[end - length]
                if left >= 0:
                    fit = pairs.get(left << 32 | token)
                    if self._fit(left, token) if fit is None else fit:
                        last[end] = token
                elif end == length and token in whole:
                    last[end] = token
        ids, at = [], len(run)
        while at:
            ids.append(last[at])
            at -= len(self.surface[last[at]])
        return ids[::-1]

    def _encode_part(self, part: str) -> list[int]:
        whole = self.number.get(part, -1)
        if whole < self.n_real and whole in self.whole:
            return [whole]
        ids: list[int] = []
        for run in self.runs.findall(part):
            tokens = self._encode_run(run) if run[0] in self.number else [-1]
            for token in tokens:
                if 0 <= token < self.n_real:
                    ids.append(token)
                    continue
                text = run if token < 0 else self.surface[token]
                for b in text.encode():
                    ids.append(self.byte_ids.get(b, self.unk))
        return ids

    def encode(self, text: str) -> bytes:
        """Begin id, ids and end id as little-endian unsigned 32-bit integers."""
        body = b""
        if text:
            marked = (" " + text).replace(" ", SPACE)
            body = b"".join(map(self.parts.__getitem__, self.cut.findall(marked)))
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; one space of the start, which encoding adds, goes."""
        raw = b"".join(map(self.out.__getitem__, memoryview(ids).cast("I")))
        return raw.removeprefix(b" ").decode("utf-8", "piece_bytes")


def _one_mark_per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


def read_model(path: str) -> tuple[list[tuple[str, float, str]], int, int, int]:
    """Entries and special ids of a SentencePiece BPE model file with byte fallback."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: UNKNOWN if m.is_unknown(i) else CONTROL if m.is_control(i) else BYTE if m.is_byte(i) else NORMAL
    entries = [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]
    return entries, m.bos_id(), m.eos_id(), m.unk_id()


_TABLES: dict[str, PieceTable] = {}
at_release(_TABLES.clear)


def table_of(model) -> PieceTable:
    """The table of a broadcast model, built once in each worker."""
    import codecs

    codecs.register_error("piece_bytes", _one_mark_per_byte)
    mark, spec = model
    if mark not in _TABLES:
        _TABLES.clear()
        _TABLES[mark] = PieceTable(*spec)
    return _TABLES[mark]


def _encode_batches(batches, shared):
    table = table_of(shared.value)
    for batch in batches:
        ids = [table.encode(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
             pa.array([table.decode(x) for x in ids], pa.string())],
            ["key", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: key (its id), n_tokens, ids (packed), decoded (their text)."""
    spark = docs.sparkSession
    spec = read_model(model_path)
    mark = hashlib.sha256(repr(spec).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((mark, spec))  # one vocabulary: below a few MB
    rows = docs.select(F.col(id_column).cast("bigint").alias("key"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, functools.partial(_encode_batches, shared=shared), SCHEMA)
