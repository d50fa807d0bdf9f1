"""Token ids in Parquet files that can be read selectively.

Documents are put into shards by ranges of their id, encoded where they lie, and written as
one row each: shard, id, number of tokens, CRC of the ids and the ids as a list column. Ids
use the delta encoding of Parquet's second writer version, ids of documents and counts too,
so the metadata columns are read without touching the tokens. Row groups and pages are small and
sorted by id: a filter on the id is answered from the page indexes. Where a document starts
in the whole stream of tokens follows from the metadata alone: totals of the shards (one
number each, whatever the size of the corpus) and a running sum inside each shard.

Null and empty texts hold the end id alone. Rows are ordered by id, null ids first, and rows
with the same id by their text; repeated rows are all written. Only the id and text columns
are read; other columns, whatever their names, take no part. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import CACHE_ENTRIES, at_release, map_arrow, small_batches, work_dir

END_ID = 1
KEPT_WORDS, KEPT_LENGTH = CACHE_ENTRIES * 3 // 4, 64  # two tables, some 60 MB: most of these words are short
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
SHARD_BYTES = 64 << 20
MARKS = ".,;:!?*#&$%"

SCHEMA = "doc_id bigint, n_tokens bigint, token_ids array<int>"
CHECKED = "shard int, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"
ODD_SPACES = re.compile("[\x1c-\x1f]")  # white space in Python, not in the tokenizer's pattern


# letters that NFC leaves alone and that have one lower case each, and the marks behind them
LETTERS = re.compile(f"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([{re.escape(MARKS)}]*)")


def _byte_letters() -> dict[int, str]:
    """Latin letters as the characters that stand for their bytes in a byte-level model."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


BYTE_LETTERS = _byte_letters()


class Words(dict):
    """Packed ids of words: the last ones used and, when these are many, those before.

    Marks behind a letter or digit are tokens of their own, and A to Z are lower-cased by the
    tokenizer, so many words share their ids with a plainer one. With ``by_letters`` a word of
    letters is one piece for the library's model, which is given it without the steps before.
    """

    def __init__(self, tokenizer, by_letters: bool = False, before: dict[str, bytes] | None = None):
        self.tokenizer, self.by_letters, self.before = tokenizer, by_letters, {} if before is None else before
        self.tokenize = tokenizer.model.tokenize if by_letters else None

    def __missing__(self, word: str) -> bytes:
        packed = self.before.get(word)
        if packed is None:
            letters = LETTERS.fullmatch(word) if self.by_letters else None
            if letters is None:
                packed = self.other(word)
            else:
                head, tail = letters.groups()
                head = head.lower()
                packed = self.get(head) or self.before.get(head)
                if packed is None:
                    found = self.tokenize(head if head.isascii() else head.translate(BYTE_LETTERS))
                    packed = struct.pack(f"<{len(found)}I", *[t.id for t in found])
                if tail:
                    if len(head) <= KEPT_LENGTH:
                        self[head] = packed
                    packed += self.root(tail)
        if len(word) <= KEPT_LENGTH:
            self[word] = packed
        return packed

    def other(self, word: str) -> bytes:
        head = word.rstrip(MARKS)
        if not head or not head[-1].lower()[-1].isalnum():
            head = word
        tail = word[len(head):]
        if head.isascii() and "|" not in head:
            head = head.lower()
        return self.root(head) + (self.root(tail) if tail else b"")

    def root(self, word: str) -> bytes:
        packed = self.get(word)
        if packed is None:
            packed = self.before.get(word)
        if packed is None:
            ids = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_LENGTH:
            self[word] = packed
        return packed

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, t.split())) for t in texts]

    def renewed(self) -> Words:
        """This table or, when it is full, an empty one that looks words up in this one."""
        if len(self) <= KEPT_WORDS:
            return self
        self.before = {}  # of two tables at most
        return Words(self.tokenizer, self.by_letters, self)


_WORDS: dict[int, Words] = {}
at_release(_WORDS.clear)


def _words(spec: str) -> Words:
    mark = zlib.crc32(spec.encode())
    if mark in _WORDS:
        _WORDS[mark] = _WORDS[mark].renewed()
    if mark not in _WORDS:
        from tokenizers import Tokenizer

        _WORDS.clear()
        _WORDS[mark] = Words(Tokenizer.from_str(spec), pieces_are_letters(spec))
    return _WORDS[mark]


def _encode_batches(batches, shared, end_id):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spec, by_word = shared.value
    end = struct.pack("<I", end_id)
    for batch in small_batches(batches, 500):
        words = _words(spec)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        packed = []
        if by_word and not ODD_SPACES.search("".join(texts)):
            packed = [p + end for p in words.encode(texts)]
        else:
            for e in words.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                packed.append(struct.pack(f"<{len(e.ids)}I", *e.ids) + end)
        counts = [len(p) // 4 for p in packed]
        offsets = [0]
        for n in counts:
            offsets.append(offsets[-1] + n)
        values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)],
            ["doc_id", "n_tokens", "token_ids"])


def drops_white_space(spec: str) -> bool:
    """Whether a text's ids are those of its words, one after the other.

    So it is if the tokenizer cuts at white space and drops it, and no added token reaches
    over it; anything else is encoded text by text.
    """
    import json

    t = json.loads(spec)
    steps = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    pattern = first.get("pattern", {}).get("Regex", "")
    spaceless = removed and "\\s" not in pattern.replace("[^\\s", "") and " " not in pattern
    added = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not re.search(r"\s", a["content"])
                for a in t.get("added_tokens", []))
    kinds = [n["type"] for n in (t.get("normalizer") or {}).get("normalizers", [])]
    return bool(spaceless and added and set(kinds) <= {"NFC", "Replace", "Lowercase"})


def pieces_are_letters(spec: str) -> bool:
    """Whether a run of letters is one piece for the model, lower-cased and byte by byte.

    So it is in a byte-level BPE whose pattern takes all letters at once, if no alternative
    before that one can begin with a letter.
    """
    import json

    t = json.loads(spec)
    model, steps = t["model"], (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if model.get("type") != "BPE" or model.get("dropout") or [p["type"] for p in steps] != ["Split", "ByteLevel"]:
        return False
    turns = (t.get("normalizer") or {}).get("normalizers", [])
    normal = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} for n in turns)
    lowered = any(n["type"] == "Lowercase" for n in turns)
    cut, signs = steps
    parts = cut.get("pattern", {}).get("Regex", "").split("|")
    at = parts.index("[\\p{L}]+") if "[\\p{L}]+" in parts else -1
    whole = at >= 0 and all(re.fullmatch("'[a-z]+", p) for p in parts[:at])
    plain = not signs.get("add_prefix_space") and not signs.get("use_regex", True)
    marked = not any(LETTERS.fullmatch(a["content"]) for a in t.get("added_tokens", []))
    return bool(normal and lowered and whole and plain and marked and cut.get("behavior") == "Removed" and cut.get("invert"))


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID,
                 shards: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode all texts and write the files below ``folder``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, drops_white_space(spec)))  # one vocabulary: a few MB
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if shards is None:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(4, -(-n_bytes // SHARD_BYTES))
    dealt = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    encoded = map_arrow(ordered, functools.partial(_encode_batches, shared=shared, end_id=end_id), SCHEMA)
    (encoded.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place"), "*")
     .write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
     .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS).parquet(folder))


def _with_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Put the running sum of n_tokens over (shard, place) in the place of these two.

    Totals of the shards come from ``sizes`` (shard, n_tokens), which need not read the tokens.
    """
    totals = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row for each shard
    before = totals.select(
        "shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place")) - F.col("n_tokens")
    rest = [c for c in rows.columns if c not in ("shard", "place", "doc_id")]
    return rows.join(before, "shard").select("doc_id", (F.col("before") + inside).alias("start"), *rest)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (tokens before the document) and n_tokens; no token is read."""
    rows = spark.read.parquet(folder).select("shard", "place", "doc_id", "n_tokens")
    return _with_start(rows, rows)


def read_tokens(spark: SparkSession, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id and token_ids of the documents with ids from ``low`` to ``high``."""
    rows = spark.read.parquet(folder)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= high)
    return rows.select("doc_id", "token_ids")


def _check_batches(batches):
    for batch in batches:
        lists = batch.column(3)
        offsets, raw = lists.offsets.to_pylist(), memoryview(lists.values.buffers()[1] or b"")
        skip = lists.values.offset
        sums = [zlib.crc32(raw[4 * (skip + a):4 * (skip + b)]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([b - a for a, b in zip(offsets, offsets[1:])], pa.int64()),
             pa.array(sums, pa.int64())], ["shard", "place", "doc_id", "n_tokens", "ids_crc32"])


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the ids that the files hold."""
    files = spark.read.parquet(folder)
    checked = map_arrow(files.select("shard", "place", "doc_id", "token_ids"), _check_batches, CHECKED)
    return _with_start(checked, files.select("shard", "n_tokens"))


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the files to a new shared folder, read them back and return what they hold."""
    folder = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path, end_id, shards, id_column, text_column)
    return read_checksums(docs.sparkSession, folder)
