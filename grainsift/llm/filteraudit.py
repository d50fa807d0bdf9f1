"""What filters do in every order: an audit of their interaction by wide packed counters.

Each document has a mask of the filters that it fails. For a mask, what happens in all orders
is known beforehand: with five filters, 120 orders of five steps. A mask is therefore mapped
to one wide integer with a field for each of the 600 steps, which is 1 where the document is
removed, and further fields for the mask itself. Integers of documents are summed per part,
equal masks as a product with their number; no field can overflow, since fields are as wide
as the number of documents of the part. Unpacking a sum gives the counts of all steps at
once. Three sums are kept: of all documents, of those labelled good and of toxic ones.

The rest follows from fields: what is kept is the documents of the part less those removed so
far, redundant failures are the failures of a filter less its removals, and a filter's Shapley
count is the sum of its removals in all orders.

Masks are found in one pass that reads texts once and moves only digests. A text that repeats
is told by 128 bits of BLAKE2b; the documents that come first are ranked per digest, where
each task passes on only its first ones, so a text that a third of all rows share is no
burden. Counts per part and mask are aggregated before they are moved; a part has at most 128
of them, and nothing reaches the driver.

A null text is an empty one and a null part the empty string. A null id is neither smaller nor
larger than any other: such a document is no copy and makes none. Rows that share an id (and
repeated rows) are documents of their own, none of them a copy of the other. A document is
good or toxic if any of its label rows says 1; null labels and ids say nothing. An empty
table has no parts and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import itertools
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import at_release, map_arrow, stored

LETTERS = "ABCDE"
COPY = 4  # the bit of the filter for copies, the only one that looks at other documents
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
MARKS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def failures(text: str | None) -> int:
    """The mask of the filters A to D that a text fails."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at ASCII white space alone
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, UPPER))) > UPPER_PERCENT * len(text or "")
    marked = len(raw) != len(raw.translate(None, MARKS))
    return few | repeated << 1 | loud << 2 | marked << 3


class Packed:
    """Wide integers of masks over ``letters``: their layout, the sums and how they are unpacked."""

    def __init__(self, letters: str = LETTERS):
        self.letters = letters
        self.orders = list(itertools.permutations(range(len(letters))))
        n = len(letters)
        self.steps = len(self.orders) * n
        places = []  # of each mask: the fields that hold a 1
        for mask in range(1 << n):
            own = [self.steps + f for f in range(n) if mask >> f & 1]  # failures of a filter
            if mask and not mask & (mask - 1):
                own.append(self.steps + n + mask.bit_length() - 1)  # failures of this filter only
            own.append(self.steps + 2 * n)  # the document itself
            for k, order in enumerate(self.orders):
                hit = next((s for s, f in enumerate(order) if mask >> f & 1), None)
                if hit is not None:
                    own.append(k * n + hit)
            places.append(own)
        self.places, self.fields = places, self.steps + 2 * n + 1

    def total(self, counts: dict[int, int], width: int) -> list[int]:
        """All fields of the sum of the integers of so many documents per mask; width: bits of a field, whole bytes."""
        packed = sum(n * sum(1 << (width * at) for at in self.places[mask]) for mask, n in counts.items())
        raw = packed.to_bytes(self.fields * width // 8, "little")
        step = width // 8
        return [int.from_bytes(raw[k:k + step], "little") for k in range(0, len(raw), step)]

    def audit(self, rows: list[tuple[int, bool, bool, int]]) -> list[tuple]:
        """(order, step, counts ...) of one part from rows (mask, good, toxic, number)."""
        n = len(self.letters)
        width = -(-max(1, sum(r[3] for r in rows).bit_length()) // 8) * 8  # whole bytes; no sum of a field exceeds it

        def fields(wanted):
            counts: dict[int, int] = {}
            for mask, good, toxic, number in rows:
                if wanted(good, toxic):
                    counts[mask] = counts.get(mask, 0) + number
            return self.total(counts, width)

        every, good, toxic = fields(lambda g, t: True), fields(lambda g, t: g), fields(lambda g, t: t)
        fails, alone, documents = every[self.steps:], every[self.steps + n:], every[self.steps + 2 * n]
        shapley = [0] * n
        for k, order in enumerate(self.orders):
            for s, f in enumerate(order):
                shapley[f] += every[k * n + s]
        out = []
        for k, order in enumerate(self.orders):
            name, left = "".join(self.letters[f] for f in order), documents
            for s, f in enumerate(order):
                at = k * n + s
                left -= every[at]
                out.append((name, s + 1, left, every[at], fails[f] - every[at], alone[f], good[at], toxic[at], shapley[f]))
        return out


_PACKED: dict[str, Packed] = {}
at_release(_PACKED.clear)


def packed(letters: str) -> Packed:
    """The layout of a set of filters, built once per worker (32 integers of 5 kB for five filters)."""
    if letters not in _PACKED:
        _PACKED.clear()
        _PACKED[letters] = Packed(letters)
    return _PACKED[letters]


def _fact_batches(batches):
    for batch in batches:
        masks, high, low = [], [], []
        for text in batch.column(2).to_pylist():
            masks.append(failures(text))
            digest = blake2b((text or "").encode(), digest_size=16).digest()
            high.append(int.from_bytes(digest[:8], "little", signed=True))
            low.append(int.from_bytes(digest[8:], "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
            ["doc_id", "part", "mask", "d1", "d2"])


def masks(docs: DataFrame, part_column: str = "source", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, part, mask (filters A to D) and the digest (d1, d2) of every text; one pass without a shuffle."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
                       F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, _fact_batches, "doc_id bigint, part string, mask int, d1 bigint, d2 bigint")


def labelled(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id", good_column: str = "quality",
             toxic_column: str = "toxic") -> DataFrame:
    """The rows with good and toxic from the label rows of their doc_id."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = (labels.groupBy(F.col(id_column).cast("bigint").alias("__id"))
             .agg(says(good_column).alias("good"), says(toxic_column).alias("toxic")).filter("__id is not null and (good or toxic)"))
    none = F.lit(False)
    return (rows.join(marks, rows.doc_id == F.col("__id"), "left").drop("__id")
            .withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)}))


def counted_masks(rows: DataFrame) -> DataFrame:
    """part, mask (with the bit for copies), good, toxic and n: how many documents have them.

    Every document with an id counts as a copy first; the first ones of each text (ranked by
    id, ties included) are then taken back and counted as none.
    """
    keys, kinds = ["part", "mask", "good", "toxic"], ("known", "unknown", "first")
    tell = lambda df, **n: df.groupBy(*keys).agg(*[n.get(k, F.sum(F.lit(0).cast("bigint"))).alias(k) for k in kinds])
    every = tell(rows, known=F.count_if(F.col("doc_id").isNotNull()), unknown=F.count_if(F.col("doc_id").isNull()))
    by_text = Window.partitionBy("d1", "d2").orderBy("doc_id")
    ranked = rows.filter("doc_id is not null").withColumn("rank", F.rank().over(by_text)).filter("rank = 1")
    both = every.union(tell(ranked, first=F.count("*"))).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in kinds])
    own = F.struct(F.col("mask").alias("mask"), (F.col("first") + F.col("unknown")).alias("n"))
    copy = F.struct(F.col("mask").bitwiseOR(F.lit(1 << COPY)).alias("mask"), (F.col("known") - F.col("first")).alias("n"))
    return (both.select("part", F.explode(F.array(own, copy)).alias("k"), "good", "toxic")
            .select("part", "k.mask", "good", "toxic", "k.n").filter("n > 0"))


def unpacked(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of every part from part, mask, good, toxic, n; a part has at most 4 * 2**filters rows."""

    def audit(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[c].to_pylist() for c in ("mask", "good", "toxic", "n"))))
        columns = list(zip(*packed(letters).audit(rows)))
        types = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
        part = pa.array([table["part"][0].as_py()] * len(columns[0]), pa.string())
        return pa.table([part, *[pa.array(c, t) for c, t in zip(columns, types)]], ["part", "filter_order", "step", *COUNTS])

    return counts.groupBy("part").applyInArrow(audit, RESULT)


def audit(docs: DataFrame, labels: DataFrame, part_column: str = "source", id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    facts = stored(labelled(masks(docs, part_column, id_column, text_column), labels), "masks")
    return unpacked(counted_masks(facts))
