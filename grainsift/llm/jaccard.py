"""Exact Jaccard similarity join of documents on word n-grams, by relations between sets.

A document's set holds the fingerprints of its distinct runs of ``size`` words. Two documents
link when 100 * |intersection| >= percent * |union|.

1. Equal sets are one node, named by a fingerprint; they need no comparison.
2. Tokens are put into one order: a quarter of them, chosen by their fingerprint, is counted
   exactly over all documents (counts stop at ``MANY``) and goes first, rare ones before
   frequent ones; the others follow by fingerprint. Linked sets share a token among the first
   few of each (the prefix). A set whose prefix holds only tokens that occur once is done.
3. The index lists of the prefix tokens are sorted by position and size; long ones are dealt
   into parts of ``LIST_PART`` entries on average, so no task holds a whole list. Each pair of
   entries that is looked at is tested by size and position, and dropped if the overlap is
   out of reach.
4. In a long list all sets are compared with one of them, the one with the fewest tokens
   before the shared one, which tends to be the middle of a family of similar sets. Sets that
   belong to one group by then have their answers derived from it: they are not compared with
   each other again.
5. Candidates are verified on the whole sets. Where long lists still hold several groups, the
   sets of such lists form families. A family is cut into blocks of bounded length by bands
   of size. Blocks whose sizes rule out a link are skipped as a whole, and so are pairs of
   blocks of the family's largest group. Each other pair of blocks is compared in one task by
   a product of its membership matrices, which yields a row for each set, never pairs. Groups
   are the connected components.

No link between different groups is missed; links inside a group that follow from the group
need not be verified, since the result is the group of each document.

Null, empty and blank texts have an empty set and link with nothing. A text with fewer words
than ``size`` has one n-gram, the whole sequence. Rows that share an id are one document
with several sets: they share a group. A null id links with nothing and has a null group.
Repeated rows give repeated results. Only id and text columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, key_filter, map_arrow, small_batches, stored
from .components import components
from .fingerprints import distinct, text_hashes, window_hashes

SIZE, PERCENT = 4, 85
COUNTED = 4  # one token of so many is counted
MANY = 1000
LONG_LIST = 4
LIST_PART = 1000
SALTS = 64
BLOCK, BLOCK_TOKENS, MATRIX_TOKENS = 1024, 1 << 20, 2048  # sets of a block, tokens of all of them

SETS = "doc_id bigint, n_shingles bigint, n_counted int, node bigint"


def shingle_sets(texts: Sequence[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct fingerprints of the n-grams of each text, lower-cased from A to Z."""
    for words in text_hashes(texts, lower=True):
        yield distinct(window_hashes(words, min(size, len(words)))) if len(words) else words


def least_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that the sum of two sizes needs: the least o with 100 o >= percent (sum - o)."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Two linked sets share a token among so many first ones of each."""
    return n - (-(-percent * n // 100)) + 1


def node_of(s: np.ndarray) -> int:
    """The fingerprint of a whole set: equal sets are one node."""
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_batches(batches, size):
    for batch in small_batches(batches):
        sets = list(shingle_sets(batch.column(1).to_pylist(), size))
        n_counted = [int((s % np.uint64(COUNTED) == 0).sum()) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(n_counted, pa.int32()),
             pa.array([node_of(s) for s in sets], pa.int64())], ["doc_id", "n_shingles", "n_counted", "node"])


def _token_batches(batches, size, percent):
    """The counted tokens of each set and, if these are too few for its prefix, the next ones."""
    for batch in small_batches(batches):
        nodes, tokens = [], []
        for s in shingle_sets(batch.column(0).to_pylist(), size):
            if len(s):
                counted = s % np.uint64(COUNTED) == 0
                short = prefix_length(len(s), percent) - int(counted.sum())
                tokens.append(np.concatenate((s[counted], s[~counted][:max(0, short)])))
                nodes.append(np.full(len(tokens[-1]), node_of(s)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(join(tokens, np.uint64).view(np.int64)), pa.array(join(nodes, np.int64))],
                                         ["token", "node"])


def _shared_batches(batches):
    """Rows (token, node), sorted, with the token's count, for tokens of more than one node.

    Of a token no more than ``MANY`` nodes are held; the others are passed on at once.
    """
    token, held, many = None, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens, nodes = (c.to_numpy() for c in batch.columns)
        heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        ends = np.append(heads[1:], len(tokens))
        visited = ends - heads > 1  # most tokens are seen once
        visited[[0, -1]] = True
        found: list[tuple[int, int, int]] = []
        for k in np.flatnonzero(visited).tolist():
            a, b = heads[k], ends[k]
            if token is None or tokens[a] != token:
                if len(held) > 1 and not many:
                    found += [(token, d, len(held)) for d in held]
                token, held, many = int(tokens[a]), [], False
            last = held[-1] if held else None
            held += [d for d in np.unique(nodes[a:b]).tolist() if d != last]
            if many or len(held) > MANY:
                found += [(token, d, MANY) for d in (held[1:] if many else held)]
                many, held = True, held[-1:]  # the last one is kept to know it again
        if found:
            yield _counted_rows(*zip(*found))
    if len(held) > 1 and not many:
        yield _counted_rows(*zip(*[(token, d, len(held)) for d in held]))


def _counted_rows(t, d, n):
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int32())],
                                      ["token", "node", "often"])


def _prefix_batches(batches, percent):
    """Index entries of each set from its shared tokens; all its other counted tokens come first."""
    for batch in small_batches(batches):
        rows, tokens, places = [], [], []
        for i, (n, n_counted, lists) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
            known = [((often, t % 2**64), t) for t, often in ((x["token"], x["often"]) for x in lists) if t % 2**64 % COUNTED == 0]
            beyond = sorted(x["token"] % 2**64 for x in lists if x["token"] % 2**64 % COUNTED)
            first = prefix_length(n, percent)
            alone = n_counted - len(known)
            taken = [(t, alone + k) for k, (_, t) in enumerate(sorted(known))]
            if n_counted < first:  # their places are bounds: tokens seen once may stand between them
                taken += [(t - 2**64 if t >= 2**63 else t, n_counted + k) for k, t in enumerate(beyond)]
            taken = [(t, k) for t, k in taken if k < first]
            rows.append(np.full(len(taken), i))
            tokens += [t for t, _ in taken]
            places += [k for _, k in taken]
        at = pa.array(np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens, pa.int64()), batch.column(0).take(at), batch.column(1).cast(pa.int32()).take(at),
             pa.array(places, pa.int32())], ["token", "node", "n", "pos"])


def _can_reach(n, pos, n2, pos2, percent):
    """Whether the tokens left at two positions allow the overlap that the sizes need."""
    return 1 + np.minimum(n - pos - 1, n2 - pos2 - 1) >= least_overlap(n + n2, percent)


class Runs:
    """Cuts sorted batches (token, part, ...) into the runs of one token and part each.

    Whole runs of a batch are handed over together; of a run that goes on in the next batches
    only what has come is held: at most about ``LIST_PART`` entries, since longer lists are
    dealt into parts.
    """

    def __init__(self, batches):
        self.batches = batches

    def __iter__(self):
        held: list[np.ndarray] = []
        for batch in self.batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield np.concatenate(held)
                held = []
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield np.concatenate([*held, rows[:cut]])
                held = []
            held.append(rows[cut:])
        if held:
            yield np.concatenate(held)


def _fits(n, pos, n2, pos2, percent):
    return (percent * np.maximum(n, n2) <= 100 * np.minimum(n, n2)) & _can_reach(n, pos, n2, pos2, percent)


def _first_batches(batches, percent, long_list):
    """Rows of kind 0: candidates (a, b). Of kind 1: entries of long lists, to be looked at again.

    The last three columns hold the first entry of a list that is dealt into parts; all
    entries of its parts are compared with that one, as those of a short list with their own.
    """
    for rows in Runs(batches):
        token, part, doc, n, pos, first_doc, first_n, first_pos = rows.T
        heads = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
        length = np.diff(np.append(heads, len(rows)))
        run = np.repeat(np.arange(len(heads)), length)
        rank = np.arange(len(rows)) - heads[run]
        dealt = first_n > 0
        long = dealt | (length[run] > long_list)
        pairs = []
        for k in range(int(min(length.max(), long_list)) - 1):  # with the k-th of the list
            y = np.flatnonzero((rank > k) & ~dealt & (~long | (k == 0)))
            x = heads[run[y]] + k
            ok = (doc[x] != doc[y]) & _fits(n[x], pos[x], n[y], pos[y], percent)
            pairs.append(np.stack((np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])), axis=1)[ok])
        y = np.flatnonzero(dealt)
        ok = (doc[y] != first_doc[y]) & _fits(n[y], pos[y], first_n[y], first_pos[y], percent)
        pairs.append(np.stack((np.minimum(doc[y], first_doc[y]), np.maximum(doc[y], first_doc[y])), axis=1)[ok])
        found = np.unique(np.concatenate(pairs), axis=0)
        yield _pair_rows(0, found[:, 0], found[:, 1], np.zeros(len(found), np.int64), np.zeros(len(found), np.int64))
        again = rows[long]
        yield _pair_rows(1, again[:, 0], again[:, 2], again[:, 3], again[:, 4])


def _dealt_lists(entries: DataFrame) -> DataFrame:
    """The index lists in order of position and size, long ones in parts of bounded length.

    A long list's first entry goes with all its parts. Rows of a list are counted where they
    lie; the join that deals them has one row per long list on its other side.
    """
    long = (entries.groupBy("token").agg(F.count("*").alias("often"), F.min(F.struct("pos", "n", "node")).alias("first"))
            .filter(F.col("often") > LIST_PART).select("token", F.ceil(F.col("often") / LIST_PART).alias("parts"), "first"))
    met = entries.join(long, "token", "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    none = lambda c, t: F.coalesce(F.col(f"first.{c}"), F.lit(0)).cast(t).alias(f"first_{c}")
    return (met.select("token", part.alias("part"), "node", "n", "pos", none("node", "bigint"), none("n", "int"), none("pos", "int"))
            .repartition("token", "part").sortWithinPartitions("token", "part", "pos", "n", "node"))


def _pair_rows(kind, a, b, n, pos):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b),
                                       pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))],
                                      ["kind", "a", "b", "n", "pos"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; tokens of one set alone are left out of the product."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[number] > 1
    of, number = of[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(number.max(initial=-1)) + 1, MATRIX_TOKENS):
        part = (number >= low) & (number < low + MATRIX_TOKENS)
        x = np.zeros((len(sets), MATRIX_TOKENS), np.float32)
        x[of[part], number[part] - low] = 1
        out += x @ x.T  # counts below 2**24 are exact
    return out.astype(np.int64)


def _compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Of two blocks of a family: each set that links beyond its group, with the least node it reaches."""
    node, group = table["node"].to_numpy(), table["component"].to_numpy()
    sets = [x.values.to_numpy() for x in table["tokens"]]
    n = np.array([len(x) for x in sets])
    both = _overlaps(sets)
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (group[:, None] != group[None, :])
    reach = node.copy()
    while True:
        step = np.minimum(reach, np.where(linked, reach[None, :], np.iinfo(np.int64).max).min(1))
        if (step == reach).all():
            break
        reach = step
    at = np.flatnonzero(reach != node)
    return pa.table({"a": pa.array(node[at], pa.int64()), "b": pa.array(reach[at], pa.int64())})


def _whole_sets_batches(batches, size, bloom):
    """The sets of texts whose node may be wanted."""
    for batch in small_batches(batches):
        sets = [s for s in shingle_sets(batch.column(0).to_pylist(), size) if len(s)]
        nodes = np.array([node_of(s) for s in sets], np.int64)
        may = np.flatnonzero(bloom.value.may_hold(nodes)).tolist() if len(nodes) else []
        ends = pa.array(np.cumsum([0, *(len(sets[i]) for i in may)]), pa.int32())
        flat = np.concatenate([sets[i] for i in may]).view(np.int64) if may else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[may]), pa.ListArray.from_arrays(ends, pa.array(flat))], ["id", "tokens"])


def _verify_batches(batches, percent):
    for batch in small_batches(batches):
        left, right = batch.column(2), batch.column(3)
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (c[i].values.to_numpy() for c in (left, right))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
        at = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _sets_of(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """id and tokens of the wanted nodes; the sets of other texts are not moved."""
    bloom = texts.sparkSession.sparkContext.broadcast(key_filter(ids))  # 8 MB at most
    sets = map_arrow(texts, functools.partial(_whole_sets_batches, size=size, bloom=bloom), "id bigint, tokens array<bigint>")
    return stored(sets.join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The candidate pairs that link, by their whole sets."""
    sets = _sets_of(stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"), texts, size)
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return stored(map_arrow(both, functools.partial(_verify_batches, percent=percent), "a bigint, b bigint"), "links")


def _salt():
    return F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")


def _join_few(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of one row per key; a key's rows are spread over ``SALTS`` tasks by their node.

    Never a broadcast, which the driver builds: Spark guesses the size of the table from before its rows are repeated.
    """
    every = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", _salt()).join(every.hint("merge"), [key, "salt"]).drop("salt")


def _stars(lists: DataFrame) -> DataFrame:
    """Links (a, b) that join all nodes of a token: to the least of their salt, and these to the least of all."""
    salted = lists.select("token", "node", _salt())
    near = salted.groupBy("token", "salt").agg(F.min("node").alias("b"))
    far = near.groupBy("token").agg(F.min("b").alias("least"))
    return (salted.join(near, ["token", "salt"]).select(F.col("node").alias("a"), "b")
            .union(near.join(far, "token").select(F.col("b").alias("a"), F.col("least").alias("b"))))


def _family_links(lists: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between groups (a, b) within the families that lists (token, node, component) make."""
    families = components(_stars(lists)).toDF("node", "family")
    members = stored(families.join(lists.select("node", "component").distinct(), "node"), "families")
    sets = _sets_of(members.select(F.col("node").alias("id")), texts, size).withColumnRenamed("id", "node")
    unit = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9  # sets that link are at most one band apart
    groups = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = groups.groupBy("family").agg(F.max(F.struct("n", "component")).alias("largest")).select("family", "largest.component")
    band = F.floor(F.log(F.size("tokens")) / unit)
    rest = (F.col("component") != F.col("largest")).cast("bigint")  # 0 in the largest group of the family
    sized = stored(_join_few(members, largest.withColumnRenamed("component", "largest"), "family").join(sets, "node")
                   .select("family", "node", "component", "tokens", band.alias("band"), rest.alias("rest")), "sized")
    counts = sized.groupBy("family", (F.col("band") * 2 + F.col("rest")).alias("kind")).agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("tokens")) / BLOCK_TOKENS)).alias("n"))
    blocks = counts.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("blocks"))  # some 200 kinds
    code = lambda kind, k: F.struct(kind.alias("kind"), k.cast("bigint").alias("k"))

    def blocks_of(kind):
        n = F.coalesce(F.try_element_at("blocks", kind), F.lit(0))
        return F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda k: code(kind, k)), lambda x: x["k"] < n)

    # two blocks of the largest group are skipped: their sets are one group already
    kinds = [(F.col("band") + d) * 2 + r for d in (-1, 0, 1) for r in (0, 1)]
    wanted = F.filter(F.array(*kinds), lambda kind: (F.col("rest") == 1) | (F.pmod(kind, F.lit(2)) == 1))
    near = F.flatten(F.transform(wanted, blocks_of))
    kind = F.col("band") * 2 + F.col("rest")
    own = code(kind, F.pmod(F.xxhash64("node"), F.element_at("blocks", kind)))
    dealt = (_join_few(sized, blocks, "family").withColumn("own", own).withColumn("other", F.explode(near))
             .select("family", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "component", "tokens"))

    def compare(pair: pa.Table) -> pa.Table:
        return _compare_blocks(pair, percent)

    return stored(dealt.groupBy("family", "p", "q").applyInArrow(compare, "a bigint, b bigint"), "links")


def _still_apart(lists: DataFrame, links: DataFrame) -> DataFrame:
    """Lists (token, node) with the group of each entry, without those of one group."""
    groups = components(links).withColumnRenamed("id", "node")
    grouped = lists.join(groups, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
    grouped = stored(grouped, "grouped")
    apart = (grouped.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low < high").select("token"))
    return stored(_join_few(grouped, apart, "token"), "apart")


def link_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    counted = stored(map_arrow(rows, functools.partial(_sets_batches, size=size), SETS), "sets")
    known = counted.filter("doc_id is not null and n_shingles > 0")
    classes = stored(known.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("n_counted").alias("n_counted")), "classes")

    texts = rows.filter("doc_id is not null and text is not null").select("text")
    tokens = map_arrow(texts, functools.partial(_token_batches, size=size, percent=percent), "token bigint, node bigint")
    shared = stored(map_arrow(tokens.repartition("token").sortWithinPartitions("token", "node"), _shared_batches,
                              "token bigint, node bigint, often int"), "tokens")
    by_node = shared.groupBy("node").agg(F.collect_list(F.struct("token", "often")).alias("lists"))  # within one set
    joined = classes.join(by_node, "node").select("node", "n", "n_counted", "lists")
    entries = stored(map_arrow(joined, functools.partial(_prefix_batches, percent=percent),
                               "token bigint, node bigint, n int, pos int"), "entries")
    seen = stored(map_arrow(_dealt_lists(entries), functools.partial(_first_batches, percent=percent, long_list=LONG_LIST),
                            "kind int, a bigint, b bigint, n int, pos int"), "lists")
    pairs = stored(seen.filter("kind = 0").select("a", "b").distinct(), "pairs")
    links = _verified(pairs, texts, size, percent)

    again = seen.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"))
    if not again.isEmpty():
        apart = _still_apart(again, links)
        if not apart.isEmpty():
            links = links.union(_family_links(apart, texts, size, percent))
    one = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").drop("z")
    same_id = known.join(one, "doc_id").select("a", F.col("node").alias("b"))
    groups = components(links.union(same_id))
    named = classes.join(groups, classes.node == groups.id, "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "group").select(F.col("node").alias("id"), "component_id")
    linked = (F.col("doc_id").isNotNull()) & (F.col("n_shingles") > 0)
    return (counted.join(found, (counted.node == found.id) & linked, "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_first(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """The documents that represent their group, with their own columns.

    A group keeps the document with its smallest id. Of several rows with that id the one with
    the least hash of its columns stays, and of complete copies one. Rows with an empty set or
    a null id are groups of their own and stay. Texts are moved once, for the join with the
    ids that lose a row.
    """
    groups = link_groups(docs, size, percent, id_column, text_column)
    id_, first, best, copies = (free_name(docs.columns, n) for n in ("id", "first", "best", "copies"))
    key, mark = F.col(id_column).cast("bigint"), F.xxhash64(*docs.columns)
    empty = F.trim(F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    rows = (docs.filter(~empty).select(key.alias(id_), mark.alias(best)).groupBy(id_, best).agg(F.count("*").alias("n"))
            .groupBy(id_).agg(F.min(F.struct(best, "n")).alias("one"), F.count("*").alias("kinds")))
    ids = groups.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias(first))
    losing = stored(
        ids.join(rows, ids.doc_id == rows[id_]).filter((F.col(first) != F.col(id_)) | (F.col("kinds") > 1) | (F.col("one.n") > 1))
        .select(id_, first, F.col(f"one.{best}").alias(best), F.col("one.n").alias(copies)), "losing")
    stays = (F.col(first) == F.col(id_)) & (mark == F.col(best))
    kept = (docs.join(losing, key == F.col(id_), "left")
            .filter(F.col(id_).isNull() | empty | (stays & (F.col(copies) == 1))).select(*docs.columns))
    whole = losing.filter((F.col(first) == F.col(id_)) & (F.col(copies) > 1))
    if whole.isEmpty():
        return kept
    same = docs.join(whole, key == F.col(id_)).filter(~empty & stays).dropDuplicates([id_]).select(*docs.columns)
    return kept.unionByName(same)
