"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside them.

1. Equal vectors are one class with a size; a class is compared once.
2. Centres are fitted by spherical k-means on at most ``MAX_SAMPLE`` vectors, one centre for
   about ``CELL_SIZE`` vectors and ``MAX_CELLS`` at most. Every vector belongs to the cell of
   its nearest centre, in its core (within half the angle of ``least``) or beyond.
3. Cores and the rest of cells are parts with a radius. By the triangle inequality of angles a
   pair of parts is too far apart for any link, so close that all must link, or neither.
   Vectors of the second kind are counted, not compared.
4. All pairs of the third kind are compared. Parts are packed into blocks of bounded size, a
   hot part is cut into several, and each pair of blocks with such a pair of parts is a task's
   matrix products, tile by tile. It yields one row for each vector, its number of links and
   the least id of its group, never pairs.
5. Components of these groups give the smallest id that links reach.

Every pair with a cosine of at least ``least``, in double precision, is found, and no other.
Where vectors are spread so evenly that no parts can be ruled out, all blocks are compared.

Vectors that are null, empty, zero or hold null or non-finite values link with nothing and
stay; shorter vectors count as padded with zeros. A null id links with nothing. Rows that
share an id share a component. Equal rows link with each other. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import few_hashes, map_arrow, ship, small_batches, stored
from .components import components

LEAST = 0.9
CELL_SIZE, MAX_CELLS, MAX_SAMPLE = 256, 4096, 32_768
VISITS, BLOCK, TILE, ROUNDS = 4, 8192, 1024, 8
BLOCK_CELLS, BLOCKS, SLACK = 1 << 22, 8, 1e-6  # numbers in a block, blocks of a small table, rounding of angles

UNIT = "vec_id bigint, node bigint, unit binary"
PLACED = "part int, angle double, node bigint, id bigint, size bigint, unit binary"


def _unit_batches(batches, dim):
    from hashlib import blake2b

    for batch in small_batches(batches):
        nodes, units = [], []
        for v in batch.column(1).to_pylist():
            x = np.zeros(dim)
            if v and None not in v:
                x[: len(v)] = v
            top = np.abs(x).max(initial=0.0)
            if top > 0 and math.isfinite(top):
                x = x / top
                x = x / np.sqrt(x @ x)
                units.append((x + 0.0).tobytes())
                nodes.append(int.from_bytes(blake2b(units[-1], digest_size=8).digest(), "little", signed=True))
            else:
                units.append(None)
                nodes.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())],
                                         ["vec_id", "node", "unit"])


def matrix(units, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, dim)


def spherical_k_means(x: np.ndarray, k: int, rounds: int, seed: int = 11) -> np.ndarray:
    """k unit centres of unit vectors; an empty cell takes the vector that fits its own worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, value = nearest(x, centres, 1)
        best, value = best[:, 0], value[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=k) == 0)
        sums[empty] = x[np.argsort(value)[: len(empty)]]
        length = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centres of each vector, nearest first, and their cosines."""
    n = min(n, len(centres))
    at, value = np.zeros((len(x), n), np.int64), np.zeros((len(x), n))
    for k in range(0, len(x), block):
        cos = x[k:k + block] @ centres.T
        few = np.argpartition(-cos, n - 1, axis=1)[:, :n]
        few = np.take_along_axis(few, np.argsort(-np.take_along_axis(cos, few, 1), axis=1, kind="stable"), 1)
        at[k:k + block], value[k:k + block] = few, np.take_along_axis(cos, few, 1)
    return at, value


def _place_batches(batches, shared, least):
    """Each class in its part (twice the cell, plus one beyond the core), with the angle to the centre."""
    centres = shared.value
    for batch in small_batches(batches):
        at, cos = nearest(matrix(batch.column(3).to_pylist(), centres.shape[1]), centres, 1)
        angle = np.arccos(np.clip(cos[:, 0], -1, 1))
        part = 2 * at[:, 0] + (angle > math.acos(least) / 2 - SLACK)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(angle), *batch.columns],
                                         ["part", "angle", "node", "id", "size", "unit"])


def part_pairs(centres: np.ndarray, radius: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of parts must be compared, and in which of them every vector links with every other."""
    far = math.acos(least)
    compare, whole = np.zeros((len(centres), len(centres)), bool), np.zeros((len(centres), len(centres)), bool)
    for k in range(0, len(centres), 256):
        between = np.arccos(np.clip(centres[k:k + 256] @ centres.T, -1, 1))
        reach = radius[k:k + 256, None] + radius[None, :]
        whole[k:k + 256] = between + reach <= far - SLACK
        compare[k:k + 256] = (between - reach <= far + SLACK) & ~whole[k:k + 256]
    own = np.arange(len(centres))  # no distance at all, whatever the rounding
    whole[own, own] = 2 * radius <= far - SLACK
    compare[own, own] = ~whole[own, own]
    return compare | compare.T, whole & whole.T & ~(compare | compare.T)


def _least_labels(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The least label of the parts that links (a square matrix) reach."""
    while True:
        new = np.array([labels[row].min(initial=own) for row, own in zip(linked, labels)])
        if (new == labels).all():
            return labels
        labels = new


def pack(counts: list[int], block: int) -> tuple[list[int], list[int]]:
    """The first block of each part, and over how many blocks of its own it is spread (1: shared)."""
    first, spread, at, full = [], [], -1, block
    for n in counts:
        pieces = -(-n // block)
        if pieces > 1 or full + n > block:
            at, full = at + 1, 0
        first.append(at)
        spread.append(pieces)
        at, full = at + pieces - 1, block if pieces > 1 else full + n
    return first, spread


def _groups(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that links reach, for both sides of a matrix of links."""
    left, right = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], top).min(1, initial=top))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(0, initial=top))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _joined(n: int, edges: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> np.ndarray:
    """The least id that edges (of row numbers) reach from each row."""
    a, b = (np.concatenate(x) for x in zip(*edges))
    least = ids.copy()
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        if (new == least).all():
            return least
        least = new


def _product(table: pa.Table, shared, dim: int, least: float) -> pa.Table:
    """One pair of blocks (side 0 and 1), or the pairs inside one block (side 0 alone)."""
    compare, whole, number = shared.value
    table = table.sort_by([("side", "ascending"), ("part", "ascending"), ("node", "ascending")])
    side, part = table["side"].to_numpy(), number[table["part"].to_numpy()]
    ids, size = table["id"].to_numpy(), table["size"].to_numpy().astype(np.float64)
    x = matrix(table["unit"].to_pylist(), dim)
    links, edges = np.zeros(len(x)), []
    half = int((side == 0).sum())
    tiles = [(k, min(k + TILE, end)) for start, end in ((0, half), (half, len(x))) for k in range(start, end, TILE)]
    inside = half == len(x) and table["p"][0].as_py() == table["q"][0].as_py() if len(x) else False
    for a, b in tiles:
        for c, d in tiles:
            if (c < a) if inside else (a >= half or c < half):
                continue
            few_a, few_b = np.unique(part[a:b]), np.unique(part[c:d])
            if not compare[np.ix_(few_a, few_b)].any():
                continue
            linked = x[a:b] @ x[c:d].T >= least
            if whole[np.ix_(few_a, few_b)].any():  # counted already
                linked &= compare[np.ix_(part[a:b], part[c:d])]
            if a == c:
                linked = np.triu(linked, 1)
            left, right = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(left):
                continue
            linked = linked[np.ix_(left, right)]
            as_number = linked.astype(np.float64)
            links[a + left] += as_number @ size[c + right]
            links[c + right] += size[a + left] @ as_number
            low_a, low_b = _groups(linked, a + left, c + right)  # the same vector may be on both sides of a tile
            edges += [(a + left, low_a), (c + right, low_b)]
    used = links > 0
    group = _joined(len(x), edges, ids) if edges else ids
    return pa.table({"node": table["node"].to_numpy()[used], "id": ids[used], "least_id": group[used],
                     "links": links[used].astype(np.int64)})


def near_duplicates(vectors: DataFrame, least: float = LEAST, cell_size: int = CELL_SIZE, visits: int = VISITS,
                    block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept (it is the smallest of its component), one row per vector.

    ``visits`` is kept for callers; every cell that can hold a link is compared.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("embedding"))
    dim = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 1)
    every = stored(map_arrow(rows, functools.partial(_unit_batches, dim=dim), UNIT), "units")
    valid = every.filter("vec_id is not null and node is not null")
    classes = stored(valid.groupBy("node").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"),
                                               F.first("unit").alias("unit")), "classes")
    n = classes.count()
    if not n:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    few = F.broadcast(few_hashes(classes, "node", MAX_SAMPLE))  # MAX_SAMPLE rows at most
    sample = classes.select(F.xxhash64("node").alias("h"), "unit").join(few, "h").orderBy("h")
    x = matrix([r.unit for r in sample.collect()], dim)
    centres = spherical_k_means(x, max(1, min(n // cell_size, len(x) // 4, MAX_CELLS)), ROUNDS)
    shared = spark.sparkContext.broadcast(centres)  # MAX_CELLS vectors at most
    placed = stored(map_arrow(classes.select("node", "id", "size", "unit"), functools.partial(
        _place_batches, shared=shared, least=least), PLACED), "cells")

    # a row for each part, twice MAX_CELLS at most; parts that lie close together share blocks
    near = nearest(centres, spherical_k_means(centres, max(1, len(centres) // 16), ROUNDS), 1)[0][:, 0]
    sums = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("id"),
                                      F.max("angle").alias("radius")).collect()
    sums = sorted(sums, key=lambda r: (r.part % 2, near[r.part // 2], r.part))
    compare, whole = part_pairs(centres[[r.part // 2 for r in sums]], np.array([r.radius for r in sums]), least)
    number = np.zeros(2 * len(centres), np.int64)
    number[[r.part for r in sums]] = np.arange(len(sums))
    block = max(1, min(block, BLOCK_CELLS // dim, -(-n // BLOCKS)))
    first, pieces = pack([r.n for r in sums], block)
    asked: dict[int, set[int]] = {}
    for k in range(len(sums)):
        for m in np.flatnonzero(compare[k]):
            asked.setdefault(first[k], set()).add(first[m])
    place = F.broadcast(spark.createDataFrame(
        [(r.part, first[k], pieces[k]) for k, r in enumerate(sums)], "part int, first int, pieces int"))
    spread_of = {f: s for f, s in zip(first, pieces)}
    partners = F.broadcast(spark.createDataFrame(
        [(f, [[m, spread_of[m]] for m in sorted(others)]) for f, others in asked.items()], "first int, others array<array<int>>"))
    # each block with itself and every other one that it must be compared with
    dealt = (placed.join(place, "part").join(partners, "first")
             .withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
             .withColumn("o", F.explode("others"))
             .withColumn("other", F.explode(F.sequence(F.col("o")[0], F.col("o")[0] + F.col("o")[1] - 1)))
             .select("part", "node", "id", "size", "unit", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                     (F.col("own") > F.col("other")).cast("int").alias("side")))
    pairs = spark.sparkContext.broadcast((compare, whole, number))

    def product(pair: pa.Table) -> pa.Table:
        return _product(pair, pairs, dim, least)

    found = stored(dealt.groupBy("p", "q").applyInArrow(
        product, "node bigint, id bigint, least_id bigint, links bigint"), "links")

    sizes = np.array([r.size for r in sums])
    labels = _least_labels(whole, np.array([r.id for r in sums]))
    counts = spark.createDataFrame(
        [(r.part, int(labels[k]), int(sizes[whole[k]].sum()), bool(whole[k, k]))
         for k, r in enumerate(sums) if whole[k].any()], "part int, least_id bigint, total bigint, own boolean")
    core = placed.join(F.broadcast(counts), "part").select(
        "node", "id", "least_id", (F.col("total") - F.when(F.col("own"), F.col("size")).otherwise(0)).alias("links"))
    parts = found.unionByName(core)
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    twins = valid.join(classes.select("node", "id"), "node").filter("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    groups = components(parts.select(F.col("id").alias("a"), F.col("least_id").alias("b")).union(twins))
    counted = classes.select("node", "size").join(links, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    own = F.when(F.col("node").isNotNull(), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return (every.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node"))
            .join(counted, "node", "left").join(groups, F.col("vec_id") == groups.id, "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
                    F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept")))
