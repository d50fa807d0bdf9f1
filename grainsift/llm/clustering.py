"""Exact k-means on an integer grid, with Ptolemaic lower bounds from cached pivot distances.

Vectors are put on a grid, each component x to floor(scale * x), and everything after that is
integer arithmetic, so assignments, ties and centroids do not depend on partitioning.

For a vector x, a centroid c and a pair of pivots p, s, Ptolemy's inequality gives

    |x c| * |p s|  >=  | |x p| * |c s| - |x s| * |c p| |

so the distances to a few fixed pivots bound the distance to every centroid from below. The
pivots are the first starting centroids; their distances are computed once and stored beside
the vectors. In each round a vector is compared exactly with the centroid of the least bound,
and then only with those whose bound does not exceed that. Bounds are rounded down by more
than the error of their few double operations (``SLACK``), and a centroid is left out only if
its bound is strictly greater, so ties reach the exact check and the smaller number wins.

A round is one pass over the stored table without a shuffle of vectors: tasks hand on one row
per centroid, component and 40-bit limb of their sums, at most ``k * dims`` rows for vectors
of usual size, whatever the number of vectors. Only these totals reach the driver.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; all others are
missing in the result. A null id keeps its vector in the clustering, but it cannot start as a
centroid. Repeated rows count as often as they occur and get equal results; of starting
candidates with equal hashes (repeated ids) the lesser vectors come first, and complete copies
may start as several centroids (the smaller number then takes all ties). With fewer vectors
than ``k`` every vector with an id starts a centroid; without any, all distances are null and
the cluster too. Components of any size are handled exactly; a squared distance or a sum that
no long can hold is null. Only the two named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored

K, ROUNDS, SCALE, DIMS, PIVOTS = 16, 3, 64, 64, 6
WIDE = 1 << 27  # beyond this grid coordinates squared sums of 64 components may not fit 64 bits
SLACK = 2.0 ** -46
LIMB = 40

CACHED = "vec_id bigint, embedding array<double>, pivots array<double>"
RESULT = "vec_id bigint, cluster int, distance bigint"


def grid(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of rows of doubles; Python integers where 64 bits could overflow later."""
    if not values.size or np.abs(values).max() < WIDE / scale:
        return np.floor(values * scale).astype(np.int64)
    whole = lambda x: int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)  # noqa: E731  (exact for a power of two)
    return np.array([[whole(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if x.dtype != y.dtype:
        x, y = x.astype(object), y.astype(object)
    d = x - y
    return (d * d).sum(-1)


def roots(x: np.ndarray) -> np.ndarray:
    """Square roots as doubles, of integers of any size."""
    if x.dtype == object:  # math.sqrt overflows beyond 2**1024
        return np.array([float(math.isqrt(int(v))) if v < 1 << 1000 else math.inf for v in x.ravel()]).reshape(x.shape)
    return np.sqrt(x.astype(np.float64))


@dataclass
class Centroids:
    """Centroids on the grid, the pivots, and all distances between them."""

    points: np.ndarray  # k x dims
    pivots: np.ndarray  # m x dims

    def __post_init__(self):
        self.to_pivots = roots(squares(self.points[:, None, :], self.pivots[None, :, :]))
        self.between = roots(squares(self.pivots[:, None, :], self.pivots[None, :, :]))

    def pairs(self) -> list[tuple[int, int]]:
        """Fixed pairs: each pivot with the next one, so m pairs that are easy to evaluate."""
        m = len(self.pivots)
        return [(p, (p + 1) % m) for p in range(m) if m > 2 or p == 0 and m == 2]

    def lower_bounds(self, cached: np.ndarray) -> np.ndarray:
        """For rows of pivot distances: bounds (rows x k) that no true distance is below."""
        best = np.zeros((len(cached), len(self.points)))
        for p, s in self.pairs():
            apart = self.between[p, s]
            if not 0 < apart < math.inf:
                continue
            one = cached[:, p, None] * self.to_pivots[None, :, s]
            two = cached[:, s, None] * self.to_pivots[None, :, p]
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / apart, out=best)
        return best * (1 - SLACK)

    def assign(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row; exact checks made."""
        if x.dtype == object or self.points.dtype == object or self.pivots.dtype == object:
            every = squares(x[:, None, :], self.points[None, :, :])
            nearest = [min(range(len(row)), key=row.__getitem__) for row in every]  # the first least one
            return np.array(nearest, np.int64), every[np.arange(len(x)), nearest], every.size
        bounds = self.lower_bounds(cached)
        cluster = bounds.argmin(1)
        distance = squares(x, self.points[cluster])
        checks = len(x)
        bounds *= bounds
        first = cluster.copy()
        for c in range(len(self.points)):
            # a bound that cannot be told from the best distance so far is no reason to leave c out
            at = np.flatnonzero((bounds[:, c] * (1 - SLACK) <= distance) & (first != c))
            exact = squares(x[at], self.points[c])
            checks += len(at)
            nearer = (exact < distance[at]) | ((exact == distance[at]) & (c < cluster[at]))
            cluster[at[nearer]], distance[at[nearer]] = c, exact[nearer]
        return cluster, distance, checks


def _rows(batch, scale, dims):
    """Grid coordinates and cached distances of a batch of the stored table."""
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return grid(values, scale), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _cache_batches(batches, scale, dims, pivots):
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        near = roots(squares(grid(values, scale)[:, None, :], pivots.value[None, :, :]))
        ends = pa.array(np.arange(len(values) + 1) * near.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))],
            ["vec_id", "embedding", "pivots"])


def limbs(value: int) -> list[tuple[int, int]]:
    """An integer as signed digits (place, digit) of 2**LIMB; sums of digits stay exact in a long."""
    sign, value, out, place = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        if digit := value & ((1 << LIMB) - 1):
            out.append((place, sign * digit))
        value >>= LIMB
        place += 1
    return out


def _sum_batches(batches, shared, scale, dims):
    """One task's sums of the components (and, as component -1, the number) of each cluster."""
    model = shared.value
    sums, counts = np.zeros((len(model.points), dims), object), np.zeros(len(model.points), np.int64)
    for batch in batches:
        if batch.num_rows:
            x, cached = _rows(batch, scale, dims)
            cluster, _, _ = model.assign(x, cached)
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                counts[c] += len(own)
                sums[c] += own.sum(0).astype(object)  # below 2**27 times the rows of a batch
    rows = [(c, d, place, digit) for c in np.flatnonzero(counts).tolist()
            for d, total in [(-1, int(counts[c])), *enumerate(map(int, sums[c]))] for place, digit in limbs(total)]
    columns = list(zip(*rows)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
        ["cluster", "dim", "place", "digit"])


def _assign_batches(batches, shared, scale, dims):
    for batch in batches:
        x, cached = _rows(batch, scale, dims)
        cluster, distance, _ = shared.value.assign(x, cached)
        if distance.dtype == object:
            distance = [d if d < 1 << 63 else None for d in map(int, distance)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance, pa.int64())],
            ["vec_id", "cluster", "distance"])


def _points(rows: list[list[int]], dims: int) -> np.ndarray:
    table = np.array(rows, object).reshape(len(rows), dims)
    small = all(abs(v) < WIDE for v in table.ravel())
    return table.astype(np.int64) if small else table


def moved(model: Centroids, totals: DataFrame, dims: int) -> Centroids:
    """The centroids after a round: componentwise floor of the exact means; empty ones stay."""
    sums: dict[tuple[int, int], int] = {}
    for r in totals.groupBy("cluster", "dim", "place").agg(F.sum("digit").alias("digit")).collect():  # k * dims totals
        sums[r.cluster, r.dim] = sums.get((r.cluster, r.dim), 0) + (r.digit << (LIMB * r.place) if r.digit >= 0
                                                                   else -(-r.digit << (LIMB * r.place)))
    points = [[sums.get((c, d), 0) // sums[c, -1] for d in range(dims)] if (c, -1) in sums else list(map(int, row))
              for c, row in enumerate(model.points)]
    return Centroids(_points(points, dims), model.pivots)


def kept_vectors(vectors: DataFrame, dims: int = DIMS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter((F.size("embedding") == dims) & ~F.exists("embedding", odd))


def starting_points(kept: DataFrame, k: int, scale: int, dims: int) -> np.ndarray:
    """The grid points of the ``k`` vectors with the least SHA-256 of ``1:<id>``."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = (kept.filter("vec_id is not null").select(mark.alias("mark"), "embedding").orderBy("mark", "embedding").limit(k).collect())
    values = np.array([r.embedding for r in first], np.float64).reshape(len(first), dims)
    return _points([list(map(int, row)) for row in grid(values, scale)], dims)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS,
            n_pivots: int = PIVOTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every kept vector.

    ``scale`` must be a power of two, so that scaling a double is exact.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, id_column, vector_column)
    start = starting_points(kept, k, scale, dims)
    if not len(start):
        none = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    model = Centroids(start, start[:n_pivots])
    share = spark.sparkContext.broadcast  # k * dims and n_pivots * dims numbers
    cached = stored(map_arrow(kept, functools.partial(_cache_batches, scale=scale, dims=dims, pivots=share(model.pivots)),
                              CACHED), "vectors")
    for _ in range(rounds):
        work = functools.partial(_sum_batches, shared=share(model), scale=scale, dims=dims)
        model = moved(model, map_arrow(cached, work, "cluster int, dim int, place int, digit bigint"), dims)
    work = functools.partial(_assign_batches, shared=share(model), scale=scale, dims=dims)
    found = stored(map_arrow(cached, work, RESULT), "clusters")
    long = lambda c: F.expr(f"try_cast({c} as bigint)")
    whole = F.count("distance") == F.count("*")  # a distance that no long holds leaves no sum either
    sums = (found.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect())  # k rows
    each = {r.cluster: r.s for r in sums}
    inertia = None if None in each.values() else sum(int(s) for s in each.values())
    shas = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in model.points]
    per = spark.createDataFrame([(c, None if s is None else str(s), None if inertia is None else str(inertia), shas[c])
                                 for c, s in each.items()],
                                "cluster int, cluster_inertia string, inertia string, centroid_sha256 string")
    per = per.select("cluster", long("cluster_inertia").alias("cluster_inertia"), long("inertia").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select(  # k rows are broadcast
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
