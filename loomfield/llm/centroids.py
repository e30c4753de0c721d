"""Centroid clustering of integer vectors that prunes by Ptolemaic pivots.

For any four points of a Euclidean space Ptolemy's inequality holds, so with two
pivots p and s every centroid c is at least

    |d(x, p) * d(c, s) - d(x, s) * d(c, p)| / d(p, s)

away from a vector x.  Pivots are a few of the first centroids, chosen far from
each other; squared distances of every vector to them are computed once and
written beside it, so a round computes distances of centroids to pivots only.
In a round each vector takes the centroid of the least bound, computes that one
distance exactly, and then exactly those of centroids whose bound doesn't exceed
it.  Bounds are rounded down by more than floating point can err, and a tie is
never pruned; all that decides is whole numbers.

A round sends a count and component sums for each cluster from each task; only
the k centroids pass the driver.  No row moves, so a frequent vector, or a third
of all in one cluster, makes no hot task.

Vectors that are null, of another length, or hold a null or non-finite component
take no part, nor do those beyond `integer_vectors.MOST_MASS`.  Repeated rows
count each time, a null id is a row like others but never a first centroid before
one with an id, fewer rows than k give fewer centroids, an empty table gives
none.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stash
from .integer_vectors import kept, matrix

#: Pivots; each pair of them gives a bound.
PIVOTS = 4
#: Share of a bound that is given up to rounding: products, roots and quotients err by a few 2**-53 of it.
SLACK = 2.0**-48


class Clusters(NamedTuple):
    assigned: DataFrame  # vec_id, cluster, distance (squared)
    centroids: DataFrame  # cluster, centroid


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to one vector, or to rows of y in turn."""
    gap = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", gap, gap)


def choose_pivots(seeds: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """The first seed, then each time the one farthest from those chosen; fewer if no other is apart."""
    at, far = [0], squared(seeds, seeds[0])
    while len(at) < count and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, squared(seeds, seeds[at[-1]]))
    return seeds[at]


def lower_bounds(to_pivots: np.ndarray, of_centroids: np.ndarray, of_pivots: np.ndarray) -> np.ndarray:
    """(rows, centroids): no more than the squared distance, from squared distances to pivots."""
    a, c, e = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(of_centroids.astype(np.float64)), np.sqrt(of_pivots.astype(np.float64))
    best = np.zeros((len(a), len(c)))
    for p, s in combinations(range(len(e)), 2):
        one, other = a[:, p, None] * c[:, s], a[:, s, None] * c[:, p]
        bound = (np.abs(one - other) - SLACK * (one + other)) / e[p, s]
        np.maximum(best, bound, out=best)
    return best * best * (1 - SLACK)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, ties to the lesser number, and how many distances were computed."""
    table = lambda rows: np.stack([squared(rows, p) for p in pivots], 1)
    low = lower_bounds(to_pivots, table(centroids), table(pivots))
    best = low.argmin(1)
    distance = squared(x, centroids[best])
    done = len(x)
    first = best.copy()
    for j in range(len(centroids)):
        at = np.flatnonzero((low[:, j] <= distance) & (first != j))
        found = squared(x[at], centroids[j])
        done += len(at)
        nearer = (found < distance[at]) | ((found == distance[at]) & (j < best[at]))
        best[at[nearer]], distance[at[nearer]] = j, found[nearer]
    return best, distance, done


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, length: int = 64, id: str = "vec_id", vector: str = "embedding", seed: int = 1, pivots: int = PIVOTS) -> Clusters:
    """Centroids start as the k vectors with the least sha256 of `seed:id`; `rounds` rounds of assignment and floored means, then one more assignment."""
    spark = rows.sparkSession
    able = kept(rows, id, vector, length)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = able.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    kind = dict(able.dtypes)["vec_id"]
    whole = lambda c: spark.createDataFrame([(j, [int(i) for i in x]) for j, x in enumerate(c)], "cluster int, centroid array<long>")
    if not first:
        return Clusters(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), whole([]))
    centroids = np.array([r.v for r in first], np.int64)
    fixed = choose_pivots(centroids, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), length)
            to = np.stack([squared(x, p) for p in fixed], 1)
            yield b.append_column("p", pa.FixedSizeListArray.from_arrays(pa.array(to.reshape(-1)), len(fixed)).cast(pa.list_(pa.int64())))

    table = stash(able.mapInArrow(measure, f"vec_id {kind}, v array<int>, p array<long>"))

    def sums(at: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(at), np.int64), np.zeros((len(at), length), np.int64)
            for b in batches:
                x = matrix(b.column("v"), length)
                best, _, _ = nearest(x, matrix(b.column("p"), len(fixed)), at, fixed)
                count += np.bincount(best, minlength=len(at))
                for j in np.unique(best):
                    total[j] += x[best == j].sum(0, dtype=np.int64)
            some = np.flatnonzero(count)
            # Position 0 holds the count, the others the components' sums.
            sent = np.concatenate([count[some, None], total[some]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, length + 1)), pa.array(np.tile(np.arange(length + 1), len(some))), pa.array(sent.reshape(-1))], ["cluster", "at", "s"])

        return run

    for _ in range(rounds):
        parts = table.select("v", "p").mapInArrow(sums(centroids), "cluster long, at long, s long")
        # A sum may leave a long where vectors are long and many.
        per = parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        got: dict[int, dict[int, int]] = {}
        for r in per:
            got.setdefault(r["cluster"], {})[r["at"]] = int(r["s"])
        centroids = centroids.copy()
        for j, s in got.items():
            centroids[j] = [s[i] // s[0] for i in range(1, length + 1)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance, _ = nearest(matrix(b.column("v"), length), matrix(b.column("p"), len(fixed)), centroids, fixed)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return Clusters(stash(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")), whole(centroids))
