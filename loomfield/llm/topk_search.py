"""Exact top-k search by inner product: branch and bound over dimensions.

Vectors stand in blocks in vertical layout, dimension after dimension.  A task
meets a block of queries with blocks of rows and adds up products a group of
dimensions at a time.  By the Cauchy-Schwarz inequality what the remaining
dimensions add lies within the product of both remaining lengths, so a candidate
whose best case is below the query's k-th worst case goes.  Once most have gone,
the survivors of all queries are compacted and only they are summed further.
What survives to the end has its exact score.

Rows are dealt to strips by a hash of their row number, so equal vectors, ids or
a hot group spread evenly.  A strip's blocks meet each block of queries once; of
each query only the best k of a strip leave the task.  Work is queries times rows.

Vectors that are null or hold a null or non-finite component take no part, nor do
those beyond `integer_vectors.MOST_MASS`; vectors of different lengths don't
meet.  A query doesn't find its own row, but finds rows that repeat it, and a
repeated query is a query each time.  Ties go to the lesser id, null last.  Fewer candidates
than k give all of them; an empty table, or one without queries, gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import stash
from .integer_vectors import kept

#: Rows of a vertical block, rows of a strip, queries of a block, queries summed at once, dimensions of a group.
BLOCK, STRIP, ASKING, AT_ONCE, GROUP = 8192, 262_144, 4096, 64, 16
#: Bounds are widened by this share; scores to this size are summed in floating point without error.
WIDER, EXACT = 2.0**-40, float(2**46)


def _pack(rows: DataFrame, parts: int) -> DataFrame:
    """rows(row, vec_id, v) -> (part, length, n, rows, ids, size, data): blocks of up to BLOCK rows of one length, data dimension after dimension."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        v = table.column("v").combine_chunks()
        length = v.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(length):
            at = np.flatnonzero(length == d)
            for i in range(0, len(at), BLOCK):
                some = table.take(pa.array(at[i : i + BLOCK]))
                x = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, d).T
                size = next(s for s in (1, 2, 4) if not x.size or (x.min() >= -(1 << 8 * s - 1) and x.max() < 1 << 8 * s - 1))
                ids = some.column("vec_id")
                out.append((key[0].as_py(), int(d), some.num_rows, some.column("row").to_numpy().tobytes(), ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_null().to_numpy().tobytes(), size, np.ascontiguousarray(x, f"i{size}").tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["part", "length", "n", "rows", "ids", "nulls", "size", "data"])

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), "row", "vec_id", "v")
    return dealt.groupBy("part").applyInArrow(run, "part long, length int, n int, rows binary, ids binary, nulls binary, size int, data binary")


class Block:
    """One vertical block as arrays, with what is left of each vector's length after each group of dimensions."""

    def __init__(self, record: dict):
        self.row, self.id, self.null = (np.frombuffer(record[c], t) for c, t in (("rows", np.int64), ("ids", np.int64), ("nulls", np.bool_)))
        self.x = np.frombuffer(record["data"], f"i{record['size']}").reshape(record["length"], record["n"])

    def ordered(self, dims: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        x = self.x[dims].astype(np.float64)
        mass = [np.einsum("ij,ij->j", x[i : i + GROUP], x[i : i + GROUP]) for i in range(0, len(x), GROUP)]
        left = np.cumsum(mass[::-1], 0)[::-1]
        return x, [np.sqrt(m) * (1 + WIDER) for m in left[1:]]


def _summed(q: np.ndarray, x: np.ndarray, q_left: list, x_left: list, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of pairs that may be among the best; q (m, d), x (d, n), least (m,): scores that are reached already."""
    m, n = len(q), x.shape[1]
    score, least = np.zeros((m, n)), least.copy()
    pairs = None
    for g, at in enumerate(range(0, len(x), GROUP)):
        dims = slice(at, at + GROUP)
        if pairs is None:
            score += q[:, dims] @ x[dims]
        else:
            a, b = pairs
            score += np.einsum("ij,ji->i", q[a][:, dims], x[dims][:, b])
        if g == len(x_left):
            break
        if pairs is None:
            room = q_left[g][:, None] * x_left[g]
            if n >= k and 2 * (at + GROUP) >= len(x):
                worst = np.partition(score - room, n - k, 1)[:, n - k]
                np.maximum(least, worst, out=least)
            alive = score + room >= least[:, None]
            if 2 * np.count_nonzero(alive) < m * n:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            good = score + q_left[g][a] * x_left[g][b] >= least[a]
            pairs, score = (a[good], b[good]), score[good]
    if pairs is None:
        pairs = np.nonzero(score >= least[:, None])
        score = score[pairs]
    return *pairs, score


def best_of(asked: Block, blocks: list[Block], k: int) -> tuple[np.ndarray, ...]:
    """(query, score, id, null, row) of the best k of every query over the blocks, by score, id and row."""
    mass = np.einsum("ij,ij->i", asked.x, asked.x, dtype=np.float64)
    dims = np.argsort(-mass, kind="stable")
    q, q_left = asked.ordered(dims)
    starts = range(0, q.shape[1], AT_ONCE)
    mine = [np.ascontiguousarray(q[:, i : i + AT_ONCE].T) for i in starts]
    least, tops = np.full(q.shape[1], -np.inf), [None] * len(mine)
    for b in blocks:
        x, x_left = b.ordered(dims)
        for i, start in enumerate(starts):
            some = slice(start, start + AT_ONCE)
            largest = max(np.abs(x).max(initial=0), np.abs(mine[i]).max(initial=0))
            if largest * largest * len(x) > EXACT:  # too long for floating point: whole numbers, no bounds
                exact = asked.x[dims][:, some].T.astype(np.int64) @ b.x[dims].astype(np.int64)
                a, c = np.nonzero(np.ones_like(exact, bool))
                score = exact[a, c]
            else:
                a, c, score = _summed(mine[i], x, [m[some] for m in q_left], x_left, least[some], k + 1)
                score = score.astype(np.int64)
            other = asked.row[some][a] != b.row[c]
            a, c, score = a[other] + start, c[other], score[other]
            new = a, score, b.id[c], b.null[c], b.row[c]
            top = new if tops[i] is None else tuple(np.concatenate(p) for p in zip(tops[i], new, strict=True))
            order = np.lexsort((top[4], top[2], top[3], -top[1], top[0]))
            top = tuple(p[order] for p in top)
            place = np.arange(len(top[0])) - np.searchsorted(top[0], top[0])
            least[top[0][place == k - 1]] = top[1][place == k - 1]
            tops[i] = tuple(p[place < k] for p in top)
    return tuple(np.concatenate(p) for p in zip(*tops, strict=True))


def search(rows: DataFrame, asking: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of every row where `asking` holds, over all other rows; ids are whole numbers."""
    table = stash(kept(rows, id, vector, None, F.coalesce(asking, F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id()))
    n, asked = table.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    strips = max(1, -(-n // STRIP))
    # No more queries than fit a task, and blocks enough for all cores.
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-asked // ASKING), min(-(-asked // AT_ONCE), -(-2 * cores // strips)))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = _pack(table.where("asks"), parts).withColumn("strip", every(strips))
    right = _pack(table, strips).withColumnRenamed("part", "strip").withColumn("part", every(parts))

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for record in queries.to_pylist():
            asked = Block(record)
            among = [Block(b) for b in blocks.to_pylist() if b["length"] == record["length"]]
            if among:
                a, score, ids, null, row = best_of(asked, among, k)
                out.append(pa.table([pa.array(asked.row[a]), pa.array(asked.id[a], mask=asked.null[a]), pa.array(ids, mask=null), pa.array(row), pa.array(score)], ["_asked", "query_id", "vec_id", "_row", "score"]))
        schema = pa.schema([(c, pa.int64()) for c in ("_asked", "query_id", "vec_id", "_row", "score")])
        return pa.concat_tables(out) if out else schema.empty_table()

    cell = ["strip", "part"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, "_asked long, query_id long, vec_id long, _row long, score long")
    order = W.partitionBy("_asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
