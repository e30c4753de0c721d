"""Vectors in metric cells: an index for searches, and exact joins that prune.

Rows become unit vectors and go to the cell of the nearest pivot, by angle.  The
angle between vectors is a metric, so a vector x has no row of a cell nearer than

    angle(x, pivot) - radius   and   (angle(x, pivot) - angle(x, own pivot)) / 2,

the triangle inequality and the plane between two pivots.  Cells beyond that
bound are never met.  Both bounds are loosened by more than arccos can err.

Pivots are means of a bounded sample (`SAMPLE` rows, `SAMPLE_BYTES`): for an index as
many as the square root of the rows, for a join one for `CELL_ROWS` rows; `MOST_PIVOTS`
at most.  Each row is placed, sampled or not.  A cell with more than `PART_BYTES` of vectors is met in parts, and its
visitors likewise, so a vector that a third of the rows share makes many tasks,
not a large one.  A join moves rows to groups of cells, not to each cell.

An index is two tables in a folder: rows by cell, and a row for each cell with
pivot, radius and count.  A search with `probes` meets that many nearest cells,
so its results are approximate; without, it meets as many cells as the first
probe's worst result leaves possible, and is exact.

Null, zero and non-finite vectors are in no cell; vectors of another length have
cells of their own and never meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stash

#: Rows and bytes that pivots are fitted on, pivots and their bytes, rounds of fitting.
SAMPLE, SAMPLE_BYTES, MOST_PIVOTS, PIVOT_BYTES, ROUNDS = 20_000, 32 << 20, 1024, 16 << 20, 8
#: Rows a cell of a join.
CELL_ROWS = 1000
#: Bytes of vectors of a part of a cell, or of its visitors; of a group of cells of a join, and of a lot of its visitors: what a join moves is the square of the input over these; of a search, whose visitors grow with the rows.
PART_BYTES, JOIN_BYTES, LOOK_BYTES = 16 << 20, 8 << 20, 4 << 20
#: Similarities that a task of a join and of a search holds at once, rows whose angles to all pivots it holds at once, and bytes of rows that it sends at once.
SCORES, LOOKS, ANGLE_ROWS, SEND_BYTES = 1 << 20, 1 << 18, 256, 4 << 20
#: Radians by which bounds are loosened, and similarity by which the worst result is.
LOOSE, TIE = 1e-7, 2e-12
#: Cells that an exact search looks into first; share of true results that an approximate one shall find, and queries that its probes are fitted on.
PROBES, RECALL, TRIALS = 16, 0.95, 200


@dataclass
class Cells:
    rows: DataFrame  # cell, angle, id, v, ...
    pivots: dict[int, np.ndarray]  # by length of the vectors
    first: dict[int, int]  # number of the first cell of a length
    size: np.ndarray  # rows of each cell
    radius: np.ndarray

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pivots, radii and the first cell's number, for vectors of a length."""
        p = self.pivots.get(length)
        if p is None:
            p = np.empty((0, length))
        at = self.first.get(length, 0)
        return p, self.radius[at : at + len(p)], at


def unit_rows(rows: DataFrame, vector: str, id: str = "id", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, v, more ...) with v of length one."""
    able = rows.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)
    able = able.withColumn("_size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where((F.col("_size") > 0) & (F.col("_size") < float("inf")))
    # The size is a value of an outer function: as a column it would be computed again for each element.
    sized = F.array(F.struct("v", F.col("_size").alias("size")))
    return able.select("id", F.transform(sized, lambda u: F.transform(u["v"], lambda x: x / u["size"]))[0].alias("v"), *more)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of rows whose lists have one length, `ANGLE_ROWS` at once: angles to every pivot grow with the index."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        for i in range(0, len(at), ANGLE_ROWS):
            some = at[i : i + ANGLE_ROWS]
            yield some, column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


def fit(x: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit pivots: seeds spread over the sample's order, then means of what is nearest to each."""
    pivots = x[np.unique(np.linspace(0, len(x) - 1, count).astype(int))]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + ANGLE_ROWS] @ pivots.T).argmax(1) for i in range(0, len(x), ANGLE_ROWS)])
        total = np.zeros_like(pivots)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        pivots = np.where(size > 1e-9, total / np.maximum(size, 1e-9), pivots)
    return pivots


def _sample(units: DataFrame, n: int, most: int) -> DataFrame:
    """(v): of n rows the `most` with the least hash of their id.  Those that can't be among them stay out first, as each partition sends its first `most` rows to the driver."""
    hashed = units.select("v", F.xxhash64("id").alias("h"))
    if n > 2 * most:
        hashed = hashed.where(F.col("h") <= int(-(1 << 63) + 1.5 * most / n * (1 << 64)))
    return hashed.orderBy("h", "v").limit(most).select("v")


def build(rows: DataFrame, vector: str, id: str = "id", more: tuple[str, ...] = (), cell_rows: int | None = None) -> Cells:
    """Place every usable row; about `cell_rows` a cell, or as many as there are cells."""
    units = unit_rows(rows, vector, id, more)
    pivots, first, cells = {}, {}, 0
    for d, n in sorted(units.groupBy(F.size("v").alias("d")).count().collect()):
        some = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * d)))
        sample = _sample(units.where(F.size("v") == d), n, some).toArrow()
        x = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        pivots[d] = fit(x, max(1, min(MOST_PIVOTS, n // cell_rows if cell_rows else math.isqrt(n), PIVOT_BYTES // (8 * d), len(x))))
        first[d] = cells
        cells += len(pivots[d])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, angle = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for at, x in _by_length(b.column("v")):
                far = angles(x, pivots[x.shape[1]])
                near = far.argmin(1)
                cell[at], angle[at] = first[x.shape[1]] + near, far[np.arange(len(x)), near]
            yield b.append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))

    kinds = ", ".join(f"{c} {k}" for c, k in units.dtypes)
    placed = stash(units.mapInArrow(place, f"{kinds}, cell long, angle double"))
    size, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():
        size[r.cell], radius[r.cell] = r.n, r.r
    return Cells(placed, pivots, first, size, radius)


def save(cells: Cells, folder: str) -> None:
    """Write an index: rows in a folder for each cell, so that a search reads only those it looks into."""
    spark = cells.rows.sparkSession
    cells.rows.repartition("cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    about = [(cells.first[d] + i, d, v.tolist(), float(cells.radius[cells.first[d] + i]), int(cells.size[cells.first[d] + i])) for d, p in cells.pivots.items() for i, v in enumerate(p)]
    spark.createDataFrame(about, "cell long, length int, pivot array<double>, radius double, size long").write.parquet(f"{folder}/cells")


def load(spark: SparkSession, folder: str) -> Cells:
    about = sorted(spark.read.parquet(f"{folder}/cells").collect())
    pivots: dict[int, list] = {}
    first: dict[int, int] = {}
    for r in about:
        pivots.setdefault(r.length, []).append(r.pivot)
        first.setdefault(r.length, r.cell)
    rows = spark.read.parquet(f"{folder}/rows").withColumn("cell", F.col("cell").cast("long"))
    return Cells(rows, {d: np.array(p) for d, p in pivots.items()}, first, np.array([r["size"] for r in about], np.int64), np.array([r.radius for r in about]))


def _send(rows: DataFrame, cells: Cells, choose: Callable[[np.ndarray, np.ndarray, np.ndarray, int, dict], np.ndarray], keep: tuple[str, ...], use: tuple[str, ...] = (), number: dict[int, int] | None = None) -> DataFrame:
    """Each row once for each cell that `choose(x, pivots, radii, first, used columns)` marks: (keep ..., to).

    number: what `choose` marks are not cells; the first one's number, by length.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column("v")):
                p, radius, start = cells.of(x.shape[1])
                if not len(p):
                    continue
                used = {c: b.column(c).to_numpy(zero_copy_only=False)[at] for c in use}
                who, to = np.nonzero(choose(x, p, radius, start, used))
                # A row may go to every cell, so copies leave in bounded lots.
                begin = number[x.shape[1]] if number else start
                some, rows_of = max(1, SEND_BYTES // (8 * x.shape[1])), b.select(list(keep))
                for i in range(0, len(who), some):
                    yield rows_of.take(pa.array(at[who[i : i + some]])).append_column("to", pa.array(begin + to[i : i + some]))

    lean = Cells(None, cells.pivots, cells.first, cells.size, cells.radius)
    cells = lean  # what tasks get: arrays only
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", to long")


def _parts(table: dict[int, int] | np.ndarray, bytes_a_row: int, most: int | None = None) -> np.ndarray:
    return np.maximum(1, -(-np.asarray(table) * bytes_a_row // (most or PART_BYTES))).astype(np.int64)


def _parts_of(parts: np.ndarray, cell: str):
    """Column: how many parts a cell has, looked up by its number."""
    if not (parts > 1).any():
        return F.lit(1).cast("long")
    return F.coalesce(F.get(F.array(*[F.lit(n).cast("long") for n in parts.tolist()]), F.col(cell).cast("int")), F.lit(1).cast("long"))


def _met(home: DataFrame, visitors: DataFrame, cells: Cells, width: int, home_columns: list[str], visitor_columns: list[str], key: str, most: int | None = None):
    """Both sides by (cell, part, visit): rows of a cell by part, its visitors by visit, each part with each visit."""
    parts = _parts(cells.size, width, most)
    count = np.zeros(len(cells.size), np.int64)
    for r in visitors.groupBy("to").count().collect():
        count[r.to] = r["count"]
    visits = _parts(count, width, most)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    a = home.select("cell", F.pmod(F.xxhash64(F.lit(1), "id"), _parts_of(parts, "cell")).alias("part"), *home_columns, every(_parts_of(visits, "cell")).alias("visit"))
    b = visitors.withColumn("_visit", F.pmod(F.xxhash64(F.lit(2), key), _parts_of(visits, "to")))
    b = b.select(F.col("to").alias("cell"), every(_parts_of(parts, "to")).alias("part"), F.col("_visit").alias("visit"), *visitor_columns)
    return a, b, count


def _matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    v = table.column(column).combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


# --- join -----------------------------------------------------------------------


def _visiting(cells: Cells, reach: float) -> DataFrame:
    """Rows that may have a partner in another cell, once for each such cell; of two cells the rows of one visit."""

    def choose(x, pivots, radius, start, used):
        far = angles(x, pivots)
        home = used["cell"] - start
        own = far[np.arange(len(x)), home]
        near = _reaches(far, own, radius, reach)
        other = np.arange(len(pivots))
        goes = np.where((home[:, None] + other) % 2 == 0, home[:, None] < other, home[:, None] > other)
        return near & goes

    return _send(cells.rows, cells, choose, ("id", "v"), ("cell",))


def _look_up(values: np.ndarray, at):
    """Column: the value at a place."""
    return F.get(F.array(*[F.lit(n).cast("long") for n in values.tolist()]), at.cast("int"))


@dataclass
class Groups:
    """Cells, or hash parts of large ones, as pieces, and pieces of one length, one after another, in groups."""

    parts: np.ndarray  # of each cell
    piece: np.ndarray  # first one of each cell
    cell: np.ndarray  # of each piece
    group: np.ndarray  # of each piece
    first: dict[int, tuple[int, int, list[int]]]  # by length: first piece, end, where each group begins


def _grouped(cells: Cells, most: int) -> Groups:
    """Groups of about `most` bytes of vectors."""
    parts = np.ones(len(cells.size), np.int64)
    for d, p in cells.pivots.items():
        at = slice(cells.first[d], cells.first[d] + len(p))
        parts[at] = _parts(cells.size[at], 8 * d, most)
    piece = np.cumsum(parts) - parts
    cell = np.repeat(np.arange(len(parts)), parts)
    group, first, number = np.zeros(len(cell), np.int64), {}, -1
    for d, p in cells.pivots.items():
        one, two = int(piece[cells.first[d]]), int(piece[cells.first[d]] + parts[cells.first[d] : cells.first[d] + len(p)].sum())
        held, begins = most, []
        for i in range(one, two):
            own = int(cells.size[cell[i]]) * 8 * d // int(parts[cell[i]])
            if not begins or held + own > most:
                number, held = number + 1, 0
                begins.append(i - one)
            held += own
            group[i] = number
        first[d] = one, two, begins
    return Groups(parts, piece, cell, group, first)


def _goes(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of two groups the rows of one visit the other, and so of two pieces of a group; a piece's rows visit their own."""
    one, two = group[a], group[b]
    same = one == two
    one, two = np.where(same, a, one), np.where(same, b, two)
    return (one == two) | (((one + two) % 2 == 0) == (one < two))


def _reaches(far: np.ndarray, own: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Whether rows may have a partner in cells at the angles `far`, of their own cell at `own`."""
    return (far - radius <= reach + LOOSE) & ((far - own[:, None]) / 2 <= reach + LOOSE)


def similar_pairs(rows: DataFrame, vector: str, min_similarity: float) -> DataFrame:
    """(src_id, dst_id, similarity) of all pairs src_id < dst_id at or above the threshold.

    A row goes once to each group of cells that may hold a partner, not to each cell: what is moved is n rows times n over
    the rows of a group.  A task has a group and a bounded lot of its visitors, meets a visitor only with the cells of the
    group that may hold a partner, and sends pairs as it finds them.
    """
    cells = build(rows, vector, cell_rows=CELL_ROWS)
    kind = dict(rows.dtypes)["id"]
    reach = math.acos(max(-1.0, min(1.0, min_similarity - 1e-12)))
    # Bytes of a side of a task: fewer where that gives each core two tasks.
    total = sum(int(cells.size[cells.first[d] : cells.first[d] + len(p)].sum()) * 8 * d for d, p in cells.pivots.items())
    most = max(1, min(PART_BYTES, JOIN_BYTES, -(-total // math.isqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))))
    groups = _grouped(cells, most)

    def choose(x, pivots, radius, start, used):
        far = angles(x, pivots)
        home = used["cell"] - start
        near = _reaches(far, far[np.arange(len(x)), home], radius, reach)
        near[np.arange(len(x)), home] = True
        one, two, begins = groups.first[x.shape[1]]
        met = near[:, groups.cell[one:two] - start] & _goes(used["piece"][:, None], np.arange(one, two), groups.group)
        return np.logical_or.reduceat(met, begins, axis=1)

    part = F.pmod(F.xxhash64(F.lit(1), "id"), _parts_of(groups.parts, "cell"))
    split = bool((groups.parts > 1).any())
    home = cells.rows.withColumn("piece", _look_up(groups.piece, F.col("cell")) + part if split else F.col("cell"))
    visitors = _send(home, cells, choose, ("id", "piece", "v"), ("cell", "piece"), {d: int(groups.group[one]) for d, (one, _, _) in groups.first.items()})
    count = np.zeros(int(groups.group.max(initial=0)) + 1, np.int64)
    for r in visitors.groupBy("to").count().collect():
        count[r.to] = r["count"]
    width = np.ones(len(count), np.int64)
    for d, (one, two, _) in groups.first.items():
        width[groups.group[one:two]] = 8 * d
    visits = _parts(count, width, most)
    columns = ["id", "piece", "v"]
    a = home.select((_look_up(groups.group, F.col("piece")) if len(count) > 1 else F.lit(0).cast("long")).alias("group"), *columns)
    a = a.select("group", F.explode(F.sequence(F.lit(0).cast("long"), _parts_of(visits, "group") - 1)).alias("visit"), *columns)
    b = visitors.select(F.col("to").alias("group"), F.pmod(F.xxhash64(F.lit(2), "id"), _parts_of(visits, "to")).alias("visit"), *columns)
    key = ["group", "visit"]

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        """Both sides of a task as one row, so that its pairs needn't be one table."""
        out = {}
        for side, table in (("a", left), ("b", right)):
            for c in table.column_names:
                if c not in key:
                    values = table.column(c).combine_chunks()
                    values = values.flatten() if c == "v" else values
                    out[f"{side}_{c}"] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(out)

    packed = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(pack, ", ".join(f"{s}_id array<{kind}>, {s}_piece array<long>, {s}_v array<double>" for s in "ab"))
    compare = _compare(Cells(None, cells.pivots, cells.first, cells.size, cells.radius), groups, min_similarity, reach, kind)
    return packed.mapInArrow(compare, f"src_id {kind}, dst_id {kind}, similarity double")


def _alike(y: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of y, rows of x, similarities) at or above the threshold: single precision says which may be, double which are."""
    d = x.shape[1]
    score = y.astype(np.float32) @ x.astype(np.float32).T
    # Rounding of either side, and of sums of products that are one at most together, twice over.
    able = np.zeros(-(-score.size // 8) * 8, bool)
    np.greater_equal(score, np.float32(least - (d + 4) * 1.2e-7), out=able[: score.size].reshape(score.shape))
    few = np.flatnonzero(able.view(np.uint64))  # few of them, so eight are passed at once
    at = (few[:, None] * 8 + np.arange(8)).reshape(-1)
    p, q = np.divmod(at[able[at]], len(x))
    if len(p) > SCORES // 64:
        s = (y @ x.T)[p, q]
    else:
        s = np.einsum("ij,ij->i", y[p], x[q])
    good = s >= least - 1e-12
    return p[good], q[good], s[good]


def _compare(cells: Cells, groups: Groups, least: float, reach: float, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed tasks -> pairs, as they are found."""
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def lots(row: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = {c: row.column(c).flatten().to_numpy(zero_copy_only=False) for c in row.schema.names}
        ids, others, of, by = held["a_id"], held["b_id"], held["a_piece"], held["b_piece"]
        if not len(ids) or not len(others):
            return
        x, y = held["a_v"].reshape(len(ids), -1), held["b_v"].reshape(len(others), -1)
        pivots, radius, start = cells.of(x.shape[1])
        own_cell = groups.cell[by] - start
        own = np.concatenate([np.arccos(np.clip(np.einsum("ij,ij->i", y[i : i + ANGLE_ROWS], pivots[own_cell[i : i + ANGLE_ROWS]]), -1.0, 1.0)) for i in range(0, len(y), ANGLE_ROWS)])
        for piece in np.unique(of):
            mine = np.flatnonzero(of == piece)
            z, zid, cell = x[mine], ids[mine], groups.cell[piece] - start
            far = angles(y, pivots[cell : cell + 1])
            near = (_reaches(far, own, radius[cell : cell + 1], reach)[:, 0] | (own_cell == cell)) & _goes(by, piece, groups.group)
            some = max(1, SCORES // len(z))
            for same in (False, True):
                who = np.flatnonzero(near & ((by == piece) == same))
                for i in range(0, len(who), some):
                    at = who[i : i + some]
                    p, q, s = _alike(y[at], z, least)
                    one, two = others[at[p]], zid[q]
                    keep = one < two if same else one != two
                    one, two, s = one[keep], two[keep], s[keep]
                    swap = one > two
                    yield np.where(swap, two, one), np.where(swap, one, two), s

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out, n = [], 0
                for found in lots(b.slice(i, 1)):
                    out.append(found)
                    n += len(found[0])
                    if n >= SCORES // 16:
                        yield pairs(out)
                        out, n = [], 0
                if n:
                    yield pairs(out)

    def pairs(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*out, strict=True), (id_type, id_type, pa.float64()), strict=True)], ["src_id", "dst_id", "similarity"])

    return compare


def join_work(rows: DataFrame, vector: str, min_similarity: float) -> DataFrame:
    """One row: n_rows, n_cells, all_pairs, compared, skipped, skipped_share of pairs of rows that the join needn't compare."""
    cells = build(rows, vector, cell_rows=CELL_ROWS)
    count = np.zeros(len(cells.size), np.int64)
    for r in _visiting(cells, math.acos(max(-1.0, min(1.0, min_similarity - 1e-12)))).groupBy("to").count().collect():
        count[r.to] = r["count"]
    n = int(cells.size.sum())
    own, across = sum(s * (s - 1) // 2 for s in cells.size.tolist()), int((cells.size * count).sum())
    whole, done = n * (n - 1) // 2, own + across
    return rows.sparkSession.createDataFrame([(n, len(cells.size), whole, done, whole - done, (whole - done) / max(whole, 1))], "n_rows long, n_cells int, all_pairs long, compared long, skipped long, skipped_share double")


# --- search ---------------------------------------------------------------------


def best_rows(x: np.ndarray, y: np.ndarray, floor: np.ndarray, count: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of y, rows of x, similarities), a lot of y at once: of unit rows x, in the order of their ids, the best `count` of each y from its floor on.

    own: ids of x and of y, which must differ.
    """
    some = max(1, LOOKS // len(x))
    for i in range(0, len(y), some):
        near = y[i : i + some] @ x.T
        good = near >= floor[i : i + some, None]
        if own:
            good &= own[1][i : i + some, None] != own[0]
        many = np.flatnonzero(np.count_nonzero(good, axis=1) > count)
        if len(many):  # all that tie with the last one, so that ids decide
            score = np.where(good[many], -np.round(near[many], 12), np.inf)
            good[many] = score <= np.partition(score, count - 1, axis=1)[:, count - 1, None]
        p, q = np.nonzero(good)
        order = np.lexsort((q, -np.round(near[p, q], 12), p))
        p, q = p[order], q[order]
        place = np.arange(len(p)) - np.searchsorted(p, p)
        p, q = p[place < count], q[place < count]
        yield p + i, q, near[p, q]


def _look(cells: Cells, asked: DataFrame, count: int, least: float, but_own: bool) -> DataFrame:
    """asked(query_id, v, to) -> (query_id, id, similarity): the best of each cell looked into.  With a column s of asked, only rows that may be as good."""
    kinds = dict(cells.rows.dtypes)["id"], dict(asked.dtypes)["query_id"]
    known = ["s"] if "s" in asked.columns else []
    a, b, _ = _met(cells.rows.select("cell", "id", "v"), asked, cells, 8 * max(cells.pivots, default=1), ["id", "v"], ["query_id", "v", *known], "query_id", min(PART_BYTES, LOOK_BYTES))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "similarity"]
        if not left.num_rows or not right.num_rows:
            return pa.table([right.column("query_id").slice(0, 0), left.column("id").slice(0, 0), pa.array([], pa.float64())], names)
        left = left.sort_by("id")
        x, ids = _matrix(left), left.column("id").to_numpy()
        y, queries = _matrix(right), right.column("query_id").to_numpy()
        floor = np.maximum(least, right.column("s").to_numpy() - TIE) if known else np.full(len(y), least)
        out = list(best_rows(x, y, floor, count, (ids, queries) if but_own else None))
        p, q, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([right.column("query_id").take(pa.array(p)), left.column("id").take(pa.array(q)), pa.array(s)], names)

    key = ["cell", "part", "visit"]
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(best, f"query_id {kinds[1]}, id {kinds[0]}, similarity double")


def _top(found: DataFrame, count: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count).drop("_rank")


def calibrate(cells: Cells, queries: DataFrame, count: int = 10, min_similarity: float = 0.0, recall: float = RECALL) -> int:
    """Fewest nearest cells that hold so great a share of the true results, over a bounded sample of the queries (`TRIALS`)."""
    some = stash(queries.where(F.col("q").isNotNull()).orderBy(F.xxhash64("query_id"), "query_id").limit(TRIALS).select("query_id", "q"))
    true = search(cells, some, count, min_similarity).select("query_id", "id").join(cells.rows.select("id", "cell"), "id")
    places: list[int] = []
    asked = {r.query_id: r.v for r in unit_rows(some, "q", "query_id").select(F.col("id").alias("query_id"), "v").collect()}
    for r in true.groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect():
        x = np.array(asked[r.query_id])
        p, _, start = cells.of(len(x))
        order = np.argsort(np.argsort(angles(x[None], p)[0]))
        places += [int(order[c - start]) for c in r.cells]
    return int(np.quantile(places, recall, method="higher")) + 1 if places else 1


def search(cells: Cells, queries: DataFrame, count: int = 10, min_similarity: float = 0.0, probes: int | None = None, but_own: bool = False) -> DataFrame:
    """queries(query_id, q) -> (query_id, id, similarity): the best `count` rows of each, ties to the lesser id.

    With `probes` only that many nearest cells are looked into.  Without, all that may hold a better row than the
    worst of a first look into PROBES cells, so the result is exact.  but_own: a row with the query's id doesn't count.
    """
    # Few rows become many, one for each cell, so they are dealt out first.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    asked = unit_rows(queries, "q", "query_id").withColumnRenamed("id", "query_id").repartition(cores, "query_id")

    def nearest(x, pivots, radius, start, used):
        far = angles(x, pivots)
        n = min(probes or PROBES, len(pivots))
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, np.argpartition(far, n - 1, axis=1)[:, :n], True, 1)
        return out

    first = _top(_look(cells, _send(asked, cells, nearest, ("query_id", "v")), count, min_similarity, but_own), count)
    if probes is not None:
        return first
    first = stash(first)
    worst = first.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
    known = asked.join(worst, F.col("query_id") == F.col("_q"), "left")
    known = known.select("query_id", "v", F.when(F.col("n") >= count, F.greatest("s", F.lit(min_similarity))).otherwise(F.lit(min_similarity)).alias("s")).repartition(cores, "query_id")

    def rest(x, pivots, radius, start, used):
        far = angles(x, pivots)
        reach = np.arccos(np.clip(used["s"] - TIE, -1.0, 1.0))[:, None] + LOOSE
        return (far - radius <= reach) & ((far - far.min(1, keepdims=True)) / 2 <= reach) & ~nearest(x, pivots, radius, start, used)

    more = _look(cells, _send(known, cells, rest, ("query_id", "v", "s"), ("s",)), count, min_similarity, but_own)
    return _top(first.unionByName(more), count)
