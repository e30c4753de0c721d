"""Metric cells: exact joins and searches against brute force, recall, what is skipped."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield.operators import cells


def clustered(seed, n, d, groups, spread=0.25):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, d))
    return middle[r.integers(groups, size=n)] + spread * r.normal(size=(n, d))


def frame(spark, x, odd=True):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if odd:
        rows += [(5000, None), (5001, [0.0] * x.shape[1]), (5002, [float("nan")] * x.shape[1]), (5003, [1.0, 2.0]), (5004, [2.0, 4.1]), (5005, [float("inf")] + [1.0] * (x.shape[1] - 1))]
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.fixture(scope="module")
def hot():
    """Clustered vectors of which a third are one and the same."""
    x = clustered(2, 240, 6, 8)
    x[::3] = x[1]
    return x


@pytest.mark.parametrize("least", [-1.0, 0.0, 0.7, 0.99])
def test_join_equals_all_pairs(spark, hot, least, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    monkeypatch.setattr(cells, "PART_BYTES", 8 * 6 * 17)
    u = hot / np.linalg.norm(hot, axis=1, keepdims=True)
    near = u @ u.T
    want = {(i, j): near[i, j] for i in range(len(u)) for j in range(i + 1, len(u)) if near[i, j] >= least - 1e-12}
    if least <= 0.9:
        want[5003, 5004] = float(np.dot([1, 2], [2, 4.1]) / np.linalg.norm([1, 2]) / np.linalg.norm([2, 4.1]))
    got = [(r.src_id, r.dst_id, r.similarity) for r in cells.similar_pairs(frame(spark, hot), "v", least).collect()]
    got = [g for g in got if g[:2] != (5003, 5004) or least <= 0.9]
    assert len(got) == len(want) and {g[:2]: g[2] for g in got} == pytest.approx(want)


def brute(x, queries, count, least, own=True):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(u @ u[q], 12)
        out[q] = [i for _, i in sorted((-v, i) for i, v in enumerate(s) if v >= least and (own or i != q))[:count]]
    return out


def listed(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((-round(r.similarity, 12), r.id))
    return {q: [i for _, i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("count,least", [(7, -1.0), (3, 0.6), (500, 0.2)])
def test_exact_search_equals_brute_force(spark, hot, count, least, monkeypatch):
    monkeypatch.setattr(cells, "PART_BYTES", 8 * 6 * 17)
    monkeypatch.setattr(cells, "PROBES", 2)
    index = cells.build(frame(spark, hot), "v")
    asked = frame(spark, hot).where("id % 5 = 0 OR id > 4999").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = listed(cells.search(index, asked, count, least))
    assert got.pop(5003)[0] == 5003 and got.pop(5004)[0] == 5004
    assert got == brute(hot, range(0, len(hot), 5), count, least)


def test_search_leaves_out_its_own_row(spark, hot):
    index = cells.build(frame(spark, hot, False), "v")
    asked = frame(spark, hot, False).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert listed(cells.search(index, asked, 1, -1.5, but_own=True)) == brute(hot, range(len(hot)), 1, -1.5, False)


def test_index_keeps_on_disk_and_answers_alike(spark, hot, tmp_path):
    index = cells.build(frame(spark, hot), "v")
    cells.save(index, str(tmp_path / "index"))
    asked = frame(spark, hot).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    again = cells.load(spark, str(tmp_path / "index"))
    assert listed(cells.search(again, asked, 5)) == listed(cells.search(index, asked, 5))


def test_recall_and_skipped_share(spark):
    x = clustered(7, 3000, 16, 40)
    rows = frame(spark, x)
    index = cells.build(rows, "v")
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    probes = cells.calibrate(index, asked)
    true, found = listed(cells.search(index, asked)), listed(cells.search(index, asked, probes=probes))
    hit = sum(len(set(true[q]) & set(found[q])) for q in true)
    assert probes < len(index.size) / 3 and hit >= 0.9 * sum(map(len, true.values()))
    assert int(index.size.sum()) == 3002  # every usable row is placed


def test_a_join_of_clustered_rows_skips_most_pairs(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 50)
    work = cells.join_work(frame(spark, clustered(7, 2000, 8, 40, 0.05)), "v", 0.9).first()
    assert work.skipped_share > 0.8 and work.compared + work.skipped == work.all_pairs == 2002 * 2001 // 2


def test_empty_tables(spark, hot):
    none = frame(spark, hot, False).limit(0)
    asked = none.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    index = cells.build(none, "v")
    assert cells.similar_pairs(none, "v", 0.5).collect() == [] and cells.search(index, asked).collect() == [] and cells.calibrate(index, asked) == 1
    some = cells.build(frame(spark, hot, False), "v")
    assert cells.search(some, asked).collect() == [] and cells.search(index, frame(spark, hot, False).select(F.col("id").alias("query_id"), F.col("v").alias("q"))).collect() == []


def test_a_row_sent_to_many_cells_leaves_in_bounded_lots(monkeypatch):
    """A batch is copied once a cell, so what is sent at once has a limit of its own."""
    monkeypatch.setattr(cells, "SEND_BYTES", 8 * 8 * 100)
    seen = []
    rows = SimpleNamespace(dtypes=[("id", "bigint"), ("v", "array<double>")], mapInArrow=lambda f, schema: seen.append(f))
    x = np.random.default_rng(1).normal(size=(500, 8))
    made = cells.Cells(None, {8: x[:40]}, {8: 0}, np.ones(40, np.int64), np.zeros(40))
    cells._send(rows, made, lambda x, p, *more: np.ones((len(x), len(p)), bool), ("id", "v"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(x.tolist())], ["id", "v"])
    sent = list(seen[0](iter([batch])))
    assert max(b.num_rows for b in sent) == 100
    assert sorted((i, t) for b in sent for i, t in zip(b["id"].to_pylist(), b["to"].to_pylist(), strict=True)) == [(i, t) for i in range(500) for t in range(40)]


@pytest.mark.parametrize("kind", ["join", "search"])
def test_similarities_are_held_in_bounded_lots(spark, hot, kind, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    seen = []
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, f, schema: seen.append(f) or spark.createDataFrame([], schema))
    if kind == "join":
        cells.similar_pairs(frame(spark, hot, False), "v", 0.9)
    else:
        cells.search(cells.build(frame(spark, hot, False), "v"), frame(spark, hot, False).select(F.col("id").alias("query_id"), F.col("v").alias("q")), probes=1)
    x = np.random.default_rng(1).normal(size=(30_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = lambda y, name: pa.table({"visit": pa.array([0] * len(y)), name: pa.array(range(len(y))), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * 24, pa.int32()), pa.array(y.reshape(-1)))})
    # Of a join the small side first: 1,000 x 30,000 similarities are 240 MB; of a search the rows first.
    left, right = (table(x[:1000], "id"), table(x, "id")) if kind == "join" else (table(x, "id"), table(x[:600], "query_id"))
    tracemalloc.start()
    try:
        seen[0](left, right)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6


def test_angles_to_all_pivots_are_held_in_bounded_lots():
    """What a task holds doesn't grow with the index: 10,000 rows have 82 MB of angles to 1,024 pivots."""
    seen = []
    rows = SimpleNamespace(dtypes=[("id", "bigint"), ("v", "array<double>")], mapInArrow=lambda f, schema: seen.append(f))
    x = np.random.default_rng(1).normal(size=(10_000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = cells.Cells(None, {8: x[:1024]}, {8: 0}, np.ones(1024, np.int64), np.zeros(1024))
    cells._send(rows, made, lambda x, p, *more: cells.angles(x, p) < 0.0, ("id", "v"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(x.tolist())], ["id", "v"])
    tracemalloc.start()
    try:
        assert not list(seen[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12e6


def test_a_second_look_returns_only_what_may_be_as_good(spark, hot, monkeypatch):
    monkeypatch.setattr(cells, "PROBES", 2)
    looks, look = [], cells._look
    monkeypatch.setattr(cells, "_look", lambda *a: looks.append(look(*a)) or looks[-1])
    rows = frame(spark, hot, False)
    asked = rows.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert listed(cells.search(cells.build(rows, "v"), asked, 7)) == brute(hot, range(0, len(hot), 5), 7, 0.0)
    first, more = (listed(x) for x in looks)
    u = hot / np.linalg.norm(hot, axis=1, keepdims=True)
    assert all(len(first[q]) < 7 or u[q] @ u[i] >= np.sort(u[first[q]] @ u[q])[-7] - 1e-11 for q in more for i in more[q])


def test_a_join_moves_a_row_once_to_a_group_of_cells(spark, monkeypatch):
    """At 0 nothing can be skipped: each row visited half of all cells, and their rows were moved once for each lot of visitors."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(cells, "CELL_ROWS", 25)
    seen, apply = [], PandasCogroupedOps.applyInArrow

    def counted(self, f, schema):
        seen.extend((self._gd1._df, self._gd2._df))
        return apply(self, f, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    x = np.random.default_rng(3).normal(size=(1000, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = cells.similar_pairs(frame(spark, x, False), "v", 0.0)
    assert found.count() == np.count_nonzero(np.triu(u @ u.T >= -1e-12, 1))
    # 40 cells in 5 groups, for 4 cores: half of them a row, and a few lots of visitors a group; half of the cells before.
    assert sum(df.count() for df in seen) < 7 * 1000


def test_pairs_leave_a_task_as_they_are_found():
    """All 3,000 x 3,000 pairs match: 216 MB as one table."""
    n, d = 3000, 4
    one = np.zeros((n, d))
    one[:, 0] = 1.0
    made = cells.Cells(None, {d: one[:1]}, {d: 0}, np.array([2 * n]), np.array([0.0]))
    groups = cells._grouped(made, n * 8 * d)
    assert groups.cell.tolist() == [0, 0] and groups.group.tolist() == [0, 1]
    side = lambda ids, piece: [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in (ids, np.full(n, piece), one.reshape(-1))]
    names = ["a_id", "a_piece", "a_v", "b_id", "b_piece", "b_v"]
    compare = cells._compare(made, groups, 0.5, float(np.arccos(0.5)), "bigint")
    # Of two groups the rows of one visit the other: here those of the second.
    for home, visitor, pairs in ((0, 0, n * (n - 1) // 2), (0, 1, n * n), (1, 0, 0)):
        batch = pa.RecordBatch.from_arrays([c for p in (home, visitor) for c in side(np.arange(n) + p * n, p)], names)
        tracemalloc.start()
        try:
            sizes = []
            for b in compare(iter([batch])):
                assert (b["src_id"].to_numpy() < b["dst_id"].to_numpy()).all()
                sizes.append(b.num_rows)
                del b
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert sum(sizes) == pairs and peak < 150e6


def test_single_precision_drops_no_pair():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    for least in (near[3, 17], near[200, 399], 0.0, -1.0, 1.0):  # pairs that are exactly at the threshold
        p, q, s = cells._alike(x, x, least)
        assert set(zip(p.tolist(), q.tolist())) == set(zip(*(c.tolist() for c in np.nonzero(near >= least - 1e-12)))) and np.allclose(s, near[p, q], atol=1e-14)


def test_a_sample_leaves_out_first_what_cannot_be_in_it(spark):
    units = spark.range(20_000).select("id", F.array(F.col("id").cast("double")).alias("v")).repartition(8)
    want = sorted(r.v for r in units.orderBy(F.xxhash64("id")).limit(500).collect())
    got = cells._sample(units, 20_000, 500)
    assert sorted(r.v for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (xxhash64(" in plan and "Filter" not in cells._sample(units, 900, 500)._jdf.queryExecution().optimizedPlan().toString()
