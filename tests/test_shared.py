"""Connected components and written tables."""

import random

import pytest

from loomfield.operators import shared


def by_union(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


def bent(n):
    """A path on which the least id is far from the next ones: label propagation walks it step by step."""
    return [(1, n)] + [(i, i + 1) for i in range(2, n)]


@pytest.mark.parametrize("name", ["chains and rings", "bent", "star", "random", "words", "none"])
def test_components_equal_union_find(spark, name):
    r = random.Random(3)
    links = {
        "chains and rings": [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200), (None, 3), (4, None)] + [(1, 2)] * 5,
        "bent": bent(300),
        "star": [(500, i) for i in range(200)] + [(0, 900 + i) for i in range(200)],
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(200)],
        "words": [("b", "a"), ("c", "b"), ("z", "y")],
        "none": [],
    }[name]
    kind = "string" if name == "words" else "long"
    got = shared.connected(spark.createDataFrame(links, f"a {kind}, b {kind}")).collect()
    assert len(got) == len({x.id for x in got}) and {x.id: x.component for x in got} == by_union(links)


def test_size_estimates_stay_real(spark, monkeypatch):
    """Tables read back have their own size, however many rounds came before."""
    sizes, stash = [], shared.stash

    def noted(df):
        out = stash(df)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    monkeypatch.setattr(shared, "stash", noted)
    shared.connected(spark.createDataFrame(bent(2000), "a long, b long"))
    assert len(sizes) > 20 and max(sizes) < 10**6


def test_no_silent_local_folder(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        shared.checkpoint_dir(Elsewhere)


def tables(spark):
    at, fs = shared._files(spark, shared.tables_dir(spark))
    return {s.getPath().getName() for s in fs.listStatus(at)}


def test_tables_go_with_their_scratch(spark):
    before = tables(spark)
    with shared.scratch():
        with shared.scratch() as keep:
            shared.stash(spark.range(3))
            kept = keep(shared.stash(spark.range(5)))
        assert len(tables(spark) - before) == 1 and kept.count() == 5
    assert tables(spark) == before


def test_tables_go_when_the_work_fails(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), shared.scratch():
        shared.stash(spark.range(3))
        raise ZeroDivisionError
    assert tables(spark) == before


def test_rounds_leave_one_table(spark):
    before = tables(spark)
    got = shared.connected(spark.createDataFrame(bent(300), "a long, b long"))
    assert len(tables(spark) - before) == 1 and {r.component for r in got.collect()} == {1}


@pytest.mark.parametrize("name", ["kmeans_full", "spatial_groups", "cross_doc_groups_grown"])
def test_a_query_in_a_scratch_leaves_nothing(spark, name):
    from loomfield.plans.queries import QUERIES

    before = tables(spark)
    with shared.scratch():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert tables(spark) == before


def test_sweep_takes_old_tables_of_others(spark):
    root = shared.checkpoint_dir(spark).rstrip("/")
    spark.range(2).write.parquet(f"{root}/stash-other/x")
    assert shared.sweep(spark, 1) == []
    at, fs = shared._files(spark, f"{root}/stash-other")
    fs.setTimes(at, 0, -1)
    own = shared.stash(spark.range(4))
    assert shared.sweep(spark, 1) == ["stash-other"] and own.count() == 4


def test_writers_of_one_session_share_the_setting(spark):
    from concurrent.futures import ThreadPoolExecutor

    before = spark.conf.get(shared.CLEANUP, None)
    with ThreadPoolExecutor(4) as pool:
        assert [d.count() for d in pool.map(lambda n: shared.stash(spark.range(n)), range(1, 9))] == list(range(1, 9))
    assert spark.conf.get(shared.CLEANUP, None) == before
