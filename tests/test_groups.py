"""Labels of groups under links that come and go, against solving all links anew by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomfield.operators import groups
from loomfield.operators.shared import stash


def solve(links):
    to = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            to.setdefault(a, set()).add(b)
            to.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(to):
        if start not in out:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = start
                    todo += to[x]
    return out


def read(labels):
    rows = labels.collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.component for r in rows}


def frame(spark, links):
    return spark.createDataFrame(links, "a long, b long")


@pytest.mark.parametrize("seed", [1, 2])
def test_links_that_come_and_go(spark, seed):
    r = random.Random(seed)
    pair = lambda: (r.randrange(60), r.randrange(60))
    all_links = [pair() for _ in range(12)]
    labels = stash(groups.relabelled(frame(spark, []).toDF("id", "component"), groups.added(frame(spark, []).toDF("id", "component"), frame(spark, all_links))))
    assert read(labels) == solve(all_links)
    for _ in range(2):
        more = [pair() for _ in range(10)] + all_links[:2] + [(None, 3), (5, None), (7, 7)]
        all_links += more
        labels = stash(groups.relabelled(labels, groups.added(labels, frame(spark, more))))
        assert read(labels) == solve(all_links)
        gone = {tuple(x) for x in r.sample([x for x in all_links if None not in x], 8)}
        all_links = [x for x in all_links if x not in gone]
        labels = stash(groups.relabelled(labels, *groups.removed(labels, frame(spark, all_links), frame(spark, list(gone)))))
        assert read(labels) == solve(all_links)


def test_only_what_changes_is_written(spark):
    labels = frame(spark, [(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)]).toDF("id", "component")
    assert read(groups.added(labels, frame(spark, [(6, 9), (1, 2)]))) == {8: 5, 9: 5}
    assert read(groups.added(labels, frame(spark, [(9, 0)]))) == {0: 0, 8: 0, 9: 0}
    assert read(groups.added(labels, frame(spark, []))) == {}
    changed, dropped = groups.removed(labels, frame(spark, [(1, 2), (8, 9)]), frame(spark, [(5, 6)]))
    assert read(changed) == {} and {r.id for r in dropped.collect()} == {5, 6}


def test_ids_of_text_and_a_hot_group(spark):
    links = spark.range(1, 3000).select(F.lit("m0").alias("a"), F.concat(F.lit("m"), "id").alias("b"))
    labels = stash(groups.added(links.limit(0).toDF("id", "component"), links))
    assert labels.where("component = 'm0'").count() == 3000
    changed = groups.added(labels, spark.createDataFrame([("m17", "a"), ("m18", "z")], "a string, b string"))
    assert {(r.component, r["count"]) for r in changed.groupBy("component").count().collect()} == {("a", 3002)}
