"""Versions of several tables, incremental ranking and the feed of shared clusters: restarts, conflicts, replays."""

import random

import pytest
from pyspark.sql import functions as F

from loomfield.operators import maintain, retrieval
from loomfield.operators.snapshots import Conflict, Snapshots

CHUNKS = "document_id string, chunk_index long, content_hash string, cluster_id int, cti double"


def lot(spark, seed, n=40):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "a", "b", "c", f"d{seed}", None]), r.randrange(1000), f"h{r.randrange(60)}", r.choice([0, 1, 2, None]), r.choice([None, r.randrange(100) / 100])) for _ in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def ranking(frame):
    return sorted((str(r.id), round(r.avg_cti, 9), r.max_cti, r.chunk_count, r.cluster_count) for r in frame.collect() if r.id is not None)


def derived(tables):
    chunks = tables.read("chunks").withColumn("id", F.col("chunk_index"))
    documents = chunks.select(F.col("document_id").alias("id")).distinct().withColumns({"filename": F.col("id"), "source_type": F.lit("text"), "user_id": F.lit(None).cast("string")})
    return retrieval.document_ranking(documents, chunks)


def test_ranking_kept_up_equals_the_one_derived_anew(spark, tmp_path):
    root = str(tmp_path / "t")
    for batch in range(4):
        assert maintain.take_in(Snapshots(spark, root, buckets=4), lot(spark, batch), ("s", batch)) == batch + 1
        now = Snapshots(spark, root)
        assert ranking(now.read("documents")) == ranking(derived(now))
    keys = [(r.document_id, r.content_hash) for r in now.read("chunks").collect() if r.document_id]
    assert len(keys) == len(set(keys))


def test_only_buckets_with_new_chunks_are_written(spark, tmp_path):
    root = str(tmp_path / "t")
    maintain.take_in(Snapshots(spark, root), lot(spark, 1))
    before = Snapshots(spark, root).manifest["tables"]["documents"]["parts"]
    maintain.take_in(Snapshots(spark, root), spark.createDataFrame([("a", 5000, "new", 9, 0.5)], CHUNKS))
    after = Snapshots(spark, root).manifest["tables"]["documents"]["parts"]
    assert sum(before[b] != after[b] for b in after) == 1 and set(before) == set(after)


def test_a_writer_that_fails_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    from loomfield.operators import snapshots

    root = str(tmp_path / "t")
    maintain.take_in(Snapshots(spark, root), lot(spark, 1), ("s", 0))
    pinned = Snapshots(spark, root)
    want = ranking(pinned.read("documents")), pinned.read("chunks").count()
    with monkeypatch.context() as m:
        m.setattr(snapshots.Change, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            maintain.take_in(Snapshots(spark, root), lot(spark, 2), ("s", 1))
    again = Snapshots(spark, root)
    assert again.version == 1 and (ranking(again.read("documents")), again.read("chunks").count()) == want
    assert maintain.take_in(again, lot(spark, 2), ("s", 1)) == 2
    # A batch that runs again is known; a reader of the first version still has it.
    assert maintain.take_in(Snapshots(spark, root), lot(spark, 2), ("s", 1)) is None
    assert (ranking(pinned.read("documents")), pinned.read("chunks").count()) == want
    assert Snapshots(spark, root, 1).read("chunks").count() == want[1]
    # What the failed writer left goes; both versions stay.
    assert Snapshots(spark, root).vacuum(keep=2) == 3
    assert Snapshots(spark, root, 1).read("chunks").count() == want[1]
    with pytest.raises(KeyError):
        Snapshots(spark, root, 7)


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    root = str(tmp_path / "t")
    one, two = Snapshots(spark, root).change(), Snapshots(spark, root).change()
    for c, v in ((one, 1), (two, 2)):
        c.append("x", spark.createDataFrame([(v,)], "id int"), "id")
    assert one.commit() == 1
    with pytest.raises(Conflict):
        two.commit()
    assert [r.id for r in Snapshots(spark, root).read("x").collect()] == [1] and Snapshots(spark, root).names("manifests") == ["0000000001.json"]


def state(spark, seed):
    r = random.Random(seed)
    documents = [(f"d{i}", f"f{r.randrange(2)}", r.choice(["u", None]), r.choice([True, False, None])) for i in range(12) if r.random() < 0.9]
    clusters = [(f"d{i}#{k}", f"d{i}", f"l{r.randrange(2)}", r.choice([None, "own"]), r.randrange(3) / 2, [1.0, float(r.randrange(2))]) for i in range(12) for k in range(3) if r.random() < 0.8]
    return spark.createDataFrame(documents, "id string, filename string, user_id string, share_to_global boolean"), spark.createDataFrame(clusters, "id string, document_id string, label string, custom_label string, avg_cti double, centroid array<double>")


def test_feed_applied_equals_the_derivation(spark, tmp_path):
    root = str(tmp_path / "t")
    none = tuple(x.limit(0) for x in state(spark, 0))
    plain = lambda rows: sorted(str(r) for r in rows.select("id", "document_id", "label", "filename", "user_id", "avg_cti", "centroid").collect())
    before = none
    for step in range(4):
        now = state(spark, step)
        feed = maintain.shared_feed(before[0], now[0], before[1], now[1])
        rows = feed.collect()
        was = {r.id: r.share_to_global for r in before[0].collect()}
        flags = {r.id: r.share_to_global for r in now[0].collect()}
        for r in rows:
            turned = bool(was.get(r.document_id)) != bool(flags.get(r.document_id))
            assert r.reason == {("insert", True): "shared", ("insert", False): "added", ("delete", True): "unshared", ("delete", False): "removed"}.get((r.op, turned), "changed")
        assert maintain.apply_to(Snapshots(spark, root, buckets=4), feed, ("feed", step)) == step + 1
        anew = maintain.shared_feed(none[0], now[0], none[1], now[1])
        stored = Snapshots(spark, root).read("shared_clusters")
        assert plain(stored) == plain(anew) and plain(maintain.apply_feed(stored, feed.drop("reason"))) == plain(anew)
        assert maintain.shared_feed(now[0], now[0], now[1], now[1]).count() == 0
        assert maintain.apply_to(Snapshots(spark, root), feed, ("feed", step)) is None
        before = now
