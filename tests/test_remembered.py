"""Remembered model calls: each text asked once, failures alone and tried again, labels through a provider."""

import json
from pathlib import Path

from loomfield.operators.snapshots import Snapshots
from loomfield.sources import remembered


def counting(folder, answer):
    """A model that notes what it was asked in files, as it runs in other processes."""
    import uuid

    folder = str(folder)

    def call(texts):
        Path(folder).mkdir(exist_ok=True)
        (Path(folder) / uuid.uuid4().hex).write_text(json.dumps(texts))
        return [answer(t) for t in texts]

    return call


def asked(folder):
    return sorted(t for f in Path(folder).glob("*") for t in json.loads(f.read_text())) if Path(folder).exists() else []


def test_each_text_is_asked_once(spark, tmp_path):
    root, log = str(tmp_path / "t"), tmp_path / "log"
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id int, text string")
    call = counting(log, lambda t: f"<{t}>")
    assert remembered.answered(Snapshots(spark, root), items, "m").where("answer IS NOT NULL").count() == 0
    assert remembered.ask(Snapshots(spark, root), items, "m", call) == 1 and asked(log) == ["", "a", "b"]
    assert remembered.ask(Snapshots(spark, root), items, "m", call) is None
    more = items.union(spark.createDataFrame([(6, "c"), (7, "c")], items.schema))
    assert remembered.ask(Snapshots(spark, root), more, "m", call) == 2 and asked(log) == ["", "a", "b", "c"]
    got = {r.id: r.answer for r in remembered.answered(Snapshots(spark, root), more, "m").collect()}
    assert got == {1: "<a>", 2: "<b>", 3: "<a>", 4: None, 5: "<>", 6: "<c>", 7: "<c>"}
    # Another model has answers of its own; reading asks nothing.
    assert remembered.answered(Snapshots(spark, root), more, "other").where("answer IS NOT NULL").count() == 0
    assert len(asked(log)) == 4


def test_failures_fail_alone_and_are_tried_again(spark, tmp_path):
    root = str(tmp_path / "t")
    items = spark.createDataFrame([(f"t{i}",) for i in range(6)] + [("bad",), ("none",)], "text string").coalesce(1)

    def flaky(t):
        if t == "bad":
            raise RuntimeError("refused")
        return None if t == "none" else t.upper()

    for n in (1, 2, 3):
        assert remembered.ask(Snapshots(spark, root), items, "m", lambda ts: [flaky(t) for t in ts], batch=4) == n
        now = Snapshots(spark, root)
        assert remembered.answered(now, items, "m").where("answer IS NOT NULL").count() == 6
        assert {(r.tries, r.error) for r in remembered.failures(now).collect()} == {(n, "RuntimeError: refused"), (n, "no answer")}
    assert remembered.ask(Snapshots(spark, root), items, "m", lambda ts: ts) is None
    assert remembered.ask(Snapshots(spark, root), items, "m", lambda ts: ts, tries=4) == 4
    assert remembered.failures(Snapshots(spark, root)).count() == 0


def test_labels_through_a_provider(spark, tmp_path):
    root, log = str(tmp_path / "t"), tmp_path / "log"
    clusters = spark.createDataFrame([("d", 0, "old", "was", None, 3), ("d", 1, "old", "was", "mine", 2), ("d", 2, "old", "was", None, 0), ("d", 3, "old", "was", None, 1), ("e", 0, "old", "was", None, 1)], "document_id string, cluster_id int, label string, description string, custom_label string, unit_count int")
    chunks = spark.createDataFrame([("d", 0, 1, 0.1, "low"), ("d", 0, 2, 0.9, "high"), ("d", 0, 3, None, "none"), ("d", 1, 4, 0.5, "mine"), ("d", 3, 5, 0.5, "prose"), ("e", 0, 6, 0.5, "x" * 500)], "document_id string, cluster_id int, id int, cti double, text string")
    replies = {"(1) high\n(2) low\n(3) none": '```json\n{"label": "' + "L" * 90 + '"}\n```', "(1) prose": "I can't say.", "(1) " + "x" * 400: '{"label": "", "description": "d"}'}
    call = counting(log, replies.get)
    for _ in range(2):
        got = {(r.document_id, r.cluster_id): (r.label, r.description) for r in remembered.label_clusters(Snapshots(spark, root), clusters, chunks, "m", call).collect()}
        assert got == {("d", 0): ("L" * 80, ""), ("d", 1): ("old", "was"), ("d", 2): ("old", "was"), ("d", 3): ("old", "was"), ("e", 0): ("old", "was")}
    assert asked(log) == sorted(replies)
