"""The stateful stream operator: repeated and late rows, expiry, restarts; against a replay in plain Python."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomfield.streaming import stateful

UNIT = "document_id string, chunk_index long, content_hash string, cti double, arrived timestamp"
NOON = datetime(2024, 5, 1, 12)


@pytest.fixture
def run(spark, tmp_path):
    """Feeds one batch a call, as a stream that stops and starts again from its checkpoint; the rows of all batches so far."""
    before = spark.conf.get(stateful.STORE[0], None)
    spark.conf.set(*stateful.STORE)
    calls = []

    def feed(rows, ttl=timedelta(hours=2)):
        spark.createDataFrame([(d, i, h, c, NOON + timedelta(minutes=m)) for d, i, h, c, m in rows], UNIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        told = stateful.first_seen(spark.readStream.schema(UNIT).parquet(str(tmp_path / "in")), ttl, "10 minutes", shards=2)
        number = len(calls)
        calls.append(rows)

        def keep(batch, n):
            batch.withColumn("batch", F.lit(number * 1000 + n)).write.mode("append").parquet(str(tmp_path / "out"))

        q = told.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        return spark.read.parquet(str(tmp_path / "out"))

    yield feed
    spark.conf.unset(stateful.STORE[0]) if before is None else spark.conf.set(stateful.STORE[0], before)


def fresh(out):
    return sorted((str(r.document_id), r.content_hash, r.chunk_index) for r in out.where("kind = 'chunk'").collect())


def totals(out):
    return {str(r.document_id): (r.chunks, None if r.avg_cti is None else round(r.avg_cti, 9), r.max_cti) for r in stateful.running(out).collect()}


def test_repeats_restart_late_rows_and_expiry(run):
    out = run([("a", 0, "x", 0.5, 0), ("a", 1, "y", None, 1), ("a", 2, "x", 0.9, 2), (None, 0, "x", 0.1, 2), ("b", 5, "z", 0.2, 3), ("b", 6, None, 0.2, 3)])
    assert fresh(out) == [("None", "x", 0), ("a", "x", 0), ("a", "y", 1), ("b", "z", 5)]
    assert totals(out) == {"a": (2, 0.5, 0.5), "None": (1, 0.1, 0.1), "b": (1, 0.2, 0.2)}
    # A restart from the checkpoint: known content stays known, new content adds up.
    out = run([("a", 3, "x", 0.7, 60), ("a", 4, "w", 0.1, 61), ("b", 7, "z", 0.9, 61)])
    assert fresh(out) == [("None", "x", 0), ("a", "w", 4), ("a", "x", 0), ("a", "y", 1), ("b", "z", 5)]
    assert totals(out)["a"] == (3, 0.3, 0.5)
    # Later than the watermark (61 - 10 minutes): dropped; inside it: taken.
    out = run([("a", 8, "late", 1.0, 20), ("a", 9, "in time", 0.3, 55)])
    assert ("a", "late", 8) not in fresh(out) and ("a", "in time", 9) in fresh(out)
    # The watermark passes 2 hours after the first rows: x, y, z end, what came an hour later stays.
    out = run([("c", 0, "q", 0.4, 150)])
    assert totals(out) == {"a": (2, 0.2, 0.3), "c": (1, 0.4, 0.4)}
    # Forgotten content is new again.
    out = run([("a", 10, "x", 0.8, 151)])
    assert fresh(out).count(("a", "x", 10)) == 1 and totals(out)["a"] == (3, 0.4, 0.8)


def test_many_rows_equal_a_replay(run):
    import random

    r = random.Random(5)
    known, sums, out = set(), {}, None
    for lot in range(2):
        rows = [(r.choice(["hot", "hot", "hot", "d"]), i, f"h{r.randrange(150)}", r.choice([None, r.randrange(100) / 100]), lot * 30 + i % 20) for i in range(300)]
        rows.sort(key=lambda x: (x[4], x[1]))
        for d, _, h, c, _ in rows:
            if (d, h) not in known:
                known.add((d, h))
                sums.setdefault(d, []).append(c)
        out = run(rows)
    got = [(str(x.document_id), x.content_hash) for x in out.where("kind = 'chunk'").collect()]
    assert len(got) == len(set(got)) and set(got) == known
    for d, cs in sums.items():
        told = [c for c in cs if c is not None]
        assert totals(out)[d] == (len(cs), round(sum(told) / len(told), 9), max(told))
