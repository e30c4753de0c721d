"""Token counts within a row, totals and vocabulary, against counting by hand."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomfield.functions.lexicon import STOP_WORDS
from loomfield.operators import analysis as A
from loomfield.operators.shared import spread

SCHEMA = "document_id string, idx long, text string"


def tokens(text):
    return [w for w in re.split(r"[^a-zæøåäöü0-9'-]+", (text or "").lower()) if len(w) > 2]


def made():
    rng = random.Random(5)
    words = ["Tension", "tension", "the", "field", "x1-2", "don't", "ÅRET", "naïve", "ab", "2024", "7", "çedilla", "with", "claims"]
    rows = [(f"d{rng.randrange(3)}", i, " ,\n".join(rng.choices(words, k=rng.randrange(40)))) for i in range(60)]
    return [*rows, ("d0", 100, None), ("d0", 101, ""), ("d1", 102, "the with a"), (None, 103, "claims claims field")]


def test_token_counts_equal_counting_by_hand(spark):
    rows = made()
    got = {tuple(r) for r in A.token_counts(spark.createDataFrame(rows, SCHEMA)).select("document_id", "idx", "token", "tf", "first_pos", "max_tf").collect()}
    want = set()
    for d, i, text in rows:
        said = tokens(text)
        count = Counter(said)
        want |= {(d, i, w, n, said.index(w), max(count.values())) for w, n in count.items() if w not in STOP_WORDS}
    assert got == want


def test_totals_and_distinct_terms(spark):
    rows = made()
    units = spark.createDataFrame(rows, SCHEMA)
    n, held = Counter(), Counter()
    for _, _, text in rows:
        said = [w for w in tokens(text) if w not in STOP_WORDS]
        n.update(said)
        held.update(set(said))
    assert {tuple(r) for r in A.term_totals(units).collect()} == {(w, n[w], held[w]) for w in n}
    terms = sorted(map(tuple, A.distinct_terms(units).select("idx", "first_pos", "token").collect()))
    assert terms == sorted((i, p, w) for _, i, text in rows for p, w in enumerate(dict.fromkeys(w for w in tokens(text) if w not in STOP_WORDS)))


def test_vocabulary_takes_either_form(spark):
    units = spark.createDataFrame(made(), SCHEMA)
    one, two = (sorted(map(str, A.vocabulary(f(units), units).collect())) for f in (A.distinct_terms, A.token_counts))
    assert one == two and one


def test_counting_shuffles_nothing_and_a_long_text_takes_no_square_time(spark):
    long = spark.range(1).select(F.lit("d").alias("document_id"), F.col("id").alias("idx"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("word"), i % 50_000)), " ").alias("text"))
    counts = A.token_counts(long)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert counts.agg(F.count("token"), F.sum("tf"), F.max("max_tf")).first()[:] == (50_000, 300_000, 6)


def test_empty_units(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not A.term_totals(none).count() and not A.vocabulary(A.distinct_terms(none), none).count() and not A.tfidf(A.token_counts(none), A.vocabulary(A.distinct_terms(none), none)).count()


def test_spread_deals_out_few_partitions_only(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(40).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "many"))
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread(one, "id").collect()) == list(range(100))
    assert spread(many, "id") is many
