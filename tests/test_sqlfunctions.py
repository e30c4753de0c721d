"""SQL table functions against the same searches and reports in Python; defaults, names, nulls, lateral calls."""

import pytest
from pyspark.sql import functions as F

from loomfield.operators import graph, retrieval
from loomfield.plans import sqlfunctions

CHUNK = "id long, document_id string, cluster_id int, cluster_label string, text string, embedding array<double>, fz double, fy double, cti double"


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, "abc"[i % 3], i % 4, f"c{i % 4}", f"t{i}", [float(i % 7), float(i % 5) - 2.0, 1.0], i / 40, 0.5, None if i % 6 == 0 else i / 40) for i in range(40)]
    rows += [(90, "a", 0, "c0", "null", None, 0.1, 0.1, 0.9), (91, "a", 0, "c0", "zero", [0.0, 0.0, 0.0], 0.1, 0.1, 0.9), (92, "b", 1, "c1", "short", [1.0], 0.1, 0.1, 0.9), (93, "b", 1, "c1", "twin", [1.0, -1.0, 1.0], 0.1, 0.1, 0.2)]
    chunks = spark.createDataFrame(rows, CHUNK)
    documents = spark.createDataFrame([("a", "a.txt", "u0"), ("b", "b.txt", None), ("c", "c.txt", "u1"), ("e", "e.txt", "u1")], "id string, filename string, user_id string").withColumn("source_type", F.lit("text"))
    usable = chunks.where("id < 40")
    mean = F.array(*[F.avg(F.get("embedding", F.lit(i))) for i in range(3)])
    clusters = usable.groupBy("document_id", "cluster_id").agg(F.count("id").alias("unit_count"), F.avg("fz").alias("avg_fz"), F.avg("fy").alias("avg_fy"), F.avg("cti").alias("avg_cti"), mean.alias("centroid"))
    clusters = clusters.select(F.concat_ws("#", "document_id", "cluster_id").alias("id"), F.concat(F.lit("c"), "cluster_id").alias("label"), F.lit(None).cast("string").alias("custom_label"), F.lit("d").alias("description"), "*")
    made = sqlfunctions.register(spark, chunks, documents, clusters, clusters, edge_floor=0.2)
    assert len(made) == len(set(made)) == 11
    return chunks, documents, clusters


V = "array(1.0D, -1.0D, 1.0D)"


def query(spark):
    return spark.createDataFrame([([1.0, -1.0, 1.0],)], "q array<double>")


def rows(df, *names):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()]


def test_searches_equal_those_in_python(spark, tables):
    chunks, documents, clusters = tables
    names = ["id", "similarity"]
    # Equal similarities may differ in the last digit: compared as rounded sets.
    got = rows(spark.sql(f"SELECT * FROM match_chunks({V})"), *names)
    assert sorted(got) == sorted(rows(retrieval.match_chunks(chunks, query(spark)), *names)) and len(got) == 10
    got = rows(spark.sql(f"SELECT * FROM match_chunks({V}, min_cti => 0.3, match_count => 50, min_similarity => 0.2)"), *names)
    assert sorted(got) == sorted(rows(retrieval.match_chunks(chunks, query(spark), 50, 0.2, 0.3), *names)) and got
    got = rows(spark.sql(f"SELECT * FROM match_clusters({V}, exclude_document => 'a')"), *names)
    assert sorted(got) == sorted(rows(retrieval.match_clusters(clusters, query(spark), exclude_document="a"), *names)) and got
    q = query(spark).withColumn("q_fz", F.lit(0.4)).withColumn("q_fy", F.lit(0.1))
    names = ["id", "filename", "similarity", "fz_delta", "fy_delta", "hybrid_score"]
    got = rows(spark.sql(f"SELECT * FROM match_clusters_hybrid({V}, 0.4, 0.1, tension_weight => 0.5)"), *names)
    assert got == rows(retrieval.match_clusters_hybrid(clusters, documents, q, weight=0.5), *names) and got
    assert rows(spark.sql(f"SELECT id FROM match_global_clusters({V}, min_cti => 0.5)"), "id")


def test_null_zero_and_short_vectors_match_nothing(spark, tables):
    for v in ("CAST(NULL AS ARRAY<DOUBLE>)", "array(0D, 0D, 0D)", "array(1D, 2D, 3D, 4D)", "CAST(array() AS ARRAY<DOUBLE>)"):
        assert spark.sql(f"SELECT * FROM match_chunks({v})").count() == 0
    found = {r.id for r in spark.sql(f"SELECT id FROM match_chunks({V}, 100, -1)").collect()}
    assert found == {*range(40), 93}
    assert spark.sql("SELECT id FROM match_chunks(from_json('[1, -1, 1]', 'array<double>'), 1)").first().id == 1  # the twins 1 and 93 tie


def test_reports(spark, tables):
    chunks, documents, clusters = tables
    names = ["id", "document_id", "cti"]
    assert rows(spark.sql("SELECT * FROM find_friction('u0', max_rows => 5)"), *names) == rows(retrieval.find_friction(chunks, documents, "u0", limit=5), *names)
    assert spark.sql("SELECT * FROM find_friction(NULL, 0, 1000)").count() == chunks.where("cti >= 0").count()
    names = ["src_id", "dst_id", "similarity", "hybrid_score"]
    assert rows(spark.sql("SELECT * FROM corpus_cluster_edges(0.4, 7)"), *names) == rows(graph.cluster_edges(clusters, 0.4, 7), *names)
    names = ["id", "cohesion", "separation", "noise_ratio", "member_count"]
    assert sorted(rows(spark.sql("SELECT * FROM corpus_cluster_quality(noise_threshold => 0.7)"), *names)) == sorted(rows(graph.cluster_quality(clusters, chunks, 0.7), *names))
    names = ["id", "avg_cti", "max_cti", "chunk_count", "cluster_count"]
    assert rows(spark.sql("SELECT * FROM document_ranking()"), *names) == rows(retrieval.top_ranking(retrieval.document_ranking(documents, chunks)), *names)
    assert {r.id for r in spark.sql("SELECT id FROM visible_documents('u1')").collect()} == {"b", "c", "e"}
    owns = spark.sql("SELECT o.u, user_owns_document(o.u, d.id) AS owns, d.id FROM loomfield_documents d, VALUES ('u0'), ('u1'), ('u9') o(u)")
    assert {(r.u, r.id) for r in owns.where("owns").collect()} == {("u0", "a"), ("u1", "c"), ("u1", "e")}


def test_edges_below_the_floor_fail_and_do_not_come_back_short(spark, tables):
    with pytest.raises(Exception, match="edges below 0.2 are not there"):
        spark.sql("SELECT * FROM corpus_cluster_edges(0.1)").collect()


def test_lateral_calls_answer_each_row(spark, tables):
    chunks, documents, clusters = tables
    asked = chunks.where("id IN (3, 8, 90, 91, 93)").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    asked.unionByName(asked.where("query_id = 3").withColumn("query_id", F.lit(1003).cast("long"))).createOrReplaceTempView("asked")
    got = rows(spark.sql("SELECT query_id, m.id, m.similarity FROM asked, LATERAL match_chunks(q, 4) m"), "query_id", "similarity")
    want = rows(retrieval.nearest(chunks, spark.table("asked"), "embedding", 4), "query_id", "similarity")
    assert sorted(got) == sorted(want) and {q for q, _ in got} == {3, 8, 93, 1003}
    users = spark.sql("SELECT u.o, f.id FROM (VALUES ('u0'), ('u1')) u(o), LATERAL find_friction(u.o, max_rows => 3) f")
    want = [(o, r.id) for o in ("u0", "u1") for r in retrieval.find_friction(chunks, documents, o, limit=3).collect()]
    assert sorted((r.o, r.id) for r in users.collect()) == sorted(want)
    found = spark.sql("SELECT t.x, q.* FROM (VALUES (0.2D), (0.9D)) t(x), LATERAL corpus_cluster_quality(t.x) q")
    assert sorted(rows(found.where("x = 0.9"), "id", "noise_ratio")) == sorted(rows(graph.cluster_quality(clusters, chunks, 0.9), "id", "noise_ratio"))


def test_many_vectors_meet_blocks_and_sort_no_pairs(spark, tables, monkeypatch):
    chunks, documents, clusters = tables
    monkeypatch.setattr(sqlfunctions, "BLOCK_ROWS", 7)
    assert sqlfunctions.register_nearest(spark, chunks.unionByName(chunks.where("id = 5"))) == ["nearest_chunks"]
    asked = chunks.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    asked.unionByName(asked.where("query_id = 3").withColumn("query_id", F.lit(1003).cast("long"))).createOrReplaceTempView("asked")
    for count, least, cti in ((4, 0.0, 0.0), (60, -1.0, 0.0), (5, 0.3, 0.4)):
        found = spark.sql(f"SELECT query_id, m.id, m.similarity FROM asked, LATERAL nearest_chunks(q, {count}, {least}D, {cti}D) m")
        want = retrieval.nearest(chunks.unionByName(chunks.where("id = 5")).where(F.coalesce("cti", F.lit(0.0)) >= cti), spark.table("asked"), "embedding", count, least)
        assert sorted(rows(found, "query_id", "similarity")) == sorted(rows(want, "query_id", "similarity")) and found.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    sqlfunctions.register_nearest(spark, chunks.limit(0))
    assert spark.sql("SELECT query_id, m.* FROM asked, LATERAL nearest_chunks(q) m").count() == 0


def test_scores_of_a_block_are_not_put_into_the_aggregate(spark, tables):
    """Its sort would hold a block once for every vector that asks."""
    chunks, documents, clusters = tables
    sqlfunctions.register_nearest(spark, chunks)
    chunks.selectExpr("id query_id", "embedding q").createOrReplaceTempView("asked")
    plan = spark.sql("SELECT query_id, m.id FROM asked, LATERAL nearest_chunks(q) m")._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.split("\n") if "collect_list" in line]
    assert gathered and not any("held" in line for line in gathered)


def test_a_table_of_vectors_meets_blocks_of_bounded_size(spark, tables, monkeypatch):
    chunks, documents, clusters = tables
    monkeypatch.setattr(sqlfunctions, "ROWS_BYTES", 8 * 3 * 9)
    monkeypatch.setattr(sqlfunctions, "ASKED_BYTES", 8 * 3 * 11)
    chunks = chunks.unionByName(chunks.where("id = 5"))
    asked = chunks.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    asked = asked.unionByName(asked.where("query_id = 3").withColumn("query_id", F.lit(1003).cast("long")))
    assert sqlfunctions.register_asked(spark, chunks, asked) == ["best_chunks"]
    met = spark.table("loomfield_met").groupBy("asks").agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks")).collect()
    assert {r.asks: (r.n, r.blocks) for r in met} == {False: (43 * 4, 20), True: (44 * 5, 20)}
    for count, least, cti in ((4, 0.0, 0.0), (60, -1.0, 0.0), (5, 0.3, 0.4)):
        found = spark.sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS place
            FROM best_chunks(TABLE(SELECT * FROM loomfield_met WHERE asks OR cti >= {cti}D) PARTITION BY (block), {count}, {least}D)) WHERE place <= {count}""")
        want = retrieval.nearest(chunks.where(F.coalesce("cti", F.lit(0.0)) >= cti), asked, "embedding", count, least)
        assert sorted(rows(found, "query_id", "id", "similarity")) == sorted(rows(want, "query_id", "id", "similarity")) and found.count()
    sqlfunctions.register_asked(spark, chunks.limit(0), asked)
    assert spark.sql("SELECT * FROM best_chunks(TABLE(loomfield_met) PARTITION BY (block), 5, 0D)").count() == 0


def test_a_call_reads_only_what_it_needs(spark, tables, tmp_path):
    chunks, documents, clusters = tables
    chunks.write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    sqlfunctions.register(spark, stored, documents, clusters, edge_floor=0.2)
    try:
        plan = spark.sql(f"SELECT id, similarity FROM match_chunks({V}, 5)")._jdf.queryExecution().executedPlan().toString()
    finally:
        sqlfunctions.register(spark, chunks, documents, clusters, clusters, edge_floor=0.2)
    assert "TakeOrderedAndProject(limit=5" in plan and "text" not in plan.split("ReadSchema")[1] and "Exchange" not in plan


def test_empty_tables(spark, tables):
    chunks, documents, clusters = tables
    sqlfunctions.register(spark, chunks.limit(0), documents.limit(0), clusters.limit(0))
    try:
        for call in (f"match_chunks({V})", f"match_clusters({V})", "find_friction('u0')", "corpus_cluster_edges()", "corpus_cluster_quality()", "document_ranking()"):
            assert spark.sql(f"SELECT * FROM {call}").count() == 0
    finally:
        sqlfunctions.register(spark, chunks, documents, clusters, clusters, edge_floor=0.2)
