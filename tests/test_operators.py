"""Properties of operators on small frames."""

import hashlib
import io
import json
import random
import zipfile
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions import text as text_functions
from loomfield.operators import analysis as A
from loomfield.operators import chunker, graph, layout, retrieval, store
from loomfield.operators.snapshots import Snapshots
from loomfield.plans import field, queries
from loomfield.sources import files, providers


def by_sums(sentences, target=500, most=1200, overlap=2, least=40):
    """(first sentence, text) of each chunk: which run of sentences it is follows from sums of lengths alone."""
    sums = np.concatenate([[0], np.cumsum([len(x) + 1 for x in sentences])])
    first, chunks = 0, []
    while first < len(sentences):
        fits = [e for e in range(first + 1, len(sentences) + 1) if sums[e] - 1 - sums[first] <= most]
        full = [e for e in fits if sums[e] - sums[first] >= target]
        end = full[0] if full else max(fits, default=first + 1)
        chunks.append((first, " ".join(sentences[first:end])))
        first = end if end == len(sentences) else max(first + 1, end - overlap)
    return [c for c in chunks if len(c[1]) >= least]


@pytest.mark.parametrize("overlap", [0, 1, 2, 5])
def test_fold_keeps_its_promises(spark, overlap, monkeypatch):
    monkeypatch.setattr(chunker, "STRETCH", 7)
    rng = np.random.default_rng(1)
    rows = [(i, [chr(97 + k % 26) * int(n) for k, n in enumerate(rng.choice([1, 3, 20, 90, 300, 1500], rng.integers(0, 60)))]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, s array<string>")
    got = {r.id: [(c.place, c.text) for c in r.c] for r in df.select("id", chunker.fold(F.col("s"), F.sequence(F.lit(0), F.size("s")), overlap=overlap).alias("c")).collect()}
    assert got == {i: by_sums(s, overlap=overlap) for i, s in rows}
    assert all(len(text) <= 1200 or " " not in text for c in got.values() for _, text in c)


def test_chunks_need_no_python(spark):
    units = spark.createDataFrame([("d", 0, "a", "One is here. Two is there.")], "document_id string, position long, source string, text string")
    plan = chunker.source_groups(units).groupBy("document_id", "group_no").agg(F.flatten(F.collect_list("sentences")).alias("s")).select(chunker.fold(F.col("s"), F.col("s")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and "Arrow" not in plan._jdf.queryExecution().executedPlan().toString()


def test_chunks_respect_sources_and_index(spark):
    long = "A" * 1999 + "."
    rows = [("d", 0, "a", "First sentence is here for you. Second one follows it now."), ("d", 1, "b", long), ("d", 2, "b", ""), ("d", 3, "b", "More of the b source text in this unit, really."), ("d", 4, "a", "Back at source a with some more words to say."), ("e", 0, None, "tiny"), ("f", 0, None, None)]
    got = chunker.chunk_units(spark.createDataFrame(rows, "document_id string, position long, source string, text string")).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.chunk_index, r.source, r.start_position) for r in got] == [("d", 0, "a", 0), ("d", 1, "b", 1), ("d", 2, "b", 3), ("d", 3, "a", 4)]


def test_chunks_over_many_ranges_equal_a_walk(spark, monkeypatch):
    monkeypatch.setattr(chunker, "RANGE_BITS", 1, raising=False)
    r = random.Random(8)
    rows = [(d, p, r.choice(["a", "b", None]), r.choice([None, "", ("Some words that make up a sentence of this unit. " * r.randint(1, 40)).strip()])) for d in ("d", "e", None) for p in r.sample(range(-20, 60), 40)]
    want, numbers = [], []
    for d in ("d", "e", None):
        groups = []
        for _, p, s, t in sorted((x for x in rows if x[0] == d and x[3]), key=lambda x: x[1]):
            if not groups or groups[-1][0] != s:
                groups.append((s, []))
            groups[-1][1].extend((p, x.strip() + ".") for x in t.split(".") if x.strip())
            numbers.append((d, p, len(groups)))
        chunks = [(s, g[first][0], text) for s, g in groups for first, text in by_sums([x for _, x in g])]
        want += [(d, i, *c) for i, c in enumerate(chunks)]
    units = spark.createDataFrame(rows, "document_id string, position long, source string, text string")
    grouped = chunker.source_groups(units)
    assert sorted(map(str, ((x.document_id, x.position, x.group_no) for x in grouped.collect()))) == sorted(map(str, numbers))
    got = [(x.document_id, x.chunk_index, x.source, x.start_position, x.text) for x in chunker.chunk_units(units).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # No window orders the texts of a whole document.
    wide = [x for x in grouped._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "_range" not in x]
    assert not wide


def test_field_query_chunks_each_text_by_itself(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.field, "build_field", lambda units, *a, **k: seen.append(units) or SimpleNamespace(units=units.selectExpr("document_id", "1 idx", "1 cluster_id", "1 fz", "1 fy", "1 cti", "1 type")))
    texts = spark.createDataFrame([(i, "hot", f"Text number {i} of the hot source has words.") for i in range(12)], "idx long, document_id string, text string")
    queries.field_units(SimpleNamespace(units=texts))
    assert {x["count"] for x in chunker.source_groups(seen[0]).groupBy("document_id", "group_no").count().collect()} == {1}


def test_fingerprints_hold_no_list(spark):
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "d", None]), f"Text {r.randrange(10**6)}") for _ in range(400)] + [("hot", "Text 1"), ("hot", "text  1"), ("empty", None)]
    texts = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "idx long, document_id string, text string")
    made = queries.document_fingerprint(SimpleNamespace(units=texts))
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {d: sha("|".join(sorted(sha(" ".join(t.lower().split())) for e, t in rows if e == d and t is not None))) for d, _ in rows}
    got = [(x.document_id, x.fingerprint) for x in made.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_merge_keeps_the_first(spark):
    a = spark.createDataFrame([("d", 0, " Same  text "), ("d", 1, "ab")], "document_id string, pos long, text string")
    b = spark.createDataFrame([("d", 0, "same TEXT"), ("d", 1, "other")], "document_id string, pos long, text string")
    assert sorted((r["set"], r.text) for r in chunker.merge_units(a, b).collect()) == [(0, "Same text"), (1, "other")]


def test_distinct_units_keep_their_text(spark):
    a = spark.createDataFrame([("d", 0, " Same  text "), ("d", 1, "same TEXT"), ("d", 2, "ab"), ("e", 0, "same text"), ("e", 1, None)], "document_id string, pos long, text string")
    assert sorted((r.document_id, r.pos, r.text) for r in chunker.distinct_units(a).collect()) == [("d", 0, " Same  text "), ("e", 0, "same text")]


def test_keys(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    keys = spark.createDataFrame([(1, "me", sha("k1"), None, None, 5), (2, "me", sha("k2"), 3, 2, 6), (3, "you", sha("k3"), None, None, 7)], "id long, user_id string, key_hash string, revoked_at long, last_used_at long, created_at long")
    assert [r.user_id for r in retrieval.active_keys(keys, "k1").collect()] == ["me"] and retrieval.active_keys(keys, "k2").collect() == []
    assert [r.id for r in retrieval.list_keys(keys, "me").collect()] == [2, 1]
    for key, want in (("k1", {1: 9, 2: 2, 3: None}), ("k2", {1: None, 2: 2, 3: None}), ("none", {1: None, 2: 2, 3: None})):
        assert {r.id: r.last_used_at for r in retrieval.use_key(keys, key, F.lit(9).cast("long")).collect()} == want
    gone = store.revoke_keys(keys, spark.createDataFrame([(1,), (2,), (1,)], "id long"), F.lit(8).cast("long"))
    assert {r.id: r.revoked_at for r in gone.collect()} == {1: 8, 2: 3, 3: None}
    assert keys.select(text_functions.key_hash(F.lit("k1"))).first()[0] == sha("k1")


def test_corpus_map_holds_every_section(spark):
    rows = queries.QUERIES["corpus_map"](spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r.section, []).append(json.loads(r.body))
    assert {"schema_version", "params", "documents", "nodes", "chunks", "summary", "edges"} <= set(by)
    seen = {d["id"] for d in by["documents"]}
    assert len(by["summary"]) == 1 and by["summary"][0]["cluster_count"] == len(by["nodes"]) and by["summary"][0]["edge_count"] == len(by["edges"])
    assert all(n["document_id"] in seen and "cohesion" in n for n in by["nodes"]) and {c["document_id"] for c in by["chunks"]} <= seen
    assert all(e["src_doc"] in seen and e["dst_doc"] in seen and "hybrid_score" in e for e in by["edges"])
    assert all(len(g["ids"]) == g["size"] for g in by.get("cross_doc_clusters", []))


def test_small_documents_are_listed_as_rejected(spark):
    u = spark.createDataFrame([("small", 0, "s", "One sentence that is long enough to be a chunk by itself."), ("none", 0, "s", "")] + [("doc", i, "s", f"Sentence {i} of the document talks about water and stones and rivers. " * 12) for i in range(6)], "document_id string, position long, source string, text string")
    out = field.build_field(u, cap=field.CAPS["pdf"])
    assert {(r.document_id, r.n) for r in out.rejected.collect()} == {("small", 1), ("none", 0)}
    assert {r.document_id for r in out.units.collect()} == {"doc"}


def units(spark, texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document_id string, idx long, text string")


def test_vocabulary_bounds_and_number_ties(spark):
    texts = ["alpha 200 beta", "alpha 100 beta", "alpha 200 beta", "alpha 100 gamma", "delta only here"]
    u = units(spark, texts)
    got = [(r.token, r.df) for r in A.vocabulary(A.token_counts(u), u).orderBy("rank").collect()]
    assert got == [("beta", 3), ("100", 2), ("200", 2)]  # alpha is in 80 % of the units


def test_kmeans_fixed_point_and_zero_vectors(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal((5, 0, 0), 0.3, (12, 3)), rng.normal((0, 5, 0), 0.3, (12, 3))])
    rows = [("d", i, v.tolist()) for i, v in enumerate(data)] + [("d", 99, [0.0, 0.0, 0.0])] + [("e", i, [1.0, float(i), 0.0]) for i in range(4)]
    v = spark.createDataFrame(rows, "document_id string, idx long, vector array<double>")
    out = A.kmeans(v, size=3)
    got = {(r.document_id, r.idx): r.cluster for r in out.collect()}
    assert len(got) == len(rows) and got[("d", 99)] == 0
    assert len({got[("d", i)] for i in range(12)} & {got[("d", i)] for i in range(12, 24)}) == 0
    again = A.assign(v, A.centroids_of(out, A.seeds(v), 3))
    assert {(r.document_id, r.idx): r.cluster for r in again.collect()} == got


def test_kmeans_equals_plain_rounds_and_writes_units_twice(spark, monkeypatch):
    """The clusters of a walk over `assign` and `centroids_of`; units are written at the start and the end, not in each round."""
    rng = np.random.default_rng(4)
    rows = [("hot", i, rng.normal(size=4).tolist()) for i in range(300)] + [("e", i, [float(i % 2), 1.0, 0.0, 0.0]) for i in range(9)] + [("one", 5, [1.0] * 4), ("none", 1, [0.0] * 4), ("none", 1, [0.0] * 4), (None, 3, [1.0] * 4)]
    v = spark.createDataFrame(rows, "document_id string, idx long, vector array<double>").repartition(3)
    units = {(d, i): np.array(x) for d, i, x in rows if d is not None}
    centroids = {}
    for r in A.seeds(v).collect():
        centroids.setdefault(r.document_id, {})[r.cluster] = np.array(r.centroid)
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)), 12)
    was, rounds = dict.fromkeys(units, 0), 0
    while True:
        rounds += 1
        want = {(d, i): max((cos(x, c), -k) for k, c in centroids[d].items())[1] * -1 for (d, i), x in units.items()}
        if want == was:
            break
        was = want
        for d, own in centroids.items():
            for k in own:
                members = [x for u, x in units.items() if u[0] == d and want[u] == k]
                own[k] = np.mean(members, 0) if members else own[k]
    written, stash = [], A.stash
    monkeypatch.setattr(A, "stash", lambda df: written.append(out := stash(df)) or out)
    got = A.kmeans(v, rounds=100, size=4).collect()
    assert len(got) == len(rows) - 1 and {(r.document_id, r.idx): r.cluster for r in got} == want and rounds > 4
    assert all(list(units[r.document_id, r.idx]) == r.vector for r in got)
    assert sum("idx" in df.columns for df in written) == 2


def test_packed_texts_hold_the_same_vectors_and_cut_no_tokens_in_rows(spark, monkeypatch):
    r = random.Random(3)
    words = ["alpha", "Beta's", "gamma", "100", "200", "0300", "Åse", "the", "and", "ab", "x-y-z", "delta", "İota", "öst"]
    rows = [(r.choice(["hot", "hot", "d", "e", None]), i, " ".join(r.choices(words, k=r.randrange(12)))) for i in range(300)] + [("hot", 900, None), ("d", 901, ""), ("one", 902, "alpha alpha"), ("late", 903, "!?")]
    u = spark.createDataFrame(rows, "document_id string, idx long, text string").repartition(3)
    want = {(x.document_id, x.idx): x.vector for x in A.dense(u, A.tfidf(A.token_counts(u), A.vocabulary(A.distinct_terms(u), u))).collect() if x.document_id}
    monkeypatch.setattr(A, "COUNTED", 5)
    monkeypatch.setattr(A, "BLOCK", 7)
    for name in ("token_counts", "distinct_terms", "dense"):
        monkeypatch.setattr(A, name, lambda *a: pytest.fail("tokens of units become rows"))
    got = {(x.document_id, x.idx): x.vector for x in A.clustered(A.text_blocks(u)).collect()}
    assert got == want and any(any(v) for v in got.values())
    out = queries.kmeans_full(SimpleNamespace(units=u)).collect()
    assert {(x.document_id, x.idx) for x in out} == set(want)


def test_projection_equals_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 5)) * (5, 3, 1, 1, 0.5)
    v = spark.createDataFrame([("d", i, r.tolist()) for i, r in enumerate(x)], "document_id string, idx long, vector array<double>").repartition(3)
    got = np.array([[r.x, r.y] for r in A.project(v, 5).orderBy("idx").collect()])
    assert got.min() == -3.5 and got.max() == 3.5
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for k in (0, 1):
        assert abs(np.corrcoef(got[:, k], (x - x.mean(0)) @ axes[k])[0, 1]) == pytest.approx(1)


def test_pairs_in_blocks_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(57, 4))
    frame = spark.createDataFrame([(f"c{i:02}", r.tolist()) for i, r in enumerate(x)] + [("z0", [0.0] * 4), ("z1", None)], "id string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"c{i:02}", f"c{j:02}"): float(u[i] @ u[j]) for i in range(57) for j in range(i + 1, 57) if u[i] @ u[j] >= 0.5}
    for size in (2000, 10):
        monkeypatch.setattr(graph, "BLOCK_ROWS", size)
        got = {(r.src_id, r.dst_id): r.similarity for r in graph.similar_pairs(frame, "v", 0.5).collect()}
        assert got == pytest.approx(want)
        near = {r.id: r.nearest for r in graph.nearest_other(frame, "v").collect()}
        assert near == pytest.approx({f"c{i:02}": max(float(u[i] @ u[j]) for j in range(57) if j != i) for i in range(57)})
    assert graph.nearest_other(frame.limit(1), "v").collect() == []


def test_top_k_edges(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], None, [0.0, 1.0], [1.0, 0.0, 0.0]])]
    c = spark.createDataFrame([(i, v, "d", None) for i, v in rows], "id long, embedding array<double>, document_id string, cti double")
    q = retrieval.query_vector(c, 0)
    assert [r.id for r in retrieval.match_chunks(c, q, 10).collect()] == [0, 1, 4]
    assert retrieval.match_chunks(c, q, 0).collect() == [] and [r.id for r in retrieval.match_chunks(c, q, 1).collect()] == [0]
    assert retrieval.match_chunks(c, retrieval.query_vector(c, 77), 10).collect() == []


def test_many_searches_equal_single_ones(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5))
    x[7] = x[3]  # a tie
    rows = [(i, v.tolist(), f"d{i % 4}", float(i % 7) / 7, None if i % 9 == 0 else 0.5) for i, v in enumerate(x)] + [(90, [0.0] * 5, "d0", 0.1, 0.1), (91, None, "d0", 0.1, 0.1), (92, [1.0, 2.0], "d1", 0.2, 0.3)]
    c = spark.createDataFrame(rows, "id long, centroid array<double>, document_id string, avg_fz double, avg_fy double")
    q = c.where("id % 5 = 0 OR id = 92").selectExpr("id AS query_id", "centroid AS q", "avg_fz AS q_fz", "coalesce(avg_fy, 0D) AS q_fy", "document_id AS q_document")
    size = np.linalg.norm(x, axis=1)
    for sizes in (1000, 7):
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", sizes)
        monkeypatch.setattr(retrieval, "BLOCK_QUERIES", max(2, sizes // 3))
        got = {}
        for r in retrieval.nearest(c, q, "centroid", 4, -0.5).collect():
            got.setdefault(r.query_id, []).append((r.id, r.similarity))
        assert sorted(got) == [*range(0, 60, 5), 92] and [i for i, _ in got[92]] == [92]
        for k in range(0, 60, 5):
            sims = x @ x[k] / size / size[k]
            want = sorted((-round(s, 12), i) for i, s in enumerate(sims) if s >= -0.5)[:4]
            assert [i for _, i in sorted((-round(s, 12), i) for i, s in got[k])] == [i for _, i in want]
            assert sorted(-s for _, s in got[k]) == pytest.approx([s for s, _ in want])
        docs = spark.createDataFrame([(f"d{i}", f"d{i}.txt") for i in range(4)], "id string, filename string")
        mixed = retrieval.nearest(c, q, "centroid", 6, 0.0, weight=0.3, exclude_own=True).collect()
        for k in (5, 10):
            one = q.where(f"query_id = {k}").select("q", "q_fz", "q_fy")
            single = retrieval.match_clusters_hybrid(c.withColumn("description", F.lit("")), docs, one, 6, exclude_document=f"d{k % 4}").collect()
            assert sorted(r.id for r in mixed if r.query_id == k) == sorted(r.id for r in single)
    assert retrieval.nearest(c.limit(0), q, "centroid").collect() == []


def test_hybrid_without_weight_is_similarity(spark):
    c = spark.createDataFrame([(f"a#{i}", "a" if i else "b", [1.0, float(i)], 0.1 * i, 0.5, None) for i in range(5)], "id string, document_id string, centroid array<double>, avg_fz double, avg_fy double, description string")
    d = spark.createDataFrame([("a", "a.txt"), ("b", "b.txt")], "id string, filename string")
    out = retrieval.search_clusters(c, d, "a#1", exclude_own=False, weight=0.0).collect()
    assert all(r.hybrid_score == pytest.approx(r.similarity) and r.description == "" for r in out) and len(out) == 5
    assert [r.id for r in retrieval.search_clusters(c, d, "a#1").collect()] == ["a#0"]


def test_visibility(spark):
    d = spark.createDataFrame([("1", "me"), ("2", "you"), ("3", None)], "id string, user_id string")
    rows = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "document_id string")
    assert sorted(r.document_id for r in retrieval.visible_rows(rows, d, "me").collect()) == ["1", "3"]


def test_store(spark):
    stored = spark.createDataFrame([("x", "u", "h1"), ("y", None, "h2")], "id string, user_id string, content_hash string")
    new = spark.createDataFrame([("n1", "u", "h1"), ("n2", "v", "h1"), ("n3", None, "h2"), ("n4", "u", "h9")], "id string, user_id string, content_hash string")
    assert sorted(r.id for r in store.new_documents(new, stored).collect()) == ["n2", "n4"]
    assert sorted((r.id, r.reused) for r in store.resolve_documents(new, stored).collect()) == [("n2", False), ("n4", False), ("x", True), ("y", True)]
    clusters = spark.createDataFrame([("c1", "old"), ("c2", "old")], "id string, custom_label string")
    labels = spark.createDataFrame([("c1", "a", 1), ("c1", None, 2)], "id string, custom_label string, updated_at long")
    assert {r.id: r.custom_label for r in store.relabel(clusters, labels).collect()} == {"c1": None, "c2": "old"}
    chunk = spark.createDataFrame([("d", "h", 1), ("d", "h", 0), ("e", "h", 0)], "document_id string, content_hash string, chunk_index long")
    assert sorted((r.document_id, r.chunk_index) for r in store.new_chunks(chunk, chunk.where("document_id = 'e'")).collect()) == [("d", 0)]
    assert store.clear_embeddings(chunk).first().embedding is None


def test_blend_moves_matched_sentences_only(spark):
    coords = spark.createDataFrame([("d", 0, 1.0, 1.0), ("d", 1, 2.0, 2.0)], "document_id string, idx long, x double, y double")
    sentences = spark.createDataFrame([("d", 0, "Alpha beta"), ("d", 1, "nothing shared")], "document_id string, idx long, text string")
    groups = spark.createDataFrame([("d", 0, "see alpha beta here", 0.5, 0.5), ("d", 1, "alpha beta again", 1.0, 1.0)], "document_id string, group_order long, text string, nx double, ny double")
    for sure, want in ((1.0, 0.3), (0.1, 1.0)):
        got = {r.idx: (r.x, r.y) for r in layout.blend(coords, sentences, groups, spark.createDataFrame([("d", sure)], "document_id string, confidence double")).collect()}
        assert got[0] == pytest.approx((want, want)) and got[1] == (2.0, 2.0)


def test_field_end_to_end(spark):
    topics = ["the river flows past stones and water", "a market sells fresh bread and fruit", "engines burn fuel and turn wheels"]
    rows = [("doc", i, "s", f"Sentence number one about {topics[i % 3]}. Perhaps it could be said that {topics[i % 3]} is why people come here every day of the week.") for i in range(18)]
    u = spark.createDataFrame(rows, "document_id string, position long, source string, text string")
    bare = field.build_field(u)
    got = bare.units.collect()
    assert len(got) >= 3 and all(r.cti == 0 and 0 <= r.fz <= 1 and 0 <= r.fy <= 1 for r in got)
    judged = field.build_field(u, intentions=lambda c: providers.surrogate_intentions(c, "idx"))
    assert sum(r.unit_count for r in judged.clusters.collect()) == len(got)
    assert judged.stats.first().total_units == len(got) and len(bare.documents.first().content_hash) == 64


def test_providers(spark):
    u = spark.createDataFrame([(i, f"t{i}") for i in range(45)], "idx long, text string").coalesce(1)

    def call(texts):
        if "t25" in texts:
            raise OSError("down")
        return [{"speech_act": "assertive", "certainty": 0.5, "force": 0.1, "tension": 0.2} for _ in texts]

    got = providers.with_intentions(u, call).collect()
    assert sum(r.speech_act is None for r in got) == 20
    assert providers.with_embeddings(u, lambda ts: [[float(len(t))] for t in ts]).first().embedding == [2.0]


def test_files(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "Deep text here")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("node_modules/x.js", "// should never be seen at all")
        z.writestr("src/m.py", "def run(x):\n  pass\n")
        z.writestr("r.md", "One para.\n\nTwo para.")
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": "hello cell"}]}))
    (tmp_path / "t.txt").write_text("P one\n is here\n\n\nP two\n\nx")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    listed, u = files.read_files(spark, str(tmp_path))
    got = sorted((r.source, r.position, r.text) for r in u.collect())
    assert got == [("n.ipynb", 0, "[md] hello cell"), ("r.md", 0, "One para."), ("r.md", 1, "Two para."), ("src/m.py", 0, "def run"), ("t.txt", 0, "P one is here"), ("t.txt", 1, "P two")]
    assert listed.count() == 4
    _, deep = files.read_files(spark, str(tmp_path), recurse_archives=True)
    assert "a.zip/in.zip::deep.txt" in {r.source for r in deep.collect()}


def test_field_export_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([({"totalUnits": 1, "boundaryUnits": 0, "avgFZ": 0.5, "avgFY": 0.5},)], "stats struct<totalUnits:long,boundaryUnits:long,avgFZ:double,avgFY:double>")
    full = frame.withColumns({"units": F.expr("array(named_struct('id','u0','text','t','clusterId',0,'type','heading','fz',0.5D,'fy',0.5D,'cti',0D))"), "clusters": F.expr("array(named_struct('id',0,'label','l','unitCount',1L,'avgFZ',0.5D,'avgFY',0.5D,'description','d'))")})
    files.write_field(full, str(tmp_path / "f"))
    (tmp_path / "f" / "bad.json").write_text('{"units": []}')
    assert files.read_field(spark, str(tmp_path / "f")).count() == 1


def test_streaming_ingest(spark, tmp_path):
    from loomfield.streaming import ingest

    land = str(tmp_path / "in")
    rows = [("d", 0, "Some text to keep here.", 0.5, 0), ("d", 1, "some  text to keep here.", 0.9, 0), ("e", 0, "Other text.", 0.1, 1)]
    make = lambda r: spark.createDataFrame(r, "document_id string, chunk_index long, text string, cti double, cluster_id int").withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    make(rows).coalesce(1).write.parquet(land)
    root = str(tmp_path / "tables")
    run = lambda cp="cp": ingest.ingest(spark, land, root, str(tmp_path / cp)).awaitTermination()
    run()
    first = Snapshots(spark, root)
    assert first.version == 1 and first.read("chunks").count() == 2
    make([("e", 5, "Brand new text.", 0.7, 1), ("e", 6, "Other TEXT.", 0.3, 1)]).coalesce(1).write.mode("append").parquet(land)
    run()
    last = Snapshots(spark, root)
    assert last.version == 2 and last.read("chunks").count() == 3 and first.read("chunks").count() == 2
    assert {r.id: (r.chunk_count, r.avg_cti) for r in last.read("documents").collect()} == {"d": (1, 0.5), "e": (2, pytest.approx(0.4))}
    run("lost")  # a stream that has forgotten where it was takes in nothing twice
    assert Snapshots(spark, root).read("chunks").count() == 3
    assert {m.split()[0] for m in Snapshots(spark, root).manifest["marks"]} == {"ingest"} and str(tmp_path) not in str(Snapshots(spark, root).manifest["marks"])
