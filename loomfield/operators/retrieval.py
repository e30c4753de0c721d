"""Vector search, ranking and visibility.

One search: the query vector is a one-row frame; results are the top rows by a
total order (score, then id), so Spark keeps only the best of each partition.

Many searches (`nearest`): rows and queries are dealt to blocks of bounded size by
hash, each pair of blocks is one product in one task, and only the best rows of
every query leave it.  Exact, so the work is queries times rows; what moves is each
row once a block of queries.

Null vectors, zero vectors and vectors of another length never match.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def query_vector(chunks: DataFrame, chunk_id: int, vector: str = "embedding") -> DataFrame:
    """The vector of one stored chunk as a one-row frame `q`."""
    return chunks.where(F.col("id") == chunk_id).select(F.col(vector).alias("q")).limit(1)


def match_vectors(rows: DataFrame, query: DataFrame, vector: str, count: int = 10, min_similarity: float = 0.0, where=None) -> DataFrame:
    """rows with `similarity`, the nearest `count` of those at or above the least similarity."""
    able = rows.where(F.col(vector).isNotNull())
    able = able.where(where) if where is not None else able
    scored = able.crossJoin(F.broadcast(query)).withColumn("similarity", cosine(F.col(vector), F.col("q"))).drop("q")
    # The best by similarity, then the threshold: the same rows, and the similarity is computed once a row.
    return scored.orderBy(F.desc_nulls_last("similarity"), "id").limit(count).where(F.col("similarity") >= min_similarity)


#: Rows, and queries, of a block.
BLOCK_ROWS, BLOCK_QUERIES = 1000, 1000


def _dealt(rows: DataFrame, vector: str, key: str, block: int) -> tuple[DataFrame, int]:
    """Rows with a usable vector, with their block and the vector's length."""
    able = rows.where(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)
    blocks = max(1, -(-able.count() // block))
    return able.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_length", F.size(vector)), blocks


def nearest(rows: DataFrame, queries: DataFrame, vector: str, count: int = 10, min_similarity: float = 0.0, weight: float | None = None, exclude_own: bool = False) -> DataFrame:
    """The best `count` rows of every query: query_id, id, similarity, and with a `weight` fz_delta, fy_delta and hybrid_score.

    rows(id, `vector`) and queries(query_id, q); with a weight also rows(avg_fz, avg_fy) and queries(q_fz, q_fy), and the
    order is by hybrid score; with exclude_own rows(document_id) and queries(q_document), which must differ.  Scores are
    compared to 12 decimals, ties go to the lesser id.  Rows that repeat an id are rows of their own.
    """
    kinds = dict(rows.dtypes)["id"], dict(queries.dtypes)["query_id"]
    gaps, own = weight is not None, exclude_own
    r, row_blocks = _dealt(rows, vector, "id", BLOCK_ROWS)
    q, query_blocks = _dealt(queries, "q", "query_id", BLOCK_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c)
    r = r.select(F.col("_block").alias("_r"), every(query_blocks).alias("_q"), "_length", "id", F.col(vector).cast("array<double>").alias("v"), *([zero("avg_fz"), zero("avg_fy")] if gaps else []), *(["document_id"] if own else []))
    q = q.select(every(row_blocks).alias("_r"), F.col("_block").alias("_q"), "_length", "query_id", F.col("q").cast("array<double>").alias("v"), *([zero("q_fz"), zero("q_fy")] if gaps else []), *(["q_document"] if own else []))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "id", "similarity", *(["fz_delta", "fy_delta", "hybrid_score"] if gaps else [])]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns})
        left = left.sort_values("id", kind="stable")
        unit = lambda pdf: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.array(pdf["v"].tolist(), np.float64))
        near = unit(right) @ unit(left).T
        score = near
        if gaps:
            dz, dy = (np.abs(right[f"q_{c}"].to_numpy()[:, None] - left[f"avg_{c}"].to_numpy()) for c in ("fz", "fy"))
            score = (1 - weight) * near + weight * (1 - np.minimum(dz + dy, 1.0))
        score = np.round(score, 12)
        score[near < min_similarity] = -np.inf
        if own:
            score[right["q_document"].to_numpy()[:, None] == left["document_id"].to_numpy()] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, :count]
        at = np.repeat(np.arange(len(right)), order.shape[1])
        order = order.reshape(-1)
        good = score[at, order] > -np.inf
        at, order = at[good], order[good]
        out = [right["query_id"].to_numpy()[at], left["id"].to_numpy()[order], near[at, order], *([dz[at, order], dy[at, order], score[at, order]] if gaps else [])]
        return pd.DataFrame(dict(zip(columns, out, strict=True)))

    cell = ["_r", "_q", "_length"]
    schema = f"query_id {kinds[1]}, id {kinds[0]}, similarity double" + (", fz_delta double, fy_delta double, hybrid_score double" if gaps else "")
    found = r.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInPandas(best, schema)
    return _top(found, F.round("hybrid_score" if gaps else "similarity", 12), count)


def _top(found: DataFrame, score: Column, count: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(score.desc(), "id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count).drop("_rank")


def match_chunks(chunks: DataFrame, query: DataFrame, count: int = 10, min_similarity: float = 0.0, min_cti: float = 0.0) -> DataFrame:
    return match_vectors(chunks, query, "embedding", count, min_similarity, F.coalesce("cti", F.lit(0.0)) >= min_cti)


def match_clusters(clusters: DataFrame, query: DataFrame, count: int = 8, min_similarity: float = 0.0, exclude_document: str | None = None) -> DataFrame:
    rule = F.col("document_id") != exclude_document if exclude_document is not None else None
    return match_vectors(clusters, query, "centroid", count, min_similarity, rule)


def hybrid(similarity, fz_gap, fy_gap, weight: float):
    """Similarity and closeness in tension; the clamp is on the sum of both gaps."""
    return (1 - weight) * similarity + weight * (1 - F.least(fz_gap + fy_gap, F.lit(1.0)))


def match_clusters_hybrid(clusters: DataFrame, documents: DataFrame, query: DataFrame, count: int = 10, exclude_document: str | None = None, min_similarity: float = 0.0, weight: float = 0.3) -> DataFrame:
    """query(q, q_fz, q_fy), one row."""
    able = clusters.where(F.col("centroid").isNotNull())
    if exclude_document is not None:
        able = able.where(F.col("document_id") != exclude_document)
    named = able.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")
    gap = lambda side: F.abs(F.coalesce(f"avg_{side}", F.lit(0.0)) - F.col(f"q_{side}"))
    scored = named.crossJoin(F.broadcast(query)).withColumn("similarity", cosine(F.col("centroid"), F.col("q"))).where(F.col("similarity") >= min_similarity)
    scored = scored.withColumn("fz_delta", gap("fz")).withColumn("fy_delta", gap("fy"))
    scored = scored.withColumn("hybrid_score", hybrid(F.col("similarity"), F.col("fz_delta"), F.col("fy_delta"), weight))
    return scored.withColumn("description", F.substring(F.coalesce("description", F.lit("")), 1, 240)).drop("q", "q_fz", "q_fy").orderBy(F.desc("hybrid_score"), "id").limit(count)


def search_clusters(clusters: DataFrame, documents: DataFrame, cluster_id: str, exclude_own: bool = True, **how) -> DataFrame:
    """Clusters like a stored one; its own document is left out unless asked for."""
    source = clusters.where((F.col("id") == cluster_id) & F.col("centroid").isNotNull())
    query = source.select(F.col("centroid").alias("q"), F.coalesce("avg_fz", F.lit(0.0)).alias("q_fz"), F.coalesce("avg_fy", F.lit(0.0)).alias("q_fy"))
    own = cluster_id.rpartition("#")[0] if exclude_own else None
    return match_clusters_hybrid(clusters, documents, query, exclude_document=own, **how)


def search_chunks(chunks: DataFrame, documents: DataFrame, query: DataFrame, count: int = 12, min_similarity: float = 0.3, min_cti: float = 0.0, owner: str | None = None, compat_limit_first: bool = False) -> DataFrame:
    """match_chunks with file names; an owner sees only what is visible to them, and limits count visible rows unless compat_limit_first."""
    seen = chunks
    if owner is not None and not compat_limit_first:
        seen = visible_rows(chunks, documents, owner)
    found = match_chunks(seen, query, count, min_similarity, min_cti)
    if owner is not None and compat_limit_first:
        found = visible_rows(found, documents, owner)
    return found.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")


def visible_documents(documents: DataFrame, owner: str) -> DataFrame:
    """Own and ownerless documents."""
    return documents.where((F.col("user_id") == owner) | F.col("user_id").isNull())


def visible_rows(rows: DataFrame, documents: DataFrame, owner: str) -> DataFrame:
    """Rows whose document is visible."""
    return rows.join(visible_documents(documents, owner).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def owns_document(documents: DataFrame, owner: str, document_id: str) -> DataFrame:
    return documents.where((F.col("id") == document_id) & (F.col("user_id") == owner)).agg((F.count(F.lit(1)) > 0).alias("owns"))


def find_friction(chunks: DataFrame, documents: DataFrame, owner: str, min_cti: float = 0.5, limit: int = 20) -> DataFrame:
    return visible_rows(chunks.where(F.col("cti") >= min_cti), documents, owner).orderBy(F.desc("cti"), "id").limit(limit)


def ranking_parts(chunks: DataFrame) -> DataFrame:
    """(document_id, cluster_id, s, n, m, c): sum, count and largest of cti, and chunks, which add up over chunks that are added."""
    return chunks.groupBy("document_id", "cluster_id").agg(F.sum("cti").alias("s"), F.count("cti").alias("n"), F.max("cti").alias("m"), F.count("id").alias("c"))


def ranking_of(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """All documents with average and largest cti, chunks and clusters, from partial aggregates; without chunks zeros."""
    per = parts.groupBy("document_id").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("a"), F.max("m").alias("m"), F.sum("c").alias("c"), F.count("cluster_id").alias("k"))
    joined = documents.join(per, F.col("id") == F.col("document_id"), "left")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    return joined.select("id", "filename", "source_type", "user_id", zero("a", "double").alias("avg_cti"), zero("m", "double").alias("max_cti"), zero("c", "int").alias("chunk_count"), zero("k", "int").alias("cluster_count"))


def document_ranking(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ranking from all chunks, summed by (document, cluster) first, so the hot document is summed before it moves."""
    return ranking_of(documents, ranking_parts(chunks))


def top_ranking(ranking: DataFrame, limit: int = 50) -> DataFrame:
    return ranking.orderBy(F.desc("avg_cti"), "id").limit(limit)


def latest_by_filename(documents: DataFrame) -> DataFrame:
    """Latest upload of each file name; ties go to the larger id."""
    return documents.groupBy("filename").agg(F.max_by("id", F.struct("uploaded_at", "id")).alias("id"), F.max("uploaded_at").alias("uploaded_at"))


def list_documents(documents: DataFrame, owner: str) -> DataFrame:
    return visible_documents(documents, owner).orderBy(F.desc("uploaded_at"), "id")


def label_samples(clusters: DataFrame, chunks: DataFrame, each: int = 6, chars: int = 400) -> DataFrame:
    """Chunks to label a cluster by: the highest cti of clusters without a label of their own."""
    from pyspark.sql import Window as W

    able = clusters.where((F.coalesce("custom_label", F.lit("")) == "") & (F.col("unit_count") > 0)).select("document_id", "cluster_id")
    best = W.partitionBy("document_id", "cluster_id").orderBy(F.desc_nulls_last("cti"), "id")
    ranked = chunks.join(able, ["document_id", "cluster_id"], "left_semi").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= each)
    return ranked.select("document_id", "cluster_id", "rank", "id", "cti", F.substring("text", 1, chars).alias("sample"))


def friction_by_source(units: DataFrame, limit: int = 10, least_sources: int = 2) -> DataFrame:
    """units(source_path, cti) by path; nothing unless there are `least_sources` paths."""
    per = units.where(F.coalesce("source_path", F.lit("")) != "").groupBy("source_path").agg(F.avg(F.coalesce("cti", F.lit(0.0))).alias("avg_cti"), F.count(F.lit(1)).alias("units"), F.max(F.coalesce("cti", F.lit(0.0))).alias("max_cti"))
    enough = per.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_sources)
    return per.crossJoin(F.broadcast(enough)).drop("_n").orderBy(F.desc("avg_cti"), "source_path").limit(limit)


def export_chunks(chunks: DataFrame, offset: int = 0, page: int | None = None) -> DataFrame:
    """In order of document and chunk; one page, or all."""
    out = chunks.orderBy("document_id", "chunk_index", "id")
    return out.offset(offset).limit(page) if page is not None else out


def active_keys(keys: DataFrame, raw_key: str) -> DataFrame:
    """The user of a key that isn't revoked, by the hash of the key."""
    return keys.where((F.col("key_hash") == F.sha2(F.lit(raw_key), 256)) & F.col("revoked_at").isNull()).select("user_id")


def use_key(keys: DataFrame, raw_key: str, at: Column) -> DataFrame:
    """The table of keys after a call with a key: an active key's `last_used_at` is renewed."""
    used = (F.col("key_hash") == F.sha2(F.lit(raw_key), 256)) & F.col("revoked_at").isNull()
    return keys.withColumn("last_used_at", F.when(used, at).otherwise(F.col("last_used_at")))


def list_keys(keys: DataFrame, owner: str) -> DataFrame:
    return keys.where(F.col("user_id") == owner).orderBy(F.desc("created_at"), "id")
