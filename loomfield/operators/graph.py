"""Cluster graph: similar pairs, quality, cross-document groups.

Exact comparison of all centroids with all others: few rows are one block, many
are placed in metric cells and meet only cells that may hold a partner
(`cells`).  No row pair leaves a task unless it is a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from . import cells
from .retrieval import hybrid
from .shared import connected

#: Rows up to which all are compared in one block.
BLOCK_ROWS = 2000


def _small(rows: DataFrame, vector: str) -> DataFrame | None:
    """Usable rows as one block, if they are few."""
    able = cells.unit_rows(rows, vector)
    return able.withColumn("cell", F.lit(0)) if able.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS else None


def _by_length(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length."""
    return [(p["id"].to_numpy(), np.array(p["v"].tolist(), dtype=np.float64)) for _, p in pdf.groupby(pdf["v"].map(len))]


def similar_pairs(rows: DataFrame, vector: str, min_similarity: float) -> DataFrame:
    """(src_id, dst_id, similarity) of all pairs src_id < dst_id at or above the threshold; vectors of one length meet."""
    block = _small(rows, vector)
    if block is None:
        return cells.similar_pairs(rows, vector, min_similarity)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, x in _by_length(pdf):
            near = x @ x.T
            a, b = np.nonzero(near >= min_similarity - 1e-12)
            good = ids[a] < ids[b]
            out.append(pd.DataFrame({"src_id": ids[a[good]], "dst_id": ids[b[good]], "similarity": near[a[good], b[good]]}))
        return pd.concat(out).drop_duplicates(["src_id", "dst_id"])

    kind = dict(rows.dtypes)["id"]
    return block.groupBy("cell").applyInPandas(compare, f"src_id {kind}, dst_id {kind}, similarity double")


def nearest_other(rows: DataFrame, vector: str) -> DataFrame:
    """(id, nearest): similarity to the most similar other row."""
    block = _small(rows, vector)
    if block is None:
        queries = rows.select(F.col("id").alias("query_id"), F.col(vector).alias("q"))
        return cells.search(cells.build(rows, vector), queries, 1, -1.5, but_own=True).select(F.col("query_id").alias("id"), F.col("similarity").alias("nearest"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, x in _by_length(pdf):
            near = x @ x.T
            np.fill_diagonal(near, -np.inf)
            out.append(pd.DataFrame({"id": ids, "nearest": near.max(1)}))
        return pd.concat(out)

    kind = dict(rows.dtypes)["id"]
    return block.groupBy("cell").applyInPandas(compare, f"id {kind}, nearest double").where("nearest > double('-infinity')")


def cluster_edges(clusters: DataFrame, min_similarity: float = 0.55, max_edges: int | None = 500) -> DataFrame:
    """Similar pairs with labels, gaps and hybrid score, the best `max_edges` by hybrid score."""
    pairs = similar_pairs(clusters, "centroid", min_similarity)
    about = lambda s: clusters.select(F.col("id").alias(f"{s}_id"), F.col("document_id").alias(f"{s}_doc"), F.coalesce("custom_label", "label").alias(f"{s}_label"), F.coalesce("avg_fz", F.lit(0.0)).alias(f"{s}_fz"), F.coalesce("avg_fy", F.lit(0.0)).alias(f"{s}_fy"))
    joined = pairs.join(about("src"), "src_id").join(about("dst"), "dst_id")
    joined = joined.withColumn("fz_delta", F.abs(F.col("src_fz") - F.col("dst_fz"))).withColumn("fy_delta", F.abs(F.col("src_fy") - F.col("dst_fy")))
    out = joined.withColumn("hybrid_score", hybrid(F.col("similarity"), F.col("fz_delta"), F.col("fy_delta"), 0.3)).drop("src_fz", "dst_fz", "src_fy", "dst_fy")
    return out.orderBy(F.desc("hybrid_score"), "src_id", "dst_id").limit(max_edges) if max_edges is not None else out


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Both ends in visible(id) documents."""
    keep = lambda e, s: e.join(visible.select(F.col("id").alias(f"{s}_doc")), f"{s}_doc", "left_semi")
    return keep(keep(edges, "src"), "dst")


def cluster_quality(clusters: DataFrame, chunks: DataFrame, noise_threshold: float = 0.5) -> DataFrame:
    """Cohesion, noise ratio, members and separation of clusters that have members."""
    members = chunks.where(F.col("embedding").isNotNull()).select("document_id", "cluster_id", "embedding")
    own = members.join(clusters.where(F.col("centroid").isNotNull()).select("id", "document_id", "cluster_id", "centroid"), ["document_id", "cluster_id"])
    sim = own.withColumn("sim", cosine(F.col("embedding"), F.col("centroid")))
    coh = sim.groupBy("id", "document_id", "cluster_id").agg(F.avg("sim").alias("cohesion"), F.avg(F.when(F.col("sim") < noise_threshold, 1.0).otherwise(0.0)).alias("noise_ratio"), F.count(F.lit(1)).alias("member_count"))
    sep = nearest_other(clusters, "centroid").select("id", (1 - F.col("nearest")).alias("distance"))
    return coh.join(sep, "id", "left").withColumn("separation", F.coalesce("distance", F.lit(1.0))).drop("distance")


def cross_document_groups(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Connected groups over edges between documents, of two clusters and two documents at least."""
    return groups_of(connected(cross_links(edges)), clusters)


def cross_links(edges: DataFrame) -> DataFrame:
    """(a, b) of edges between documents."""
    return edges.where("src_doc <> dst_doc").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))


def groups_of(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups with what the corpus map tells of them, from labels(id, component)."""
    member = labels.join(clusters.select("id", "document_id", "avg_cti", F.coalesce("custom_label", "label").alias("name")), "id")
    groups = member.groupBy(F.col("component").alias("group_id")).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct("document_id").alias("documents"),
        F.avg(F.coalesce("avg_cti", F.lit(0.0))).alias("avg_cti"),
        F.min_by("name", "id").alias("label"),
        F.array_sort(F.collect_set("id")).alias("ids"),
    )
    return groups.where("size >= 2 AND documents >= 2")


def corpus_summary(clusters: DataFrame, quality: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: averages over clusters with quality, and counts."""
    q = clusters.select("id").join(quality, "id", "left").agg(
        F.count(F.lit(1)).alias("cluster_count"),
        F.avg(F.when(F.col("member_count").isNotNull(), F.coalesce("cohesion", F.lit(0.0)))).alias("avg_cohesion"),
        F.avg(F.when(F.col("member_count").isNotNull(), F.coalesce("separation", F.lit(0.0)))).alias("avg_separation"),
        F.avg(F.when(F.col("member_count").isNotNull(), F.coalesce("noise_ratio", F.lit(0.0)))).alias("avg_noise_ratio"),
    )
    return q.crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count"))).crossJoin(groups.agg(F.count(F.lit(1)).alias("group_count")))


def near_points(points: DataFrame, radius: float = 2.0) -> DataFrame:
    """points(document_id, id, x, y, cluster_id) -> pairs a < b of a document within the radius.

    A grid of cells as wide as the radius: a point meets only its own and neighbouring cells.
    """
    cell = points.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = cell.withColumn("o", F.explode(around)).select("document_id", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cluster_id").alias("ca"))
    right = cell.select("document_id", "cx", "cy", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("cluster_id").alias("cb"))
    far = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    met = left.join(right, ["document_id", "cx", "cy"]).where("a < b").withColumn("distance", far).where(F.col("distance") <= radius)
    return met.select("document_id", "a", "b", "distance", F.greatest(F.lit(0.02), 0.12 - F.col("distance") * 0.05).alias("opacity"), (F.col("ca") == F.col("cb")).alias("same_cluster"))
