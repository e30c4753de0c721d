"""Registered queries of the engine, each with the SQL that gives the same rows.

Computed numbers are rounded to six decimals on both sides, as sums over many
rows have no fixed order; ties in every top-k are broken by id.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..functions.vectors import guarded_cosine
from ..operators import analysis as A
from ..operators import cells, chunker, graph, groups, layout, maintain, retrieval, store
from ..operators.shared import checkpoint_dir, stash
from ..operators.snapshots import Snapshots
from ..sources import files, remembered
from . import field, sqlfunctions
from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CHUNKS = """fx_chunks AS (SELECT e.vec_id AS id, d.source AS document_id, d.doc_id AS chunk_index, d.text, d.lang, e.label AS cluster_id, 'cluster ' || e.label AS cluster_label,
  e.embedding::DOUBLE[] AS embedding, (d.doc_id*29 % 101)/1e2 AS fz, (d.doc_id*43 % 101)/1e2 AS fy, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE (d.doc_id*61 % 101)/1e2 END AS cti,
  (d.doc_id*37 % 101)/1e2 AS certainty, (d.doc_id*53 % 101)/1e2 AS force, (d.doc_id*71 % 101)/1e2 AS tension,
  ['assertive', 'directive', 'commissive', 'expressive', 'declarative'][(d.doc_id % 5 + 1)::INT] AS speech_act
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""
_DOCUMENTS = """fx_documents AS (SELECT source AS id, source || '.txt' AS filename, 'text' AS source_type, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 'u0' ELSE 'u1' END AS user_id,
  n % 3 = 0 AS share_to_global, n AS uploaded_at FROM (SELECT DISTINCT source, substr(source, 4)::INT AS n FROM documents))"""
_CLUSTERS = """fx_cent AS (SELECT document_id, cluster_id, list(m ORDER BY i) AS centroid FROM (SELECT document_id, cluster_id, i, avg(x) AS m FROM
  (SELECT document_id, cluster_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM fx_chunks) GROUP BY ALL) GROUP BY ALL),
fx_clusters AS (SELECT document_id || '#' || cluster_id AS id, document_id, cluster_id, 'cluster ' || cluster_id AS label, CASE WHEN cluster_id % 4 = 0 THEN 'custom ' || cluster_id END AS custom_label,
  left(arg_min(text, id), 240) AS description, count(*) AS unit_count, avg(fz) AS avg_fz, avg(fy) AS avg_fy, avg(coalesce(cti, 0)) AS avg_cti, any_value(centroid) AS centroid
  FROM fx_chunks JOIN fx_cent USING (document_id, cluster_id) GROUP BY document_id, cluster_id)"""
_WITH = f"WITH {_CHUNKS}, {_DOCUMENTS}, {_CLUSTERS}"
_EDGES = """edges AS (SELECT a.id AS src_id, b.id AS dst_id, a.document_id AS src_doc, b.document_id AS dst_doc, list_cosine_similarity(a.centroid, b.centroid) AS similarity,
  abs(a.avg_fz - b.avg_fz) AS fz_delta, abs(a.avg_fy - b.avg_fy) AS fy_delta FROM fx_clusters a JOIN fx_clusters b ON a.id < b.id WHERE list_cosine_similarity(a.centroid, b.centroid) >= {least})"""
_QUALITY = """sims AS (SELECT s.id, c.cluster_id, s.document_id, list_cosine_similarity(c.embedding, s.centroid) AS sim FROM fx_clusters s JOIN fx_chunks c ON c.document_id = s.document_id AND c.cluster_id = s.cluster_id),
coh AS (SELECT id, avg(sim) AS cohesion, avg(CASE WHEN sim < 0.15e0 THEN 1e0 ELSE 0e0 END) AS noise_ratio, count(*) AS member_count FROM sims GROUP BY id),
sep AS (SELECT a.id, min(1 - list_cosine_similarity(a.centroid, b.centroid)) AS d FROM fx_clusters a JOIN fx_clusters b ON a.id <> b.id GROUP BY a.id),
quality AS (SELECT id, cohesion, coalesce(d, 1e0) AS separation, noise_ratio, member_count FROM coh LEFT JOIN sep USING (id))"""
_TOKENS = r"""tokens AS (SELECT document_id, idx, pos - 1 AS pos, ws[pos] AS token FROM (SELECT document_id, idx, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT {key} AS document_id, {idx} AS idx,
  list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zæøåäöü0-9\s''-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2) AS ws FROM {rows})))"""
_STOP = "(" + ", ".join(f"'{w}'" for w in sorted(set(X.lexicon.STOP_WORDS))) + ")"
_HEDGE = r"""words AS (SELECT *, greatest(3, len(string_split_regex(text, '\s+')))::DOUBLE AS n, lower(text) AS low FROM {rows}),
dens AS (SELECT *, least(1e0, (len(regexp_extract_all(low, '\b(?:for|that|with)\b')) + contains(low, 'and the')::INT) / n * 3) AS dh,
  least(1e0, len(regexp_extract_all(low, '\b(?:are|was)\b')) / n * 3) AS dc, least(1e0, len(regexp_extract_all(low, '\b(?:from|this)\b')) / n * 3) AS dq FROM words),
hedged AS (SELECT *, floor(dh * 100 + 0.5e0) / 1e2 AS h, floor(dc * 100 + 0.5e0) / 1e2 AS c, floor(dq * 100 + 0.5e0) / 1e2 AS q,
  floor(least(1e0, greatest(0e0, dh * 0.4e0 + dq * 0.45e0 + (1 - dc) * 0.15e0)) * 100 + 0.5e0) / 1e2 AS lex FROM dens)"""
_SCORED = """means AS (SELECT document_id, cluster_id, round(avg(certainty), 9) AS mc, round(avg(force), 9) AS mf, round(avg(tension), 9) AS mt, count(*) AS members FROM fx_chunks GROUP BY ALL),
dev AS (SELECT h.*, CASE WHEN members > 1 THEN least(1e0, sqrt((certainty - mc) * (certainty - mc) + (force - mf) * (force - mf) + (tension - mt) * (tension - mt)) / 1.73e0) ELSE 0e0 END AS deviation,
  CASE speech_act WHEN 'assertive' THEN h * 0.7e0 + q * 0.3e0 WHEN 'directive' THEN h * 0.5e0 + q * 0.5e0 WHEN 'commissive' THEN h * 0.6e0 + q * 0.4e0 WHEN 'expressive' THEN q * 0.6e0 + h * 0.2e0
    WHEN 'declarative' THEN h * 0.8e0 + q * 0.2e0 ELSE 0e0 END AS disc FROM hedged h JOIN means USING (document_id, cluster_id)),
scored AS (SELECT *, floor(least(1e0, greatest(0e0, tension * 0.35e0 + lex * 0.2e0 + disc * 0.25e0 + deviation * 0.2e0)) * 100 + 0.5e0) / 1e2 AS tri,
  floor(least(1e0, sqrt(disc * deviation)) * 100 + 0.5e0) / 1e2 AS cti_score FROM dev)"""
_POINTS = """pts AS (SELECT id, document_id, cluster_id, embedding[1] * 14 AS x, embedding[2] * 14 AS y FROM fx_chunks)"""
_ITEMS = """items AS (SELECT p_partkey % 40 AS page_index, p_partkey AS item_id, p_name AS text, (p_partkey*37 % 612)::DOUBLE AS x, (p_partkey*91 % 792)::DOUBLE AS y, p_size::DOUBLE AS width, 12e0 AS height FROM part),
near AS (SELECT a.item_id AS a, b.item_id AS b FROM items a JOIN items b ON a.page_index = b.page_index AND a.item_id < b.item_id
  WHERE sqrt((a.x + a.width/2 - b.x - b.width/2)^2 + (a.y - b.y)^2) < 0.04e0 * sqrt(612e0*612e0 + 792e0*792e0)),
both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
walk(a, b) AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT w.a, e.b FROM walk w JOIN both_ways e ON w.b = e.a),
comp AS (SELECT a AS item_id, min(b) AS g FROM walk GROUP BY a),
groups AS (SELECT page_index, coalesce(g, item_id) AS group_id, count(*) AS n_items, string_agg(text, ' ' ORDER BY y, x, item_id) AS text, avg(x + width/2) AS cx, avg(y + height/2) AS cy,
  min(x) AS min_x, min(y) AS min_y, max(x + width) AS max_x, max(y + height) AS max_y FROM items LEFT JOIN comp USING (item_id) GROUP BY ALL HAVING length(string_agg(text, ' ')) >= 3)"""
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_ASKING = "asking AS (SELECT id AS query_id, embedding AS v FROM fx_chunks WHERE id % 20 = 0)"


def _sim(rows: str, vector: str, where: str, least: str, limit: int, columns: str = "id", more: str = "") -> str:
    """Every query against all rows: the best `limit` of each."""
    return f"""{_WITH}{more}, {_ASKING}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM
(SELECT r.*, query_id, list_cosine_similarity({vector}, v) AS s FROM {rows} r, asking WHERE {where}) WHERE s >= {least}) WHERE rank <= {limit})
SELECT query_id, {columns}, round(s, 6) AS similarity FROM best"""


# --- search: queries are all rows with an id divisible by 20, against all rows ------------


@query(_sim("fx_chunks", "embedding", "true", "0e0", 10))
def match_chunks(t: Tables) -> DataFrame:
    return _six(retrieval.nearest(t.chunks, t.asking, "embedding"), "similarity")


@query(_sim("fx_chunks", "embedding", "true", "0e0", 10))
def match_chunks_index(t: Tables) -> DataFrame:
    """match_chunks through the index: exact, cells that can't hold a better row are not looked into."""
    return _six(cells.search(cells.build(t.chunks, "embedding"), t.asking), "similarity")


@query()
def match_chunks_probed(t: Tables) -> DataFrame:
    """match_chunks through the index: approximate, the nearest cells only, as many as a sample of the queries needs."""
    index = cells.build(t.chunks, "embedding")
    return _six(cells.search(index, t.asking, probes=cells.calibrate(index, t.asking)), "similarity")


@query()
def index_recall(t: Tables) -> DataFrame:
    """One row: cells looked into of all, queries, true results, those that the approximate search finds too, and the share."""
    index = cells.build(t.chunks, "embedding")
    true = retrieval.nearest(t.chunks, t.asking, "embedding")
    probes = cells.calibrate(index, t.asking)
    found = cells.search(index, t.asking, probes=probes).select("query_id", "id", F.lit(1).alias("hit"))
    both = true.join(found, ["query_id", "id"], "left")
    return both.agg(F.lit(probes).alias("probes"), F.lit(len(index.size)).alias("cells"), F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("results"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


@query()
def join_pruning(t: Tables) -> DataFrame:
    """Pairs of chunks that an exact join at a similarity of 0.4 compares, and those that it needn't."""
    return cells.join_work(t.chunks, "embedding", 0.4)


@query(f"""{_WITH} SELECT a.id AS src_id, b.id AS dst_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity
FROM fx_chunks a JOIN fx_chunks b ON a.id < b.id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.4e0""")
def similar_chunks(t: Tables) -> DataFrame:
    """All pairs of chunks at a similarity of 0.4 or more, over metric cells."""
    return _six(cells.similar_pairs(t.chunks, "embedding", 0.4), "similarity")


@query(_sim("fx_chunks", "embedding", "coalesce(cti, 0) >= 0.5e0", "0.1e0", 25))
def match_chunks_cti_floor(t: Tables) -> DataFrame:
    return _six(retrieval.nearest(t.chunks.where(F.coalesce("cti", F.lit(0.0)) >= 0.5), t.asking, "embedding", 25, 0.1), "similarity")


@query(_sim("fx_clusters", "centroid", "true", "0e0", 8))
def match_clusters(t: Tables) -> DataFrame:
    return _six(retrieval.nearest(t.clusters, t.asking, "centroid", 8), "similarity")


def _hybrid_sql(exclude: str) -> str:
    return f"""{_WITH}, asking AS (SELECT id AS query_id, document_id AS q_document, centroid AS v, avg_fz AS qz, avg_fy AS qy FROM fx_clusters WHERE (substr(document_id, 4)::INT * 10 + cluster_id) % 20 = 0),
met AS (SELECT query_id, c.id, d.filename, c.description, list_cosine_similarity(centroid, v) AS s, abs(avg_fz - qz) AS dz, abs(avg_fy - qy) AS dy FROM fx_clusters c JOIN fx_documents d ON d.id = c.document_id, asking WHERE {exclude}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7e0 * s + 0.3e0 * (1 - least(dz + dy, 1e0)), 12) DESC, id) AS rank FROM met WHERE s >= 0e0)
SELECT query_id, id, filename, round(s, 6) AS similarity, round(dz, 6) AS fz_delta, round(dy, 6) AS fy_delta, round(0.7e0 * s + 0.3e0 * (1 - least(dz + dy, 1e0)), 6) AS hybrid_score, description FROM best WHERE rank <= 10"""


def _hybrid(t: Tables, own: bool) -> DataFrame:
    found = retrieval.nearest(t.clusters, t.asking_clusters, "centroid", 10, 0.0, weight=0.3, exclude_own=own)
    named = t.clusters.join(t.documents.select(F.col("id").alias("document_id"), "filename"), "document_id").select("id", "filename", "description")
    return _six(found.join(named, "id").select("query_id", "id", "filename", "similarity", "fz_delta", "fy_delta", "hybrid_score", "description"), "similarity", "fz_delta", "fy_delta", "hybrid_score")


@query(_hybrid_sql("true"))
def match_clusters_hybrid(t: Tables) -> DataFrame:
    return _hybrid(t, False)


@query(_hybrid_sql("c.document_id <> q_document"))
def match_clusters_hybrid_excl(t: Tables) -> DataFrame:
    return _hybrid(t, True)


_SHARED_ROWS = f"""{_QUALITY}, shared AS (SELECT c.id, c.document_id, coalesce(custom_label, label) AS label, c.avg_cti, c.centroid, cohesion, separation, noise_ratio
FROM fx_clusters c JOIN fx_documents d ON d.id = c.document_id AND d.share_to_global LEFT JOIN quality q ON q.id = c.id)"""
_SHARED = f"{_WITH}, {_SHARED_ROWS}"


def _shared(t: Tables) -> DataFrame:
    return store.shared_clusters(t.clusters, t.documents, graph.cluster_quality(t.clusters, t.chunks, 0.15))


@query(_SHARED + " SELECT id, document_id, label, round(avg_cti, 6) AS avg_cti, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation, round(noise_ratio, 6) AS noise_ratio FROM shared")
def shared_clusters(t: Tables) -> DataFrame:
    return _six(_shared(t).select("id", "document_id", "label", "avg_cti", "cohesion", "separation", "noise_ratio"), "avg_cti", "cohesion", "separation", "noise_ratio")


@query(_sim("shared", "centroid", "avg_cti >= 0.2e0", "0e0", 10, "id, label, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation", f", {_SHARED_ROWS}"))
def match_global_clusters(t: Tables) -> DataFrame:
    able = stash(_shared(t).where(F.coalesce("avg_cti", F.lit(0.0)) >= 0.2))
    found = retrieval.nearest(able, t.asking, "centroid").join(able.select("id", "label", "cohesion", "separation"), "id")
    return _six(found.select("query_id", "id", "label", "similarity", "cohesion", "separation"), "similarity", "cohesion", "separation")


@query(_sim("(SELECT c.*, filename FROM fx_chunks c LEFT JOIN fx_documents d ON d.id = c.document_id)", "embedding", "true", "0.1e0", 12, "id, document_id, filename"))
def search_chunks_enriched(t: Tables) -> DataFrame:
    found = retrieval.nearest(t.chunks, t.asking, "embedding", 12, 0.1).join(t.chunks.select("id", "document_id"), "id")
    named = found.join(t.documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    return _six(named.select("query_id", "id", "document_id", "filename", "similarity"), "similarity")


@query(_sim("fx_chunks", "embedding", "document_id IN (SELECT id FROM fx_documents WHERE user_id = 'u0' OR user_id IS NULL)", "0e0", 10, "id, document_id"))
def search_chunks_owner(t: Tables) -> DataFrame:
    seen = retrieval.visible_rows(t.chunks, t.documents, "u0")
    found = retrieval.nearest(seen, t.asking, "embedding").join(t.chunks.select("id", "document_id"), "id")
    return _six(found.select("query_id", "id", "document_id", "similarity"), "similarity")


# --- graph and quality --------------------------------------------------------


@query(f"""{_WITH}, {_EDGES.format(least='0.2e0')} SELECT src_id, dst_id, src_doc, dst_doc, round(similarity, 6) AS similarity, round(fz_delta, 6) AS fz_delta, round(fy_delta, 6) AS fy_delta,
round(0.7e0 * similarity + 0.3e0 * (1 - least(fz_delta + fy_delta, 1e0)), 6) AS hybrid_score FROM edges ORDER BY 0.7e0 * similarity + 0.3e0 * (1 - least(fz_delta + fy_delta, 1e0)) DESC, src_id, dst_id LIMIT 500""")
def corpus_cluster_edges(t: Tables) -> DataFrame:
    out = graph.cluster_edges(t.clusters, 0.2, 500)
    return _six(out.select("src_id", "dst_id", "src_doc", "dst_doc", "similarity", "fz_delta", "fy_delta", "hybrid_score"), "similarity", "fz_delta", "fy_delta", "hybrid_score")


@query(f"""{_WITH}, {_EDGES.format(least='0.2e0')}, v AS (SELECT id FROM fx_documents WHERE user_id = 'u1' OR user_id IS NULL)
SELECT src_id, dst_id, round(similarity, 6) AS similarity FROM edges WHERE src_doc IN (FROM v) AND dst_doc IN (FROM v)""")
def visible_edges(t: Tables) -> DataFrame:
    edges = graph.cluster_edges(t.clusters, 0.2, None)
    return _six(graph.visible_edges(edges, retrieval.visible_documents(t.documents, "u1")).select("src_id", "dst_id", "similarity"), "similarity")


@query(f"{_WITH}, {_QUALITY} SELECT id, round(cohesion, 6) AS cohesion, round(noise_ratio, 6) AS noise_ratio, member_count FROM quality")
def cluster_quality(t: Tables) -> DataFrame:
    return _six(graph.cluster_quality(t.clusters, t.chunks, 0.15).select("id", "cohesion", "noise_ratio", "member_count"), "cohesion", "noise_ratio")


@query(f"{_WITH}, {_QUALITY} SELECT id, round(d, 6) AS separation FROM sep")
def cluster_separation(t: Tables) -> DataFrame:
    return graph.nearest_other(t.clusters, "centroid").select("id", F.round(1 - F.col("nearest"), 6).alias("separation"))


_GROUPS = """cross_edges AS (SELECT src_id AS a, dst_id AS b FROM edges WHERE src_doc <> dst_doc), both_ways AS (SELECT a, b FROM cross_edges UNION ALL SELECT b, a FROM cross_edges),
walk(a, b) AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT w.a, e.b FROM walk w JOIN both_ways e ON w.b = e.a), comp AS (SELECT a AS id, min(b) AS g FROM walk GROUP BY a),
groups AS (SELECT g AS group_id, count(*) AS size, count(DISTINCT document_id) AS documents, avg(avg_cti) AS avg_cti, arg_min(coalesce(custom_label, label), id) AS label, string_agg(id, ',' ORDER BY id) AS ids
FROM comp JOIN fx_clusters USING (id) GROUP BY g HAVING count(*) >= 2 AND count(DISTINCT document_id) >= 2)"""


@query(f"{_WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_EDGES.format(least='0.3e0')}, {_GROUPS} SELECT group_id, size, documents, round(avg_cti, 6) AS avg_cti, label, ids FROM groups")
def cross_doc_groups(t: Tables) -> DataFrame:
    out = graph.cross_document_groups(graph.cluster_edges(t.clusters, 0.3, None), t.clusters)
    return _six(out.withColumn("ids", F.array_join("ids", ",")), "avg_cti")


_GROUPED = f"{_WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_EDGES.format(least='0.3e0')}, {_GROUPS} SELECT group_id, size, documents, round(avg_cti, 6) AS avg_cti, label, ids FROM groups"


@query(_GROUPED)
def cross_doc_groups_grown(t: Tables) -> DataFrame:
    """cross_doc_groups, kept up: the edges come in three lots, then a fifth of them goes and comes back."""
    edges = stash(graph.cluster_edges(t.clusters, 0.3, None))
    links = graph.cross_links(edges).withColumn("lot", F.pmod(F.xxhash64("a", "b"), F.lit(15)))
    labels = links.where("lot < 0").select(F.col("a").alias("id"), F.col("b").alias("component"))
    for lot in (links.where("lot % 3 = 0"), links.where("lot % 3 = 1"), links.where("lot % 3 = 2")):
        labels = stash(groups.relabelled(labels, groups.added(labels, lot)))
    labels = stash(groups.relabelled(labels, *groups.removed(labels, links.where("lot % 5 <> 0"), links.where("lot % 5 = 0"))))
    labels = groups.relabelled(labels, groups.added(labels, links.where("lot % 5 = 0")))
    out = graph.groups_of(labels, t.clusters)
    return _six(out.withColumn("ids", F.array_join("ids", ",")), "avg_cti")


@query(f"""{_WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_EDGES.format(least='0.3e0')}, {_GROUPS}, {_QUALITY}
SELECT (SELECT count(*) FROM fx_clusters) AS cluster_count, round(avg(cohesion), 6) AS avg_cohesion, round(avg(separation), 6) AS avg_separation, round(avg(noise_ratio), 6) AS avg_noise_ratio,
(SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM groups) AS group_count FROM quality""")
def corpus_summary(t: Tables) -> DataFrame:
    edges = graph.cluster_edges(t.clusters, 0.3, None)
    out = graph.corpus_summary(t.clusters, graph.cluster_quality(t.clusters, t.chunks, 0.15), edges, graph.cross_document_groups(edges, t.clusters))
    return _six(out, "avg_cohesion", "avg_separation", "avg_noise_ratio")


@query(f"{_WITH}, {_QUALITY} SELECT c.id, c.unit_count, coalesce(custom_label, label) AS label, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation FROM fx_clusters c LEFT JOIN quality USING (id)")
def corpus_nodes(t: Tables) -> DataFrame:
    nodes = t.clusters.select("id", "unit_count", F.coalesce("custom_label", "label").alias("label"))
    q = graph.cluster_quality(t.clusters, t.chunks, 0.15).select("id", "cohesion", "separation")
    return _six(nodes.join(q, "id", "left"), "cohesion", "separation")


@query(f"""WITH {_CHUNKS}, {_POINTS} SELECT a.document_id, a.id AS a, b.id AS b, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 6) AS distance,
round(greatest(0.02e0, 0.12e0 - sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) * 0.05e0), 6) AS opacity, a.cluster_id = b.cluster_id AS same_cluster
FROM pts a JOIN pts b ON a.document_id = b.document_id AND a.id < b.id WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 2""")
def proximity_links(t: Tables) -> DataFrame:
    return _six(graph.near_points(t.points), "distance", "opacity")


# --- the same searches and reports, called from SQL ------------------------------------


def _sql(t: Tables, text: str) -> DataFrame:
    """A statement over the table functions; `asking` and `asking_clusters` are the rows that search."""
    sqlfunctions.register(t.spark, t.chunks, t.documents, t.clusters, edge_floor=0.3)
    t.asking.createOrReplaceTempView("asking")
    t.asking_clusters.createOrReplaceTempView("asking_clusters")
    return t.spark.sql(text)


@query(_sim("fx_chunks", "embedding", "coalesce(cti, 0) >= 0.5e0", "0.1e0", 25))
def sql_match_chunks(t: Tables) -> DataFrame:
    sqlfunctions.register_asked(t.spark, t.chunks, t.asking)
    return _six(t.spark.sql("""SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS place
        FROM best_chunks(TABLE(SELECT * FROM loomfield_met WHERE asks OR cti >= 0.5) PARTITION BY (block), 25, 0.1D)) WHERE place <= 25"""), "similarity")


@query(_hybrid_sql("c.document_id <> q_document"))
def sql_match_clusters_hybrid(t: Tables) -> DataFrame:
    found = _sql(t, "SELECT query_id, id, filename, similarity, fz_delta, fy_delta, hybrid_score, description FROM asking_clusters, LATERAL match_clusters_hybrid(q, q_fz, q_fy, exclude_document => q_document)")
    return _six(found, "similarity", "fz_delta", "fy_delta", "hybrid_score")


@query(f"{_WITH}, {_QUALITY} SELECT id, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation, round(noise_ratio, 6) AS noise_ratio, member_count FROM quality")
def sql_cluster_quality(t: Tables) -> DataFrame:
    return _six(_sql(t, "SELECT id, cohesion, separation, noise_ratio, member_count FROM corpus_cluster_quality(0.15)"), "cohesion", "separation", "noise_ratio")


@query(f"""WITH {_CHUNKS}, {_DOCUMENTS} SELECT owner, c.id, c.cti FROM (VALUES ('u0'), ('u1')) o(owner), LATERAL (SELECT c.id, c.cti FROM fx_chunks c JOIN fx_documents d ON d.id = c.document_id
WHERE cti >= 0.5e0 AND (user_id IS NULL OR user_id = owner) ORDER BY cti DESC, c.id LIMIT 20) c""")
def sql_find_friction(t: Tables) -> DataFrame:
    return _sql(t, "SELECT owner, id, cti FROM VALUES ('u0'), ('u1') o(owner), LATERAL find_friction(owner)")


# --- ranking, friction, visibility -----------------------------------------------

_RANKING = f"""{_WITH}, ranking AS (SELECT d.id, d.filename, coalesce(avg(c.cti), 0) AS avg_cti, coalesce(max(c.cti), 0) AS max_cti, count(c.id)::INT AS chunk_count, count(DISTINCT c.cluster_id)::INT AS cluster_count
FROM fx_documents d LEFT JOIN fx_chunks c ON c.document_id = d.id GROUP BY d.id, d.filename)"""


@query(_RANKING + " SELECT id, filename, round(avg_cti, 6) AS avg_cti, max_cti, chunk_count, cluster_count FROM ranking")
def document_ranking(t: Tables) -> DataFrame:
    return _six(retrieval.document_ranking(t.documents, t.chunks).select("id", "filename", "avg_cti", "max_cti", "chunk_count", "cluster_count"), "avg_cti")


@query(_RANKING + " SELECT id, filename, round(avg_cti, 6) AS avg_cti, max_cti, chunk_count, cluster_count FROM ranking")
def ranking_kept_up(t: Tables) -> DataFrame:
    """document_ranking from partial aggregates of three lots of chunks, added one after another."""
    parts = None
    for lot in range(3):
        parts = maintain.add_parts(parts, retrieval.ranking_parts(t.chunks.where(F.col("id") % 3 == lot)))
    return _six(retrieval.ranking_of(t.documents, parts).select("id", "filename", "avg_cti", "max_cti", "chunk_count", "cluster_count"), "avg_cti")


_TURNED = """now_documents AS (SELECT id, filename, user_id, CASE WHEN n % 6 = 0 THEN false WHEN n % 6 = 1 THEN true ELSE share_to_global END AS share_to_global FROM (SELECT *, uploaded_at AS n FROM fx_documents)),
now_clusters AS (SELECT id, document_id, CASE WHEN cluster_id % 5 = 0 THEN 'renamed' ELSE coalesce(custom_label, label) END AS label, avg_cti FROM fx_clusters WHERE cluster_id <> 7),
was AS (SELECT c.id, c.document_id, coalesce(custom_label, label) AS label, filename, avg_cti FROM fx_clusters c JOIN fx_documents d ON d.id = c.document_id AND d.share_to_global),
is_now AS (SELECT c.id, c.document_id, label, filename, avg_cti FROM now_clusters c JOIN now_documents d ON d.id = c.document_id AND d.share_to_global)"""


def _turned(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents and clusters after flags turned, labels were given and clusters went."""
    n = F.col("uploaded_at") % 6
    documents = t.documents.withColumn("share_to_global", F.when(n == 0, False).when(n == 1, True).otherwise(F.col("share_to_global")))
    clusters = t.clusters.where("cluster_id <> 7").withColumn("custom_label", F.when(F.col("cluster_id") % 5 == 0, "renamed").otherwise(F.col("custom_label")))
    return documents, clusters


@query(f"""{_WITH}, {_TURNED}
SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS op,
CASE WHEN a.id IS NULL THEN 'shared' WHEN b.id IS NULL THEN CASE WHEN d.share_to_global THEN 'removed' ELSE 'unshared' END ELSE 'changed' END AS reason, coalesce(b.label, a.label) AS label
FROM was a FULL JOIN is_now b ON a.id = b.id JOIN now_documents d ON d.id = coalesce(a.document_id, b.document_id) WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label""")
def shared_feed(t: Tables) -> DataFrame:
    documents, clusters = _turned(t)
    return maintain.shared_feed(t.documents, documents, t.clusters, clusters).select("id", "op", "reason", "label")


@query(f"{_WITH}, {_TURNED} SELECT id, document_id, label, filename, round(avg_cti, 6) AS avg_cti FROM is_now")
def shared_after_feed(t: Tables) -> DataFrame:
    """The stored shared table after its feed: what deriving it anew gives."""
    documents, clusters = _turned(t)
    feed = maintain.shared_feed(t.documents, documents, t.clusters, clusters).drop("reason")
    stored = maintain.shared_feed(t.documents.limit(0), t.documents, t.clusters.limit(0), t.clusters).drop("op", "reason")
    return _six(maintain.apply_feed(stored, feed).select("id", "document_id", "label", "filename", "avg_cti"), "avg_cti")


@query(_RANKING + " SELECT id, round(avg_cti, 6) AS avg_cti FROM ranking ORDER BY round(avg_cti, 9) DESC, id LIMIT 8")
def ranking_top(t: Tables) -> DataFrame:
    ranking = retrieval.document_ranking(t.documents, t.chunks).withColumn("avg_cti", F.round("avg_cti", 9))
    return _six(retrieval.top_ranking(ranking, 8).select("id", "avg_cti"), "avg_cti")


@query(f"WITH {_DOCUMENTS} SELECT id, filename, user_id FROM fx_documents WHERE user_id = 'u1' OR user_id IS NULL")
def visible_documents(t: Tables) -> DataFrame:
    return retrieval.visible_documents(t.documents, "u1").select("id", "filename", "user_id")


@query(f"WITH {_DOCUMENTS} SELECT id, uploaded_at FROM fx_documents WHERE user_id = 'u0' OR user_id IS NULL")
def list_documents(t: Tables) -> DataFrame:
    return retrieval.list_documents(t.documents, "u0").select("id", "uploaded_at")


@query(f"WITH {_CHUNKS}, {_DOCUMENTS} SELECT id, document_id FROM fx_chunks WHERE document_id IN (SELECT id FROM fx_documents WHERE user_id = 'u0' OR user_id IS NULL)")
def visible_chunks_semi(t: Tables) -> DataFrame:
    return retrieval.visible_rows(t.chunks, t.documents, "u0").select("id", "document_id")


@query(f"WITH {_DOCUMENTS} SELECT count(*) > 0 AS owns FROM fx_documents WHERE id = 'src2' AND user_id = 'u0'")
def user_owns_document(t: Tables) -> DataFrame:
    return retrieval.owns_document(t.documents, "u0", "src2")


@query(f"""WITH {_CHUNKS}, {_DOCUMENTS} SELECT id, document_id, cti FROM fx_chunks WHERE cti >= 0.5e0 AND document_id IN (SELECT id FROM fx_documents WHERE user_id = 'u1' OR user_id IS NULL) ORDER BY cti DESC, id LIMIT 20""")
def find_friction(t: Tables) -> DataFrame:
    return retrieval.find_friction(t.chunks, t.documents, "u1").select("id", "document_id", "cti")


@query(f"""{_WITH} SELECT document_id, cluster_id, rank, id, cti, sample FROM (SELECT c.document_id, c.cluster_id, c.id, c.cti, left(c.text, 400) AS sample,
row_number() OVER (PARTITION BY c.document_id, c.cluster_id ORDER BY c.cti DESC NULLS LAST, c.id) AS rank FROM fx_chunks c JOIN fx_clusters s ON s.document_id = c.document_id AND s.cluster_id = c.cluster_id AND s.custom_label IS NULL) WHERE rank <= 6""")
def label_sample_topn(t: Tables) -> DataFrame:
    return retrieval.label_samples(t.clusters, t.chunks)


def _stand_in(prompts: list[str]) -> list[str]:
    """A labelling model's place: a reply that depends on the whole prompt, fenced as models do."""
    return ["```json\n" + json.dumps({"label": f"Theme {hashlib.sha256(p.encode()).hexdigest()[:12]}", "description": f"{len(p)} characters"}) + "\n```" for p in prompts]


@query(f"""{_WITH}, ranked AS (SELECT c.document_id, c.cluster_id, left(c.text, 400) AS sample, row_number() OVER (PARTITION BY c.document_id, c.cluster_id ORDER BY c.cti DESC NULLS LAST, c.id) AS rank
FROM fx_chunks c JOIN fx_clusters s ON s.document_id = c.document_id AND s.cluster_id = c.cluster_id AND s.custom_label IS NULL),
prompts AS (SELECT document_id, cluster_id, string_agg('(' || rank || ') ' || sample, chr(10) ORDER BY rank) AS p FROM ranked WHERE rank <= 6 AND sample IS NOT NULL GROUP BY ALL)
SELECT id, CASE WHEN p IS NULL THEN label ELSE 'Theme ' || left(sha256(p), 12) END AS label, CASE WHEN p IS NULL THEN description ELSE length(p) || ' characters' END AS description
FROM fx_clusters LEFT JOIN prompts USING (document_id, cluster_id)""")
def label_clusters_called(t: Tables) -> DataFrame:
    """Clusters relabelled through a provider whose answers are remembered: a second run over the same samples asks nothing."""
    tables = Snapshots(t.spark, f"{checkpoint_dir(t.spark).rstrip('/')}/answers-{uuid.uuid4().hex}")
    return remembered.label_clusters(tables, t.clusters, t.chunks, "stand-in", _stand_in).select("id", "label", "description")


@query(f"WITH {_CHUNKS} SELECT document_id AS source_path, round(avg(coalesce(cti, 0)), 6) AS avg_cti, count(*) AS units, max(coalesce(cti, 0)) AS max_cti FROM fx_chunks GROUP BY document_id ORDER BY round(avg(coalesce(cti, 0)), 9) DESC, source_path LIMIT 10")
def friction_by_source(t: Tables) -> DataFrame:
    return _six(retrieval.friction_by_source(t.chunks.withColumnRenamed("document_id", "source_path")), "avg_cti")


@query("""SELECT lang AS filename, arg_max(source, n) AS id, max(n) AS uploaded_at FROM (SELECT DISTINCT lang, source, substr(source, 4)::INT AS n FROM documents) GROUP BY lang""")
def latest_document(t: Tables) -> DataFrame:
    uploads = t.raw("documents").select(F.col("lang").alias("filename"), F.col("source").alias("id")).distinct().withColumn("uploaded_at", F.substring("id", 4, 20).cast("int"))
    return retrieval.latest_by_filename(uploads)


@query(f"WITH {_CHUNKS} SELECT document_id, chunk_index, id, cluster_label FROM fx_chunks")
def export_chunks(t: Tables) -> DataFrame:
    return retrieval.export_chunks(t.chunks).select("document_id", "chunk_index", "id", "cluster_label")


# --- vectors ---------------------------------------------------------------------


@query(f"{_WITH} SELECT id, unit_count, round(centroid[1], 6) AS c0, round(centroid[64], 6) AS c63, round(list_sum(centroid), 5) AS total FROM fx_clusters")
def centroids(t: Tables) -> DataFrame:
    total = F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5)
    return t.clusters.select("id", "unit_count", F.round(F.get("centroid", F.lit(0)), 6).alias("c0"), F.round(F.get("centroid", F.lit(63)), 6).alias("c63"), total.alias("total"))


@query(f"{_WITH} SELECT c.id, round(list_cosine_similarity(embedding, centroid), 6) AS similarity FROM fx_chunks c JOIN fx_clusters s ON s.document_id = c.document_id AND s.cluster_id = c.cluster_id")
def chunk_to_centroid(t: Tables) -> DataFrame:
    own = t.chunks.join(t.clusters.select("document_id", "cluster_id", "centroid"), ["document_id", "cluster_id"])
    return own.select("id", F.round(guarded_cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


@query(f"""WITH {_CHUNKS}, mean AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(x) AS m FROM (SELECT cluster_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM fx_chunks) GROUP BY ALL) GROUP BY ALL)
SELECT c.id AS idx, arg_max(m.cluster_id, (round(list_cosine_similarity(embedding, m.c), 12), -m.cluster_id)) AS cluster FROM fx_chunks c, mean m GROUP BY c.id""")
def kmeans_one_step(t: Tables) -> DataFrame:
    from ..functions.vectors import mean_vector
    from .tables import DIM

    start = t.chunks.groupBy("cluster_id").agg(mean_vector(F.col("embedding"), DIM).alias("centroid")).select(F.lit("all").alias("document_id"), F.col("cluster_id").alias("cluster"), "centroid")
    vectors = t.chunks.select(F.lit("all").alias("document_id"), F.col("id").alias("idx"), F.col("embedding").alias("vector"))
    # One set of centroids for all rows: its size is the number of labels, so it is sent to the rows.
    return A.assign(vectors, start).select("idx", "cluster")


# --- text ------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, sha256(lower({_SQUEEZE.format('text')})) AS content_hash, source FROM documents)
SELECT doc_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source, content_hash ORDER BY doc_id) AS r FROM t) WHERE r = 1""")
def chunk_dedup(t: Tables) -> DataFrame:
    hashed = t.units.select("document_id", F.col("idx").alias("chunk_index"), X.content_hash(F.col("text")).alias("content_hash"))
    return store.new_chunks(hashed).select(F.col("chunk_index").alias("doc_id"), "content_hash")


@query(f"SELECT source AS document_id, sha256(string_agg(h, '|' ORDER BY h)) AS fingerprint FROM (SELECT source, sha256(lower({_SQUEEZE.format('text')})) AS h FROM documents) GROUP BY source")
def document_fingerprint(t: Tables) -> DataFrame:
    hashed = t.units.select("document_id", X.content_hash(F.col("text")).alias("h"))
    return store.fingerprints(hashed)


@query(f"""WITH h AS (SELECT doc_id, sha256(lower({_SQUEEZE.format('text')})) AS h FROM documents), o AS (SELECT sha256(lower({_SQUEEZE.format('text')})) AS h FROM conversations UNION ALL SELECT sha256(lower({_SQUEEZE.format('text')})) FROM benchmark)
SELECT doc_id FROM h WHERE h NOT IN (FROM o)""")
def new_documents_anti(t: Tables) -> DataFrame:
    """Documents whose content is neither a turn nor a benchmark item."""
    hashed = lambda name, key: t.raw(name).select(F.col(key).alias("doc_id"), F.lit(None).cast("string").alias("user_id"), X.content_hash(F.col("text")).alias("content_hash"))
    return store.new_documents(hashed("documents", "doc_id"), hashed("conversations", "conv_id").unionByName(hashed("benchmark", "item_id"))).select("doc_id")


@query(f"""{_WITH}, v AS (SELECT id, document_id, cluster_id, unit_count, avg_cti, 1 AS version FROM fx_clusters UNION ALL SELECT id, document_id, cluster_id, unit_count - 1, avg_cti / 2, 2 FROM fx_clusters WHERE cluster_id < 5)
SELECT id, unit_count, round(avg_cti, 6) AS avg_cti, version FROM (SELECT *, row_number() OVER (PARTITION BY document_id, cluster_id ORDER BY version DESC) AS r FROM v WHERE version = 1 OR unit_count > 0) WHERE r = 1""")
def cluster_upsert_latest(t: Tables) -> DataFrame:
    stored = t.clusters.select("id", "document_id", "cluster_id", "unit_count", "avg_cti").withColumn("version", F.lit(1))
    incoming = stored.where("cluster_id < 5").withColumns({"unit_count": F.col("unit_count") - 1, "avg_cti": F.col("avg_cti") / 2, "version": F.lit(2)})
    return _six(store.upsert_clusters(stored, incoming).select("id", "unit_count", "avg_cti", "version"), "avg_cti")


@query(f"WITH {_DOCUMENTS} SELECT id, coalesce(user_id, 'u9') AS user_id, user_id IS NULL AS claimed FROM fx_documents")
def claim_orphans(t: Tables) -> DataFrame:
    return store.claim_orphans(t.documents, "u9").select("id", "user_id", "claimed")


@query(f"WITH {_CHUNKS}, {_DOCUMENTS} SELECT id, document_id FROM fx_chunks WHERE document_id NOT IN (SELECT id FROM fx_documents WHERE user_id = 'u0')")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.documents.where("user_id = 'u0'").select(F.col("id").alias("document_id"))
    return store.without_documents(t.chunks, gone).select("id", "document_id")


_NAMES = """names AS (SELECT page_id, regexp_replace(url, '^[^:]*://', '') || ['.pdf', '.MP3', '.png', '.zip', '.ipynb', '.py', '.json', '.d.ts', '.md', '/node_modules/x.js', '.min.js', '/a.lock'][(page_id % 12 + 1)::INT] AS name,
  CASE WHEN page_id % 7 = 3 THEN 'application/pdf' WHEN page_id % 11 = 5 THEN 'audio/mpeg' END AS mime FROM pages)"""


def _names(t: Tables) -> DataFrame:
    ends = F.array(*map(F.lit, (".pdf", ".MP3", ".png", ".zip", ".ipynb", ".py", ".json", ".d.ts", ".md", "/node_modules/x.js", ".min.js", "/a.lock")))
    mime = F.when(F.col("page_id") % 7 == 3, "application/pdf").when(F.col("page_id") % 11 == 5, "audio/mpeg")
    return t.raw("pages").select("page_id", F.concat(F.regexp_replace("url", "^[^:]*://", ""), F.get(ends, (F.col("page_id") % 12).cast("int"))).alias("name"), mime.alias("mime"))


@query(rf"""WITH {_NAMES}, n AS (SELECT page_id, lower(name) AS n, lower(coalesce(mime, '')) AS m FROM names) SELECT page_id, CASE WHEN m = 'application/pdf' OR n LIKE '%.pdf' THEN 'pdf'
WHEN m LIKE 'audio/%' OR regexp_matches(n, '{X.lexicon.AUDIO}') THEN 'audio' WHEN m LIKE 'image/%' OR regexp_matches(n, '{X.lexicon.IMAGE}') THEN 'image' WHEN m = 'application/zip' OR n LIKE '%.zip' THEN 'zip'
WHEN n LIKE '%.ipynb' THEN 'notebook' WHEN regexp_matches(n, '{X.lexicon.SCRIPT}') THEN 'script' WHEN n LIKE '%.json' THEN 'json' ELSE 'text' END AS source_type FROM n""")
def detect_source_type(t: Tables) -> DataFrame:
    return _names(t).select("page_id", X.source_type(F.col("name"), F.col("mime")).alias("source_type"))


@query(f"WITH {_NAMES} SELECT page_id, regexp_matches(name, '{X.lexicon.EXCLUDED}') AS excluded FROM names")
def exclude_paths(t: Tables) -> DataFrame:
    return _names(t).select("page_id", X.excluded_path(F.col("name")).alias("excluded"))


@query(rf"""SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda s: {_SQUEEZE.format('s')}), lambda s: length(s) >= 3)) AS paragraphs,
len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 15)) AS page_sentences FROM documents""")
def text_units(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("paragraphs"), F.size(X.page_sentences(F.col("text"))).alias("page_sentences"))


@query(r"""SELECT doc_id, len(parts) AS sentences, sha256(array_to_string(parts, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(
regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+([A-ZÅÄÖ"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents)""")
def split_sentences(t: Tables) -> DataFrame:
    parts = t.texts.select("doc_id", X.split_sentences(F.col("text")).alias("p"))
    return parts.select("doc_id", F.size("p").alias("sentences"), F.sha2(F.array_join("p", "\n"), 256).alias("digest"))


@query("WITH " + _TOKENS.format(key="source", idx="doc_id", rows="documents") + f" SELECT token, count(*) AS n, count(DISTINCT idx) AS units FROM tokens WHERE token NOT IN {_STOP} GROUP BY token")
def tokenize_counts(t: Tables) -> DataFrame:
    return A.term_totals(t.units)


_VOCAB = (
    "WITH "
    + _TOKENS.format(key="source", idx="doc_id", rows="documents")
    + f""", counts AS (SELECT document_id, idx, token, count(*) AS tf, min(pos) AS pos FROM tokens WHERE token NOT IN {_STOP} GROUP BY ALL),
sizes AS (SELECT source AS document_id, count(*) AS n FROM documents GROUP BY source), dfs AS (SELECT document_id, token, count(*) AS df, min((idx, pos)) AS seen FROM counts GROUP BY ALL),
vocab AS (SELECT document_id, token, df, n, rank FROM (SELECT document_id, token, df, n, row_number() OVER (PARTITION BY document_id ORDER BY df DESC, CASE WHEN regexp_matches(token, '^(0|[1-9][0-9]{{0,8}})$') THEN token::BIGINT END NULLS LAST, seen) AS rank
  FROM dfs JOIN sizes USING (document_id) WHERE df >= 2 AND df < n * 0.8e0) WHERE rank <= 100)"""
)


@query(_VOCAB + " SELECT document_id, token, df, rank FROM vocab")
def vocab_top100(t: Tables) -> DataFrame:
    return A.vocabulary(A.distinct_terms(t.units), t.units).select("document_id", "token", "df", "rank")


@query(_VOCAB + """, top AS (SELECT document_id, idx, max(c) AS m FROM (SELECT document_id, idx, token, count(*) AS c FROM tokens GROUP BY ALL) GROUP BY ALL)
SELECT document_id, idx, token, round(tf / m::DOUBLE * ln(n / df::DOUBLE), 6) AS weight FROM counts JOIN vocab USING (document_id, token) JOIN top USING (document_id, idx)""")
def tfidf_weights(t: Tables) -> DataFrame:
    return _six(A.tfidf(A.token_counts(t.units), A.vocabulary(A.distinct_terms(t.units), t.units)).select("document_id", "idx", "token", "weight"), "weight")


@query(f"WITH {_CHUNKS}, " + _TOKENS.format(key="document_id || '#' || cluster_id", idx="id", rows="fx_chunks") + f""", tf AS (SELECT document_id AS g, token, count(*) AS c, min((idx, pos)) AS seen FROM tokens WHERE token NOT IN {_STOP} GROUP BY ALL),
best AS (SELECT g, token, row_number() OVER (PARTITION BY g ORDER BY c DESC, CASE WHEN regexp_matches(token, '^(0|[1-9][0-9]{{0,8}})$') THEN token::BIGINT END NULLS LAST, seen) AS r FROM tf),
lab AS (SELECT g, string_agg(upper(token[1]) || token[2:], ' · ' ORDER BY r) AS label FROM best WHERE r <= 3 GROUP BY g),
d AS (SELECT document_id || '#' || cluster_id AS g, any_value(cluster_id) AS k, arg_min(text, id) AS f FROM fx_chunks GROUP BY 1)
SELECT g AS id, coalesce(label, 'Cluster ' || (k + 1)) AS label, left(f, 120) || CASE WHEN length(f) > 120 THEN '…' ELSE '' END AS description FROM d LEFT JOIN lab USING (g)""")
def cluster_labels(t: Tables) -> DataFrame:
    units = t.chunks.select("document_id", "cluster_id", F.col("id").alias("idx"), "text")
    return A.cluster_labels(units).select(F.concat("document_id", F.lit("#"), F.col("cluster_id").cast("string")).alias("id"), "label", "description")


@query(r"SELECT doc_id, CASE WHEN len(string_split_regex(text, '\s+')) < 8 THEN 'fragment' WHEN len(string_split_regex(text, '\s+')) > 25 THEN 'paragraph' ELSE 'heading' END AS type FROM documents")
def unit_type(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.unit_type(F.col("text")).alias("type"))


@query("WITH " + _HEDGE.format(rows="documents") + " SELECT doc_id, h AS hedging, c AS certainty, q AS challenge, lex AS tension FROM hedged")
def hedging_scores(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", S.hedging(F.col("text"), field.CORPUS_LEXICON).alias("s")).select("doc_id", "s.*")


_INTENT = f"WITH {_CHUNKS}, " + _HEDGE.format(rows="fx_chunks") + f", {_SCORED} "


@query(_INTENT + "SELECT id, round(disc, 6) AS discrepancy FROM scored")
def discrepancy(t: Tables) -> DataFrame:
    return _six(t.judged.select("id", "discrepancy"), "discrepancy")


@query(_INTENT + "SELECT id, round(deviation, 6) AS deviation FROM scored")
def cluster_deviation(t: Tables) -> DataFrame:
    return _six(t.judged.select("id", "deviation"), "deviation")


@query(_INTENT + "SELECT id, tri AS triangulated FROM scored")
def triangulated(t: Tables) -> DataFrame:
    return t.judged.select("id", "triangulated")


@query(_INTENT + "SELECT id, floor(least(1e0, greatest(0e0, fz * 0.45e0 + tri * 0.25e0 + (1 - certainty) * 0.15e0 + force * 0.15e0)) * 100 + 0.5e0) / 1e2 AS fz FROM scored")
def blended_fz(t: Tables) -> DataFrame:
    return t.judged.select("id", S.chosen_fz(F.col("fz"), F.col("triangulated"), F.col("certainty"), F.col("force")).alias("fz"))


@query(_INTENT + "SELECT id, cti_score AS cti, CASE WHEN cti_score > 0.4e0 THEN 'critical' WHEN cti_score > 0.25e0 THEN 'amber' WHEN cti_score > 0.15e0 THEN 'detail' ELSE 'calm' END AS severity FROM scored")
def cti(t: Tables) -> DataFrame:
    return t.judged.select("id", F.col("cti_score").alias("cti"), S.severity(F.col("cti_score")).alias("severity"))


_PLACED = f"""WITH {_CHUNKS}, {_POINTS}, mid AS (SELECT document_id, cluster_id, round(avg(x), 9) AS mx, round(avg(y), 9) AS my FROM pts GROUP BY ALL),
placed AS (SELECT p.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS d FROM pts p JOIN mid USING (document_id, cluster_id))"""


@query(_PLACED + " SELECT id, round(least(1e0, d / 4 + 0.1e0), 6) AS fz, round(greatest(0e0, 1 - d / 3), 6) AS fy, round(greatest(5e0, least(95e0, (x + 4) / 8 * 100)), 6) AS px FROM placed")
def lexical_fz_fy(t: Tables) -> DataFrame:
    out = field.score_places(t.points)
    return _six(out.select("id", F.col("lexical_fz").alias("fz"), F.col("lexical_fy").alias("fy"), S.canvas_percent(F.col("x")).alias("px")), "fz", "fy", "px")


@query(f"WITH {_CHUNKS} SELECT document_id, count(*) AS total_units, count(*) FILTER (fz > 0.65e0) AS boundary_units, round(avg(fz), 6) AS avg_fz, round(avg(fy), 6) AS avg_fy FROM fx_chunks GROUP BY document_id")
def field_stats(t: Tables) -> DataFrame:
    return _six(A.field_stats(t.chunks), "avg_fz", "avg_fy")


@query(f"""WITH {_CHUNKS}, {_POINTS}, every AS (SELECT document_id, unnest(range(0, 12)) AS cluster_id FROM (SELECT DISTINCT document_id FROM fx_chunks)),
own AS (SELECT document_id, cluster_id, count(*) AS n, avg(fz) AS z, avg(x) AS cx FROM fx_chunks JOIN pts USING (id, document_id, cluster_id) GROUP BY ALL)
SELECT document_id, cluster_id, coalesce(n, 0) AS unit_count, round(coalesce(z, 0), 6) AS avg_fz, round(coalesce(cx, 0), 6) AS cx FROM every LEFT JOIN own USING (document_id, cluster_id)""")
def cluster_summary(t: Tables) -> DataFrame:
    at = lambda i: (F.get("embedding", F.lit(i)) * 14).alias("xy"[i])
    units = t.chunks.select("document_id", "cluster_id", "fz", "fy", at(0), at(1))
    k = t.chunks.select("document_id").distinct().withColumn("k", F.lit(12))
    return _six(A.cluster_summary(units, k).select("document_id", "cluster_id", "unit_count", "avg_fz", "cx"), "avg_fz", "cx")


@query("WITH RECURSIVE " + _ITEMS + " SELECT page_index, group_id, n_items, text, round(cx, 6) AS cx, round(cy, 6) AS cy, min_x, max_y FROM groups")
def spatial_groups(t: Tables) -> DataFrame:
    return _six(layout.spatial_groups(t.items).select("page_index", "group_id", "n_items", "text", "cx", "cy", "min_x", "max_y"), "cx", "cy")


@query("WITH RECURSIVE " + _ITEMS + """, f AS (SELECT page_index, count(*) AS n, avg(length(text)) AS m, avg((length(text) < 80)::INT) AS s, max(cx / 612e0) - min(cx / 612e0) AS spread, count(DISTINCT floor(cy / 792e0 * 10 + 0.5e0)) AS lv FROM groups GROUP BY page_index),
p AS (SELECT page_index, n, CASE WHEN n < 3 THEN 0e0 ELSE round((CASE WHEN s > 0.6e0 THEN 0.3e0 ELSE 0e0 END) + (CASE WHEN m < 60 THEN 0.2e0 ELSE 0e0 END) + (CASE WHEN spread > 0.4e0 THEN 0.25e0 ELSE 0e0 END) + (CASE WHEN lv / n::DOUBLE > 0.3e0 THEN 0.25e0 ELSE 0e0 END), 9) END AS confidence FROM f)
SELECT page_index, n, confidence, confidence >= 0.5e0 AS is_diagram FROM p""")
def diagram_layout(t: Tables) -> DataFrame:
    return layout.diagram_layout(layout.spatial_groups(t.items), "page_index")


@query(r"""WITH w AS (SELECT item_id, lower(b.text) AS bt, d.doc_id, lower(d.text) AS dt FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT doc_id, len(list_intersect(list_distinct(list_filter(string_split_regex(bt, '\s+'), lambda x: length(x) > 3)), list_distinct(list_filter(string_split_regex(dt, '\s+'), lambda x: length(x) > 3)))) AS overlap FROM w""")
def word_overlap(t: Tables) -> DataFrame:
    pairs = t.raw("benchmark").select(F.col("item_id").alias("doc_id"), F.lower("text").alias("b")).join(t.raw("documents").select("doc_id", F.lower("text").alias("d")), "doc_id")
    return pairs.select("doc_id", X.common_words(F.col("b"), F.col("d")).alias("overlap"))


@query(f"""WITH u AS (SELECT source AS document_id, 0 AS s, doc_id AS pos, {_SQUEEZE.format('text')} AS text FROM documents UNION ALL SELECT d.source, 1, b.item_id, {_SQUEEZE.format('b.text')} FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
SELECT document_id, s AS "set", pos, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(text) ORDER BY s, pos) AS r FROM u WHERE length(text) >= 3) WHERE r = 1""")
def merge_units(t: Tables) -> DataFrame:
    own = t.units.withColumnRenamed("idx", "pos")
    more = t.raw("benchmark").join(t.raw("documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("document_id")), "item_id").select("document_id", F.col("item_id").alias("pos"), "text")
    return chunker.merge_units(own, more).select("document_id", "set", "pos", F.sha2("text", 256).alias("digest"))


@query("""WITH r AS (SELECT conv_id, turn, role, (lag(turn) OVER w IS NULL OR role IS DISTINCT FROM lag(role) OVER w)::INT AS new FROM conversations WHERE trim(text) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS group_no FROM r""")
def gaps_islands_sources(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("position"), F.col("role").alias("source"), "text")
    return chunker.source_groups(rows).select(F.col("document_id").alias("conv_id"), F.col("position").alias("turn"), "group_no")


@query("SELECT conv_id::VARCHAR AS document_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, 'talk' || conv_id || '.wav@0' || turn || ':00' AS source, sha256(trim(text)) AS digest FROM conversations WHERE trim(text) <> ''")
def audio_segments(t: Tables) -> DataFrame:
    return files.transcript_units(t.transcripts).select("document_id", "position", "source", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_CHUNKS} SELECT id, sha256('[doc: ' || document_id || '] [cluster: ' || cluster_label || '] [act: ' || speech_act || '] [certainty: ' || printf('%.2f', certainty) || '] ' || text) AS digest FROM fx_chunks""")
def augmented_text(t: Tables) -> DataFrame:
    out = X.augment(F.col("text"), F.col("document_id"), F.col("cluster_label"), F.col("speech_act"), F.col("certainty"))
    return t.chunks.select("id", F.sha2(out, 256).alias("digest"))


@query("SELECT page_id, left(trim(regexp_replace(html, '<[^>]*>', '', 'g')), 60) AS label FROM pages")
def sanitize_label(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.sanitize_label(F.col("html")).alias("label"))


@query(r"SELECT doc_id, length(t) >= 3 AND len(regexp_extract_all(t, '[\p{L}\p{N}]')) >= 2 AS useful FROM (SELECT doc_id, " + _SQUEEZE.format("text") + " AS t FROM documents)")
def useful_lines(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.useful_line(F.col("text")).alias("useful"))


@query(r"SELECT source AS document_id, (sum(n) < 5 OR sum(v) < 120 OR count(*) < 3) AS needs_ocr FROM (SELECT source, len(string_split(text, '.')) AS n, length(regexp_replace(text, '\s+', '', 'g')) AS v FROM documents) GROUP BY source")
def ocr_needed(t: Tables) -> DataFrame:
    per = t.units.select("document_id", F.size(F.split("text", "\\.", -1)).alias("n"), F.length(F.regexp_replace("text", X.WS + "+", "")).alias("v")).groupBy("document_id").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("g"))
    return per.select("document_id", X.needs_ocr(F.col("n"), F.col("v"), F.col("g")).alias("needs_ocr"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN '[IMAGE]: ' || source WHEN doc_id % 3 = 0 THEN '[CAPTION]: ' || lang WHEN doc_id % 2 = 0 THEN '[OCR]: ' || left(text, 30) ELSE '[OCR]: ' || left(text, 30) || ' [CAPTION]: ' || lang END AS unit FROM documents")
def image_units(t: Tables) -> DataFrame:
    ocr, caption = F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 30)).otherwise(""), F.when(F.col("doc_id") % 2 != 0, F.col("lang"))
    return t.raw("documents").select("doc_id", X.image_unit(F.col("source"), ocr, caption).alias("unit"))


# --- chunks: where one begins follows from where the last ended -------------------------


_CUTS = r"""parts AS (SELECT row_number() OVER () AS rid, doc_id, source, list_filter(list_transform(string_split(
regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+([A-ZÅÄÖ"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ps FROM documents),
sized AS (SELECT *, sum(n) OVER (PARTITION BY rid ORDER BY i) AS upto FROM (SELECT rid, unnest(range(len(ps))) AS i, unnest(list_transform(ps, lambda s: length(s) + 1)) AS n FROM parts)),
ends AS MATERIALIZED (SELECT a.rid, a.i, a.i + greatest(1, least(coalesce(min(b.i - a.i + 1) FILTER (b.upto - a.upto + a.n >= 500), 10000), count(*) FILTER (b.upto - a.upto + a.n - 1 <= 1200))) AS e
  FROM sized a JOIN sized b ON a.rid = b.rid AND b.i BETWEEN a.i AND a.i + 251 GROUP BY a.rid, a.i, a.upto, a.n),
cuts(rid, i, e) AS (SELECT rid, i, e FROM ends WHERE i = 0 UNION ALL SELECT n.rid, n.i, n.e FROM cuts c JOIN parts p USING (rid) JOIN ends n ON n.rid = c.rid AND n.i = greatest(c.e - 2, c.i + 1) WHERE c.e < len(p.ps)),
chunks AS (SELECT rid, doc_id, source, i, e, text, row_number() OVER (PARTITION BY rid ORDER BY i) - 1 AS idx FROM (SELECT c.*, doc_id, source, array_to_string(ps[i + 1:e], ' ') AS text FROM cuts c JOIN parts USING (rid)) WHERE length(text) >= 40)"""


@query(f"WITH RECURSIVE {_CUTS} SELECT doc_id::VARCHAR AS document_id, idx::INT AS chunk_index, source, length(text)::INT AS length, sha256(text) AS digest FROM chunks")
def chunk_units(t: Tables) -> DataFrame:
    units = t.raw("documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).cast("long").alias("position"), "source", "text")
    return chunker.chunk_units(units).select("document_id", "chunk_index", "source", F.length("text").alias("length"), F.sha2("text", 256).alias("digest"))


# --- without SQL: iterations, tested by their properties ----------------------------------


@query()
def kmeans_full(t: Tables) -> DataFrame:
    return A.clustered(A.text_blocks(t.units)).select("document_id", "idx", "cluster")


@query()
def pca_projection(t: Tables) -> DataFrame:
    from .tables import DIM

    vectors = t.chunks.select("document_id", F.col("id").alias("idx"), F.col("embedding").alias("vector"))
    return _six(A.project(vectors, DIM), "x", "y")


@query()
def field_units(t: Tables) -> DataFrame:
    """The whole plan: chunks of every text (none across two texts), clustered, projected and scored by source."""
    units = t.units.select("document_id", F.col("idx").alias("position"), F.col("idx").cast("string").alias("source"), "text")
    built = field.build_field(units, field.CORPUS_LEXICON, cap=None)
    return built.units.select("document_id", "idx", "cluster_id", "fz", "fy", "cti", "type")


@query()
def corpus_map(t: Tables) -> DataFrame:
    """The whole map of what one owner sees: documents, nodes with quality, edges with scores, groups with members, chunks, summary."""
    documents = retrieval.visible_documents(t.documents, "u1")
    clusters = stash(retrieval.visible_rows(t.clusters, t.documents, "u1"))
    chunks = retrieval.visible_rows(t.chunks, t.documents, "u1")
    quality = stash(graph.cluster_quality(clusters, chunks, 0.15))
    edges = stash(graph.cluster_edges(clusters, 0.3, None))
    groups = stash(graph.cross_document_groups(edges, clusters))
    nodes = clusters.select("id", "document_id", F.coalesce("custom_label", "label").alias("label"), "description", "unit_count", "avg_fz", "avg_fy", "avg_cti")
    nodes = nodes.join(quality.select("id", "cohesion", "separation", "noise_ratio"), "id", "left")
    return files.corpus_map(
        {"min_similarity": 0.3, "noise_threshold": 0.15},
        documents=documents,
        nodes=nodes,
        edges=edges.select("src_id", "dst_id", "src_doc", "dst_doc", "similarity", "fz_delta", "fy_delta", "hybrid_score"),
        cross_doc_clusters=groups,
        chunks=chunks.select("id", "document_id", "cluster_id", "chunk_index", "fz", "fy", "cti"),
        summary=graph.corpus_summary(clusters, quality, edges, groups),
    )
