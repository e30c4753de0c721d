"""The engine's searches and reports as SQL table functions with named defaults.

`register` names the stored tables as views and creates temporary functions over
them, all in SQL, so Catalyst sees through a call: with constant arguments a search
is one scan and a top-k in each task, and unused columns are not read.

    SELECT * FROM match_chunks(array(0.1D, ...), match_count => 5)
    SELECT * FROM match_chunks(from_json('[0.1]', 'array<double>'))
    SELECT a.id, m.* FROM asked a, LATERAL match_chunks(a.v, min_cti => 0.5) m

A lateral search meets each of its vectors with each row, in the JVM, and sorts all of
these, so it suits the few vectors of a statement.  For more there is `nearest_chunks`
(`register_nearest`), which takes the best rows of each block of rows at once, and for a
table of them `best_chunks` (`register_asked`), whose blocks of vectors meet blocks of
rows as products, each in a task of bounded size.  Arguments that
are null match nothing, but `exclude_document` and `owner`, for which null is no limit.
Vectors that are null, zero or of another length never match; ties go to the lesser id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..operators import cells, graph, retrieval
from ..operators.shared import stash

#: Similarity from which the edges behind `corpus_cluster_edges` are there.
EDGE_FLOOR = 0.55
#: Rows of a block of `nearest_chunks`: of 64 numbers a vector, 0.13 MB.  Spark's nested loop join holds a block once a vector that asks.
BLOCK_ROWS = 256
#: Bytes of vectors of a block of rows, and of a block of vectors asked, of `best_chunks`; rows of the smallest block.
ROWS_BYTES, ASKED_BYTES, LEAST_ROWS = 8 << 20, 4 << 20, 1000

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"


def _function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def _table(spark: SparkSession, name: str, arguments: str, columns: dict[str, str], source: str, order: str = "", limit: str = "", where: str = "true") -> None:
    """A function that returns `columns` of the select `source`, the first `limit` by `order`, and of these what `where` keeps."""
    listed = ", ".join(columns)
    if limit:
        source = f"SELECT *, row_number() OVER (ORDER BY {order}) AS _place FROM ({source})"
        where = f"_place <= {name}.{limit} AND {where}"
    _function(spark, name, arguments, "TABLE(" + ", ".join(f"{c} {t}" for c, t in columns.items()) + ")", f"SELECT {listed} FROM ({source}) WHERE {where}")


def _types(df: DataFrame, names: list[str]) -> dict[str, str]:
    kinds = dict(df.dtypes)
    return {n: kinds[n] for n in names if n in kinds}


def register(spark: SparkSession, chunks: DataFrame, documents: DataFrame, clusters: DataFrame, shared: DataFrame | None = None, edge_floor: float = EDGE_FLOOR) -> list[str]:
    """Create the functions over these tables in the session, in place of earlier ones; their names.

    shared is the table of shared clusters, for match_global_clusters.  corpus_cluster_edges answers from `edge_floor`
    on and fails below it, as its pairs come from a join that prunes by the floor.
    """
    sim = clusters.where(F.col("centroid").isNotNull()).select("id", "document_id", "cluster_id", "centroid")
    members = chunks.where(F.col("embedding").isNotNull()).select("document_id", "cluster_id", "embedding").join(sim, ["document_id", "cluster_id"])
    views = {
        "loomfield_chunks": chunks,
        "loomfield_documents": documents,
        "loomfield_clusters": clusters,
        "loomfield_shared": shared if shared is not None else clusters.limit(0),
        "loomfield_edges": graph.cluster_edges(clusters, edge_floor, None),
        "loomfield_members": members.select("id", "document_id", "cluster_id", cosine(F.col("embedding"), F.col("centroid")).alias("sim")),
        "loomfield_separation": graph.nearest_other(clusters, "centroid").select("id", (1 - F.col("nearest")).alias("distance")),
        "loomfield_ranking": retrieval.document_ranking(documents, chunks),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)

    _function(spark, "cosine_similarity", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size(a) = size(b) THEN {_DOT} / nullif({_NORM.format('a')} * {_NORM.format('b')}, 0D) END")

    asked = "query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT {0}, min_similarity DOUBLE DEFAULT 0"
    best = {"order": "similarity DESC NULLS LAST, id", "limit": "match_count"}

    def search(name: str, df: DataFrame, view: str, vector: str, names: list[str], count: int, more: str, rule: str) -> None:
        found = f"SELECT *, cosine_similarity({vector}, {name}.query_embedding) AS similarity FROM {view} WHERE {vector} IS NOT NULL AND {rule}"
        _table(spark, name, asked.format(count) + more, _types(df, names) | {"similarity": "double"}, found, where=f"similarity >= {name}.min_similarity", **best)

    cti = ", min_cti DOUBLE DEFAULT 0"
    out = ", exclude_document STRING DEFAULT NULL"
    search("match_chunks", chunks, "loomfield_chunks", "embedding", ["id", "document_id", "text", "source_path", "cluster_label", "fz", "cti"], 10, cti, "coalesce(cti, 0D) >= match_chunks.min_cti")
    search("match_clusters", clusters, "loomfield_clusters", "centroid", ["id", "document_id", "cluster_id", "label", "description", "unit_count", "avg_fz", "avg_cti"], 8, out, "(match_clusters.exclude_document IS NULL OR document_id <> match_clusters.exclude_document)")
    if shared is not None:
        search("match_global_clusters", shared, "loomfield_shared", "centroid", ["id", "label", "description", "unit_count", "avg_fz", "avg_fy", "avg_cti", "cohesion", "separation", "noise_ratio"], 10, cti, "coalesce(avg_cti, 0D) >= match_global_clusters.min_cti")

    hybrid = """SELECT c.*, filename, abs(coalesce(avg_fz, 0D) - f.query_fz) AS fz_delta, abs(coalesce(avg_fy, 0D) - f.query_fy) AS fy_delta, cosine_similarity(centroid, f.query_embedding) AS similarity
        FROM loomfield_clusters c JOIN (SELECT id AS _document, filename FROM loomfield_documents) ON document_id = _document
        WHERE centroid IS NOT NULL AND (f.exclude_document IS NULL OR document_id <> f.exclude_document)""".replace("f.", "match_clusters_hybrid.")
    scored = f"SELECT *, (1 - match_clusters_hybrid.tension_weight) * similarity + match_clusters_hybrid.tension_weight * (1 - least(fz_delta + fy_delta, 1D)) AS hybrid_score FROM ({hybrid}) WHERE similarity >= match_clusters_hybrid.min_similarity"
    columns = _types(clusters, ["id", "document_id", "cluster_id", "label", "custom_label", "description", "unit_count", "avg_fz", "avg_fy", "avg_cti"]) | {"filename": "string", "similarity": "double", "fz_delta": "double", "fy_delta": "double", "hybrid_score": "double"}
    _table(spark, "match_clusters_hybrid", "query_embedding ARRAY<DOUBLE>, query_fz DOUBLE, query_fy DOUBLE, match_count INT DEFAULT 10" + out + ", min_similarity DOUBLE DEFAULT 0, tension_weight DOUBLE DEFAULT 0.3", columns, scored, "hybrid_score DESC, id", "match_count")

    friction = """SELECT c.* FROM loomfield_chunks c JOIN (SELECT id AS _document, user_id FROM loomfield_documents) ON document_id = _document
        WHERE cti >= find_friction.min_cti AND (find_friction.owner IS NULL OR user_id IS NULL OR user_id = find_friction.owner)"""
    _table(spark, "find_friction", "owner STRING, min_cti DOUBLE DEFAULT 0.5, max_rows INT DEFAULT 20", _types(chunks, ["id", "document_id", "text", "cluster_label", "fz", "fy", "cti"]), friction, "cti DESC, id", "max_rows")

    edges = _types(views["loomfield_edges"], ["src_id", "dst_id", "src_doc", "dst_doc", "src_label", "dst_label", "similarity", "fz_delta", "fy_delta", "hybrid_score"])
    floor = f"if(corpus_cluster_edges.min_similarity < {edge_floor}D, raise_error('corpus_cluster_edges: edges below {edge_floor} are not there'), true)"
    _table(spark, "corpus_cluster_edges", "min_similarity DOUBLE DEFAULT 0.55, max_edges INT DEFAULT 500", edges, f"SELECT * FROM loomfield_edges WHERE {floor} AND similarity >= corpus_cluster_edges.min_similarity", "hybrid_score DESC, src_id, dst_id", "max_edges")

    quality = """SELECT id, document_id, cluster_id, cohesion, coalesce(distance, 1D) AS separation, noise_ratio, member_count FROM
        (SELECT id, document_id, cluster_id, avg(sim) AS cohesion, avg(noisy) AS noise_ratio, count(*) AS member_count FROM
        (SELECT *, if(sim < corpus_cluster_quality.noise_threshold, 1D, 0D) AS noisy FROM loomfield_members) GROUP BY id, document_id, cluster_id) LEFT JOIN loomfield_separation USING (id)"""
    _table(spark, "corpus_cluster_quality", "noise_threshold DOUBLE DEFAULT 0.5", _types(clusters, ["id", "document_id", "cluster_id"]) | {"cohesion": "double", "separation": "double", "noise_ratio": "double", "member_count": "long"}, quality)

    _table(spark, "document_ranking", "max_rows INT DEFAULT 50", dict(views["loomfield_ranking"].dtypes), "SELECT * FROM loomfield_ranking", "avg_cti DESC, id", "max_rows")
    _table(spark, "visible_documents", "owner STRING", dict(documents.dtypes), "SELECT * FROM loomfield_documents WHERE user_id IS NULL OR user_id = visible_documents.owner")
    _function(spark, "user_owns_document", "owner STRING, document STRING", "BOOLEAN", "(SELECT count(*) > 0 FROM loomfield_documents WHERE id = user_owns_document.document AND user_id = user_owns_document.owner)")
    made = ["match_chunks", "match_clusters", "match_clusters_hybrid", "find_friction", "corpus_cluster_edges", "corpus_cluster_quality", "document_ranking", "visible_documents", "user_owns_document", "cosine_similarity"]
    return made + (["match_global_clusters"] if shared is not None else [])


def register_nearest(spark: SparkSession, chunks: DataFrame) -> list[str]:
    """Create `nearest_chunks`, the id and similarity of what `match_chunks` finds, for lateral calls with many vectors.

    Chunks are written in blocks.  A vector and a block give their best rows within one row, so what is shuffled
    are `match_count` rows for a vector and a block, not each vector with each chunk.  Vectors that aren't finite never match.
    """
    able = chunks.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce("cti", F.lit(0.0)).alias("cti"))
    able = able.withColumn("n", norm(F.col("v"))).where((F.col("n") > 0) & (F.col("n") < float("inf")))
    count = max(1, -(-able.count() // BLOCK_ROWS))
    blocks = able.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("id", "v", "n", "cti")).alias("held"))
    # Dealt one by one, as each is much work.
    stash(blocks.repartition(max(count, spark.sparkContext.defaultParallelism))).createOrReplaceTempView("loomfield_blocks")

    like = _DOT.replace("(a, b,", "(r.v, nearest_chunks.query_embedding,")
    size = _NORM.format("nearest_chunks.query_embedding")
    scored = f"transform(filter(held, r -> r.cti >= nearest_chunks.min_cti AND size(r.v) = size(nearest_chunks.query_embedding) AND asked > 0 AND asked < double('infinity')), r -> struct(-({like} / (r.n * asked)) AS s, r.id AS id))"
    best = f"SELECT slice(array_sort(filter(scored, x -> -x.s >= nearest_chunks.min_similarity)), 1, nearest_chunks.match_count) AS best FROM (SELECT {scored} AS scored FROM (SELECT held, {size} AS asked FROM loomfield_blocks))"
    # Exploded before they are gathered: the optimizer would put the scores into the aggregate, which then sorts whole blocks, one for each vector.
    first = f"SELECT slice(array_sort(collect_list(x)), 1, nearest_chunks.match_count) AS best FROM (SELECT explode(best) AS x FROM ({best}))"
    kind = dict(chunks.dtypes)["id"]
    arguments = "query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT 10, min_similarity DOUBLE DEFAULT 0, min_cti DOUBLE DEFAULT 0"
    _function(spark, "nearest_chunks", arguments, f"TABLE(id {kind}, similarity double)", f"SELECT e.id, -e.s FROM (SELECT explode(best) AS e FROM ({first}))")
    return ["nearest_chunks"]


class BestChunks:
    """Table function over a block of rows and a block of vectors: the best rows of each vector; rows of other lengths never match."""

    def __init__(self):
        self.held, self.count, self.least = [], 0, 0.0

    def eval(self, met: pa.RecordBatch, match_count: pa.Array, min_similarity: pa.Array):
        if met.num_rows:
            self.held.append(met)
            self.count, self.least = match_count[0].as_py() or 0, min_similarity[0].as_py()

    def terminate(self):
        if not self.held or self.count < 1 or self.least is None:
            return
        met = pa.Table.from_batches(self.held)
        self.held = []
        asks = met.column("asks")
        asked, rows = met.filter(asks), met.filter(pa.compute.invert(asks)).sort_by("id")
        wide, long = asked.column("v").combine_chunks().value_lengths(), rows.column("v").combine_chunks().value_lengths()
        for d in pa.compute.unique(wide).to_pylist():
            a, r = asked.filter(pa.compute.equal(wide, d)), rows.filter(pa.compute.equal(long, d))
            if r.num_rows:
                x, y = cells._matrix(r), cells._matrix(a)
                for p, q, s in cells.best_rows(x, y, np.full(len(y), self.least), self.count):
                    yield pa.table([a.column("query_id").take(pa.array(p)), r.column("id").take(pa.array(q)), pa.array(s)], ["query_id", "id", "similarity"])


def register_asked(spark: SparkSession, chunks: DataFrame, asked: DataFrame) -> list[str]:
    """Create the view `loomfield_met` and the table function `best_chunks`, which answer a table asked(query_id, q) at once::

        SELECT * FROM best_chunks(TABLE(SELECT * FROM loomfield_met WHERE asks OR cti >= 0.5) PARTITION BY (block), 25, 0.1D)

    The view has each chunk once for each block of vectors (block, id, cti, v), and each vector once for each block of
    chunks (block, asks, query_id, v); the function gives the best rows (query_id, id, similarity) of a vector in each block,
    so the caller keeps the first of these.  What a task holds are the bytes of two blocks, however many rows there are.
    Vectors that are null, zero or not finite are not in the view.
    """
    kinds = dict(chunks.dtypes)["id"], dict(asked.dtypes)["query_id"]
    rows = stash(cells.unit_rows(chunks.select("id", "embedding", F.coalesce("cti", F.lit(0.0)).alias("cti")), "embedding", more=("cti",)))
    vectors = stash(cells.unit_rows(asked, "q", "query_id").withColumnRenamed("id", "query_id"))
    (n, wide), (m, long) = (df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first() for df in (rows, vectors))
    # At least a few blocks a core, where that leaves them rows enough.
    ours = max(1, -(-n * 8 * wide // ROWS_BYTES), min(n // LEAST_ROWS, 4 * spark.sparkContext.defaultParallelism))
    theirs = max(1, -(-m * 8 * long // ASKED_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = rows.select(F.pmod(F.xxhash64("id"), F.lit(ours)).alias("_r"), every(theirs).alias("_q"), F.lit(False).alias("asks"), F.lit(None).cast(kinds[1]).alias("query_id"), "id", "cti", "v")
    b = vectors.select(every(ours).alias("_r"), F.pmod(F.xxhash64("query_id"), F.lit(theirs)).alias("_q"), F.lit(True).alias("asks"), "query_id", F.lit(None).cast(kinds[0]).alias("id"), F.lit(None).cast("double").alias("cti"), "v")
    both = a.unionByName(b)
    both.select((F.col("_r") * theirs + F.col("_q")).alias("block"), "asks", "query_id", "id", "cti", "v").createOrReplaceTempView("loomfield_met")
    spark.udtf.register("best_chunks", F.arrow_udtf(BestChunks, returnType=f"query_id {kinds[1]}, id {kinds[0]}, similarity double"))
    return ["best_chunks"]
