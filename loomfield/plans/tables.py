"""Corpus tables derived from the given tables, lazily: chunks, documents, clusters, items, points."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector
from ..operators.shared import spread, stash

DIM = 64


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        """`documents`, for queries that compute much from each text."""
        return spread(self.raw("documents"), "doc_id")

    @cached_property
    def chunks(self) -> DataFrame:
        d, e = self.raw("documents"), self.raw("embeddings")
        j = e.join(d, e.vec_id == d.doc_id)
        share = lambda m: (F.col("doc_id") * m % 101) / F.lit(100.0)
        act = F.get(F.array(*map(F.lit, ("assertive", "directive", "commissive", "expressive", "declarative"))), (F.col("doc_id") % 5).cast("int"))
        return j.select(
            F.col("vec_id").alias("id"),
            F.col("source").alias("document_id"),
            F.col("doc_id").alias("chunk_index"),
            "text",
            "lang",
            F.col("label").alias("cluster_id"),
            F.concat(F.lit("cluster "), F.col("label").cast("string")).alias("cluster_label"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            share(29).alias("fz"),
            share(43).alias("fy"),
            F.when(F.col("doc_id") % 17 != 0, share(61)).alias("cti"),
            share(37).alias("certainty"),
            share(53).alias("force"),
            share(71).alias("tension"),
            act.alias("speech_act"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        t = self.raw("documents").select("source").distinct().withColumn("n", F.substring("source", 4, 20).cast("int"))
        owner = F.when(F.col("n") % 5 == 0, F.lit(None)).when(F.col("n") % 2 == 0, "u0").otherwise("u1")
        return t.select(F.col("source").alias("id"), F.concat("source", F.lit(".txt")).alias("filename"), F.lit("text").alias("source_type"), owner.alias("user_id"), (F.col("n") % 3 == 0).alias("share_to_global"), F.col("n").alias("uploaded_at"))

    @cached_property
    def clusters(self) -> DataFrame:
        g = self.chunks.groupBy("document_id", "cluster_id").agg(
            F.min_by("text", "id").alias("_first"),
            F.count(F.lit(1)).alias("unit_count"),
            F.avg("fz").alias("avg_fz"),
            F.avg("fy").alias("avg_fy"),
            F.avg(F.coalesce("cti", F.lit(0.0))).alias("avg_cti"),
            mean_vector(F.col("embedding"), DIM).alias("centroid"),
        )
        key = F.concat("document_id", F.lit("#"), F.col("cluster_id").cast("string"))
        custom = F.when(F.col("cluster_id") % 4 == 0, F.concat(F.lit("custom "), F.col("cluster_id").cast("string")))
        # Few rows that a query uses many times: written once.
        return stash(g.select(key.alias("id"), "document_id", "cluster_id", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")).alias("label"), custom.alias("custom_label"), F.substring("_first", 1, 240).alias("description"), "unit_count", "avg_fz", "avg_fy", "avg_cti", "centroid"))

    @cached_property
    def asking(self) -> DataFrame:
        """Chunks that search: every row whose id is divisible by 20."""
        return self.chunks.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))

    @cached_property
    def asking_clusters(self) -> DataFrame:
        """Clusters that search: those whose number, ten times the document's and the cluster's own, is divisible by 20."""
        number = F.substring("document_id", 4, 20).cast("int") * 10 + F.col("cluster_id")
        return self.clusters.where(number % 20 == 0).select(F.col("id").alias("query_id"), F.col("centroid").alias("q"), F.col("avg_fz").alias("q_fz"), F.col("avg_fy").alias("q_fy"), F.col("document_id").alias("q_document"))

    @cached_property
    def units(self) -> DataFrame:
        """Every document's whole text as a unit of its source."""
        return self.texts.select(F.col("source").alias("document_id"), F.col("doc_id").alias("idx"), "text")

    @cached_property
    def items(self) -> DataFrame:
        p = self.raw("part")
        return p.select((F.col("p_partkey") % 40).alias("page_index"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"), (F.col("p_partkey") * 37 % 612).cast("double").alias("x"), (F.col("p_partkey") * 91 % 792).cast("double").alias("y"), F.col("p_size").cast("double").alias("width"), F.lit(12.0).alias("height"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))

    @cached_property
    def points(self) -> DataFrame:
        at = lambda i: (F.get("embedding", F.lit(i)) * 14).alias("xy"[i])
        return self.chunks.select("document_id", "id", "cluster_id", at(0), at(1))

    @cached_property
    def transcripts(self) -> DataFrame:
        """A conversation as a transcript: each turn after its time mark."""
        c = self.raw("conversations")
        said = F.concat(F.lit("[0"), F.col("turn").cast("string"), F.lit(":00] "), F.coalesce("text", F.lit("")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda t: t["s"]), " ")
        return c.groupBy("conv_id").agg(joined.alias("transcript")).select(F.col("conv_id").cast("string").alias("document_id"), F.concat(F.lit("talk"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("filename"), "transcript")

    @cached_property
    def judged(self) -> DataFrame:
        """Chunks with lexical scores (test lexicon), discrepancy, deviation and the scores that follow."""
        from .field import score_intentions

        return score_intentions(self.chunks)

