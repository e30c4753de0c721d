"""Derived tables kept up with changes instead of derived anew.

The ranking: partial aggregates of each (document, cluster) are sums, counts and
maxima, so those of new chunks are added to those that are stored, and only
documents with new chunks are read and written.

The table of shared clusters: what its derivation had before and has now, told
as rows to insert, update and delete, from what changed in documents and
clusters; applied to the stored table they give the derivation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import ranking_of, ranking_parts
from .snapshots import Snapshots


def add_parts(stored: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Partial aggregates of both, by document and cluster (null is one too)."""
    both = fresh if stored is None else stored.unionByName(fresh)
    return both.groupBy("document_id", "cluster_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m"), F.sum("c").alias("c"))


def take_in(tables: Snapshots, fresh: DataFrame, mark: tuple[str, int] | None = None) -> int | None:
    """Chunks that aren't stored yet, with the clusters and documents that they change, as one new version; None if the mark is known or there are none.

    fresh(document_id, chunk_index, content_hash, cluster_id, cti, ...).  Only buckets of documents with new chunks are
    read and written.  Tables: chunks, clusters (partial aggregates), documents (the ranking).
    """
    if mark and tables.mark(mark[0]) >= mark[1]:
        return None
    from .store import new_chunks

    fresh = fresh.persist()
    try:
        touched = tables.buckets(fresh, "document_id")
        if not touched:
            return None
        change = tables.change()
        added = change.append("chunks", new_chunks(fresh, tables.read("chunks", touched)), "document_id")
        parts = add_parts(tables.read("clusters", touched), ranking_parts(added.withColumn("id", F.col("chunk_index"))))
        parts = change.replace("clusters", parts, "document_id", touched)
        documents = parts.select(F.col("document_id").alias("id")).distinct().withColumns({"filename": F.col("id"), "source_type": F.lit("text"), "user_id": F.lit(None).cast("string")})
        change.replace("documents", ranking_of(documents, parts), "id", touched)
        return change.commit(mark)
    finally:
        fresh.unpersist()


def changes(before: DataFrame, now: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `now` with op insert, update or nothing, and rows of `before` with op delete: what makes one of the other.

    Rows are compared whole, null equals null; what is equal is left out.
    """
    names = [c for c in now.columns if c != key]
    old = before.select(F.col(key).alias("_k"), F.struct(*names).alias("_old"))
    both = now.select(key, F.struct(*names).alias("_new")).join(old, F.col(key) == F.col("_k"), "full")
    op = F.when(F.col("_k").isNull(), "insert").when(F.col(key).isNull(), "delete").when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
    both = both.withColumn("op", op).where("op IS NOT NULL")
    return both.select(F.coalesce(key, "_k").alias(key), "op", *(F.when(F.col("op") == "delete", F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")).alias(c) for c in names))


def sharing(documents: DataFrame) -> DataFrame:
    """What the shared table takes from a document, with whether it is shared (null: not)."""
    return documents.select(F.col("id").alias("document_id"), "filename", "user_id", F.coalesce("share_to_global", F.lit(False)).alias("shared"))


def shared_feed(documents_before: DataFrame, documents: DataFrame, clusters_before: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, op, reason, document_id, label, filename, user_id, avg_cti, centroid) of the table of shared clusters.

    reason: shared or unshared (the document's flag turned), added or removed (the cluster came or went), changed
    (the document's or the cluster's columns).  Clusters of documents that are shared neither before nor now aren't compared.
    """
    flags = changes(sharing(documents_before), sharing(documents), "document_id").select("document_id", F.col("op").alias("turn"), F.col("shared").alias("_to"))
    was, now = (sharing(d).where("shared").drop("shared") for d in (documents_before, documents))

    def rows(c: DataFrame, d: DataFrame) -> DataFrame:
        return c.select("id", "document_id", F.coalesce("custom_label", "label").alias("label"), "avg_cti", "centroid").join(d, "document_id")

    feed = changes(rows(clusters_before, was), rows(clusters, now))
    turned: Column = F.col("turn").isNotNull()
    reason = F.when((F.col("op") == "insert") & turned & F.col("_to"), "shared").when((F.col("op") == "delete") & turned & ((F.col("turn") == "delete") | ~F.col("_to")), "unshared")
    reason = F.coalesce(reason, F.when(F.col("op") == "insert", "added").when(F.col("op") == "delete", "removed").otherwise("changed"))
    return feed.join(flags, "document_id", "left").select("id", "op", reason.alias("reason"), "document_id", "label", "filename", "user_id", "avg_cti", "centroid")


def apply_feed(stored: DataFrame, feed: DataFrame, key: str = "id") -> DataFrame:
    """The stored table after a feed; a feed that is applied again changes nothing."""
    kept = stored.join(feed.select(key), key, "left_anti")
    return kept.unionByName(feed.where("op <> 'delete'").select(*stored.columns))


def apply_to(tables: Snapshots, feed: DataFrame, mark: tuple[str, int] | None = None, table: str = "shared_clusters") -> int | None:
    """A feed applied to the stored table as one new version: only buckets with changes are read and written."""
    if mark and tables.mark(mark[0]) >= mark[1]:
        return None
    rows = feed.drop("reason")
    touched = tables.buckets(rows, "id")
    if not touched:
        return None
    stored = tables.read(table, touched)
    change = tables.change()
    change.replace(table, rows.where("op <> 'delete'").drop("op") if stored is None else apply_feed(stored, rows), "id", touched)
    return change.commit(mark)
