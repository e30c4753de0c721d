"""Writes as derivations: what the stored tables become.

Parquet has no update; the latest version of a key wins.  Every function
returns the new state of a table (or the rows to append), to be written by the
caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose content this user has not stored yet; owner null equals null."""
    one = stored.select(F.col("user_id").alias("_u"), F.col("content_hash").alias("_h"))
    return incoming.join(one, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("content_hash") == F.col("_h")), "left_anti")


def resolve_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming with the id to use: the stored one where the content is known, and whether it was reused."""
    one = stored.groupBy(F.col("user_id").alias("_u"), F.col("content_hash").alias("_h")).agg(F.min("id").alias("_id"))
    joined = incoming.join(one, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("content_hash") == F.col("_h")), "left")
    return joined.withColumn("reused", F.col("_id").isNotNull()).withColumn("id", F.coalesce("_id", "id")).drop("_u", "_h", "_id")


def new_chunks(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First chunk of each text of a document, without those that are stored."""
    first = keep_first(incoming, ["document_id", "content_hash"], ["chunk_index"])
    return first if stored is None else first.join(stored.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both with the latest version of each key."""
    return keep_first(stored.unionByName(incoming, allowMissingColumns=True), keys, [F.desc(version)])


def upsert_clusters(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming.where("unit_count > 0"), ["document_id", "cluster_id"], "version")


def relabel(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(id, custom_label, updated_at): the latest label wins, a null clears."""
    last = keep_first(labels, ["id"], [F.desc("updated_at")]).select(F.col("id").alias("_id"), F.col("custom_label").alias("_l"), F.col("updated_at").alias("_t"))
    joined = clusters.join(last, F.col("id") == F.col("_id"), "left")
    return joined.withColumn("custom_label", F.when(F.col("_id").isNotNull(), F.col("_l")).otherwise(F.col("custom_label"))).withColumn("custom_label_updated_at", F.col("_t")).drop("_id", "_l", "_t")


def claim_orphans(documents: DataFrame, owner: str) -> DataFrame:
    """Ownerless documents get an owner; `claimed` tells which."""
    return documents.withColumn("claimed", F.col("user_id").isNull()).withColumn("user_id", F.coalesce("user_id", F.lit(owner)))


def shared_clusters(clusters: DataFrame, documents: DataFrame, quality: DataFrame) -> DataFrame:
    """The table of shared clusters, derived whole: clusters of documents that are shared, with quality where there is any."""
    shared = documents.where(F.col("share_to_global").eqNullSafe(F.lit(True))).select(F.col("id").alias("document_id"), "filename", "user_id")
    q = quality.select("id", "cohesion", "separation", "noise_ratio")
    return clusters.join(shared, "document_id").withColumn("label", F.coalesce("custom_label", "label")).join(q, "id", "left")


def without_documents(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cascade of a delete: deleted(document_id)."""
    return rows.join(deleted.select("document_id").distinct(), "document_id", "left_anti")


def clear_embeddings(chunks: DataFrame, dim: int = 3072) -> DataFrame:
    """Model switch: vectors go, the new length is noted."""
    return chunks.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("embedding_dim", F.lit(dim))


def revoke_keys(keys: DataFrame, ids: DataFrame, at) -> DataFrame:
    """Soft delete of API keys."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    return keys.join(gone, F.col("id") == F.col("_id"), "left").withColumn("revoked_at", F.when(F.col("_id").isNotNull(), F.coalesce("revoked_at", at)).otherwise(F.col("revoked_at"))).drop("_id")


def fingerprints(hashes: DataFrame, name: str = "fingerprint") -> DataFrame:
    """hashes(document_id, h) -> (document_id, `name`): SHA-256 of a document's sorted hashes, joined by a bar; nulls left out.

    Spark sorts the hashes, and spills; they are digested as they pass, so no task holds a document's hashes at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, bar, kind = None, None, b"", pa.null()
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], kind), pa.array([x for _, x in rows], pa.string())], names=["document_id", name])
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for document, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or document != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest, bar = document, hashlib.sha256(), b""
                if h is not None:
                    digest.update(bar + h.encode())
                    bar = b"|"
            yield out(done)
        if digest is not None:
            yield out([(at, digest.hexdigest())])

    rows = hashes.select("document_id", "h").repartition("document_id").sortWithinPartitions("document_id", "h")
    return rows.mapInArrow(run, f"document_id {dict(hashes.dtypes)['document_id']}, {name} string")
