"""Incremental ingest: units that arrive as files become stored chunks, and the ranking is renewed.

Splitting, scoring and hashing are stateless column expressions; duplicates
inside the watermark are dropped by state, older ones by the store.  Chunks,
clusters and the ranking of a batch become one version of the stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scoring as S
from ..functions.lexicon import Lexicon
from ..functions.text import content_hash, unit_type
from ..operators.maintain import take_in
from ..operators.snapshots import Snapshots

ARRIVING = "document_id string, chunk_index long, text string, cti double, cluster_id int, arrived timestamp"


def read_units(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def prepare(units: DataFrame, lexicon: Lexicon = Lexicon(), late: str = "1 hour") -> DataFrame:
    """Hash, type and lexical tension; repeated content of a document inside the watermark is dropped."""
    out = units.withColumn("content_hash", content_hash(F.col("text"))).withColumn("type", unit_type(F.col("text"))).withColumn("hedge", S.hedging(F.col("text"), lexicon))
    return out.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["document_id", "content_hash"])


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, lexicon: Lexicon = Lexicon()) -> StreamingQuery:
    """Start the stream: each batch is one version of the tables under `root`; a batch that runs again after its version is there does nothing."""

    def write(batch: DataFrame, number: int) -> None:
        # Batches are numbered by stream, whose id its checkpoint holds: a new checkpoint begins anew.
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        take_in(Snapshots(spark, root), batch, (f"ingest {stream}", number))

    return prepare(read_units(spark, folder), lexicon).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tension_by_window(units: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Average and largest cti of the chunks that arrive in each window, by document."""
    return units.withWatermark("arrived", late).groupBy(F.window("arrived", width), "document_id").agg(F.count(F.lit(1)).alias("chunks"), F.avg("cti").alias("avg_cti"), F.max("cti").alias("max_cti"))
