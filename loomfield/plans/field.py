"""From text units to a scored corpus, all documents in one plan.

units -> chunks -> vectors -> clusters -> plane -> scores -> summaries -> rows to store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.lexicon import Lexicon
from ..functions.text import content_hash, unit_type
from ..operators import analysis as A
from ..operators.chunker import chunk_units
from ..operators.shared import stash
from ..operators.store import fingerprints

#: Frequent words of the given corpus, in place of markers that it doesn't hold.
CORPUS_LEXICON = Lexicon(hedge=("that", "with", "for", "and the"), certainty=("was", "are"), challenge=("this", "from"))


def cluster_means(units: DataFrame) -> DataFrame:
    """Means of the intention and judged members of each cluster, summed map-side; 9 decimals, so that the order of sums can't show."""
    judged = F.col("certainty").isNotNull() & F.col("force").isNotNull() & F.col("tension").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(judged, F.col(c))), 9).alias(c)
    return units.groupBy("document_id", "cluster_id").agg(F.struct(mean("certainty"), mean("force"), mean("tension")).alias("means"), F.count(F.when(judged, 1)).alias("members"))


def score_intentions(units: DataFrame, lexicon: Lexicon = CORPUS_LEXICON) -> DataFrame:
    """units(document_id, cluster_id, text, speech_act, certainty, force, tension) with all intention scores; a column hedge is taken as it is."""
    out = units.join(cluster_means(units), ["document_id", "cluster_id"])
    out = out if "hedge" in out.columns else out.withColumn("hedge", S.hedging(F.col("text"), lexicon))
    out = out.withColumn("deviation", S.cluster_deviation(F.col("certainty"), F.col("force"), F.col("tension"), F.col("means"), F.col("members")))
    out = out.withColumn("discrepancy", S.discrepancy(F.col("speech_act"), F.col("hedge.hedging"), F.col("hedge.challenge")))
    model = F.when(F.col("speech_act").isNotNull(), F.col("tension"))
    out = out.withColumn("triangulated", S.triangulated(model, F.col("hedge.tension"), F.col("discrepancy"), F.col("speech_act"), F.col("deviation")))
    return out.withColumn("cti_score", S.cti(F.col("discrepancy"), F.col("deviation"))).drop("means", "members")


def score_places(units: DataFrame) -> DataFrame:
    """units(document_id, cluster_id, x, y) with distance to the own cluster's centre, and lexical FZ and FY from it."""
    centre = units.groupBy("document_id", "cluster_id").agg(F.round(F.avg("x"), 9).alias("_x"), F.round(F.avg("y"), 9).alias("_y"))
    far = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
    out = units.join(centre, ["document_id", "cluster_id"]).withColumn("distance", far).drop("_x", "_y")
    return out.withColumn("lexical_fz", S.lexical_fz(F.col("distance"))).withColumn("lexical_fy", S.lexical_fy(F.col("distance")))


@dataclass
class Field:
    units: DataFrame
    clusters: DataFrame
    stats: DataFrame
    documents: DataFrame
    rejected: DataFrame


#: Chunks of a document that are kept, by its kind: text, and PDF.
CAPS = {"text": 200, "pdf": 80}


def build_field(units: DataFrame, lexicon: Lexicon = Lexicon(), intentions=None, cap: int | None = 200, least_chunks: int = 3) -> Field:
    """units(document_id, source, position, text); intentions: chunks -> chunks with speech_act, certainty, force, tension (none: null).

    A document keeps its first `cap` chunks (see CAPS; None: all).  Documents with fewer than `least_chunks` chunks are
    listed in `rejected` (document_id, n, reason), with 0 chunks where no sentence was found, and in none of the others.
    """
    # What follows from a text alone is computed once, as the chunks are written: below, each use would compute it again.
    said = {"hedge": S.hedging(F.col("text"), lexicon), "type": unit_type(F.col("text")), "content_hash": content_hash(F.col("text"))}
    chunks = stash(chunk_units(units, cap=cap).withColumns(said))
    counted = units.select("document_id").distinct().join(chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")), "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n"))
    # Written, so that its size is known and a small one is broadcast: the texts then stay where they are.
    counted = stash(counted)
    enough = counted.where(F.col("n") >= least_chunks)
    rejected = counted.where(F.col("n") < least_chunks).withColumn("reason", F.format_string(f"%d chunks, at least {least_chunks} are needed", "n"))
    chunks = chunks.join(enough.select("document_id"), "document_id", "left_semi").withColumnRenamed("chunk_index", "idx")
    chunks = intentions(chunks) if intentions else chunks.withColumns({"speech_act": F.lit(None).cast("string"), **{c: F.lit(None).cast("double") for c in ("certainty", "force", "tension")}})
    grouped = A.clustered(A.text_blocks(chunks))
    plane = A.project(grouped)
    full = chunks.join(grouped.select("document_id", "idx", F.col("cluster").alias("cluster_id")), ["document_id", "idx"]).join(plane, ["document_id", "idx"])
    scored = score_places(score_intentions(full, lexicon))
    fz = S.chosen_fz(F.col("lexical_fz"), F.col("triangulated"), F.col("certainty"), F.col("force"))
    scored = scored.withColumns({"fz": fz, "fy": S.round2(F.col("lexical_fy")), "cti": F.col("cti_score"), "px": S.unit_position(F.col("x")), "py": S.unit_position(F.col("y"))})
    scored = stash(scored.drop("cti_score"))
    k = enough.select("document_id", A.choose_k(F.col("n")).alias("k"))
    clusters = A.cluster_summary(scored, k).join(A.cluster_labels(scored), ["document_id", "cluster_id"], "left")
    clusters = clusters.withColumn("description", F.coalesce("description", F.lit("Empty cluster"))).withColumn("label", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id") + 1)))
    stats = A.field_stats(scored)
    documents = fingerprints(scored.select("document_id", F.col("content_hash").alias("h")), "content_hash")
    return Field(scored, clusters, stats, documents, rejected)
