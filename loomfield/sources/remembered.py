"""Calls of outside models whose answers are remembered in a table, so that a text is asked once.

The table `answers` of a set of versions holds a row an attempt: the hash of model
and text, and an answer or an error.  A run asks for what an anti-join leaves: distinct
texts with no answer yet and fewer than `tries` failures.  What comes back is written
before anything reads it, as one version, so a reader never causes a call and a run
that dies leaves nothing half told; it asks again for what it hadn't committed.  A
task that Spark runs again asks again for its own batches.

Answers are strings (JSON where they have parts).  Null texts are not asked; empty ones are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_model_json
from ..operators.retrieval import label_samples
from ..operators.shared import stash
from ..operators.snapshots import Snapshots

#: Attempts at a text that fails before it is left alone.
TRIES = 3
#: Characters of an error that are kept.
ERROR = 200

Call = Callable[[list[str]], list[str | None]]


def key_of(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), text), 256)


def _asking(call: Call, batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one_by_one(texts: list[str]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each text; a batch that fails is asked text by text, so that one bad text fails alone."""
        try:
            said = call(texts)
            if len(said) != len(texts):
                raise ValueError(f"{len(said)} answers to {len(texts)} texts")
            return [(a, None if a is not None else "no answer") for a in said]
        except Exception as error:  # the model is outside: any failure is an outcome to record
            if len(texts) == 1:
                return [(None, f"{type(error).__name__}: {error}"[:ERROR])]
            return [r for t in texts for r in one_by_one([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [r for b in range(0, len(pdf), batch) for r in one_by_one(pdf["text"].iloc[b : b + batch].tolist())]
            yield pd.DataFrame({"key": pdf["key"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    return run


def ask(tables: Snapshots, items: DataFrame, model: str, call: Call, batch: int = 20, tries: int = TRIES) -> int | None:
    """Ask for the texts of items(text) that are not answered yet; the new version, or None if nothing was left to ask."""
    wanted = items.where("text IS NOT NULL").select(key_of(model, F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    stored = tables.read("answers")
    if stored is not None:
        done = stored.groupBy("key").agg(F.count("answer").alias("_n"), F.count("error").alias("_e")).where((F.col("_n") > 0) | (F.col("_e") >= tries))
        wanted = wanted.join(done, "key", "left_anti")
    said = stash(wanted.mapInPandas(_asking(call, batch), "key string, answer string, error string"))
    if not said.limit(1).count():
        return None
    change = tables.change()
    change.append("answers", said.select("key", F.lit(model).alias("model"), "answer", "error"), "key")
    return change.commit()


def answered(tables: Snapshots, items: DataFrame, model: str) -> DataFrame:
    """items with `answer`, null where there is none, from the version that `tables` is at."""
    stored = tables.read("answers")
    if stored is None:
        return items.withColumn("answer", F.lit(None).cast("string"))
    # Of answers that two writers gave to one text, the same one for all readers.
    held = stored.where("answer IS NOT NULL").groupBy(F.col("key").alias("_key")).agg(F.min("answer").alias("answer"))
    return items.withColumn("_k", key_of(model, F.col("text"))).join(held, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def failures(tables: Snapshots) -> DataFrame:
    """(model, key, tries, error) of texts that have failed and have no answer."""
    stored = tables.read("answers")
    per = stored.groupBy("model", "key").agg(F.count("answer").alias("_n"), F.count("error").alias("tries"), F.max("error").alias("error"))
    return per.where("_n = 0").drop("_n")


def label_prompts(clusters: DataFrame, chunks: DataFrame, each: int = 6, chars: int = 400) -> DataFrame:
    """(document_id, cluster_id, text): numbered samples of each cluster that has no label of its own."""
    told = F.concat(F.lit("("), F.col("rank"), F.lit(") "), "sample")
    samples = label_samples(clusters, chunks, each, chars).where("sample IS NOT NULL")
    per = samples.groupBy("document_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", told.alias("s")))).alias("s"))
    return per.select("document_id", "cluster_id", F.array_join(F.transform("s", lambda x: x["s"]), "\n").alias("text"))


def label_clusters(tables: Snapshots, clusters: DataFrame, chunks: DataFrame, model: str, call: Call, each: int = 6, chars: int = 400) -> DataFrame:
    """clusters with label and description from a model's reply to their samples; `call` gets the samples and returns the reply.

    Only clusters without a label of their own that have units are asked for.  A reply that doesn't parse, or has no
    label, leaves its cluster as it is.  The same samples are not asked twice.
    """
    prompts = stash(label_prompts(clusters, chunks, each, chars))
    ask(tables, prompts, model, call)
    reply = clean_model_json(F.col("answer"))
    now = Snapshots(tables.spark, tables.root)
    said = answered(now, prompts, model).select("document_id", "cluster_id", reply.alias("_r")).where("_r.label <> ''")
    joined = clusters.join(said, ["document_id", "cluster_id"], "left")
    given = F.col("_r").isNotNull()
    return joined.withColumns({"label": F.when(given, F.col("_r.label")).otherwise(F.col("label")), "description": F.when(given, F.coalesce("_r.description", F.lit(""))).otherwise(F.col("description"))}).drop("_r").select(*clusters.columns)
