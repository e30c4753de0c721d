"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target by its weight; documents of a source stand in a
shuffled queue (order of an md5 of the id), up to `epochs` times.  A copy's
virtual finish time is the running sum of its source's words divided by the
source's target.  Copies are served in order of finish time until the total
budget is used.

No window spans a source, all sources or the whole queue: rows are range-sorted
to partitions, partitions are summed first, and a window sees the rows of one
partition, or one row a partition.  Where the budget runs out is found by
steps: finish times are summed in `STEPS` equal bands, then in as many parts of
the band in which it runs out, until that band holds few copies.

Null text has size 0 (taken 0), a null source is a source of its own (last in
order), tied and repeated rows are ordered by md5, id and size (rows alike in all take turns in any order),
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.shared import stash
from .textkit import words_of

# Weights in order of the source's name, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a range-sorted partition, about; copies of a band that are ordered in one window; bands a step.
SLICE_ROWS, BAND_ROWS, STEPS = 100_000, 10_000, 2048


def running(rows: DataFrame, order: list, slice_rows: int = SLICE_ROWS, **sums: Column) -> DataFrame:
    """rows with, for each of `sums`, its sum over all rows before in `order` (0 for the first; whole numbers or doubles)."""
    parts = max(1, -(-rows.count() // slice_rows))
    placed = rows.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    placed = stash(placed)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row a partition meets here.
    starts = placed.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}_all") for k in sums])
    starts = starts.select(F.col("_part").alias("_p"), *[zero(f"_{k}_all", W.orderBy("_part")).alias(f"_{k}_start") for k in sums])
    inside = placed.withColumns({f"_{k}_in": zero(f"_{k}", W.partitionBy("_part").orderBy(*order)) for k in sums})
    joined = inside.join(F.broadcast(starts) if parts <= 100_000 else starts, F.col("_part") == F.col("_p"))
    return joined.withColumns({k: F.col(f"_{k}_start") + F.col(f"_{k}_in") for k in sums}).drop("_part", "_p", *[f"_{k}{x}" for k in sums for x in ("", "_start", "_in")])


def targets(sources: DataFrame, share: float = 1.5, epochs: int = 2, weights=WEIGHTS) -> DataFrame:
    """sources(source, source_size, n) -> the same and target: weight shares of share x all words, none above epochs x its own words.

    The excess goes round by weight until no target is above its cap: with sources in order of cap/weight, the capped
    ones are a prefix, so the level is found by two running sums.  One row a source.
    """
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_before") % len(weights) + 1).cast("int"))
    out = running(sources, order, _before=F.lit(1)).withColumn("_w", weight).drop("_before")
    out = out.withColumn("_cap", (F.lit(epochs) * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = out.agg(F.coalesce(F.sum("source_size") * F.lit(share), F.lit(0.0)).alias("budget"), F.sum("_w").alias("w")).first()
    out = stash(running(out, [F.col("_ratio"), *order], _done=F.col("_cap"), _passed=F.col("_w")))
    level = out.withColumn("_level", (F.lit(whole.budget) - F.col("_done")) / (F.lit(whole.w) - F.col("_passed")))
    # Sources are capped up to the first open one; its level holds for all that follow.
    open_ = level.where(F.col("_ratio") > F.col("_level")).agg(F.min_by("_level", F.struct("_ratio", F.col("source").isNull().alias("n"), "source")).alias("level")).first().level
    target = F.col("_cap") if open_ is None else F.least(F.col("_cap"), F.lit(open_) * F.col("_w"))
    return out.withColumn("target", target).drop("_w", "_cap", "_ratio", "_done", "_passed")


def _last_served(copies: DataFrame, budget: float, band_rows: int, steps: int) -> float:
    """The latest finish time that is served: copies(size, finish) in order of finish, those that finish together going together."""
    about = copies.agg(F.min("finish").alias("low"), F.max("finish").alias("high"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    if not about.n:
        return float("-inf")
    if about.size <= budget:
        return about.high
    low, high, n, before, last = about.low, about.high, about.n, 0, float("-inf")
    while n > band_rows and high > low:
        wide = (high - low) / steps
        band = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(wide)), F.lit(steps - 1)) if wide > 0 else F.lit(0)
        bands = sorted(copies.groupBy(band.alias("band")).agg(F.sum("size").alias("size"), F.min("finish").alias("low"), F.max("finish").alias("high"), F.count(F.lit(1)).alias("n")).collect(), key=lambda b: b.low)
        for b in bands:  # at most `steps`
            if before + b.size > budget:
                break
            before, last = before + b.size, b.high
        low, high, n = b.low, b.high, b.n
        copies = copies.where(F.col("finish").between(low, high))
        if len(bands) == 1:  # neighbouring doubles
            break
    run = copies.withColumn("_run", F.lit(before) + F.sum("size").over(W.orderBy("finish")))
    within = run.where(F.col("_run") <= F.lit(budget)).agg(F.max("finish").alias("last")).first().last
    return last if within is None else within


def mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, weights=WEIGHTS, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix", slice_rows: int = SLICE_ROWS, band_rows: int = BAND_ROWS, steps: int = STEPS) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken."""
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    sized = stash(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), order.alias("_order"), F.monotonically_increasing_id().alias("_tie")))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = targets(per_source, share, epochs, weights)
    budget = per_source.agg(F.sum("source_size")).first()[0]
    if budget is None:
        return sized.select("doc_id", "source", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    budget *= share
    # Words before a document in the order of all sources' queues, less those of the sources before its own.
    queue = running(sized, [F.col("source").asc_nulls_last(), "_order", "doc_id", "size", "_tie"], slice_rows, _ahead=F.col("size"))
    begins = running(per_source, [F.col("source").asc_nulls_last()], slice_rows, _begin=F.col("source_size")).withColumnRenamed("source", "_s")
    queued = queue.join(begins, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_upto", F.col("_ahead") - F.col("_begin") + F.col("size"))
    times = F.array(*[(F.col("_upto") + F.lit(e) * F.col("source_size")) / F.col("target") for e in range(epochs)])
    queued = stash(queued.withColumn("_finish", F.when(F.col("size") > 0, times)).select("doc_id", "source", "size", "source_size", "target", "_finish"))
    last = _last_served(queued.select("size", F.explode("_finish").alias("finish")), budget, band_rows, steps)
    served = F.size(F.filter(F.coalesce("_finish", F.array().cast("array<double>")), lambda f: f <= F.lit(last)))
    return queued.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * served).cast("long").alias("taken"))


def take(docs: DataFrame, **how) -> DataFrame:
    """docs (columns doc_id, source, text and any others) that the mix takes, with size, source_size, target and taken.

    The four replace columns of these names.  Rows that repeat an id and size are told apart by a rank, so each gets
    its own share.
    """
    added = ("size", "source_size", "target", "taken")
    mixed = mix(docs, **how)
    twin = W.partitionBy("_id", "_size").orderBy("taken")
    mixed = mixed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "source_size", "target", "taken").withColumn("_rank", F.row_number().over(twin)).where("taken > 0")
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in added]).alias("_row"), F.col("doc_id").alias("_own_id"), F.xxhash64("text").alias("_h"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    packed = packed.withColumn("_own", F.row_number().over(W.partitionBy("_own_id", "size").orderBy("_h")))
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("_own") == F.col("_rank"))
    return packed.join(mixed, same).select("_row.*", *added)
