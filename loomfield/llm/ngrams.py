"""Hashed byte n-grams and bounded training samples for the two classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hashed terms of a text; labels that can teach, in order of their number of texts.
BUCKETS, LABELS = 4096, 200
_PAD = np.zeros(2, np.uint8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, of short or long offsets, without a copy of the bytes."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def trigram_counts(data: np.ndarray, fold: bool, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed byte trigrams of one whole text; fold: A-Z as a-z and digits as one."""
    if fold:
        data = _FOLD[data]
    if len(data) < 3:
        data = np.concatenate([data, _PAD])
    if len(data) < 3:
        return np.zeros(buckets, np.float32)
    total = np.zeros(buckets, np.int64)
    for b in range(0, len(data) - 2, 1 << 18):  # long texts in pieces
        x = data[b : b + (1 << 18) + 2].astype(np.uint32)
        code = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        total += np.bincount(code >> np.uint32(20), minlength=buckets)[:buckets]
    return total.astype(np.float32)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo `parts`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def bounded_sample(keys: DataFrame, label: str, each: int, labels: int = LABELS) -> DataFrame:
    """At most `each` ids of every label (all, where there are fewer), with their label, the same every time.

    keys: (id, label).  The ids with the least hashes are taken; an id that has several rows takes one place.  The share
    of hashes that is ranked follows from the label's rows, four times what is needed, so little is shuffled.  Labels
    beyond the `labels` most frequent (ties: the first in order) don't teach, which bounds the sample whatever the table.
    """
    counts = keys.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_label").limit(labels)
    spot = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    near = keys.select("id", label).join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label"))).where(spot * F.col("_n") < 4 * each + 100)
    first = W.partitionBy(label).orderBy(F.xxhash64("id", F.lit(11)), "id")
    return near.select("id", label).distinct().withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= each).drop("_rank")


def one_row_an_id(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Of rows of one key, the one with the least hash of its text."""
    first = W.partitionBy(*keys).orderBy(F.xxhash64(text))
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
