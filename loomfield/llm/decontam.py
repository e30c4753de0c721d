"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (up to 8, 16, 32, ...).
A long document has a Jaccard similarity near nothing with a short item that it
holds, so documents are cut into blocks of 8 shingles and compared by runs of
blocks as long as the partition's items.  A run and an item that agree on any
minimum are a candidate; candidates are verified by exact containment in the
shingle set of the whole document.

The number of minima in a partition follows from the containment threshold: of
n shingles of an item at least 3/4 n are in the document, and each, where it is
the item's minimum, is the minimum of a run around it too unless one of the
run's other shingles is less, so a minimum meets with probability 3/4 n /
(n + run) at least, wherever the item's shingles stand.  So many minima are
taken that a contained item, together or scattered, is missed with probability
below `MISS`.

Block minima are computed once and serve all partitions.  Items are indexed and
sent to the tasks in blocks of at most `ITEM_BLOCK` items and about `ITEM_BYTES`
bytes; more items are more passes, so what is broadcast at once doesn't grow with
the benchmark.  Documents are not shuffled.

Null, empty and short texts are documents without (or with one) shingle; items
without words match nothing; repeated items are reported once an id; rows keep
their order id; an empty benchmark contaminates nothing.  Rows that repeat an id,
or have none, are judged each by its own text, however many items there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stash
from .textkit import grouped_minima, permutations, shingle_hashes

CONTAINMENT, WIDTH, BLOCK, MISS, SLAB = 0.75, 5, 8, 1e-6, 200_000
ITEM_BLOCK, ITEM_BYTES, MOST_MINIMA = 20_000, 16 << 20, 256


class ItemIndex:
    """Minima of one block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]]):
        sets = {}
        for item, text in items:
            if item is not None and len(s := np.unique(shingle_hashes(text, WIDTH))):
                sets[item] = s if item not in sets else np.union1d(sets[item], s)
        self.ids = list(sets)
        self.sets = [sets[i] for i in self.ids]
        self.xor, self.mul = permutations(MOST_MINIMA, 6)
        parts: dict[int, list[int]] = {}
        for j, s in enumerate(self.sets):
            parts.setdefault(max(3, math.ceil(math.log2(len(s)))), []).append(j)
        #: minimum -> [(item, blocks in a run)] for each permutation
        self.held: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(MOST_MINIMA)]
        self.used = 0
        for power, members in parts.items():
            run = math.ceil(2**power / BLOCK) + 1
            least = min(len(self.sets[j]) for j in members)
            shared = max(1.0, CONTAINMENT * least)
            meets = shared / (run * BLOCK + least)
            need = min(MOST_MINIMA, math.ceil(math.log(MISS) / math.log1p(-meets)))
            self.used = max(self.used, need)
            flat = np.concatenate([self.sets[j] for j in members])
            starts = np.cumsum([0, *(len(self.sets[j]) for j in members)])[:-1]
            minima = grouped_minima(flat, starts, self.xor[:need], self.mul[:need])
            for k in range(need):
                for j, value in zip(members, minima[k].tolist(), strict=True):
                    self.held[k].setdefault(value, []).append((j, run))
        # The top 16 bits of a minimum tell most strangers apart at once.
        self.tops = np.zeros((self.used, 1 << 16), bool)
        for k in range(self.used):
            self.tops[k][np.array([v >> 48 for v in self.held[k]], int)] = True

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> list[set[int]]:
        """For each document (its shingles in order end at `ends`), the items that share a minimum with one of its runs."""
        begins = np.concatenate([[0], ends[:-1]])
        counts = -(-(ends - begins) // BLOCK)
        owner = np.repeat(np.arange(len(ends)), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        starts = begins[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        found: list[set[int]] = [set() for _ in ends]
        if not len(starts):
            return found
        for k in range(self.used):
            minima = grouped_minima(hashes, starts, self.xor[k : k + 1], self.mul[k : k + 1])[0]
            for b in np.flatnonzero(self.tops[k][minima >> np.uint64(48)]).tolist():
                value = int(minima[b])
                for item, run in self.held[k].get(value, ()):
                    d = int(owner[b])
                    if item in found[d]:
                        continue
                    low, high = int(first[d]), int(first[d] + counts[d])
                    for begin in range(max(low, b - run + 1), b + 1):
                        if minima[begin : min(high, begin + run)].min() == minima[b]:
                            found[d].add(item)
                            break
        return found


def _search(index) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        for table in batches:
            ids, rows, n = [], [], 0
            for doc, text, digest in zip(table.column(0).to_pylist(), table.column(1), table.column(2).to_pylist(), strict=True):
                ids.append((doc, digest))
                rows.append(shingle_hashes(text.as_py(), WIDTH))
                n += len(rows[-1])
                if n >= SLAB:
                    yield report(items, ids, rows)
                    ids, rows, n = [], [], 0
            if ids:
                yield report(items, ids, rows)

    def report(items: ItemIndex, ids: list, rows: list) -> pa.RecordBatch:
        flat, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        hits, best = [], []
        for row, found in zip(rows, items.candidates(flat, ends), strict=True):
            whole = np.unique(row) if found else row
            exact = [(items.ids[j], int(np.isin(items.sets[j], whole, assume_unique=True).sum()), len(items.sets[j])) for j in found]
            exact = sorted((i, c / n) for i, c, n in exact if 100 * c >= round(100 * CONTAINMENT) * n)
            hits.append([i for i, _ in exact])
            best.append(max((c for _, c in exact), default=0.0))
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array([len(np.unique(r)) for r in rows], pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(best, pa.float64()), pa.array([d for _, d in ids], pa.string())], names=["doc_id", "n_shingles", "item_ids", "containment", "digest"])

    return run


FOUND = "doc_id long, n_shingles long, item_ids array<long>, containment double"


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", digest: bool = False) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, item_ids contained (ascending), containment (the largest); the text's MD5 if asked for."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    about = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-about.n // ITEM_BLOCK), -(-about.size // ITEM_BYTES))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else items
        index = spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in block.toLocalIterator()]))
        # The text's digest parts rows of one id; equal texts have equal findings.
        parts.append(plain.select("doc_id", "text", F.md5("text").alias("digest")).mapInArrow(_search(index), f"{FOUND}, digest string").withColumn("_first", F.lit(int(b == 0))))
    names = ["doc_id", "n_shingles", "item_ids", "containment"]
    if blocks == 1:
        return parts[0].select(*names, *(["digest"] if digest else []))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.groupBy("doc_id", "digest").agg(F.max("n_shingles").alias("n_shingles"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("containment").alias("containment"), F.sum("_first").alias("_rows"))
    return out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).select(*names, *(["digest"] if digest else []))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item, whatever their id; null texts hold none."""
    bad = stash(find_items(docs, benchmark, digest=True).where(F.size("item_ids") > 0).select(F.col("digest").alias("_bad")).distinct())
    packed = docs.select(F.struct("*").alias("_row"), F.md5("text").alias("_digest"))
    return packed.join(bad, F.col("_digest") == F.col("_bad"), "left_anti").select("_row.*")
