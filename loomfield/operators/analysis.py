"""Vocabulary, TF-IDF, k-means, projection and labels, for all documents at once.

Units are (document_id, idx, text): idx orders the units of a document.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicon import STOP_WORDS
from ..functions.text import TOKEN, term_tokens, tokenize
from .shared import scratch, stash

VOCABULARY, LEAST_DF, MOST_SHARE = 100, 2, 0.8
#: Units of a packed row: Spark's reader holds 4,096 rows at once, here 100 MB at most.
BLOCK = 32
_STOP = frozenset(STOP_WORDS)
#: Tokens of documents that a task counts before it sends what it has.
COUNTED = 200_000


def distinct_terms(units: DataFrame) -> DataFrame:
    """(document_id, idx, token, first_pos): a unit's tokens without stop words, each once, numbered by first appearance; no shuffle."""
    return units.select("document_id", "idx", F.posexplode(F.array_distinct(term_tokens(F.col("text")))).alias("first_pos", "token"))


def term_totals(units: DataFrame) -> DataFrame:
    """(token, n, units): how often a token without stop words occurs, and in how many units; one shuffle, of partial sums."""
    terms = units.select(term_tokens(F.col("text")).alias("_t"))
    said = F.transform("_t", lambda t: F.struct(t.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("units")))
    held = F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("units")))
    each = terms.select(F.explode_outer(F.concat(said, held)).alias("e")).where(F.col("e").isNotNull())
    return each.groupBy(F.col("e.token").alias("token")).agg(F.sum("e.n").alias("n"), F.sum("e.units").alias("units"))


def token_counts(units: DataFrame, *more: str) -> DataFrame:
    """(document_id, idx, *more, token, tf, first_pos, max_tf) without stop words; max_tf is the unit's most frequent token's, stop words included.

    Tokens are sorted within their row and equal ones are neighbours then, so nothing is shuffled.  A row is a unit: rows
    that repeat (document_id, idx) are counted apart.
    """
    keys = ["document_id", "idx", *more]
    placed = F.transform(tokenize(F.col("text")), lambda w, i: F.struct(w.alias("token"), i.alias("pos")))
    # Steps of their own: a lambda that held the sort itself would sort again for each token.
    out = units.select(*keys, F.sort_array(placed).alias("_s"))
    starts = F.transform("_s", lambda x, i: F.when((i == 0) | (x["token"] != F.get("_s", i - 1)["token"]), i))
    out = out.select(*keys, "_s", F.array_compact(starts).alias("_k"))
    runs = F.transform("_k", lambda k, j: F.struct(F.get("_s", k)["token"].alias("token"), (F.coalesce(F.get("_k", j + 1), F.size("_s")) - k).alias("tf"), F.get("_s", k)["pos"].alias("first_pos")))
    out = out.select(*keys, runs.alias("_r"))
    terms = F.filter("_r", lambda r: ~r["token"].isin(list(STOP_WORDS)))
    out = out.select(*keys, F.array_max(F.transform("_r", lambda r: r["tf"])).alias("max_tf"), terms.alias("_t"))
    # Outer, or a check for empty arrays would be pushed below all the steps, and they with it into one expression.
    out = out.select(*keys, "max_tf", F.explode_outer("_t").alias("_t")).where(F.col("_t").isNotNull())
    return out.select(*keys, "_t.token", "_t.tf", "_t.first_pos", "max_tf")


def _ranked(tokens: DataFrame, keys: list[str], count: str) -> DataFrame:
    """tokens(*keys, token, `count`, seen, first_pos) with `rank`: most frequent first; ties: whole numbers in ascending order, then by first appearance."""
    number = F.when(F.col("token").rlike("^(0|[1-9][0-9]{0,8})$"), F.col("token").cast("long"))
    return tokens.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(count), number.asc_nulls_last(), "seen", "first_pos")))


def _seen():
    """Where a token is seen first: two plain aggregates, as the least of a struct would sort every token."""
    return F.min("idx").alias("seen"), F.min_by("first_pos", "idx").alias("first_pos")


def vocabulary(terms: DataFrame, units: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(document_id, token, df, n, rank): terms of 2 units at least and under 80 % of them, the `size` most frequent.

    terms: distinct_terms or token_counts of the units.  Only partial counts of (document, token) are shuffled.
    """
    return _chosen(terms.groupBy("document_id", "token").agg(F.count(F.lit(1)).alias("df"), *_seen()), units, size)


def _chosen(df: DataFrame, units: DataFrame, size: int) -> DataFrame:
    n = units.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    able = df.where(F.col("df") >= LEAST_DF).join(n, "document_id").where(F.col("df") < F.col("n") * MOST_SHARE)
    return _ranked(able, ["document_id"], "df").where(F.col("rank") <= size).select("document_id", "token", "df", "n", "rank")


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(document_id, idx, rank, token, weight): tf over the unit's most frequent token (stop words included), times ln(n / df)."""
    held = counts.join(vocab, ["document_id", "token"])
    return held.withColumn("weight", F.col("tf") / F.col("max_tf") * F.ln(F.col("n") / F.col("df"))).select("document_id", "idx", "rank", "token", "weight")


def dense(units: DataFrame, weights: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(document_id, idx, vector) of `size` numbers, zeros where a term is missing; every unit has one."""
    per = weights.groupBy("document_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("rank", "weight"))).alias("m"))
    joined = units.select("document_id", "idx").join(per, ["document_id", "idx"], "left")
    empty = F.create_map().cast("map<int,double>")
    return joined.select("document_id", "idx", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at(F.coalesce("m", empty), i), F.lit(0.0))).alias("vector"))


def choose_k(n):
    return F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 6))).cast("int")


def seeds(vectors: DataFrame) -> DataFrame:
    """(document_id, cluster, centroid): the k units with the least hash of their index: distinct, and the same every time."""
    n = vectors.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("document_id").orderBy(F.xxhash64("idx"), "idx")
    first = vectors.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 5)  # cut before the shuffle
    ranked = first.withColumn("cluster", F.col("_rn") - 1).join(n, "document_id")
    return ranked.where(F.col("cluster") < choose_k(F.col("n"))).select("document_id", "cluster", F.col("vector").alias("centroid"))


def _cos(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.round(dot / F.nullif(size(a) * size(b), F.lit(0.0)), 12), F.lit(0.0))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with `cluster`: the most similar centroid of the document, the lowest number on ties; zero vectors go to cluster 0."""
    listed = centroids.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("cs"))
    scored = vectors.join(listed, "document_id").withColumn("_s", F.transform("cs", lambda c: F.struct(_cos(F.col("vector"), c["centroid"]).alias("s"), (-c["cluster"]).alias("c"))))
    return scored.withColumn("cluster", (-F.array_max("_s")["c"]).cast("int")).drop("cs", "_s")


def centroids_of(assigned: DataFrame, before: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """Means of the members; a cluster without members keeps its centroid."""
    mean = F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(size)])
    new = assigned.groupBy("document_id", "cluster").agg(mean.alias("_new"))
    return before.join(new, ["document_id", "cluster"], "left").select("document_id", "cluster", F.coalesce("_new", "centroid").alias("centroid"))


def _in_order(batch):
    """The batch's rows by document, as they came, and where each document's begin."""
    code = batch.column("document_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return batch.take(pa.array(order)), np.concatenate([[0], np.cumsum(np.bincount(code))]).tolist()


def _listed(at, values):
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _blocks(vectors: DataFrame) -> DataFrame:
    """(document_id, idx, h, v): up to BLOCK units of a document that share an Arrow batch as a row, h the hashes of idx; of the vectors' numbers that aren't zero how many a unit has (vn), their places (vr) and they themselves (v), as bytes; nothing is shuffled."""
    kinds = dict(vectors.dtypes)

    def pack(batches):
        for b in batches:
            b, ends = _in_order(b)
            wide = np.append(0, np.cumsum(b.column("vector").value_lengths().to_numpy(zero_copy_only=False)))
            yield _packed(b, ends, b.column("vector").flatten().to_numpy(zero_copy_only=False), wide)

    rows = vectors.where("document_id IS NOT NULL").select("document_id", "idx", F.xxhash64("idx").alias("h"), "vector")
    return rows.mapInArrow(pack, f"document_id {kinds['document_id']}, idx array<{kinds['idx']}>, h array<long>, vn binary, vr binary, v binary")


def _packed(b, ends, numbers: np.ndarray, wide: np.ndarray):
    """Blocks of rows (document_id, idx, h) in order; wide: where the numbers of each row begin."""
    at = np.array([i for one, two in pairwise(ends) for i in range(one, two, BLOCK)], np.int64)
    cut = np.append(at, b.num_rows)
    at_number = np.flatnonzero(numbers)
    row = np.searchsorted(wide, at_number, side="right") - 1
    held = np.bincount(row, minlength=b.num_rows)
    until = np.append(0, np.cumsum(held))[cut]
    parts = _bytes(held.astype(np.uint16), cut), _bytes((at_number - wide[row]).astype(np.uint16), until), _bytes(numbers[at_number].astype(np.float64), until)
    return pa.RecordBatch.from_arrays([b.column("document_id").take(pa.array(at)), _listed(cut, b.column("idx")), _listed(cut, b.column("h")), *parts], ["document_id", "idx", "h", "vn", "vr", "v"])


def _bytes(values: np.ndarray, cut: np.ndarray):
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _numbers(column, kind) -> np.ndarray:
    if not len(column):
        return np.empty(0, kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind)


def term_counts(units: DataFrame) -> DataFrame:
    """(document_id, token, df, seen, first_pos) of parts of the units: as `distinct_terms` counted by document, each unit's tokens cut once, in Python, and only counts leave a task."""
    kinds = dict(units.dtypes)

    def count(batches):
        find, found, n = re.compile(TOKEN).findall, {}, 0
        for b in batches:
            for doc, idx, low in zip(*(b.column(c).to_pylist() for c in ("document_id", "idx", "low")), strict=True):
                own = found.setdefault(doc, {})
                before = len(own)
                for pos, token in enumerate(t for t in dict.fromkeys(find(low)) if t not in _STOP):
                    e = own.get(token)
                    if e is None:
                        own[token] = [1, idx, pos]
                    else:
                        e[0] += 1
                        if idx is not None and (e[1] is None or idx < e[1]):
                            e[1], e[2] = idx, pos
                n += len(own) - before
                if n >= COUNTED:
                    yield sent(found)
                    found, n = {}, 0
        if n:
            yield sent(found)

    def sent(found):
        rows = [(doc, token, *e) for doc, own in found.items() for token, e in own.items()]
        types = (pa.string() if kinds["document_id"] == "string" else None, pa.string(), pa.int64(), None, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["document_id", "token", "df", "seen", "first_pos"])

    low = units.where("text IS NOT NULL").select("document_id", F.col("idx").cast("long").alias("idx"), F.lower("text").alias("low"))
    return low.mapInArrow(count, f"document_id {kinds['document_id']}, token string, df long, seen long, first_pos int")


def text_blocks(units: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """Packed units(document_id, idx, text), with the vectors that `dense` makes of `tfidf`.

    Tokens are cut and counted in Python, a batch of texts at a time, once for the vocabulary and once for the vectors; no
    token of a unit is shuffled.  A row is a unit: rows that repeat (document_id, idx) are counted apart.
    """
    kinds = dict(units.dtypes)
    df = term_counts(units).groupBy("document_id", "token").agg(F.sum("df").alias("df"), F.min("seen").alias("seen"), F.min_by("first_pos", "seen").alias("first_pos"))
    vocab = _chosen(df, units, size).withColumn("idf", F.ln(F.col("n") / F.col("df")))
    held = F.array_sort(F.collect_list(F.struct("rank", "token", "idf")))
    listed = stash(vocab.groupBy("document_id").agg(held.alias("t")).select("document_id", F.col("t.rank").alias("rank"), F.col("t.token").alias("token"), F.col("t.idf").alias("idf")))
    rows = units.where("document_id IS NOT NULL").select("document_id", "idx", F.xxhash64("idx").alias("h"), F.lower("text").alias("low"))

    def pack(batches):
        find = re.compile(TOKEN).findall
        for b in batches:
            b, ends = _in_order(b)
            numbers, low = np.zeros((b.num_rows, size)), b.column("low").to_pylist()
            for one, two in pairwise(ends):
                if one == two or not b.column("token")[one].is_valid:
                    continue
                terms = {t: (r - 1, x) for t, r, x in zip(*(b.column(c)[one].as_py() for c in ("token", "rank", "idf")), strict=True)}
                for i in range(one, two):
                    counts = Counter(find(low[i] or ""))
                    most = max(counts.values(), default=1)
                    for token in counts.keys() & terms.keys():
                        r, x = terms[token]
                        numbers[i, r] = counts[token] / most * x
            yield _packed(b, ends, numbers.reshape(-1), np.arange(b.num_rows + 1) * size)

    return rows.join(listed, "document_id", "left").mapInArrow(pack, f"document_id {kinds['document_id']}, idx array<{kinds['idx']}>, h array<long>, vn binary, vr binary, v binary")


def _block_seeds(blocks: DataFrame, size: int) -> DataFrame:
    """`seeds` of packed units: each block names its first few."""
    kind = dict(blocks.dtypes)["idx"].removeprefix("array<").removesuffix(">")

    def least(batches):
        for b in batches:
            b, ends = _in_order(b)
            for one, two in pairwise(ends):
                own = b.slice(one, two - one)
                table = pa.table({"h": own.column("h").flatten(), "idx": own.column("idx").flatten()})
                at = pc.sort_indices(table, [("h", "ascending"), ("idx", "ascending")], null_placement="at_start")[:5]
                vector = pa.array(list(_matrix(own, "v", size)[at.to_numpy()]), pa.list_(pa.float64()))
                picked = table.take(at).combine_chunks()
                yield pa.RecordBatch.from_arrays([own.column("document_id").take(pa.array([0] * len(at))), *(picked[c].combine_chunks() for c in ("h", "idx")), vector], ["document_id", "h", "idx", "vector"])

    first = blocks.mapInArrow(least, f"document_id {dict(blocks.dtypes)['document_id']}, h long, idx {kind}, vector array<double>")
    n = blocks.groupBy("document_id").agg(F.sum(F.size("idx")).alias("n"))
    ranked = first.withColumn("cluster", F.row_number().over(W.partitionBy("document_id").orderBy("h", "idx")) - 1).join(n, "document_id")
    return ranked.where(F.col("cluster") < choose_k(F.col("n"))).select("document_id", "cluster", F.col("vector").alias("centroid"))


def _matrix(batch, column: str, size: int) -> np.ndarray:
    values = batch.column(column)
    if pa.types.is_binary(values.type):
        held = _numbers(batch.column("vn"), np.uint16)
        out = np.zeros((len(held), size))
        out[np.repeat(np.arange(len(held)), held), _numbers(batch.column("vr"), np.uint16)] = _numbers(values, np.float64)
        return out
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """As `assign`: the most similar centroid to 12 decimals, the first of equals."""
    sizes = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((centroids * centroids).sum(1))
    return np.round(np.divide(x @ centroids.T, sizes, out=np.zeros_like(sizes), where=sizes > 0), 12).argmax(1)


def kmeans(vectors: DataFrame, rounds: int = 20, size: int = VOCABULARY) -> DataFrame:
    """(document_id, idx, vector, cluster), until no unit of any document changes its cluster; only the last table stays.

    Units are written once, packed by document, and a round reads them once: each block gives sums of its clusters and how
    many of its units the centroids before put elsewhere, so neither units nor their clusters are shuffled or written.
    Units without a document are left out.
    """
    return clustered(_blocks(vectors), rounds, size)


def clustered(packed: DataFrame, rounds: int = 20, size: int = VOCABULARY) -> DataFrame:
    """`kmeans` of packed units."""
    kinds = {c: k.removeprefix("array<").removesuffix(">") for c, k in packed.dtypes}
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cluster", c))), lambda x: x[c]))

    def sums(batches):
        for b in batches:
            b, ends = _in_order(b)
            for one, two in pairwise(ends):
                own, first = b.slice(one, two - one), b.slice(one, 1)
                x, c = _matrix(own, "v", size), _matrix(first, "now", size)
                cluster = _nearest(x, c)
                was = _nearest(x, _matrix(first, "before", size)) if first.column("before")[0].is_valid else np.zeros(len(x), int)
                mine = cluster == np.arange(len(c))[:, None]
                counts = [pa.array(np.arange(len(c)), pa.int32()), pa.array(mine.sum(1)), pa.array((mine & (cluster != was)).sum(1))]
                lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (mine @ x, c)]
                yield pa.RecordBatch.from_arrays([first.column("document_id").take(pa.array([0] * len(c))), *counts, *lists], ["document_id", "cluster", "n", "moved", "s", "centroid"])

    def give(batches):
        for b in batches:
            b, ends = _in_order(b)
            cluster = [_nearest(_matrix(b.slice(one, two - one), "v", size), _matrix(b.slice(one, 1), "now", size)) for one, two in pairwise(ends)]
            ids = b.column("idx").flatten()
            doc = b.column("document_id").take(pa.array(np.repeat(np.arange(b.num_rows), b.column("idx").value_lengths().to_numpy(zero_copy_only=False))))
            vector = _listed(np.arange(len(ids) + 1) * size, pa.array(_matrix(b, "v", size).reshape(-1)))
            yield pa.RecordBatch.from_arrays([doc, ids, vector, pa.array(np.concatenate([np.empty(0, int), *cluster]), pa.int32())], ["document_id", "idx", "vector", "cluster"])

    doc = f"document_id {kinds['document_id']}"
    with scratch() as keep:
        blocks = stash(packed)
        now = stash(_block_seeds(blocks, size).groupBy("document_id").agg(listed("centroid").alias("now"), F.lit(None).cast("array<double>").alias("before")))
        for left in reversed(range(rounds)):
            met = blocks.join(now, "document_id")
            total = met.mapInArrow(sums, f"{doc}, cluster int, n long, moved long, s array<double>, centroid array<double>").groupBy("document_id", "cluster")
            total = stash(total.agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(size)]).alias("s"), F.any_value("centroid").alias("centroid")))
            if not left or not total.agg(F.sum("moved")).first()[0]:
                break
            mean = F.when(F.col("n") > 0, F.transform("s", lambda x: x / F.col("n"))).otherwise(F.col("centroid"))
            now = stash(total.withColumn("mean", mean).groupBy("document_id").agg(listed("mean").alias("now"), listed("centroid").alias("before")))
        return keep(stash(met.select("document_id", "idx", "vn", "vr", "v", "now").mapInArrow(give, f"{doc}, idx {kinds['idx']}, vector array<double>, cluster int")))


def project(vectors: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(document_id, idx, x, y): the two leading principal components, each axis stretched to [-3.5, 3.5].

    A document's covariance is summed from partial products of its units' batches, size x size numbers each, so units
    never meet in one task; the sign of a component makes its largest loading positive.  A flat axis is -3.5.
    """

    def partial(batches):
        for pdf in batches:
            for doc, own in pdf.groupby("document_id", dropna=False):
                x = np.array(own["vector"].tolist())
                yield pd.DataFrame({"document_id": [doc], "n": [float(len(x))], "s": [x.sum(0)], "p": [(x.T @ x).reshape(-1)]})

    def solve(key, pdf):
        n, s = pdf["n"].sum(), np.sum(pdf["s"].tolist(), 0)
        p = np.sum(pdf["p"].tolist(), 0).reshape(size, size)
        _, v = np.linalg.eigh(p - np.outer(s, s) / n)
        axes = [v[:, -1], v[:, -2]]
        axes = [a * np.sign(a[np.argmax(np.abs(a))] or 1.0) for a in axes]
        return pd.DataFrame({"document_id": [key[0]], "mean": [s / n], "one": [axes[0]], "two": [axes[1]]})

    parts = vectors.select("document_id", "vector").mapInPandas(partial, "document_id string, n double, s array<double>, p array<double>")
    axes = parts.groupBy("document_id").applyInPandas(solve, "document_id string, mean array<double>, one array<double>, two array<double>")
    dot = lambda a: F.aggregate(F.zip_with(F.zip_with("vector", "mean", lambda x, m: x - m), a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    raw = vectors.join(axes, "document_id").select("document_id", "idx", F.round(dot("one"), 12).alias("rx"), F.round(dot("two"), 12).alias("ry"))
    return stretch(raw)


def stretch(raw: DataFrame) -> DataFrame:
    """rx, ry to x, y in [-3.5, 3.5] per document; bounds are aggregated, then joined."""
    ends = raw.groupBy("document_id").agg(F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"))
    span = lambda v, a, b: (F.col(v) - F.col(a)) / F.coalesce(F.nullif(F.col(b) - F.col(a), F.lit(0.0)), F.lit(1.0)) * 7 - 3.5
    return raw.join(ends, "document_id").select("document_id", "idx", span("rx", "x0", "x1").alias("x"), span("ry", "y0", "y1").alias("y"))


def cluster_labels(units: DataFrame, terms: int = 3) -> DataFrame:
    """units(document_id, cluster_id, idx, text) -> label of the most frequent terms (ties: first appearance) and description."""
    tf = token_counts(units, "cluster_id").groupBy("document_id", "cluster_id", "token").agg(F.sum("tf").alias("tf"), *_seen())
    best = _ranked(tf, ["document_id", "cluster_id"], "tf").where(F.col("rank") <= terms)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda t: F.concat(F.upper(F.substring(t["token"], 1, 1)), F.substr(t["token"], F.lit(2))))
    label = best.groupBy("document_id", "cluster_id").agg(F.array_join(named, " · ").alias("label"))
    text = F.min_by("text", "idx")
    first = units.groupBy("document_id", "cluster_id").agg(F.concat(F.substring(text, 1, 120), F.when(F.length(text) > 120, "…").otherwise("")).alias("description"))
    return first.join(label, ["document_id", "cluster_id"], "left").withColumn("label", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id") + 1)))


def cluster_summary(units: DataFrame, k: DataFrame) -> DataFrame:
    """Count, means and centre of every cluster 0 .. k-1 of k(document_id, k); empty ones too."""
    every = k.select("document_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cluster_id"))
    own = units.groupBy("document_id", "cluster_id").agg(F.count(F.lit(1)).alias("unit_count"), F.avg("fz").alias("avg_fz"), F.avg("fy").alias("avg_fy"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(own, ["document_id", "cluster_id"], "left").select("document_id", "cluster_id", *map(zero, ("unit_count", "avg_fz", "avg_fy", "cx", "cy")))


def field_stats(units: DataFrame) -> DataFrame:
    return units.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_units"), F.count_if(F.col("fz") > 0.65).alias("boundary_units"), F.avg("fz").alias("avg_fz"), F.avg("fy").alias("avg_fy"))
