"""Quality by nearest-neighbour voting in a latent semantic space.

Labelled texts, at most `SAMPLE` a label, become term vectors
(hashed byte trigrams, and a few ratios of the text's form as terms of their
own, weighted by inverse document frequency); a truncated singular value
decomposition gives `RANK` latent dimensions.  The labelled vectors (at most
2 x SAMPLE x RANK numbers, whatever the corpus) are broadcast.  Every document
is folded in and compared with all of them by exact cosine products, a block of
documents at a time; the `NEIGHBOURS` nearest vote with the square of their
similarity, and votes are divided by the label's share of the sample.

Null and empty texts have no vector and get the share of good labels as score.
With no labelled row every score is 0.5.  Ties in similarity are taken in the
sample's order.  Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import BUCKETS, bounded_sample, one_row_an_id, text_buffers, trigram_counts

SAMPLE, RANK, NEIGHBOURS, BLOCK = 1000, 48, 15, 512
FORM = 8

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b"#*$%&|<>{}[]\\=~^_@")] = 4
_CLASS[list(b"!?")] = 5
_CLASS[list(b".,;:'\"()-")] = 6


def text_terms(data: np.ndarray) -> np.ndarray:
    """Term counts of one whole text: hashed trigrams, then ratios of its form scaled like counts."""
    grams = trigram_counts(data, False)
    n = max(1, len(data))
    kinds = np.bincount(_CLASS[data], minlength=7) / n if len(data) else np.zeros(7)
    words = data.tobytes().split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    fresh = len(set(words)) / max(1, len(words)) ** 0.8 if words else 0.0
    form = np.array([kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], again, min(fresh, 1.5), kinds[1]], np.float32)
    return np.concatenate([grams, form])


def weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """log term frequency x idf, length 1, and the form terms beside them with a weight of their own."""
    grams = np.log1p(terms[:, :BUCKETS]) * idf
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    form = np.sqrt(terms[:, BUCKETS:]) * np.array([1, 1, 2, 3, 0.5, 2, 0.5, 0.5], np.float32)
    return np.concatenate([grams, form], 1)


class Model:
    def __init__(self, terms: np.ndarray, labels: np.ndarray, rank: int = RANK):
        held = (terms[:, :BUCKETS] > 0).sum(0)
        self.idf = np.log((1 + len(terms)) / (1 + held)).astype(np.float32)
        x = weighted(terms, self.idf).astype(np.float32)
        self.mean = x.mean(0)
        rng = np.random.default_rng(2)
        rank = min(rank, *x.shape)
        centred = x - self.mean
        basis = rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32)
        for _ in range(4):  # randomised range finder with power steps
            basis, _ = np.linalg.qr(centred.T @ (centred @ basis))
        _, _, turn = np.linalg.svd(centred @ basis, full_matrices=False)
        self.axes = (basis @ turn.T[:, :rank]).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.good = float(labels.mean())
        self.vectors = self._unit(centred @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        near = self._unit((weighted(terms, self.idf) - self.mean) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** 2
        label = self.labels[best]
        up = (vote * label).sum(1) / max(self.good, 1e-3)
        down = (vote * (1 - label)).sum(1) / max(1 - self.good, 1e-3)
        return up / np.maximum(up + down, 1e-12)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches:
        data, at = text_buffers(table.column(2))
        rows = [text_terms(data[at[i] : at[i + 1]]).tobytes() for i in range(table.num_rows)]
        yield pa.RecordBatch.from_arrays([table.column(0), table.column(1), pa.array(rows, pa.binary())], names=["id", "label", "terms"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for table in batches:
            for b in range(0, table.num_rows, BLOCK):
                part = table.slice(b, BLOCK)
                data, at = text_buffers(part.column(1))
                if model is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    score = model.score(np.stack([text_terms(data[at[i] : at[i + 1]]) for i in range(part.num_rows)])).astype(np.float64)
                    score[np.diff(at) == 0] = model.good
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])

    return run


def learn(labelled: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labelled(id, label in 0/1), docs(doc_id, text) -> model.

    Null ids, labels and texts don't teach, nor does an id that has both labels; of rows of one id one teaches.
    """
    clear = labelled.where("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("_other")).where("label = _other").select("id", "label")
    picked = bounded_sample(clear, "label", sample)
    # At most 2 x sample ids are sent to the scan of the texts, and as many texts come back.
    texts = docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "label", "text")
    rows = one_row_an_id(texts, ["id"], "text").mapInArrow(_terms, "id long, label int, terms binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.id)
    return Model(np.stack([np.frombuffer(r.terms, np.float32) for r in rows]), np.array([r.label for r in rows]))


def rate(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of docs: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
