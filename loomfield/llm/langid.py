"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; one binary classifier a bit (logistic
regression over hashed byte trigrams of the whole text, trained in numpy on a
bounded sample) predicts it.  Decoding adds the logistic losses of a codeword's
bits, each weighted by how well its classifier does on the sample, and takes
the codeword with the least loss.  `ambiguous` marks texts whose second best
codeword is close, or whose bits differ from the chosen codeword by more than
`FAR` of their weight.

Null texts and texts without a letter (Unicode category L) get `und`, score 0, not ambiguous.
Learning takes at most `SAMPLE` texts a language, of the 200 most frequent
languages (documented bounds); with no labelled text every text is `und`.  Ties go to the language first in order.
Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import bounded_sample, one_row_an_id, text_buffers, trigram_counts

#: Texts a language teaches; score below, and share of wrong bits above which a text is ambiguous.
SAMPLE, AMBIGUOUS, FAR = 500, 0.75, 0.25


def codewords(classes: int) -> np.ndarray:
    """(classes, bits) of +1/-1, no two bits equal or opposite, none constant.

    Up to 7 classes every split in two is a bit; for more, of 50 seeded draws the one whose closest rows differ most.
    """
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 7:
        rest = range(1, classes)
        splits = [set(c) for r in range(1, classes) for c in combinations(rest, r)]
        return np.array([[1.0 if i in s else -1.0 for s in splits] for i in range(classes)])
    rng, bits, best, apart = np.random.default_rng(7), int(np.ceil(15 * np.log2(classes))), None, -1
    for _ in range(50):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = rng.choice([-1.0, 1.0], classes)
            c *= c[0]
            if (c < 0).any():
                columns[c.tobytes()] = c
        code = np.stack(list(columns.values()), 1)
        least = min((code[a] != code[b]).sum() for a, b in combinations(range(classes), 2))
        if least > apart:
            best, apart = code, least
    return best


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, scaled to length 1, so a text's length doesn't matter."""
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    def __init__(self, x: np.ndarray, y: list[str]):
        self.languages = sorted(set(y))
        self.code = codewords(len(self.languages))
        self.mean = x.mean(0)
        x = x - self.mean
        target = self.code[[self.languages.index(v) for v in y]]
        # Each language weighs the same.
        share = np.array([1.0 / (len(self.languages) * y.count(v)) for v in y], np.float32)[:, None]
        self.weights, self.bias = np.zeros((x.shape[1], self.code.shape[1]), np.float32), np.zeros(self.code.shape[1], np.float32)
        speed = np.zeros_like(self.weights)
        for _ in range(150):
            margin = target * (x @ self.weights + self.bias)
            pull = (-target / (1 + np.exp(np.clip(margin, -30, 30)))) * share
            speed = 0.9 * speed - 8.0 * (x.T @ pull + 1e-5 * self.weights)
            self.weights += speed.astype(np.float32)
            self.bias -= (4.0 * pull.sum(0)).astype(np.float32)
        right = (share * (target * (x @ self.weights + self.bias) > 0)).sum(0)
        self.trust = np.clip(right, 0.05, 1.0)

    def decode(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        bits = (features(counts) - self.mean) @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -np.clip(bits * c, -30, 30)) * self.trust).sum(1) for c in self.code], 1)
        like = np.exp(-(loss - loss.min(1, keepdims=True)))
        like /= like.sum(1, keepdims=True)
        best = like.argmax(1)
        score = like[np.arange(len(best)), best]
        wrong = ((np.sign(bits) != self.code[best]) * self.trust).sum(1) / self.trust.sum()
        return [self.languages[b] for b in best], score, (score < AMBIGUOUS) | (wrong > FAR)


PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for table in batches:
            for b in range(0, table.num_rows, 512):
                part = table.slice(b, 512)
                data, at = text_buffers(part.column(1))
                texts = part.column(1)
                known = [bool(model) and texts[i].is_valid and any(map(str.isalpha, texts[i].as_py())) for i in range(len(texts))]
                langs, scores, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                rows = [i for i, k in enumerate(known) if k]
                if rows:
                    got, s, d = model.decode(np.stack([trigram_counts(data[at[i] : at[i + 1]], True) for i in rows]))
                    for i, lang in zip(rows, got, strict=True):
                        langs[i] = lang
                    scores[rows], doubt[rows] = s, d
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores), pa.array(doubt)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches:
        data, at = text_buffers(table.column(1))
        rows = [trigram_counts(data[at[i] : at[i + 1]], True).tobytes() for i in range(table.num_rows)]
        yield pa.RecordBatch.from_arrays([table.column(0), pa.array(rows, pa.binary())], names=["lang", "counts"])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """labelled(id, lang, text) -> model; rows with a null id, text or language don't teach, of rows of one id and language one does."""
    taught = labelled.select("id", "lang", "text").where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    picked = bounded_sample(taught.select("id", "lang"), "lang", sample)
    texts = one_row_an_id(taught.join(F.broadcast(picked), ["id", "lang"]), ["id", "lang"], "text")
    chosen = texts.select("lang", "text").mapInArrow(_count, "lang string, counts binary").collect()
    if not chosen:
        return None
    chosen.sort(key=lambda r: (r.lang, bytes(r.counts)))
    return Model(features(np.stack([np.frombuffer(r.counts, np.float32) for r in chosen])), [r.lang for r in chosen])


def predict(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of docs: doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_predict(shared), PREDICTED)
