"""Outputs of outside models are columns: a provider maps batches of texts, the default is computed from an id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTENTION = "speech_act string, certainty double, force double, tension double"
# The speech acts in order.
ACTS = ("assertive", "directive", "commissive", "expressive", "declarative")


def surrogate_intentions(units: DataFrame, key: str) -> DataFrame:
    """Deterministic judgements from a whole-number key, for use without a model."""
    share = lambda m: (F.col(key) * m % 101) / F.lit(100.0)
    act = F.get(F.array(*map(F.lit, ACTS)), (F.col(key) % 5).cast("int"))
    return units.withColumns({"speech_act": act, "certainty": share(37), "force": share(53), "tension": share(71)})


def with_intentions(units: DataFrame, call: Callable[[list[str]], list[dict | None]], batch: int = 20) -> DataFrame:
    """units with a model's judgement of `text`; a batch that fails leaves its units without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[dict | None] = []
            for b in range(0, len(pdf), batch):
                texts = pdf["text"].iloc[b : b + batch].tolist()
                try:
                    said = call(texts)
                except Exception:  # the model is outside: any failure means no judgement
                    said = [None] * len(texts)
                got += said
            yield pdf.assign(**{c: [g.get(c) if g else None for g in got] for c in ("speech_act", "certainty", "force", "tension")})

    return units.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields) + ", " + INTENTION)


def with_embeddings(items: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = 50) -> DataFrame:
    """items with `embedding` of `text`, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float]] = []
            for b in range(0, len(pdf), batch):
                vectors += call(pdf["text"].iloc[b : b + batch].tolist())
            yield pdf.assign(embedding=vectors)

    return items.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", embedding array<double>")
