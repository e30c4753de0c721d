"""The tension calculus as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Lexicon
from .text import marker_count, word_count

# Weights of (hedging, challenge) for each speech act.
ACT_WEIGHTS = {"assertive": (0.7, 0.3), "directive": (0.5, 0.5), "commissive": (0.6, 0.4), "expressive": (0.2, 0.6), "declarative": (0.8, 0.2)}


def round2(x: Column) -> Column:
    """Half up, as two decimals."""
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def unit_interval(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def clamp(x: Column) -> Column:
    return round2(unit_interval(x))


def hedging(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Struct of three densities and the lexical tension; the tension comes from densities before rounding."""
    words = F.greatest(F.lit(3), word_count(text)).cast("double")
    density = lambda markers: F.least(F.lit(1.0), marker_count(text, markers) / words * 3)
    h, c, q = density(lexicon.hedge), density(lexicon.certainty), density(lexicon.challenge)
    tension = unit_interval(h * 0.4 + q * 0.45 + (1 - c) * 0.15)
    return F.struct(round2(h).alias("hedging"), round2(c).alias("certainty"), round2(q).alias("challenge"), round2(tension).alias("tension"))


def discrepancy(act: Column, hedge: Column, challenge: Column) -> Column:
    """Between the act and its hedging, from rounded densities; no or unknown act: 0."""
    out = None
    for name, (wh, wc) in ACT_WEIGHTS.items():
        both = challenge * wc + hedge * wh if name == "expressive" else hedge * wh + challenge * wc
        out = F.when(act == name, both) if out is None else out.when(act == name, both)
    return out.otherwise(F.lit(0.0))


def triangulated(model: Column, lexical: Column, disc: Column, act: Column, deviation: Column) -> Column:
    """Four sources where the model has judged, three otherwise."""
    full = model * 0.35 + lexical * 0.20 + disc * 0.25 + deviation * 0.20
    return clamp(F.when(model.isNotNull() & act.isNotNull(), full).otherwise(lexical * 0.45 + deviation * 0.35 + disc * 0.20))


def cluster_deviation(certainty: Column, force: Column, tension: Column, means: Column, members: Column) -> Column:
    """Distance of a unit's intention to its cluster's means (struct certainty, force, tension); at most one judged member, or no intention: 0."""
    judged = certainty.isNotNull() & force.isNotNull() & tension.isNotNull()
    square = lambda c, n: (c - means[n]) * (c - means[n])
    far = F.sqrt(square(certainty, "certainty") + square(force, "force") + square(tension, "tension")) / 1.73
    return F.when(judged & (members > 1), F.least(F.lit(1.0), far)).otherwise(F.lit(0.0))


def blended_fz(lexical: Column, tri: Column, certainty: Column, force: Column) -> Column:
    return clamp(lexical * 0.45 + tri * 0.25 + (1 - certainty) * 0.15 + force * 0.15)


def cti(disc: Column, deviation: Column) -> Column:
    return round2(F.least(F.lit(1.0), F.sqrt(disc * deviation)))


def lexical_fz(distance: Column) -> Column:
    return F.least(F.lit(1.0), distance / 4 + 0.1)


def lexical_fy(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 3)


def chosen_fz(lexical: Column, tri: Column, certainty: Column, force: Column) -> Column:
    return F.when(certainty.isNotNull(), blended_fz(lexical, tri, certainty, force)).otherwise(round2(lexical))


def unit_position(v: Column) -> Column:
    return (v + 4) / 8


def canvas_percent(v: Column) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(95.0), unit_position(v) * 100))


def severity(c: Column) -> Column:
    """Band of a composite tension; the canvas rings what is above 0.35."""
    return F.when(c > 0.4, "critical").when(c > 0.25, "amber").when(c > 0.15, "detail").otherwise("calm")
