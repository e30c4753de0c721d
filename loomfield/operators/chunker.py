"""Sentence-aware chunks with overlap, as column expressions over the sentences of a group.

A group is a run of consecutive units of one source.  A chunk that begins at a
sentence is as many sentences as reach the target size, or fewer if the next
would exceed the most that is allowed, but one at least; sizes count a blank
after each sentence.  The next chunk begins so many sentences before its end as
the overlap says, but after its beginning.  So the end of a chunk follows from
sizes after its beginning alone, and a state of one number, where the next chunk
begins, is all that passes along a group's sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, split_sentences
from .shared import stash

TARGET, MOST, OVERLAP, LEAST = 500, 1200, 2, 40
#: Positions, and groups, are counted in ranges of two to this power, so that no task orders a whole document.
RANGE_BITS = 12
#: Sentences that are passed before what is found is gathered.
STRETCH = 256


def source_groups(units: DataFrame) -> DataFrame:
    """units(document_id, position, source, text) with sentences and group_no; units without sentences break no group.

    Groups are counted within ranges of positions; what earlier ranges hold is added from one narrow row a range.
    """
    # A text has a sentence if it has anything but white space; what the sentences are is computed once, at the end.
    with_sentences = units.where(F.col("text").rlike(f"[^{WS[1:-1]}]"))
    order = W.partitionBy("document_id", "_range").orderBy("position", "source")
    step = (F.lag(F.lit(1)).over(order).isNotNull() & ~F.col("source").eqNullSafe(F.lag("source").over(order))).cast("long")
    ranged = with_sentences.withColumn("_range", _range_of("position")).withColumn("_new", step).withColumn("_run", F.sum("_new").over(order)).drop("_new")
    place = F.struct("position", "source")
    ranges = ranged.groupBy("document_id", "_range").agg(F.max("_run").alias("_more"), F.min(place)["source"].alias("_first"), F.max(place)["source"].alias("_last"))
    along = W.partitionBy("document_id").orderBy("_range")
    begins = (F.lag(F.lit(1)).over(along).isNull() | ~F.col("_first").eqNullSafe(F.lag("_last").over(along))).cast("long")
    ranges = ranges.withColumn("_begins", begins).withColumn("_before", F.sum(F.col("_begins") + F.col("_more")).over(along) - F.col("_more"))
    ranges = ranges.select(F.col("document_id").alias("_d"), F.col("_range").alias("_r"), "_before")
    joined = ranged.join(ranges, F.col("document_id").eqNullSafe(F.col("_d")) & F.col("_range").eqNullSafe(F.col("_r")))
    joined = joined.withColumn("group_no", F.col("_before") + F.col("_run")).drop("_range", "_run", "_d", "_r", "_before")
    return joined.withColumn("sentences", split_sentences(F.col("text")))


def _range_of(name: str) -> Column:
    return F.shiftright(F.col(name).cast("long"), RANGE_BITS)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _admitted(sizes: Column, first: Column, target: int, most: int) -> Column:
    """How many sentences from `first` on make a chunk; none is empty, so no more are looked at than could reach the target."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def admit(s: Column, x: Column) -> Column:
        size = s["size"] + x + 1
        return F.when(s["full"] | (size - 1 > most), F.struct(s["size"].alias("size"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(size.alias("size"), (s["n"] + 1).alias("n"), (size >= target).alias("full")))

    return F.greatest(F.aggregate(F.slice(sizes, first + 1, min(target, most) // 2 + 2), start, admit, lambda s: s["n"]), F.lit(1))


def cuts(sentences: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """array<struct<first, end>> of the chunks of an array of sentences, none of them empty.

    Sentences are passed in stretches, so that what is found is gathered a stretch at a time.
    """
    part = "array<struct<first: int, end: int>>"

    def step(s: Column, f: Column) -> Column:
        def cut(n: Column) -> Column:
            end = f + n
            after = F.when(end >= F.size(s["sizes"]), F.lit(-1)).otherwise(F.greatest(end - overlap, f + 1))
            return F.struct(s["sizes"].alias("sizes"), after.alias("next"), F.concat(s["cuts"], F.array(F.struct(f.alias("first"), end.alias("end")))).alias("cuts"))

        return F.when(f == s["next"], _let(_admitted(s["sizes"], f, target, most), cut)).otherwise(s)

    def stretch(s: Column, begin: Column) -> Column:
        start = F.struct(s["sizes"].alias("sizes"), s["next"].alias("next"), F.array().cast(part).alias("cuts"))
        passed = F.aggregate(F.sequence(begin, F.least(begin + STRETCH, F.size(s["sizes"])) - 1), start, step)
        return _let(passed, lambda p: F.struct(s["sizes"].alias("sizes"), p["next"].alias("next"), F.concat(s["cuts"], F.array(p["cuts"])).alias("cuts")))

    sizes = F.transform(sentences, F.length)
    start = F.struct(sizes.alias("sizes"), F.lit(0).alias("next"), F.array().cast(f"array<{part}>").alias("cuts"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(sentences) - 1, F.lit(STRETCH)), start, stretch, lambda s: F.flatten(s["cuts"]))
    return F.when(F.size(sentences) > 0, found).otherwise(F.array().cast(part))


def fold(sentences: Column, places: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """array<struct<place, text>>: chunks of `least` characters and more, each with the place of its first sentence."""

    def texts(t: Column) -> Column:
        text = lambda c: F.struct(F.get(t["places"], c["first"]).alias("place"), F.array_join(F.slice(t["sentences"], c["first"] + 1, c["end"] - c["first"]), " ").alias("text"))
        return F.filter(F.transform(cuts(t["sentences"], target, most, overlap), text), lambda c: F.length(c["text"]) >= least)

    return _let(F.struct(sentences.alias("sentences"), places.alias("places")), texts)


def _chunks_before(pieces: DataFrame) -> DataFrame:
    """pieces(document_id, group_no, chunks) -> (_d, _g, _before): the document's chunks before each group."""
    sizes = pieces.select("document_id", "group_no", F.size("chunks").alias("_n"), _range_of("group_no").alias("_range"))
    ranges = sizes.groupBy(F.col("document_id").alias("_rd"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_all"))
    ranges = ranges.withColumn("_earlier", F.sum("_all").over(W.partitionBy("_rd").orderBy("_r")) - F.col("_all")).drop("_all")
    within = F.sum("_n").over(W.partitionBy("document_id", "_range").orderBy("group_no")) - F.col("_n")
    joined = sizes.withColumn("_within", within).join(ranges, F.col("document_id").eqNullSafe(F.col("_rd")) & (F.col("_range") == F.col("_r")))
    return joined.select(F.col("document_id").alias("_d"), F.col("group_no").alias("_g"), (F.col("_earlier") + F.col("_within")).alias("_before"))


def chunk_units(units: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST, cap: int | None = None) -> DataFrame:
    """(document_id, chunk_index, text, source, start_position), indices without gaps; `cap` keeps the first so many of a document.

    A group is handled by itself, whatever document it is of, as one array of its sentences; indices are the chunks
    counted in a group, in the groups before it in its range, and in the ranges before.  The chunks are written once, as
    they are counted and numbered.
    """
    groups = source_groups(units).groupBy("document_id", "group_no")
    rows = groups.agg(F.min("source").alias("source"), F.array_sort(F.collect_list(F.struct("position", "sentences"))).alias("units"))
    places = lambda us: F.flatten(F.transform(us, lambda u: F.transform(u["sentences"], lambda _: u["position"])))
    chunks = _let(F.col("units"), lambda us: fold(F.flatten(us["sentences"]), places(us), target, most, overlap, least))
    pieces = stash(rows.select("document_id", "group_no", "source", chunks.alias("chunks")))
    out = pieces.join(_chunks_before(pieces), F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("group_no") == F.col("_g")))
    out = out.select("document_id", "source", "_before", F.posexplode("chunks").alias("n", "c"))
    out = out.select("document_id", F.col("c.text").alias("text"), "source", F.col("c.place").cast("long").alias("start_position"), (F.col("_before") + F.col("n")).cast("int").alias("chunk_index"))
    return out.where(F.col("chunk_index") < cap) if cap is not None else out


def distinct_units(units: DataFrame, least: int = 3) -> DataFrame:
    """units(document_id, pos, text) as they came, the first of those whose squeezed texts are equal (case ignored); shorter than `least` go."""
    from ..functions.text import squeeze
    from .store import keep_first

    keyed = units.withColumn("_k", F.lower(squeeze(F.col("text")))).where(F.length("_k") >= least)
    return keep_first(keyed, ["document_id", "_k"], ["pos"]).drop("_k")


def merge_units(*sets: DataFrame) -> DataFrame:
    """sets of (document_id, pos, text) in order: squeezed, 3 characters at least, the first of equal texts (case ignored) stays."""
    from ..functions.text import squeeze
    from .store import keep_first

    parts = [s.select("document_id", F.lit(i).alias("set"), "pos", squeeze(F.col("text")).alias("text")) for i, s in enumerate(sets)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return keep_first(whole.where(F.length("text") >= 3).withColumn("_k", F.lower("text")), ["document_id", "_k"], ["set", "pos"]).drop("_k")
