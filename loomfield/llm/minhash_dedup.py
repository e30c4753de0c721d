"""Near duplicates by b-bit MinHash.

1. One pass over the texts: the set of 5-word shingles of each document, a
   128-bit digest of the set, `BANDS` band keys of `ROWS` minima each, and the
   low `BITS` bits of all minima, packed into longs.
2. Documents with equal sets are one class; its smallest doc_id stands for it.
   Only these representatives go on, so thousands of copies cost one row.
3. Candidates: in each band bucket every member is paired with the smallest
   doc_id in it (a star, never all pairs; buckets of a group agree on few centres).  The packed signatures are compared with
   bit counts; the share of equal b-bit values, corrected for chance
   collisions, estimates the similarity, and pairs `SLACK` below the threshold go.
4. Links are confirmed on the full sets (intersection and union counts).
5. Components; then buckets that still hold several components, and no more than
   `FEW` members, have the pairs between different components tested the same way.
6. Larger buckets of several components (pages of one template, say) would have
   too many pairs.  Their members are joined by their rarest shingles instead,
   which is exact: with both sets in one order, by how many members hold a
   shingle, a linked pair shares one of the first n - 6n/7 + 1 of the smaller set
   with the first m - 3m/4 + 1 of the larger (at 75 per cent; prefix filtering).  What a
   template adds is frequent and stands last, so its pages meet only where their own words do.
   A sketch of fixed size tells those that nobody else holds and the most frequent; only what lies between is counted exactly.
7. Components are taken again.  So a bucket is closed only when all its members
   are linked or no pair across its components can be a link untested.

At similarity 0.75 a pair shares at least one of 48 bands of 6 with
probability 1 - 8e-5, at 0.8 1 - 5e-7.

Empty or null texts have no shingles and link with nothing; fewer than five
words are one shingle; repeated rows share a component; rows of one doc_id with
different texts each follow their own text, and where the id stands for both
texts, the two are one group; rows with a null doc_id are linked with nothing
(component null, kept true); extra columns are not carried; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import connected, stash
from .textkit import grouped_minima, permutations, scramble, shingle_hashes

#: MINIMA of a document; the first BANDS x ROWS make band keys, all give BITS bits to the signature.  SLACK is four standard errors of the estimate.
MINIMA, BANDS, ROWS, BITS, SLACK = 512, 48, 6, 4, 0.08
SIMILARITY, WIDTH = 75, 5  # per cent, words
PACKED = MINIMA * BITS // 64
#: Members up to which all pairs of a bucket are compared.
FEW = 64
#: Counters of a bounded sketch of how many members hold a shingle: 8 MB, whatever the input.
SKETCH = 1 << 20
#: Bits of the map that sifts texts before they are shuffled: 8 MB, whatever the input.
SLOTS = 1 << 26
#: Shingles hashed at a time: bounds the memory of a task beside the longest text.
SLAB = 200_000

SIGNED = "doc_id long, n_shingles long, hi long, lo long, bands array<long>, packed array<long>"


def _slabs(table: pa.RecordBatch, make) -> Iterator[tuple[list, list]]:
    """Rows in order, cut where SLAB shingles are reached."""
    rows, sets, n = [], [], 0
    for row, text in zip(table.column(0).to_pylist(), table.column(1), strict=True):
        rows.append(row)
        sets.append(make(text.as_py()))
        n += len(sets[-1])
        if n >= SLAB:
            yield rows, sets
            rows, sets, n = [], [], 0
    if rows:
        yield rows, sets


def _longs(x: np.ndarray) -> pa.Array:
    """(rows, k) uint64 -> array<long>."""
    flat = pa.array(np.ascontiguousarray(x).view(np.int64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    xor, mul = permutations(MINIMA, 3)
    salt = np.random.default_rng(4).integers(0, 2**63, size=(BANDS, 1), dtype=np.uint64)
    for table in batches:
        for ids, sets in _slabs(table, lambda t: np.unique(shingle_hashes(t, WIDTH))):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            hi, lo = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            bands, packed = np.zeros((len(ids), BANDS), np.uint64), np.zeros((len(ids), PACKED), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                hi[full] = np.add.reduceat(scramble(flat + np.uint64(0x51)), starts)
                lo[full] = np.add.reduceat(scramble(flat ^ np.uint64(0xABCDEF0123456789)), starts)
                minima = grouped_minima(flat, starts, xor, mul)
                keys = np.repeat(salt, len(full), axis=1)
                for r in range(ROWS):
                    keys = scramble(keys * np.uint64(31) + minima[r::ROWS][:BANDS])
                bands[full] = keys.T
                # Low bits of a multiplied hash are weak: take them after mixing.
                low = scramble(minima) & np.uint64((1 << BITS) - 1)
                each = 64 // BITS
                for w in range(PACKED):
                    for i in range(each):
                        packed[full, w] |= low[w * each + i] << np.uint64(BITS * i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), _longs(bands), _longs(packed)],
                names=["doc_id", "n_shingles", "hi", "lo", "bands", "packed"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches:
        for ids, sets in _slabs(table, lambda t: np.unique(shingle_hashes(t, WIDTH))):
            ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["id", "shingles"])


def estimate(a: str, b: str):
    """Similarity from two packed signatures: the share of equal b-bit values, less chance collisions."""
    lanes = F.lit(int("1" * (64 // BITS), 1 << BITS))
    equal = F.lit(0)
    for w in range(PACKED):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        equal = equal + (64 // BITS - F.bit_count(folded.bitwiseAND(lanes)))
    chance = 1.0 / (1 << BITS)
    return (equal / F.lit(float(MINIMA)) - chance) / (1 - chance)


def near(a: str, b: str, na: str, nb: str):
    """Cheap necessary conditions: sizes and the estimate."""
    sizes = (100 * F.least(na, nb) >= SIMILARITY * F.greatest(na, nb))
    return sizes & (estimate(a, b) >= SIMILARITY / 100 - SLACK)


def _sift(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most rows whose doc_id is not in wanted(_id), so that their texts need no shuffle.

    Hashed ids set bits of a map that is broadcast in rows of 4 KB, at most SLOTS bits in all.  Ids that meet a set bit
    by chance stay, so a join must follow.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    row, at = (lambda s: F.shiftright(s, 15)), (lambda s: s.bitwiseAND(F.lit(32767)))
    bits = wanted.groupBy(row(slot("_id")).alias("_row")).agg(F.bitmap_construct_agg(at(slot("_id"))).alias("_bits"))
    place = at(slot("doc_id"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = docs.join(F.broadcast(bits), row(slot("doc_id")) == F.col("_row"))
    return met.where(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1).drop("_row", "_bits")


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted(_id) -> (id, shingles, set) of each different text; set numbers them."""
    # An inner join: a semi join would be moved below the sift, and all texts shuffled.
    texts = _sift(docs, wanted).join(wanted, F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id", "text"])
    return stash(texts.select("doc_id", "text").mapInArrow(_sets, "id long, shingles array<long>").withColumn("set", F.monotonically_increasing_id()))


def _linked(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Of pairs of sets by a key (a, b), the ids (a, b) of those that reach the similarity."""
    side = lambda x: sets.select(F.col(key).alias(x), F.col("id").alias(f"_i{x}"), F.col("shingles").alias(f"_s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    good = both.where(100 * shared >= SIMILARITY * (F.size("_sa") + F.size("_sb") - shared))
    return stash(good.select(F.col("_ia").alias("a"), F.col("_ib").alias("b")).distinct())


def _confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs(a, b) whose full sets reach the similarity."""
    wanted = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    return _linked(pairs, _sets_of(wanted, docs), "id")


def _sketch(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How many shingles of all sets fall in each of SKETCH slots, never less than one of them is held; and from where a slot is heavy."""

    slots = SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for b in batches:
            total += np.bincount(_slot(b.column(0).flatten(), slots), minlength=slots)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(slots, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts, FEW + 4 * int(counts.sum()) // slots


def _slot(shingles: pa.Array, slots: int) -> np.ndarray:
    return (shingles.to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(slots)).astype(np.int64)


def _parted(counts, heavy: int):
    """Of each set: shingles, those alone in their slot, and apart those of heavy slots and of others."""

    def lists(flat: pa.Array, chosen: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
        ends = np.append(0, np.cumsum(np.bincount(owner[chosen], minlength=n))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(chosen)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("shingles").value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(length)), length)
            flat = b.column("shingles").flatten()
            held = counts.value[_slot(flat, len(counts.value))]
            alone = np.bincount(owner[held == 1], minlength=len(length))
            yield pa.RecordBatch.from_arrays([b.column("set"), b.column("id"), pa.array(length, pa.int32()), pa.array(alone, pa.int32()), lists(flat, (held > 1) & (held <= heavy), owner, len(length)), lists(flat, held > heavy, owner, len(length))], ["set", "id", "n", "alone", "middle", "heavy"])

    return run


def prefix_pairs(sets: DataFrame, components: DataFrame) -> DataFrame:
    """sets(set, id, shingles), components(id, c) -> (a, b) of sets in different components, among them all that reach the similarity.

    a has no more shingles than b.
    """
    counts, heavy = _sketch(sets)
    # Shingles that nobody else holds stand first, those of heavy slots last: neither needs an exact count.
    parted = sets.select("set", "id", "shingles").mapInArrow(_parted(sets.sparkSession.sparkContext.broadcast(counts), heavy), "set long, id long, n int, alone int, middle array<long>, heavy array<long>")
    parted = stash(parted)
    each = parted.select("set", F.explode("middle").alias("s"))
    held = each.groupBy("s").agg(F.count(F.lit(1)).alias("held"))
    ranked = each.join(held, "s").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("held", "s"))).alias("o"))
    over = lambda x, y: F.floor((x + (y - 1)) / y)  # noqa: E731  rounded up
    probing = F.col("n") - over(SIMILARITY * F.col("n"), 100) + 1
    indexed = F.col("n") - over(2 * SIMILARITY * F.col("n"), 100 + SIMILARITY) + 1
    late = F.transform("heavy", lambda x: F.struct(F.lit(2).cast("long").alias("held"), x.alias("s")))
    lined = F.concat(F.coalesce("o", F.array().cast("array<struct<held: bigint, s: bigint>>")), late)
    first = parted.join(ranked, "set", "left").select("set", "id", "n", "alone", indexed.alias("indexed"), F.posexplode(F.slice(lined, F.lit(1), F.greatest(probing - F.col("alone"), F.lit(0)).cast("int"))).alias("at", "t"))
    first = first.withColumn("at", F.col("at") + F.col("alone")).where("t.held > 1")
    first = first.join(components, "id")
    side = lambda x: [F.col("t.s").alias("s"), F.col("set").alias(x), F.col("c").alias(f"_c{x}"), F.col("n").alias(f"_n{x}"), F.col("at").alias(f"_at{x}")]
    small, large = first.where("at < indexed").select(side("a")), first.select(side("b"))
    met = small.join(large, "s").where("_ca <> _cb AND (_na < _nb OR (_na = _nb AND a < b))").where(100 * F.col("_na") >= SIMILARITY * F.col("_nb"))
    # What the sizes of this pair ask for: the first shingle that both hold leaves enough after it on either side.
    most = over(SIMILARITY * (F.col("_na") + F.col("_nb")), 100 + SIMILARITY)
    met = met.where((F.col("_ata") <= F.col("_na") - most) & (F.col("_atb") <= F.col("_nb") - most))
    return met.select("a", "b").distinct()


def group_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stash(plain.mapInArrow(_sign, SIGNED))
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "hi", "lo").agg(F.min("doc_id").alias("rep"))
    reps = signed.where("n_shingles > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n_shingles", "hi", "lo"], "left_semi").dropDuplicates(["doc_id", "hi", "lo"])
    reps = stash(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "packed"))
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    sign = lambda side: reps.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("packed").alias(f"p{side}"))

    shared = rows.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", "a")
    members = stash(rows.join(shared, "key"))  # only buckets of two and more
    stars = members.where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    stars = stars.join(sign("b"), "b").join(sign("a"), "a").where(near("pa", "pb", "na", "nb")).select("a", "b")
    edges = _confirm(stash(stars), plain)
    labels = connected(edges)

    # Buckets whose members aren't one component yet.
    named = members.select("key", "band", "id").join(labels, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("_l"), F.max("c").alias("_h"), F.count(F.lit(1)).alias("_n")).where("_l < _h").select("key", "_n")
    open_ = stash(named.join(mixed, "key"))
    rest = stash(open_.where(F.col("_n") <= FEW).drop("_n").join(reps.select("id", "n", "packed", "bands"), "id"))
    side = lambda s: rest.select("key", *[F.col(x).alias(f"{y}{s}") for x, y in (("band", "band"), ("id", ""), ("c", "c"), ("n", "n"), ("packed", "p"), ("bands", "bands"))])
    one, two = side("a"), side("b")
    # A bucket's pairs are only those across components; a pair that shares many buckets leaves the join in the first one,
    # and only if its signatures are near.  Where that one is large, both are joined by their rarest shingles.
    first = F.array_position(F.zip_with("bandsa", "bandsb", lambda x, y: x == y), F.lit(True)) == F.col("banda") + 1
    across = one.join(two, (one["key"] == two["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near("pa", "pb", "na", "nb") & first).select("a", "b").distinct()
    across = stash(across)
    found = [_confirm(across, plain)] if across.limit(1).count() else []
    wide = stash(open_.where(F.col("_n") > FEW).select("id", "c").distinct())
    if wide.limit(1).count():
        sets = _sets_of(wide.select(F.col("id").alias("_id")), plain)
        found.append(_linked(prefix_pairs(sets, wide), sets, "set"))
    if found:
        for more in found:
            edges = edges.unionByName(more)
        labels = connected(edges)
    # From representative to every member of its class.
    final = classes.join(labels, F.col("rep") == F.col("id"), "left").select("n_shingles", "hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(final, ["n_shingles", "hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, one document of each group (the smallest doc_id) and one row of each id.

    An id goes if none of its rows stays.  Of rows that repeat an id, the least by the hash of the text stays; rows with
    a null id all stay.
    """
    groups = group_duplicates(docs, text, doc_id).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).where("NOT _kept").select("_gone")
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"))
    named = packed.where("_id IS NOT NULL").join(groups, F.col("_id") == F.col("_gone"), "left_anti").groupBy("_id").agg(F.min_by("_row", "_hash").alias("_row"))
    return named.select("_row").unionByName(packed.where("_id IS NULL").select("_row")).select("_row.*")
