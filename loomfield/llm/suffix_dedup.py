"""Repeated passages by a depth-limited most-significant-digit radix sort of suffixes.

A byte goes if it lies in a `DEPTH`-byte string that also starts in a document
with a smaller doc_id.  Suffixes are only told apart through their first DEPTH
bytes, one digit a pass, and only groups that still hold more than one
document are split further; groups that are equal after the last digit are
exactly the repeated strings.

* First digit: the least K-byte hash inside the DEPTH bytes.  Consecutive
  suffixes with the same first digit move together as one run.
* Second digit: the bytes that a run covers.  Runs equal in both digits repeat
  each other as a whole, whatever their length.
* Last digit: the DEPTH bytes of a single suffix, only for first digits under
  which runs differ (the edges of repeated passages).

A pass sends (digit, digit, document) to the bucket of a digit.  Before that
each batch keeps one entry, of the smallest doc_id, for each pair of digits; its
other documents know already that they repeat.  So a passage that a third of
the corpus shares is one entry a batch.  The first pass deals by the first digit,
as it counts the contents under it: what meets there is at most two runs a
document at the edges of a passage (20 bytes each).  The last pass deals single
suffixes by the last digit, so that the edges of a frequent passage spread over
all buckets.  A digit is 48 bits of a hash, two are compared together.

Null text is empty; texts shorter than DEPTH keep all; rows with a null doc_id
keep all and remove nothing elsewhere; rows with equal doc_id don't remove each
other's bytes; extra columns are ignored; texts of any length are worked
through in pieces of `PIECE` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stash
from .ngrams import text_buffers
from .textkit import STEP, scramble

DEPTH, K, PIECE = 50, 24, 1 << 18
BUCKET_BYTES, BUCKETS_A_PARTITION = 8 << 20, 8
#: Entries of a batch that are gathered before they are sent: bounds a task's memory.
GATHER = 400_000

_rng = np.random.default_rng(5)
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**62, 2**63)) * 4 + 5
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, made once a worker."""
    if not _powers:
        n = 2 * PIECE + 1
        for base in (_BASE % 2**64, pow(_BASE, -1, 2**64)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers


class Runs:
    """Runs of suffixes of some byte pieces laid end to end."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        power, self.inverse = _power_tables()
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self.sums[1:])
        self.first = self.last = np.empty(0, np.int64)
        self.digit = np.empty(0, np.uint64)
        if n < DEPTH:
            return
        count = n - K + 1
        least = scramble((self.sums[K:] - self.sums[:count]) * self.inverse[:count])
        width, want = 1, DEPTH - K + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        whole = np.ones(len(least), bool)
        for e in ends[:-1].tolist():
            whole[max(0, e - DEPTH + 1) : e] = False
        change = np.empty(len(least), bool)
        change[0] = True
        change[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
        starts = np.flatnonzero(change)
        stops = np.append(starts[1:], len(least)) - 1
        good = whole[starts]
        self.first, self.last = starts[good], stops[good]
        # A run of good suffixes may be followed by bad ones with the same digit.
        if not whole.all():
            bad = np.append(np.flatnonzero(~whole), len(least))
            self.last = np.minimum(self.last, bad[np.searchsorted(bad, self.first)] - 1)
        self.digit = scramble(least[self.first] ^ STEP) >> np.uint64(16)

    def content(self) -> np.ndarray:
        """Second digit of each run."""
        stop = self.last + DEPTH
        return scramble((self.sums[stop] - self.sums[self.first]) * self.inverse[self.first] + (stop - self.first).astype(np.uint64)) >> np.uint64(16)

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, first and last digits of the suffixes of the chosen runs."""
        sizes = (self.last - self.first + 1)[chosen]
        at = np.repeat(self.first[chosen], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return at, np.repeat(self.digit[chosen], sizes), scramble((self.sums[at + DEPTH] - self.sums[at]) * self.inverse[at] + np.uint64(7)) >> np.uint64(16)


def names_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit name of a pair of digits, used inside one document only."""
    return scramble(first * STEP + second)


def _pieces(offsets: np.ndarray, rows: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, begin, end), some PIECE bytes each; long texts overlap by DEPTH - 1 bytes."""
    group, size = [], 0
    for r in rows.tolist():
        begin, end = int(offsets[r]), int(offsets[r + 1])
        while end - begin >= DEPTH:
            stop = min(end, begin + PIECE)
            if size + stop - begin > PIECE and group:
                yield group
                group, size = [], 0
            group.append((r, begin, stop))
            size += stop - begin
            begin = stop if stop == end else stop - DEPTH + 1
    if group:
        yield group


def _laid(data: np.ndarray, group: list[tuple[int, int, int]]) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Runs, piece of each run, and what to add to a position for the place in the batch's data."""
    ends = np.cumsum([e - b for _, b, e in group])
    runs = Runs(np.concatenate([data[b:e] for _, b, e in group]), ends)
    begin = np.array([b for _, b, _ in group]) - np.concatenate([[0], ends[:-1]])
    return runs, np.searchsorted(ends, runs.first, side="right"), begin


SENT = "bucket int, known boolean, first binary, second binary, docs binary"
ANSWER = "doc_id long, again boolean, name long"


def _pack_ids(x: np.ndarray) -> bytes:
    """Ascending ids as compressed steps: about a byte each."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=np.int64(0)).tobytes())


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64))


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).reshape(-1)


def _post(first: np.ndarray, second: np.ndarray, docs: np.ndarray, buckets: int, spread: bool) -> pa.RecordBatch:
    """One entry a pair of digits and batch to the bucket of the first digit (spread: the second); the rest is known to repeat."""
    order = np.lexsort((docs, second, first))
    first, second, docs = first[order], second[order], docs[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    least = docs[np.flatnonzero(new)][np.cumsum(new) - 1] if len(docs) else docs
    fresh = np.ones(len(first), bool)
    fresh[1:] = new[1:] | (docs[1:] != docs[:-1])
    out = {k: [] for k in ("bucket", "known", "first", "second", "docs")}
    for known, chosen in ((False, new), (True, fresh & (docs > least))):
        f, s, d = first[chosen], second[chosen], docs[chosen]
        home = ((s if spread else f) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((d, home))
        home, f, s, d = home[order], f[order], s[order], d[order]
        cuts = np.flatnonzero(np.diff(home)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(home)], strict=True):
            if b > a:
                for k, v in zip(out, (int(home[a]), known, _six(f[a:b]), _six(s[a:b]), _pack_ids(d[a:b])), strict=True):
                    out[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["known"], pa.bool_()), *(pa.array(out[k], pa.binary()) for k in ("first", "second", "docs"))], names=list(out))


def _sent(got: list, buckets: int, spread: bool = False) -> pa.RecordBatch:
    return _post(*(np.concatenate(x) for x in zip(*got, strict=True)), buckets, spread)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for table in batches:
        data, offsets = text_buffers(table.column(1))
        packed = [squeeze.compress(data[a:b]) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([table.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _unpack(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of one packed text and their offsets, 0 and length."""
    raw = column[row].as_py()
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8) if raw else np.empty(0, np.uint8)
    return data, np.array([0, len(data)], np.int64)


def _first_pass(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            ids = table.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(table.column(1))
            got = []
            for group in _pieces(offsets, np.arange(len(ids))):
                runs, piece, _ = _laid(data, group)
                got.append((runs.digit, runs.content(), ids[np.array([r for r, _, _ in group])[piece]]))
                if sum(len(g[0]) for g in got) >= GATHER:
                    yield _sent(got, buckets)
                    got = []
            if got:
                yield _sent(got, buckets)

    return run


def _last_pass(buckets: int):
    """Single suffixes of the runs named in `open`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            ids = table.column(0).to_numpy(zero_copy_only=False)
            got, size = [], 0
            for r in range(len(ids)):
                wanted = np.array(table.column(2)[r].as_py() or [], np.int64).view(np.uint64)
                data, offsets = _unpack(table.column(1), r)
                for group in _pieces(offsets, np.array([0])) if len(wanted) else ():
                    runs, _, _ = _laid(data, group)
                    _, first, last = runs.suffixes(np.isin(names_of(runs.digit, runs.content()), wanted))
                    got.append((first, last, np.full(len(first), ids[r], np.int64)))
                    size += len(first)
                    if size >= GATHER:
                        yield _sent(got, buckets, True)
                        got, size = [], 0
            if got:
                yield _sent(got, buckets, True)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket: sort a bucket by its digits, answer the documents.

    again: a smaller document has the same pair of digits.  Not again: the smallest one, under a first digit that
    has other second digits as well.
    """

    def answer(docs: np.ndarray, again: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(again), pa.array(names.view(np.int64))], names=["doc_id", "again", "name"])

    def solve(rows: list) -> pa.RecordBatch:
        first, second = _eight([r[0] for r in rows]), _eight([r[1] for r in rows])
        docs = np.concatenate([_unpack_ids(r[2]) for r in rows])
        order = np.argsort(first, kind="stable")
        f = first[order]
        edge = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        size = np.diff(np.append(edge, len(f)))
        live = order[np.repeat(size > 1, size)]  # a first digit of one entry is done
        order = live[np.lexsort((docs[live], second[live], first[live]))]
        f, s, d = first[order], second[order], docs[order]
        if not len(f):
            return answer(d, np.empty(0, bool), f)
        new1 = np.append(True, f[1:] != f[:-1])
        new2 = new1 | np.append(True, s[1:] != s[:-1])
        least = d[np.flatnonzero(new2)][np.cumsum(new2) - 1]
        kinds = np.add.reduceat(new2.astype(np.int64), np.flatnonzero(new1))[np.cumsum(new1) - 1]
        again = d > least
        tell = again | (new2 & (kinds > 1))
        return answer(d[tell], again[tell], names_of(f[tell], s[tell]))

    at, rows = None, []
    for table in batches:
        for bucket, known, first, second, docs in zip(*(table.column(i).to_pylist() for i in range(5)), strict=True):
            if known:
                d = _unpack_ids(docs)
                yield answer(d, np.ones(len(d), bool), names_of(_eight([first]), _eight([second])))
                continue
            if bucket != at and rows:
                yield solve(rows)
                rows = []
            at = bucket
            rows.append((first, second, docs))
    if rows:
        yield solve(rows)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _cut_out(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            for r in range(table.num_rows):
                own, offsets = _unpack(table.column(1), r)
                end = len(own)
                gone = [np.array(table.column(c)[r].as_py() or [], np.int64).view(np.uint64) for c in (2, 3, 4)]
                spans = np.zeros(end + 1, np.int32)
                for group in _pieces(offsets, np.array([0])) if len(gone[0]) or len(gone[2]) else ():
                    runs, _, base = _laid(own, group)
                    names = names_of(runs.digit, runs.content())
                    hit = np.isin(names, gone[0])
                    np.add.at(spans, runs.first[hit] + base[0], 1)
                    np.add.at(spans, runs.last[hit] + DEPTH + base[0], -1)
                    if len(gone[2]):
                        at, first, last = runs.suffixes(np.isin(names, gone[1]) & ~hit)
                        at = at[np.isin(names_of(first, last), gone[2])] + base[0]
                        np.add.at(spans, at, 1)
                        np.add.at(spans, at + DEPTH, -1)
                lost = np.cumsum(spans[:-1]) > 0
                kept = own[~lost].tobytes() if lost.any() else own.tobytes()
                out["n_bytes"].append(end)
                out["n_removed"].append(int(lost.sum()))
                out["n_spans"].append(int((lost & ~np.append(False, lost[:-1])).sum()) if end else 0)
                out["kept"].append(kept if keep_bytes else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([table.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_bytes: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes, null unless keep_bytes), kept_sha256."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = plain.where("doc_id IS NOT NULL")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    buckets = parts * BUCKETS_A_PARTITION

    def passed(sent: DataFrame) -> DataFrame:
        return sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_split, ANSWER)

    def listed(answers: DataFrame, **columns) -> DataFrame:
        return answers.groupBy(F.col("doc_id").alias("_id")).agg(*[F.collect_set(F.when(F.col("again") == again, F.col("name"))).alias(k) for k, again in columns.items()])

    # Each pass is a written table, so its shuffle files go before the next pass writes its own.
    runs = stash(listed(passed(named.mapInArrow(_first_pass(buckets), SENT)), gone=True, open=False))
    packed = plain.mapInArrow(_pack, "doc_id long, packed binary")
    opened = packed.join(runs.where(F.size("open") > 0).select("_id", "open"), F.col("doc_id") == F.col("_id")).select("doc_id", "packed", "open")
    suffixes = stash(listed(passed(opened.mapInArrow(_last_pass(buckets), SENT)).where("again"), ends=True))
    answers = runs.join(suffixes.select(F.col("_id").alias("_id2"), "ends"), F.col("_id") == F.col("_id2"), "left").select("_id", "gone", "open", "ends")
    joined = packed.join(answers, F.col("doc_id") == F.col("_id"), "left")
    return joined.select("doc_id", "packed", "gone", "open", "ends").mapInArrow(_cut_out(keep_bytes), OUT)
