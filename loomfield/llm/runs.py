"""Periodic runs of words, over a grammar.

A run is a stretch of words with smallest period q, at least twice as long as q
and of `LEAST` words at least, that no neighbouring word extends with that period.

Re-Pair names the words of a document by numbers and replaces repeated pairs of
neighbours by new symbols until none is left that repeats.  Pairs are replaced
in rounds, by falling frequency: all that aren't next to a more frequent one at once.
Every symbol is then a rule of two parts, and every gap between two words is the
boundary of one rule's derivation, or of the sequence that is left.  A run lies
within the expansion of the lowest symbol that holds it and crosses its boundary.
So runs across each rule's boundary are computed once, in one derivation, by
looking up where the words at the boundary stand again at a distance that a
period may have, and extending both copies.  They are then carried to all
derivations of the rule, and of intervals with one period the maximal ones stay,
of periods of one interval the smallest.  Hashes only propose; every run is
compared word by word, and another hash is taken if one fails.

A document is one row of one task, many small ones are worked on at once; nothing
is shuffled.  Null text has no words and no runs.  Repeated rows are rows of their
own, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .textkit import STEP, scramble

#: Fewest words of a run, words of documents that are worked on at once, distances of the first scale and its gram.
LEAST, AT_ONCE, NEAR, GRAM = 12, 300_000, 8, 3


class Rules(NamedTuple):
    """Rule i is at positions at[first[i] : first[i + 1]], of `length` words, the left part of `left` words; heads: where a symbol that is left begins."""

    at: np.ndarray
    first: np.ndarray
    left: np.ndarray
    length: np.ndarray
    heads: np.ndarray


def _often(keys: np.ndarray) -> np.ndarray:
    """Where a key may stand twice: all of those, and a few others."""
    buckets = 1 << (4 * len(keys)).bit_length()
    bucket = (scramble(keys.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)
    return np.flatnonzero(np.bincount(bucket, minlength=buckets)[bucket] > 1)


def repair(words: np.ndarray) -> Rules:
    """The grammar of a sequence of word numbers; documents in it share no number, so no pair across them repeats."""
    n = len(words)
    symbol = np.append(words, -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n], before[0] = n, n  # position n stands for both ends
    size = np.ones(n + 1, np.int64)
    rank = np.full(n + 1, -1)
    names = int(words.max()) + 1 if n else 0
    ats, lefts, lengths, counts = [], [], [], []
    active = np.arange(max(n - 1, 0))
    while len(active):
        key = symbol[active] << 32 | symbol[after[active]]
        some = _often(key)
        active, key = active[some], key[some]
        kinds, kind, often = np.unique(key, return_inverse=True, return_counts=True)
        some = often[kind] > 1
        active, kind = active[some], kind[some]
        if not len(active):
            break
        order = np.empty(len(kinds), np.int64)
        order[np.lexsort((kinds, often))] = np.arange(len(kinds))
        mine = order[kind]
        rank[active] = mine
        previous, following = rank[before[active]], rank[after[active]]
        # Equal pairs in a row, of one symbol with itself, go by twos from the first.
        tied = previous == mine
        place = np.arange(len(active))
        place -= np.maximum.accumulate(np.where(tied, 0, place))
        chosen = (place % 2 == 0) & (mine >= previous) & (mine >= following)
        chosen &= (np.bincount(kind[chosen], minlength=len(kinds)) > 1)[kind]
        rank[active] = -1
        if not chosen.any():
            break
        at, kind = active[chosen], kind[chosen]
        by = np.argsort(kind, kind="stable")
        at, kind = at[by], kind[by]
        _, new, many = np.unique(kind, return_inverse=True, return_counts=True)
        right = after[at]
        end = after[right]
        begins = np.append(0, np.cumsum(many)[:-1])
        lefts.append(size[at[begins]])
        lengths.append(size[at[begins]] + size[right[begins]])
        ats.append(at)
        counts.append(many)
        symbol[at] = names + new
        symbol[right] = -1
        size[at] += size[right]
        after[at], before[end] = end, at
        after[n], before[before == -1] = n, n
        names += len(many)
        again = np.concatenate([active[~chosen], at, before[at]])
        again = np.unique(again[again < n])
        active = again[(symbol[again] >= 0) & (after[again] < n)]
    flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return Rules(flat(ats), np.append(0, np.cumsum(flat(counts))), flat(lefts), flat(lengths), np.flatnonzero(symbol[:n] >= 0))


def _grams(words: np.ndarray, seed: int) -> tuple[dict[int, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Hashes of all grams of 1, 2, 4 ... words, and for GRAM, 4, 8 ... words, as long as some stand twice: (gram, number, position), sorted."""
    one = scramble(words.astype(np.uint64) + np.uint64(seed) * STEP)
    join = lambda a, b: scramble((a * STEP ^ a >> np.uint64(31)) + b)
    hashes = {1: one, 2: join(one[:-1], one[1:])}
    found, gram, alive = [], GRAM, None
    while True:
        if gram == GRAM:
            whole = join(hashes[2][:-1], one[2:])
        else:
            half = hashes[gram // 2]
            whole = hashes[gram] = join(half[: max(len(half) - gram // 2, 0)], half[gram // 2 :])
        alive = np.arange(len(whole)) if alive is None else alive[alive < len(whole)]
        alive = alive[_often(whole[alive])]
        _, number, often = np.unique(whole[alive], return_inverse=True, return_counts=True)
        some = often[number] > 1
        alive, number = alive[some], number[some]
        if not len(alive):
            return hashes, found
        order = np.argsort(number, kind="stable")
        found.append((gram, number[order], alive[order]))
        gram = 4 if gram == GRAM else 2 * gram


def _copies(gaps: np.ndarray, gram: int, number: np.ndarray, position: np.ndarray, low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gap, first, distance): where the gram at a gap's right, or left, stands again at a distance in [low, high)."""
    key = number * (n + 1) + position
    where = np.full(n + 1, -1)
    where[position] = number
    out = []
    for shift in (0, gram):
        some = gaps[gaps >= shift]
        some = some[where[some - shift] >= 0]
        base = where[some - shift] * (n + 1)
        at = some - shift
        for a, b in ((at + low, at + high), (at - high + 1, at - low + 1)):
            begin = np.searchsorted(key, base + np.clip(a, 0, n))
            many = np.maximum(np.searchsorted(key, base + np.clip(b, 0, n)) - begin, 0)
            each = np.repeat(np.arange(len(some)), many)
            other = position[np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + begin[each]]
            out.append((some[each], np.minimum(at[each], other), np.abs(at[each] - other)))
    gap, first, distance = (np.concatenate(c) for c in zip(*out, strict=True))
    return gap, first, distance


def _extend(hashes: dict[int, np.ndarray], first: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) around `first` in which every word equals the one q further; as far as that holds."""
    begin, end = first.copy(), first.copy()
    for g in sorted(hashes, reverse=True):
        h = hashes[g]
        for side, sign in ((end, 1), (begin, -1)):
            todo = np.arange(len(first))
            while len(todo):
                at = side[todo] if sign == 1 else side[todo] - g
                good = (at >= 0) & (at + q[todo] < len(h))
                todo, at = todo[good], at[good]
                todo = todo[h[at] == h[at + q[todo]]]
                side[todo] += sign * g
    return begin, end


def _maximal(begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that no other of their period holds, each with its smallest period."""
    order = np.lexsort((-end, begin, q))
    begin, end, q = begin[order], end[order], q[order]
    _, group = np.unique(q, return_inverse=True)
    reach = group * (int(end.max(initial=0)) + 1) + end
    inside = np.append(False, np.maximum.accumulate(reach)[:-1] >= reach[1:]) if len(reach) else np.empty(0, bool)
    begin, end, q = begin[~inside], end[~inside], q[~inside]
    order = np.lexsort((q, end, begin))
    begin, end, q = begin[order], end[order], q[order]
    same = np.append(False, (begin[1:] == begin[:-1]) & (end[1:] == end[:-1])) if len(begin) else np.empty(0, bool)
    return begin[~same], end[~same], q[~same]


def _runs(words: np.ndarray, rules: Rules, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(words)
    hashes, scales = _grams(words, seed)
    sample = rules.at[rules.first[:-1]]
    crossed = sample + rules.left
    rule_of = np.full(n + 1, -1)
    rule_of[crossed] = np.arange(len(crossed))
    gaps = np.unique(np.concatenate([crossed, rules.heads]))
    low, parts = 1, []
    for gram, number, position in scales:
        high = NEAR if low == 1 else 2 * low
        gap, first, q = _copies(gaps, gram, number, position, low, high, n)
        low = high
        # One extension for each pair of copies.
        pairs, back = np.unique(first * (n + 1) + q, return_inverse=True)
        begin, end = _extend(hashes, pairs // (n + 1), pairs % (n + 1))
        begin, end = begin[back], end[back] + q
        rule = rule_of[gap]
        ruled = rule >= 0
        begin[ruled] = np.maximum(begin[ruled], sample[rule[ruled]])
        end[ruled] = np.minimum(end[ruled], (sample + rules.length)[rule[ruled]])
        good = end - begin >= np.maximum(least, 2 * q)
        parts.append(np.unique(np.stack([rule, begin, end, q])[:, good], axis=1))
    rule, begin, end, q = np.concatenate(parts, 1) if parts else np.empty((4, 0), np.int64)
    # Of periods of one interval of a rule the smallest will do.
    order = np.lexsort((q, end, begin, rule))
    rule, begin, end, q = rule[order], begin[order], end[order], q[order]
    same = np.append(False, (rule[1:] == rule[:-1]) & (begin[1:] == begin[:-1]) & (end[1:] == end[:-1])) if len(rule) else np.empty(0, bool)
    rule, begin, end, q = rule[~same], begin[~same], end[~same], q[~same]
    # To all derivations of a rule.
    ruled = np.flatnonzero(rule >= 0)
    many = np.diff(rules.first)[rule[ruled]]
    each = np.repeat(ruled, many)
    offset = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    shift = rules.at[rules.first[rule[each]] + offset] - sample[rule[each]]
    rest = rule < 0
    return _maximal(np.concatenate([begin[rest], begin[each] + shift]), np.concatenate([end[rest], end[each] + shift]), np.concatenate([q[rest], q[each]]))


def find(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of all runs of a sequence of word numbers below 2**31, by begin; see `repair`."""
    if len(words) < least:
        return (np.empty(0, np.int64),) * 3
    rules = repair(words)
    for seed in count():
        begin, end, q = _runs(words, rules, least, seed)
        if all(np.array_equal(words[b : e - p], words[b + p : e]) for b, e, p in zip(begin.tolist(), end.tolist(), q.tolist(), strict=True)):
            return begin, end, q


def batch_runs(texts: list[str | None], least: int = LEAST) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """For each text its runs (start, length, period), by start and period, and its words without what repeats in them, joined by one space."""
    cut = [(t or "").encode().split() for t in texts]
    numbers, sizes, names = [], [], 0
    for ws in cut:
        own = dict.fromkeys(ws)
        own = dict(zip(own, range(names, names + len(own)), strict=True))
        names += len(own)
        numbers.append(np.fromiter(map(own.__getitem__, ws), np.int64, len(ws)))
        sizes.append(len(ws))
    starts = np.append(0, np.cumsum(sizes))
    begin, end, q = find(np.concatenate(numbers) if numbers else np.empty(0, np.int64), least)
    order = np.lexsort((q, begin))
    begin, end, q = begin[order], end[order], q[order]
    owner = np.searchsorted(starts, begin, "right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = [np.ones(len(ws), bool) if i in set(owner.tolist()) else None for i, ws in enumerate(cut)] if len(owner) else [None] * len(cut)
    for d, b, e, p in zip(owner.tolist(), (begin - starts[owner]).tolist(), (end - starts[owner]).tolist(), q.tolist(), strict=True):
        runs[d].append((b, e - b, p))
        kept[d][b + p : e] = False
    joined = [b" ".join(ws if k is None else [ws[i] for i in np.flatnonzero(k).tolist()]).decode() for ws, k in zip(cut, kept, strict=True)]
    return runs, joined


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, runs array<struct<start, length, period>>, collapsed): all runs of each text, and the text with the first period only of each."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            size = f["text"].str.len().fillna(0).cumsum() // (6 * AT_ONCE)
            for _, part in f.groupby(size, sort=False):
                runs, collapsed = batch_runs([None if t is None else t for t in part["text"]], least)
                yield pd.DataFrame({"id": part["id"], "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], "collapsed": collapsed})

    kind = dict(docs.dtypes)[id]
    out = docs.select(docs[id].alias("id"), docs[text].alias("text")).mapInPandas(work, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id)
