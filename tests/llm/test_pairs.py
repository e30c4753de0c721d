"""Near duplicates, repeated passages, decontamination and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomfield.llm import decontam, line_dedup, minhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, source string, n_chars long, rep string, `_row` string"


def table(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    base = [[word() for _ in range(r.randint(20, 120))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        own = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            own[r.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    shared = " ".join(word() for _ in range(40))
    rows += [(200 + i, f"{word()} {word()} {shared} {word()} {word()}\n{word()}") for i in range(8)]
    return rows + [(300, None), (301, ""), (302, " \n\t"), (303, "Two words"), (304, "two WORDS"), (305, "é ü 𝄞 x y z " * 9), (None, "a b c d e f"), (0, rows[0][1]), (307, "w" + " w" * 30_000)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.group_duplicates(table(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {(i, len(s), find(i), find(i) == i) for i, s in sets.items()} | {(None, 2, None, True)}
    assert got == want


def test_keep_one_keeps_columns_and_null_ids(spark):
    docs = table(spark, corpus())
    out = minhash_dedup.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 1 and len(ids) == len(set(ids)) and 303 in ids and 304 not in ids


def test_one_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "words of its own and nothing more here")]
    got = {(r.doc_id, r.component_id) for r in minhash_dedup.group_duplicates(table(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_near_duplicates_of_nothing(spark):
    empty = table(spark, []).limit(0)
    assert minhash_dedup.group_duplicates(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_estimate_follows_similarity(spark):
    r = random.Random(4)
    common = [str(r.random()) for _ in range(600)]
    a, b = common, common[:450] + [str(r.random()) for _ in range(150)]
    docs = table(spark, [(1, " ".join(a)), (2, " ".join(b))])
    signed = docs.select("doc_id", "text").mapInArrow(minhash_dedup._sign, minhash_dedup.SIGNED)
    both = signed.where("doc_id = 1").selectExpr("packed AS pa").crossJoin(signed.where("doc_id = 2").selectExpr("packed AS pb"))
    x, y = shingles(" ".join(a)), shingles(" ".join(b))
    assert both.select(minhash_dedup.estimate("pa", "pb")).first()[0] == pytest.approx(len(x & y) / len(x | y), abs=0.1)


def remove_by_hand(rows, depth=50):
    first = defaultdict(lambda: None)
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - depth + 1):
                w = b[p : p + depth]
                first[w] = i if first[w] is None else min(first[w], i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if i is not None and first[b[p : p + depth]] < i:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(seed=2):
    r = random.Random(seed)
    pool = ["".join(r.choice("ab é") for _ in range(r.randint(30, 140))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.6 else "".join(r.choice("xyz ") for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 8)))) for i in range(50)]
    long = "".join(r.choice("qrstuv") for _ in range(3000))
    return rows + [(60, None), (61, ""), (62, "a" * 400), (63, "b" + "a" * 300), (64, "a" * 49), (65, "a" * 50), (3, rows[7][1]), (None, rows[7][1]), (70, long), (71, "k" + long[100:2000] + "m"), (72, long)]


@pytest.mark.parametrize("piece, gather", [(1 << 18, 400_000), (120, 50)])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, piece, gather):
    """Small pieces and gatherings take every text through the path of very long ones (values are pickled with the functions)."""
    rows = passages()

    def small(make):
        def made(*a):
            run = make(*a)

            def inner(batches):
                before = suffix_dedup.PIECE, suffix_dedup.GATHER
                try:  # workers are used again by later tests
                    suffix_dedup.PIECE, suffix_dedup.GATHER = piece, gather
                    suffix_dedup._powers.clear()
                    yield from run(batches)
                finally:
                    suffix_dedup.PIECE, suffix_dedup.GATHER = before
                    suffix_dedup._powers.clear()

            return inner

        return made

    for name in ("_first_pass", "_last_pass", "_cut_out"):
        monkeypatch.setattr(suffix_dedup, name, small(getattr(suffix_dedup, name)))
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(table(spark, rows)).drop("kept").collect())
    assert got == remove_by_hand(rows)


def test_long_arrow_strings(spark):
    rows = passages()
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(table(spark, rows)).drop("kept").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
    assert got == remove_by_hand(rows)


def test_long_texts_go_in_pieces():
    import numpy as np

    data = np.frombuffer(bytes(random.Random(3).choices(range(97, 103), k=3 * suffix_dedup.PIECE // 2)), np.uint8)
    seen = [(b, e) for g in suffix_dedup._pieces(np.array([0, len(data)]), np.array([0])) for _, b, e in g]
    assert seen[0][0] == 0 and seen[-1][1] == len(data) and all(y[0] == x[1] - suffix_dedup.DEPTH + 1 for x, y in zip(seen, seen[1:]))


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 14, 30, 31, 60, 100, 140, 3, 1])] + [(50, None), (51, ""), (52, "dup item here now ok yes"), (52, "dup item here now ok yes")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(r.choice([0, 3, 50, 400, 3000]))]
        if i % 2:
            item = (items[r.randrange(9)][1] or "").split()
            if i % 4 == 3:
                item = [w if r.random() < 0.97 else word() for w in item]
            at = r.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else " ".join(body)))
    docs += [(90, None), (91, ""), (None, items[4][1]), (1, docs[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = table(spark, docs)
    got = Counter((x.doc_id, x.n_shingles, tuple(x.item_ids)) for x in decontam.find_items(frame, bench).collect())
    sets = defaultdict(set)
    for i, t in items:
        sets[i] |= shingles(t)
    want = Counter((i, len(s), tuple(sorted(k for k, q in sets.items() if q and 100 * len(q & s) >= 75 * len(q)))) for i, t in docs for s in [shingles(t)])
    assert got == want
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(i for i, t in docs if not any(q and 100 * len(q & shingles(t)) >= 75 * len(q) for q in sets.values()))
    assert {tuple(x.item_ids) for x in decontam.find_items(frame, bench.limit(0)).collect()} == {()}


def test_rows_of_one_id_or_none_are_judged_by_their_own_text(spark, monkeypatch):
    words = [f"w{i}" for i in range(120)]
    held = {i: " ".join(words[20 * i : 20 * i + 20]) for i in range(6)}
    docs = [(1, "before " + held[0]), (1, "clean words only in this text"), (1, "before " + held[0]), (None, held[1] + " after"), (None, "nothing here at all to find"), (None, None), (2, held[2] + " " + held[3])]
    bench = spark.createDataFrame(list(held.items()), "item_id long, text string")
    frame = table(spark, docs)
    want = Counter([(1, (0,)), (1, ()), (1, (0,)), (None, (1,)), (None, ()), (None, ()), (2, (2, 3))])
    for name, least in (("ITEM_BLOCK", 20_000), ("ITEM_BLOCK", 2), ("ITEM_BYTES", 250)):
        monkeypatch.undo()
        monkeypatch.setattr(decontam, name, least)
        assert Counter((x.doc_id, tuple(x.item_ids)) for x in decontam.find_items(frame, bench).collect()) == want
        kept = [(x.doc_id, x.text) for x in decontam.drop_contaminated(frame, bench).collect()]
        assert Counter(kept) == Counter([docs[1], *docs[4:6]])


def test_recall_of_scattered_items(spark):
    """Items of any length in pieces of six words through long documents, three quarters of their shingles kept."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(5))
    items = [(i, [word() for _ in range(r.choice([5, 7, 11, 19, 40, 90, 200, 400]))]) for i in range(60)]
    docs = []
    for i, item in items:
        body = []
        for b in range(0, max(1, len(item) - 5), 2):
            body += [word() for _ in range(r.choice([3, 30, 200]))] + item[b : b + 6]
        docs.append((i, " ".join(body)))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(x.doc_id, i) for x in decontam.find_items(table(spark, docs), bench).collect() for i in x.item_ids}
    sets = {i: shingles(" ".join(t)) for i, t in items}
    want = {(d, i) for d, t in docs for i, q in sets.items() if 100 * len(q & shingles(t)) >= 75 * len(q)}
    assert len(want) >= 45 and got == want


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(90):
        lines = [f"line {r.randrange(1000)}" for _ in range(r.randint(0, 4))] + ["All rights reserved"] * (r.random() < 0.3) + ["menu"] * (i % 3 == 1) + ["", "  "]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(95, None), (96, ""), (4, rows[4][1])]
    docs = table(spark, rows).withColumnRenamed("rep", "n_dropped")
    for ratio in (0.2, 0.05):
        got = Counter((x.doc_id, x.text, x.n_chars, x.n_dropped) for x in line_dedup.clean_documents(docs, ratio).collect())
        pages, held = Counter(), Counter()
        for i, t in rows:
            pages[i % 3] += 1
            held.update((i % 3, s) for s in {s for s in (t or "").split("\n") if s.strip()})
        certain = lambda n, p: n >= line_dedup.HOLDERS and n / p - ratio > line_dedup.SURE * (ratio * (1 - ratio) / p) ** 0.5  # noqa: E731, B023
        bad = {k for k, n in held.items() if certain(n, pages[k[0]])}
        assert bad
        clean = lambda i, t: None if t is None else "\n".join(s for s in t.split("\n") if (i % 3, s) not in bad)  # noqa: E731, B023
        assert got == Counter((i, clean(i, t), len(clean(i, t) or ""), "x") for i, t in rows)
    assert line_dedup.clean_documents(docs.limit(0)).collect() == []


def test_small_sites_have_boilerplate_too(spark):
    pages = {"five": 5, "big": 100, "pair": 2}
    rows = [(h, i, [f"{h} own {i}"] + ["foot"] * (i < k) + ["often"] * (i < n)) for h, n in pages.items() for k in [{"five": 3, "big": 14, "pair": 2}[h]] for i in range(n)]
    frame = spark.createDataFrame([(f"{h}{i}", h, x) for h, i, x in rows], "page_id string, host string, lines array<string>")
    out = line_dedup.drop_boilerplate(frame, frame.lines, frame.host, "page_id").collect()
    left = {h: Counter(s for x in out if x.host == h for s in x.kept_lines) for h in pages}
    # On all of five pages, on 3 of 5, and on all of 100 it goes; 14 of 100 isn't certain, and two pages repeat no line often enough.
    assert not left["five"]["often"] and not left["five"]["foot"] and not left["big"]["often"]
    assert left["big"]["foot"] == 14 and left["pair"]["often"] == 2


def test_page_lines(spark):
    html = "<html><head><title>A  B</title><script>var x='<p>';</script></head><body><p>One <b>two</b></p><div>\n three\t</div><!-- no --></body></html>"
    df = spark.createDataFrame([(html, "HTTP://Www.Example.org:80/x?y"), (None, None)], "h string, u string")
    rows = df.select(line_dedup.html_lines(df.h), line_dedup.url_host(df.u)).collect()
    assert rows[0][0] == ["A B", "One two", "three"] and rows[0][1] == "www.example.org" and rows[1][0] is None


def templated(seed, n, shared, own):
    """Pages of one template with words of their own, and near copies of some of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(shared)]
    pages = [frame + [word() for _ in range(own)] for _ in range(n)]
    for i in range(0, n // 4, 2):
        pages[i] = list(pages[i + n // 2])
        pages[i][-1 - i % 9] = word()
    return [(i, " ".join(p)) for i, p in enumerate(pages)]


def links_of(rows):
    sets = {i: shingles(t) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("shared", [90, 100])
def test_a_bucket_of_many_components_equals_brute_force(spark, shared, monkeypatch):
    """240 pages that share most words, so that whole buckets hold hundreds of them, few of which are links."""
    rows = templated(shared, 240, shared, 120 - shared)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(links_of(rows)):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert len({find(i) for i in parent}) > 100
    confirmed = []
    monkeypatch.setattr(minhash_dedup, "_linked", lambda p, s, k, f=minhash_dedup._linked: (confirmed.append((k, p.count())), f(p, s, k))[1])
    got = {r.doc_id: r.component_id for r in minhash_dedup.group_duplicates(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in parent}
    # The large buckets were joined by rare shingles, and what came to be compared isn't all pairs of them.
    assert any(k == "set" and n < 240 * 239 / 2 / 20 for k, n in confirmed)


@pytest.mark.parametrize("slots", [1 << 20, 64])
def test_rarest_shingles_lose_no_link(spark, slots, monkeypatch):
    """Whether or not the sketch can tell shingles apart."""
    monkeypatch.setattr(minhash_dedup, "SKETCH", slots)
    rows = [(i, t) for i, t in corpus(5, 80) if t] + [(500 + i, t) for i, t in templated(3, 60, 90, 40)]
    rows = [(i, t) for i, t in rows if i is not None and len(t) < 5000 and shingles(t)]
    rows = list(dict(rows).items())
    numbers = {}
    sets = [(k, i, [numbers.setdefault(g, len(numbers)) for g in sorted(shingles(t))]) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(sets, "`set` long, id long, shingles array<long>")
    met = {tuple(sorted((rows[r.a][0], rows[r.b][0]))) for r in minhash_dedup.prefix_pairs(frame, frame.select("id", F.col("id").alias("c"))).collect()}
    assert links_of(rows) <= met and len(met) < len(rows) ** 2 / 8
