"""Quality rules, mixing, chat, language, quality classifier, personal data, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomfield.llm import chat, langid, mixing, pii, quality_knn, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, `_words` string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "z", "w") for i, t, s in rows], DOCS)


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {p for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def test_quality_measures_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("the of a b cd é 𝄞 #x |".split()) + r.choice(["", "", "\n"]) for _ in range(r.randint(0, 60))), "s") for i in range(80)]
    rows += [(100, None, "s"), (101, "", None), (102, "a b c d e a b c d e", "s"), (103, "x " * 20_000, "s"), (104, "l\r\nl\r\nm\x0b\x0c", "s"), (None, "the cat", "s"), (102, "a b c d e a b c d e", "s")]
    out = quality_rules.judge(docs_of(spark, rows)).collect()
    got = Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in out)
    assert got == Counter((i, *measured(t)) for i, t, _ in rows)
    assert not any(x.kept and x.base_failed for x in out)
    kept = quality_rules.apply_rules(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, []).columns and {x["_words"] for x in kept.collect()} <= {"w"}
    assert quality_rules.judge(docs_of(spark, [])).collect() == []


def test_rules_are_one_projection(spark):
    plan = quality_rules.judge(docs_of(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_mix_targets_and_truncation(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 40), s) for i, s in enumerate(["a"] * 300 + ["b"] * 200 + ["c"] * 150 + ["d"] * 40 + [None] * 60)]
    rows += [(5000, None, "e"), (5001, "", "e"), (7, rows[7][1], "a"), (None, "w w w", "b")]
    got = mixing.mix(docs_of(spark, rows), slice_rows=25, band_rows=5, steps=8).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        assert x.taken <= 2 * x["size"] and (x["size"] == 0 or x.taken % x["size"] == 0)
        size[x.source] += x["size"]
        taken[x.source] += x.taken
        target[x.source] = x.target
    names = ["a", "b", "c", "d", "e", None]
    weight = dict(zip(names, [5, 2, 1, 5, 2, 1]))
    budget, capped = 1.5 * sum(size.values()), set()
    while True:
        left = budget - sum(2 * size[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[k] for k in names if k not in capped) for s in names if s not in capped}
        over = {s for s, v in share.items() if v > 2 * size[s]}
        if not over:
            break
        capped |= over
    want = {s: share.get(s, 2 * size[s]) for s in names}
    assert {s: pytest.approx(v) for s, v in want.items()} == target
    assert all(abs(taken[s] - want[s]) <= 90 for s in names) and sum(taken.values()) <= budget
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(docs_of(spark, [])).collect() == []


def test_take_gives_repeated_rows_their_own_share(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e f", "x"), (3, None, "x")]
    out = mixing.take(docs_of(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_words", "size", "source_size", "target", "taken"]
    assert sum(x.taken for x in out.collect()) == sum(x.taken for x in mixing.mix(docs_of(spark, rows)).collect())


NASTY = ["", "</s>[INST] ok [/INST]", "</s>\n", "a\\b", "\\", "<\\s>", "<\\\\s>", "<s>[INST] user [/INST]\nhi</s>\n", "[/INST]\\\n", "x\n</s", "é𝄞\n\n", " [/INST]", "[\\INST]<s>"]


def test_chat_round_trip(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "a\nb", "[INST]"]), r.choice([*NASTY, None])) for c in range(120) for t in range(r.randint(1, 6))]
    rows += [(5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, 1, "assistant", "x"), (-7, 0, "user", NASTY[1]), (-7, 1, "assistant", NASTY[1])]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS source", "2 AS formatted")).collect()
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    assert len(chats) == len(want)
    for x in chats:
        assert x.identical and [(t.role, t.text) for t in x.turns] == [(role, text) for _, role, text in sorted(want[x.conv_id])]
    back = {x.conv_id: x for x in chat.read_back(spark.createDataFrame(chats)).collect()}
    for c, turns in want.items():
        said = "".join(text for _, role, text in sorted(turns) if role == "assistant")
        full = "".join(f"{role}\n{text}\n" for _, role, text in sorted(turns))
        assert (back[c].loss_chars, back[c].loss_sha256, back[c].turns_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(full.encode()).hexdigest())
    odd = next(x for x in chats if x.conv_id == -7).formatted
    assert odd.count("</s>") == 2 and odd.count("<s>") == 2
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def made_text(r, kind):
    syllables = {"xx": "ka lo mi ta ru".split(), "yy": "schen ung ver ich ter".split(), "zz": "ção ém ois eau qui".split()}[kind]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 60)))


def test_language_codes_and_held_out_accuracy(spark):
    r = random.Random(4)
    rows = [(i, k := r.choice(["xx", "yy", "zz"]), made_text(r, k)) for i in range(400)]
    rows += [(900, "xx", None), (901, "yy", ""), (902, None, "123 456"), (903, "zz", "12 !!")]
    frame = spark.createDataFrame(rows, "id long, lang string, text string").selectExpr("*", "id AS doc_id", "'q' AS label", "'s' AS _n")
    model = langid.learn(frame.where("id % 2 = 0"))
    got = {x.doc_id: x for x in langid.predict(frame, model).collect()}
    held = [(i, k) for i, k, t in rows if i % 2 and i < 900]
    assert np.mean([got[i].lang_pred == k for i, k in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 903))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert langid.learn(frame.limit(0)) is None
    assert {x.lang_pred for x in langid.predict(frame, None).collect()} == {"und"}
    for n in (2, 3, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n and all(abs(c.sum()) < n for c in code.T)


def test_codewords_of_many_languages():
    for n in (6, 7, 8, 12, 30):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n
        assert len({tuple(c * c[0]) for c in code.T}) == code.shape[1] and all(abs(c.sum()) < n for c in code.T)


def test_decoding_equals_a_plain_loop():
    r, kinds = random.Random(11), ["xx", "yy", "zz"]
    texts = [(made_text(r, k), k) for k in kinds * 30]
    counts = lambda t: langid.trigram_counts(np.frombuffer(t.encode(), np.uint8), True)
    model = langid.Model(langid.features(np.stack([counts(t) for t, _ in texts])), [k for _, k in texts])
    asked = [made_text(r, k) for k in kinds * 5] + [made_text(r, "xx") + " " + made_text(r, "yy"), "ab", "q w e"]
    names, scores, doubt = model.decode(np.stack([counts(t) for t in asked]))
    for t, name, score, d in zip(asked, names, scores, doubt, strict=True):
        x = np.sqrt(counts(t).astype(float))
        x /= max(np.sqrt((x * x).sum()), 1e-9)
        bits = [sum((x - model.mean) * model.weights[:, b]) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(np.log1p(np.exp(-bit * c)) * w for bit, c, w in zip(bits, row, model.trust, strict=True)) for row in model.code]
        k = int(np.argmin(loss))
        like = np.exp(-np.array(loss) + loss[k])
        off = sum(w for bit, c, w in zip(bits, model.code[k], model.trust, strict=True) if bit * c < 0) / sum(model.trust)
        assert name == model.languages[k] and score == pytest.approx(1 / like.sum(), abs=1e-4)
        assert d == (score < langid.AMBIGUOUS or off > langid.FAR)
    assert doubt.any() and not doubt.all()


def test_only_letters_make_a_language(spark):
    r = random.Random(12)
    rows = [(i, "xx" if i % 2 else "yy", made_text(r, "xx" if i % 2 else "yy")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.learn(docs.withColumnRenamed("doc_id", "id"))
    odd = spark.createDataFrame([(0, "½ ² ³ 12"), (1, "_ ①"), (2, "ª"), (3, "x")], "doc_id long, text string")
    assert [x.lang_pred == "und" for x in langid.predict(odd, model).orderBy("doc_id").collect()] == [True, True, False, False]


def test_samples_are_bounded_and_even(spark):
    from loomfield.llm import ngrams

    rows = [(5, "a")] * 900 + [(i, "a") for i in range(400)] + [(i, "b") for i in range(7)] + [(i, None) for i in range(60)] + [(1000 + i, f"rare{i:03}") for i in range(230)]
    frame = spark.createDataFrame(rows, "id long, label string")
    picked = [(x.id, x.label) for x in ngrams.bounded_sample(frame, "label", 50).collect()]
    n = Counter(label for _, label in picked)
    assert len(set(picked)) == len(picked) and n["a"] == 50 and n["b"] == 7 and n[None] == 50 and len(n) == 200
    assert {x.id for x in ngrams.bounded_sample(frame.where("label = 'a'"), "label", 50).collect()} == {i for i, label in picked if label == "a"}
    r = random.Random(13)
    texts = [(5, f"{made_text(r, 'xx')}")] * 300 + [(i, made_text(r, "xx")) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality_knn.learn(docs.selectExpr("doc_id AS id", "doc_id % 2 AS label"), docs, sample=40)
    assert len(model.labels) == 80


def test_an_id_with_both_labels_teaches_nothing(spark):
    r = random.Random(14)
    docs = spark.createDataFrame([(i, made_text(r, "xx")) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (4, 0), (4, 0)], "id long, label int")
    assert len(quality_knn.learn(labels, docs).labels) == 19


def test_long_arrow_strings_score_alike(spark):
    r = random.Random(15)
    rows = [(i, ["xx", "yy"][i % 2], made_text(r, ["xx", "yy"][i % 2])) for i in range(120)] + [(900, "xx", ""), (901, "yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")

    def both():
        lang = langid.predict(docs, langid.learn(docs.withColumnRenamed("doc_id", "id"))).orderBy("doc_id").collect()
        return lang, quality_knn.rate(docs, quality_knn.learn(docs.selectExpr("doc_id AS id", "doc_id % 2 AS label"), docs)).orderBy("doc_id").collect()

    plain = both()
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert both() == plain
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_votes_equal_plain_nearest_neighbours():
    r = random.Random(16)
    terms = lambda t: quality_knn.text_terms(np.frombuffer(t.encode(), np.uint8))
    taught = [made_text(r, r.choice(["xx", "yy", "zz"])) for _ in range(70)]
    labels = np.array([int(r.random() < 0.6) for _ in taught])
    model = quality_knn.Model(np.stack([terms(t) for t in taught]), labels)
    asked = np.stack([terms(made_text(r, r.choice(["xx", "yy", "zz"]))) for _ in range(25)])
    got = model.score(asked)
    place = lambda x: (lambda v: v / np.sqrt((v * v).sum()))((quality_knn.weighted(x[None], model.idf)[0] - model.mean) @ model.axes)
    known = [place(terms(t)) for t in taught]
    for x, score in zip(asked, got, strict=True):
        near = sorted(((float(place(x) @ k), y) for k, y in zip(known, labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        up = sum(s * s for s, y in near if y and s > 0) / model.good
        down = sum(s * s for s, y in near if not y and s > 0) / (1 - model.good)
        assert score == pytest.approx(up / (up + down), abs=1e-3)


def test_quality_neighbours_on_held_out_texts(spark):
    r = random.Random(5)
    bad = lambda t: r.choice([lambda s: s.upper().replace(" ", "!! "), lambda s: s.replace(" ", "### "), lambda s: (s.split()[0] + " ") * 40])(t)
    rows = []
    for i in range(400):
        label = int(r.random() < 0.7)
        text = made_text(r, r.choice(["xx", "yy", "zz"]))
        rows.append((i, text if label else bad(text), label))
    docs = spark.createDataFrame([*rows, (900, None, 0), (901, "", 1)], "doc_id long, text string, label int").withColumnRenamed("label", "id_")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0] + [(4, rows[4][2]), (None, 1), (2, None)], "id long, label int")
    model = quality_knn.learn(labels, docs)
    got = {x.doc_id: x for x in quality_knn.rate(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if i % 2]) > 0.95
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert quality_knn.learn(labels.limit(0), docs) is None
    assert {x.score for x in quality_knn.rate(docs, None).collect()} == {0.5}


def brute_patterns(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_patterns_equal_plain_regular_expressions():
    r = random.Random(6)
    bits = ["a@b.c", "@", ".", "x", " ", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111-1111 1111 1111", "+1 (017) 555-7713", "+", "-", "9", "12", "é", "𝄞", "\n", "b@c.d@e.f", "1.2.3.4.5.6", "00000000000000000", "%+-@q-.r.s"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.find_patterns(text) == brute_patterns(text), text


def luhn16(r):
    d = [r.randrange(10) for _ in range(15)]
    s = sum(v if k % 2 else sum(divmod(2 * v, 10)) for k, v in enumerate(d[::-1]))
    return "".join(map(str, d)) + str(-s % 10)


def private_row(i, r):
    make = [lambda: f"user{r.randrange(999)}@mail{r.randrange(9)}.example.com", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: luhn16(r), lambda: f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}", lambda: f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"']
    return i, " ".join(["some words of text here"] * r.randint(1, 30)) + " " + r.choice(make)() + " and more words " + r.choice(make)() + " end"


@pytest.fixture(scope="module")
def tagger(spark):
    r = random.Random(7)
    rows = [(i, made_text(r, r.choice(["xx", "yy", "zz"])) + " " + private_row(i, r)[1]) for i in range(500)]
    # An id that has most of the rows takes one place.
    rows += [(7, f"hot row {k}") for k in range(900)]
    return pii.learn(spark.createDataFrame(rows, "doc_id long, text string"))


def test_tagger_adds_to_patterns_and_never_drops_one(spark, tagger):
    r = random.Random(17)
    rows = [private_row(i, r) for i in range(200)] + [(900, None), (901, ""), (902, "no digits here"), (903, "card 4111111111111112 fails the check"), (3, private_row(3, r)[1]), (904, "w " * 40_000 + "write to anna.berg (at) posten (dot) org now" + " w" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans")
    found = pii.find(docs, tagger).collect()
    assert len(found) == len(rows)
    assert Counter((x.doc_id, str([(pii.KINDS.index(k), b, e) for k, b, e in map(tuple, x.base)])) for x in found) == Counter((i, str(brute_patterns(t or ""))) for i, t in rows)
    for x in found:
        base = [tuple(s) for s in x.base]
        assert base == [tuple(s) for s in x.spans if tuple(s) in set(base)]
        assert all(not (b < e2 and b2 < e) for k, b, e in map(tuple, x.spans) if (k, b, e) not in base for k2, b2, e2 in map(tuple, x.spans) if (k2, b2, e2) != (k, b, e))
    by_id = {x.doc_id: x for x in found}
    assert by_id[902].spans == [] and by_id[903].spans == []
    # A very long text is read to its end: a spelled-out address in the middle of it is found.
    assert [s.kind for s in by_id[904].spans] == ["email"]
    secrets = [(i, m.span(1)) for i, t in rows[:200] for m in re.finditer(r'token = "([0-9a-f]{32})"', t)]
    caught = sum(("secret", *at) in {tuple(s) for s in by_id[i].spans} for i, at in secrets if i != 3)
    assert caught >= 0.9 * len(secrets)
    digest = {x.doc_id: x for x in pii.digest(pii.find(docs, tagger)).collect()}[901]
    assert digest.base_sha256 == hashlib.sha256(b"").hexdigest() and digest.spans == "" and digest.n_email == digest.n_spans == 0
    assert [x.spans == x.base for x in pii.find(docs, None).collect()] == [True] * len(rows)
    assert pii.learn(docs.limit(0)) is None


def test_precision_and_recall_on_made_texts(tagger):
    """Unseen made-up spans between unseen words: forms that no pattern knows count as well."""
    r, tagged, right, there = random.Random(99), 0, 0, 0
    texts, spans = [], []
    for _ in range(400):
        kind, said = pii.made_span(r)
        lead = made_text(r, r.choice(["xx", "yy", "zz"])) + (' token = "' if kind == 4 else " ")
        texts.append(lead + said + ('" ' if kind == 4 else " ") + made_text(r, "xx"))
        spans.append((kind, len(lead), len(lead) + len(said)))
    for text, (kind, b, e), (_, got) in zip(texts, spans, pii.Finder(tagger).find(texts), strict=True):
        truth = kind is not None and pii.plausible(kind, text[b:e])
        there += truth
        tagged += len(got)
        right += sum(truth and k == kind and x < e and b < y for k, x, y in got)
    assert right / tagged > 0.85 and right / there > 0.8, (right, tagged, there)


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    t = pii.Tagger()
    t.p["move"], t.p["start"] = rng.normal(0, 2, t.p["move"].shape).astype(np.float32), rng.normal(0, 2, t.TAGS).astype(np.float32)
    emit = rng.normal(0, 2, (5, t.TAGS, 6)).astype(np.float32)
    got = t.viterbi(emit)
    worth = lambda path, r: t.p["start"][path[0]] + sum(emit[i, k, r] for i, k in enumerate(path)) + sum(t.p["move"][a, b] for a, b in zip(path, path[1:], strict=False))
    for r in range(6):
        assert tuple(got[r]) == max(product(range(t.TAGS), repeat=5), key=lambda p: worth(p, r))


def test_windows_left_out_have_no_span():
    rng, t, seen = np.random.default_rng(2), pii.Tagger(), 0
    for _ in range(40):
        t.p["move"], t.p["start"] = rng.normal(0, 2, t.p["move"].shape).astype(np.float32), rng.normal(0, 1, t.TAGS).astype(np.float32)
        emit = rng.normal(0, 1, (12, t.TAGS, 50)).astype(np.float32)
        emit[:, 0] += rng.uniform(0, 8)
        quiet = t.quiet(emit)
        seen += quiet.sum()
        assert not t.viterbi(emit)[quiet].any()
    assert seen > 50


def test_tagger_gradient_is_right():
    tagger = pii.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    sym, tags = rng.integers(0, pii.SYMBOLS, (3, 7)).astype(np.uint8), rng.integers(0, 6, (3, 7)).astype(np.uint8)
    _, grad = tagger._gradient(sym, tags)
    for key in tagger.p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in tagger.p[key].shape)
            kept, step = tagger.p[key][at], 1e-3
            tagger.p[key][at] = kept + step
            up = tagger._gradient(sym, tags)[0]
            tagger.p[key][at] = kept - step
            down = tagger._gradient(sym, tags)[0]
            tagger.p[key][at] = kept
            assert grad[key][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)
    tagger = pii.Tagger()
    both = np.concatenate([tagger._lstm(sym, "f")[0], tagger._lstm(sym, "b")[0]], 2)
    assert np.allclose(tagger.emissions(sym).transpose(0, 2, 1), both @ tagger.p["out"] + tagger.p["bias"], atol=1e-4)


def test_windows_cover_a_text_and_spans_cross_them():
    for n in (1, 47, 48, 49, 255, 256, 257, 463, 464, 465, 3000):
        text = np.random.default_rng(n).integers(0, pii.PAD, n).astype(np.uint8)
        at = pii.cut_windows(text)
        back = np.concatenate([w[: pii.WINDOW - pii.OVERLAP] for w in at] + [at[-1][pii.WINDOW - pii.OVERLAP :]])
        assert (back[:n] == text).all() and (back[n:] == pii.PAD).all() and len(at) == max(1, -(-(n - pii.OVERLAP) // (pii.WINDOW - pii.OVERLAP)))
    true = np.zeros(1000, np.uint8)
    true[40:610], true[620:621], true[999] = 3, 1, 2
    line = np.concatenate([true, np.zeros(300, np.uint8)])
    step = pii.WINDOW - pii.OVERLAP
    tags = np.stack([line[i * step : i * step + pii.WINDOW] for i in range(len(pii.cut_windows(true)))]).astype(np.int8)
    assert pii.reconcile(1000, tags) == [(2, 40, 610), (0, 620, 621), (1, 999, 1000)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rules_by_hand(rows):
    out = []
    for i, t, s in rows:
        n, chars, signs, dup, _, failed = measured(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        stops = sum(w.lower() in quality_rules.STOP_WORDS for w in words)
        if not failed and 1.5 <= chars / n <= 20 and signs / n <= 0.1 and dup <= 0.5 * len(lines) and (n < 30 or stops / n >= 0.02):
            out.append((i, t, s))
    return out


def lines_by_hand(rows):
    pages, held = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        held.update((s, x) for x in {x for x in t.split("\n") if x.strip()})
    bad = {(s, x) for (s, x), n in held.items() if n >= 3 and n / pages[s] - 0.1 > 1.64 * (0.09 / pages[s]) ** 0.5}
    assert bad
    return [(i, "\n".join(x for x in t.split("\n") if (s, x) not in bad), s) for i, t, s in rows]


def copies_by_hand(rows):
    sets, first = [(i, shingles(t)) for i, t, _ in rows], {i: i for i, _, _ in rows}
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                low, high = sorted((first[i], first[j]))
                first = {k: low if v == high else v for k, v in first.items()}
    return [x for x in rows if first[x[0]] == x[0]]


def leaks_by_hand(rows, items):
    sets = [shingles(t) for _, t in items]
    return [x for x in rows if not any(q and 100 * len(q & shingles(x[1])) >= 75 * len(q) for q in sets)]


def mix_by_hand(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows})
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight, capped, budget = dict(zip(names, [5, 2, 1] * len(names), strict=False)), set(), 1.5 * sum(size.values())
    while True:
        left = (budget - sum(2 * total[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and left * weight[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * total[s] if s in capped else left * weight[s] for s in names}
    queue = []
    for s in names:
        upto = 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            upto += size[i]
            queue += [((upto + e * total[s]) / target[s], i) for e in (0, 1) if size[i]]
    taken, run = Counter(), 0
    for finish in sorted({f for f, _ in queue}):
        now = [i for f, i in queue if f == finish]
        run += sum(size[i] for i in now)
        if run > budget:
            break
        taken.update({i: size[i] for i in now} if len(set(now)) == len(now) else Counter({i: size[i] * now.count(i) for i in now}))
    return {(i, t, s, taken[i]) for i, t, s in rows if taken[i]}


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(21)
    say = lambda n: " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.2 else "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(i, say(r.choice([8, 15, 40]))) for i in range(6)]
    rows = [(i, "\n".join([say(r.randint(12, 40)), *["Subscribe to the letter of the house"] * (r.random() < 0.5), say(r.randint(3, 30))]), f"s{i % 4}") for i in range(70)]
    rows += [(100 + i, t.replace("the", "thee", 1) if i % 2 else t, s) for i, (_, t, s) in enumerate(rows[:14])]
    rows += [(200 + i, say(20) + " " + items[i][1] + " " + say(9), "s1") for i in range(6)] + [(300, "$ # % & < > | *", "s0"), (301, "", "s0"), (302, None, "s2"), (303, "a b c d e " * 9, "s3")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = lambda df: sorted((x.doc_id, x.text, x.source) for x in df.collect())
    want, at = rows, docs
    for (_, stage), hand in zip(P.STAGES[:4], [rules_by_hand, lines_by_hand, copies_by_hand, lambda x: leaks_by_hand(x, items)], strict=True):
        before, want = len(want), hand(want)
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == docs.columns and plain(at) == sorted(want) and (len(want) < before or hand is lines_by_hand)
        assert all(x.n_chars == len(x.text) for x in at.collect())
    mixed = {(x.doc_id, x.text, x.source, x.taken) for x in P.run(spark, str(tmp_path)).collect()}
    assert mixed == mix_by_hand(want) and 0 < len(mixed)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, folder).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        before = after
    last = P.STAGES[-1][1](spark, before, folder)
    assert last.where("taken > 2 * size OR taken <= 0").count() == 0
    ids = {x.doc_id for x in P.run(spark, folder).select("doc_id").collect()}
    assert ids == {x.doc_id for x in last.select("doc_id").collect()} and len(ids) > 80
