"""Scalar goldens, by hand from the formulas."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomfield.functions import lexicon, scoring as S, text as X
from loomfield.functions.vectors import cosine, guarded_cosine, parse_vector
from loomfield.sources import files


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_lexicon_sizes():
    assert (len(lexicon.HEDGE), len(lexicon.CERTAINTY), len(lexicon.CHALLENGE), len(set(lexicon.STOP_WORDS))) == (45, 24, 21, 70)


@pytest.mark.parametrize(
    "text, want",
    [
        ("", (0.0, 0.0, 0.0, 0.15)),
        ("maybe", (1.0, 0.0, 0.0, 0.55)),
        ("it seems it seems fine here now ok", (0.38, 0.0, 0.0, 0.3)),
        ("åmåste x måste", (0.0, 1.0, 0.0, 0.0)),
        ("why must this be so ", (0.0, 0.5, 0.5, 0.3)),
    ],
)
def test_hedging(spark, text, want):
    got = one(spark, "t string", (text,), S.hedging(F.col("t")).alias("h")).h
    assert tuple(got) == pytest.approx(want)


def test_ascii_boundaries_count_both(spark):
    assert one(spark, "t string", ("åmåste x måste",), X.marker_count(F.col("t"), ("måste",))).asDict().popitem()[1] == 2


def test_discrepancy_weights(spark):
    for act, want in {"assertive": 0.58, "directive": 0.5, "commissive": 0.54, "expressive": 0.32, "declarative": 0.62, "other": 0.0}.items():
        got = one(spark, "a string, h double, q double", (act, 0.7, 0.3), S.discrepancy(F.col("a"), F.col("h"), F.col("q")).alias("d")).d
        assert got == pytest.approx(want)
    assert one(spark, "a string, h double, q double", (None, 0.7, 0.3), S.discrepancy(F.col("a"), F.col("h"), F.col("q")).alias("d")).d == 0


def test_triangulation_both_ways(spark):
    column = S.triangulated(F.col("m"), F.col("l"), F.col("d"), F.col("a"), F.col("v")).alias("t")
    assert one(spark, "m double, l double, d double, a string, v double", (0.8, 0.5, 0.4, "assertive", 0.2), column).t == 0.52
    assert one(spark, "m double, l double, d double, a string, v double", (None, 0.5, 0.4, None, 0.2), column).t == 0.38


def test_small_scores(spark):
    row = one(spark, "d double, v double", (0.5, 0.32), S.cti(F.col("d"), F.col("v")).alias("c"), S.lexical_fz(F.col("d")).alias("z"), S.lexical_fy(F.lit(4.0)).alias("y"), S.clamp(F.lit(1.7)).alias("k"), S.canvas_percent(F.lit(-9.0)).alias("p"))
    assert tuple(row) == (0.4, 0.225, 0.0, 1.0, 5.0)


def test_text(spark):
    s = 'He left. she stayed. "Why?" Å. B. C said (so). [end]'
    row = one(spark, "t string", (s,), X.split_sentences(F.col("t")).alias("s"), X.tokenize(F.lit("The Café's naïve ÅRET x1-2 of")).alias("t"))
    assert row.s == ["He left. she stayed.", '"Why?" Å.', "B.", "C said (so).", "[end]"]
    assert row.t == ["the", "caf", "året", "x1-2"]
    row = one(spark, "t string", ("  A\n b ",), X.content_hash(F.col("t")).alias("h"), X.unit_type(F.lit(" a b c d e f g ")).alias("u"), X.sanitize_label(F.lit(" <b>x</b> ")).alias("l"))
    assert row.h == hashlib.sha256(b"a b").hexdigest() and row.u == "heading" and row.l == "x"


def test_model_reply(spark):
    good = '```json\n{"label": "' + "x" * 90 + '", "description": "d"}\n```'
    got = one(spark, "t string, b string", (good, "nonsense"), X.clean_model_json(F.col("t")).alias("g"), X.clean_model_json(F.col("b")).alias("n"))
    assert len(got.g.label) == 80 and got.g.description == "d" and got.n is None


def test_transcript(spark):
    seg = lambda t: [tuple(x) for x in one(spark, "t string", (t,), X.transcript_segments(F.col("t")).alias("s")).s]
    assert seg("intro [00:01] one [1:02:03] two [00:09]") == [(None, "intro"), ("00:01", "one"), ("1:02:03", "two")]
    assert seg("no marks") == [(None, "no marks")] and seg("") == [] and seg("[00:01]") == [(None, "[00:01]")]


@pytest.mark.parametrize("name, mime, want", [("A.PDF", "", "pdf"), ("x", "audio/ogg", "audio"), ("p.JPEG", None, "image"), ("a.zip", "", "zip"), ("n.ipynb", "", "notebook"), ("t.d.ts", "", "script"), ("t.json", "", "json"), ("s.scala", "", "text"), ("b.txt", "application/pdf", "pdf")])
def test_source_type(spark, name, mime, want):
    assert one(spark, "n string, m string", (name, mime), X.source_type(F.col("n"), F.col("m")).alias("s")).s == want


def test_excluded(spark):
    paths = ["node_modules/a.js", "src/dist/x", "a.LOCK", ".env.local", "b.zip", "c.min.js", "src/main.py", "distance/a.py"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(X.excluded_path(F.col("p")).alias("e")).collect()
    assert [r.e for r in rows] == [True] * 6 + [False] * 2


def test_vectors(spark):
    c = lambda a, b, f: one(spark, "a array<double>, b array<double>", (a, b), f(F.col("a"), F.col("b")).alias("c")).c
    assert c([1.0, 0.0], [1.0, 1.0], cosine) == pytest.approx(0.5**0.5)
    assert c([0.0, 0.0], [1.0, 1.0], cosine) is None and c(None, [1.0], cosine) is None and c([1.0], [1.0, 1.0], cosine) is None
    assert c([0.0, 0.0], [1.0, 1.0], guarded_cosine) == 0
    assert one(spark, "t string", ("[1, 2.5]",), parse_vector(F.col("t")).alias("v")).v == [1.0, 2.5]


def test_augment_leaves_out_what_is_missing(spark):
    column = X.augment(F.col("t"), F.col("d"), F.col("c"), F.col("a"), F.col("n")).alias("x")
    assert one(spark, "t string, d string, c string, a string, n double", ("body", "f.txt", None, "", 0.5), column).x == "[doc: f.txt] [certainty: 0.50] body"
    assert one(spark, "t string, d string, c string, a string, n double", ("body", None, None, None, None), column).x == "body"


def test_file_helpers():
    script = '/* block comment text */\n# first line of notes\n# second line\ndef main(a):\n    return "x"\nclass Thing {\n'
    assert files.script_units(script) == ["block comment text", "first line of notes\nsecond line", "def main", "class Thing"]
    assert files.script_units("short\nlonger line here\n") == ["longer line here"]
    assert files.notebook_units('{"cells": [{"cell_type": "code", "source": ["a = 1\\n", "b"]}, {"cell_type": "markdown", "source": "hey"}, {"source": "other text"}]}') == ["[code] a = 1\nb", "[raw] other text"]
    assert files.notebook_units("{") == ["{"] and files.notebook_units("[1]") == []


def test_sentences_keep_digits_at_their_ends(spark):
    """The place of a sentence isn't taken for characters to trim."""
    got = spark.createDataFrame([("0 begins. 1 follows 1. And 2 ends 2",)], "t string").select(X.split_sentences(F.col("t")).alias("s"), X.page_sentences(F.concat("t", F.lit(". 0123456789 0123456789"))).alias("p")).first()
    assert got.s == ["0 begins. 1 follows 1.", "And 2 ends 2"] and got.p[-1] == "0123456789 0123456789"
