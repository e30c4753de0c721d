"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in column expression over the whole text; no user
function runs.  Null text counts as empty (no words, fails the base rule).
Repeated rows are judged alike, extra columns pass through `apply_rules`, an
empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this from at or an have not they you which "
    "de la le et les des en un du une que est pour qui dans par pas sur au avec "
    "der die und den von zu das mit sich ist dem nicht ein eine als auch auf für im "
    "el los se las del y con una su lo por no es al más como"
).split()

# Fixed values: (measure, least, most, words from which the rule holds); None leaves a side open.
RULES = (
    ("mean_word_chars", 1.5, 20.0, 0),
    ("symbol_ratio", None, 0.10, 0),
    ("stop_ratio", 0.02, None, 30),
    ("dup_line_ratio", None, 0.50, 0),
)

WINDOW = 5


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the raw counts and the ratios that the rules name, beside all columns of `docs`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("_text", whole)
    out = out.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.col("n_words").cast("int") - WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])))
    out = out.withColumn("_windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # Only texts that repeat a window at all are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(placed)))
    twice = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)),
    )
    out = out.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + WINDOW).cast("int").alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    out = (
        out.withColumn("word_chars", (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_stop", F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"))
    )
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return out.drop("_text", "_words", "_lines", "_w", "_windows", "_sorted", "_twice").withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "stop_ratio": F.col("n_stop") / words,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        }
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression: true where every rule holds."""
    tests = []
    for measure, least, most, words in rules:
        short = [F.col("n_words") < words] if words else []
        tests += [reduce(lambda a, b: a | b, [*short, t]) for t in ([F.col(measure) >= F.lit(least)] if least is not None else []) + ([F.col(measure) <= F.lit(most)] if most is not None else [])]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """All columns of `docs` (clashing names are replaced), the measures, base_failed and kept."""
    return with_measures(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Documents that pass, with their own columns only (a column of any name keeps its values)."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_whole"))
    # The row number keeps the optimizer from writing the measures, many times over, into the filter.
    judged = judge(packed, rules, "_whole").select("_row", "kept", F.monotonically_increasing_id().alias("_n"))
    return judged.where("kept AND _n >= 0").select("_row.*")
