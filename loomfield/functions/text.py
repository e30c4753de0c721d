"""Text preparation as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: White space as ECMAScript has it, in Java's syntax.
WS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def pieces(text: Column, pattern: str, least: int) -> Column:
    """Split, squeeze, keep what has `least` characters."""
    return F.filter(F.transform(F.split(text, pattern, -1), squeeze), lambda s: F.length(s) >= least)


def paragraphs(text: Column) -> Column:
    return pieces(text, rf"\n{WS}*\n+", 3)


def split_sentences(text: Column) -> Column:
    """Sentences end at . ! ? before white space and an upper-case letter, quote or bracket."""
    flat = F.regexp_replace(text, WS + "+", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+(?=[A-ZÅÄÖ\"'(\[])", -1), lambda s: F.trim(s)), lambda s: s != "")


def page_sentences(page: Column) -> Column:
    """Sentences of a page of positioned text: longer than 15 characters."""
    flat = F.regexp_replace(page, WS + "+", " ")
    return F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+", -1), lambda s: F.trim(s)), lambda s: F.length(s) > 15)


#: A token of a lower-cased text, in Java's syntax and in Python's.
TOKEN = "[a-zæøåäöü0-9'-]{3,}"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens of more than two characters; others than a-z, Nordic letters, digits, ' and - part them."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_tokens(text: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokenize(text), lambda w: ~w.isin(list(lexicon.STOP_WORDS)))


def word_count(text: Column) -> Column:
    """Pieces between white space; blanks at either end count one piece each."""
    return F.size(F.split(text, WS + "+", -1))


def content_hash(text: Column) -> Column:
    """SHA-256 of the squeezed, lower-cased text."""
    return F.sha2(F.lower(squeeze(text)), 256)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def unit_type(text: Column) -> Column:
    n = word_count(text)
    return F.when(n < 8, "fragment").when(n > 25, "paragraph").otherwise("heading")


def augment(text: Column, doc: Column, cluster: Column, act: Column, certainty: Column) -> Column:
    """Context in brackets before the text; missing parts are left out."""
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}: "), c, F.lit("]")))
    sure = F.when(certainty.isNotNull(), F.format_string("%.2f", certainty.cast("double")))
    return F.concat_ws(" ", tag("doc", doc), tag("cluster", cluster), tag("act", act), tag("certainty", sure), text)


def sanitize_label(label: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(label, "<[^>]*>", "")), 1, 60)


def clean_model_json(reply: Column) -> Column:
    """Struct (label of 80, description of 240 characters) from a model's reply, code fences stripped; null if it doesn't parse."""
    bare = F.regexp_replace(squeeze(reply), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(bare, "label string, description string")
    return F.when(parsed["label"].isNotNull(), F.struct(F.substring(parsed["label"], 1, 80).alias("label"), F.substring(parsed["description"], 1, 240).alias("description")))


def useful_line(text: Column) -> Column:
    """Recognised lines worth keeping: 3 characters, 2 of them letters or digits."""
    flat = squeeze(text)
    return (F.length(flat) >= 3) & (F.regexp_count(flat, F.lit(r"[\p{L}\p{N}]")) >= 2)


def needs_ocr(n_sentences: Column, visible_chars: Column, n_groups: Column) -> Column:
    return (n_sentences < 5) | (visible_chars < 120) | (n_groups < 3)


def image_unit(name: Column, ocr: Column, caption: Column) -> Column:
    """One unit from recognised text and caption; the file name where there is neither."""
    said = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{tag}]: "), c))
    both = F.concat_ws(" ", said("OCR", ocr), said("CAPTION", caption))
    return F.when(both != "", both).otherwise(F.concat(F.lit("[IMAGE]: "), name))


def transcript_segments(transcript: Column) -> Column:
    """Array of (ts, text): text up to the first marker has no time; without any text the whole transcript."""
    stamp = r"\[(\d{1,2}:\d{2}(?::\d{2})?)\]"
    parts = F.split(transcript, rf"(?={stamp})", -1)
    cut = F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, "^" + stamp, 1), F.lit("")).alias("ts"), F.trim(F.regexp_replace(p, "^" + stamp, "")).alias("text")))
    kept = F.filter(cut, lambda s: s["text"] != "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("ts"), transcript.alias("text")))
    return F.when(F.size(kept) > 0, kept).when(transcript != "", whole).otherwise(F.slice(whole, 1, 0))


def source_type(name: Column, mime: Column) -> Column:
    """The first rule that fits, by media type or ending."""
    n, m = F.lower(name), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when((m == "application/pdf") | n.endswith(".pdf"), "pdf")
        .when(m.startswith("audio/") | n.rlike(lexicon.AUDIO), "audio")
        .when(m.startswith("image/") | n.rlike(lexicon.IMAGE), "image")
        .when((m == "application/zip") | n.endswith(".zip"), "zip")
        .when(n.endswith(".ipynb"), "notebook")
        .when(n.rlike(lexicon.SCRIPT), "script")
        .when(n.endswith(".json"), "json")
        .otherwise("text")
    )


def excluded_path(path: Column) -> Column:
    return path.rlike(lexicon.EXCLUDED)


def marker_count(text: Column, markers: tuple[str, ...]) -> Column:
    """Whole-word hits of the single words (ASCII boundaries), plus one for each phrase that occurs."""
    low = F.lower(text)
    words = sorted({m for m in markers if " " not in m})
    out = F.lit(0)
    if words:
        out = out + F.regexp_count(low, F.lit(rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, words))})(?![A-Za-z0-9_])"))
    for phrase in (m for m in markers if " " in m):
        out = out + low.contains(phrase).cast("int")
    return out


def common_words(a: Column, b: Column) -> Column:
    """Distinct words of more than three characters that both have."""
    long_words = lambda c: F.array_distinct(F.filter(F.split(c, WS + "+", -1), lambda w: F.length(w) > 3))
    return F.size(F.array_intersect(long_words(a), long_words(b)))
