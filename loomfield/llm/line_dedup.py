"""Line dedup by site-relative frequency.

For each host, the pages that hold a line are divided by all pages of the
host; lines above the boilerplate ratio are dropped from every page of that
host.  On few pages a share says little, so it must exceed the ratio by `SURE`
standard errors of a share measured on that many pages (a score test): 3 of 5
pages, 5 of 20, 15 of 100, and in the limit the ratio itself.  A line on fewer
than `HOLDERS` pages never goes.

Lines travel as (host, hash, page row, position); texts only meet the
positions to drop, at most one row a page.  Counts are pre-aggregated before
the shuffle, so a hot host or a hot line is one partial row a task.

Null text is kept null, null host is a host of its own, blank lines are never
dropped, a line that a page repeats counts once for its page, repeated rows
are pages of their own, empty tables give empty tables, all columns of the
input come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stash

#: Share of a host's pages from which a line is boilerplate, in how many standard errors that must be certain, and the fewest pages that repeat a line.
RATIO, SURE, HOLDERS = 0.1, 1.64, 3


def html_lines(html: Column) -> Column:
    """Visible text of a page, one block an array item, white space collapsed."""
    flat = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    blocks = F.regexp_replace(flat, r"(?i)</?(p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|title|head|body|html|aside|main|pre|blockquote)( [^>]*)?/?>", "\n")
    text = F.regexp_replace(blocks, r"<[^>]*>", "")
    trimmed = F.transform(F.split(text, "\n", -1), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r]+", " ")))
    return F.filter(trimmed, lambda s: s != "")


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def boilerplate(lines: DataFrame, ratio: float = RATIO, sure: float = SURE, holders: int = HOLDERS) -> DataFrame:
    """lines(host, hash), a row for each distinct line of a page, hash null for a page's own row -> (host, hash) to drop."""
    counts = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    pages = counts.where("hash IS NULL").select(F.col("host").alias("_h"), F.col("n").alias("pages"))
    held = counts.where("hash IS NOT NULL").where(F.col("n") >= holders).join(pages, F.col("host").eqNullSafe(F.col("_h")))
    over = F.col("n") - ratio * F.col("pages")
    return held.where((over > 0) & (over * over > sure * sure * ratio * (1 - ratio) * F.col("pages"))).select("host", "hash")


def drop_boilerplate(pages: DataFrame, lines: Column, host: Column, key: str, ratio: float = RATIO, sure: float = SURE) -> DataFrame:
    """pages with two more columns (which replace columns of these names): kept_lines (array, null for null lines) and n_dropped; `key` names the rows' id."""
    hashed = F.transform(lines, lambda s: F.when(F.trim(F.translate(s, "\t\r\x0b\x0c", "    ")) != "", F.xxhash64(s, F.lit(7))))
    narrow = pages.select(F.col(key).alias("key"), host.alias("host"), F.coalesce(hashed, F.array().cast("array<bigint>")).alias("hashes"))
    narrow = stash(narrow)  # lines are cut and hashed once for the counts, and once more where they are dropped
    each = narrow.select("key", "host", F.explode(F.array_union(F.array(F.lit(None).cast("long")), F.array_distinct("hashes"))).alias("hash"))
    bad = boilerplate(each, ratio, sure).select(F.col("host").alias("_bh"), F.col("hash").alias("_bx"))
    hits = each.where("hash IS NOT NULL").join(bad, F.col("host").eqNullSafe(F.col("_bh")) & (F.col("hash") == F.col("_bx")))
    # Rows of one id on one host may share their lists: a hash in it is boilerplate of the host anyway.
    hits = hits.groupBy(F.col("key").alias("_key"), F.col("host").alias("_host")).agg(F.collect_set("hash").alias("_bad"))
    packed = pages.select(F.struct(*[F.col(c) for c in pages.columns if c not in ("kept_lines", "n_dropped")]).alias("_row"), lines.alias("_lines"), host.alias("_hostof"), F.col(key).alias("_id"))
    joined = packed.join(hits, F.col("_id").eqNullSafe(F.col("_key")) & F.col("_hostof").eqNullSafe(F.col("_host")), "left")
    none = F.array().cast("array<bigint>")
    kept = F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda s: ~F.array_contains(F.coalesce("_bad", none), F.xxhash64(s, F.lit(7)))))
    out = joined.select("_row", "_lines", kept.alias("kept_lines"))
    no_lines = F.array().cast("array<string>")
    dropped = (F.size(F.coalesce("_lines", no_lines)) - F.size(F.coalesce("kept_lines", no_lines))).cast("long")
    return out.select("_row.*", "kept_lines", dropped.alias("n_dropped"))


def cut_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, host, lines) of HTML pages, written once: the HTML is cut into lines a single time and never shuffled."""
    return stash(pages.select(key, url_host(F.col(url)).alias("host"), html_lines(F.col(html)).alias("lines")))


def clean_documents(docs: DataFrame, ratio: float = RATIO, sure: float = SURE) -> DataFrame:
    """documents without the boilerplate lines of their source: same columns, text and n_chars renewed where lines went."""
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    out = drop_boilerplate(packed, F.split("text", "\n", -1), F.col("source"), "doc_id", ratio, sure)
    text = F.array_join("kept_lines", "\n")
    renewed = F.col("row").withField("text", text).withField("n_chars", F.length(text).cast("long"))
    return out.select(F.when(F.col("n_dropped") > 0, renewed).otherwise(F.col("row")).alias("row")).select("row.*")
