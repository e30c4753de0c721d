"""One thin query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, langid, line_dedup, minhash_dedup, mixing, pii, quality_knn, quality_rules, runs, suffix_dedup, topk_search
from .ngrams import fold_of
from .textkit import words_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of every page without the boilerplate of its site."""
    pages = line_dedup.cut_pages(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    out = line_dedup.drop_boilerplate(pages, F.col("lines"), F.col("host"), "page_id")
    kept = F.array_join("kept_lines", "\n")
    return out.select("page_id", "host", F.size("kept_lines").cast("long").alias("n_kept"), "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = _table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 3) != 1).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = quality_knn.rate(docs, quality_knn.learn(taught, docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.group_duplicates(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_shingles", F.size("item_ids").cast("long").alias("n_items"), items.alias("items"), "containment", (F.size("item_ids") == 0).alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(fold_of(F.col("doc_id"), 4) != 2).select(F.col("doc_id").alias("id"), "lang", "text"))
    out = langid.predict(docs, model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.learn(docs)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows)).drop("identical")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    each = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # A row for each of the few centroids.
    about = each.join(F.broadcast(found.centroids.select("cluster", digest.alias("centroid_sha256"))), "cluster").crossJoin(F.broadcast(each.agg(F.sum("cluster_inertia").alias("inertia"))))
    return found.assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    words, h = words_of(F.col("text")), F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    looped = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    found = runs.find_runs(docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), looped).otherwise(F.col("text"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_knn, op3_minhash_dedup, op4_quality_rules, op5_suffix_dedup, op6_decontamination, op7_language_id, op8_mixing, op9_pii, op10_chat_formatting, op11_centroids, op12_runs, op13_topk_search, pipeline)}

_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_SETS = rf"""
w AS (SELECT rid, id, {{split}} AS ws FROM {{rows}}),
s AS (SELECT DISTINCT rid, id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0))"""

_WHOLE = "list_transform(embedding, lambda x: floor(64e0 * x::DOUBLE))"
_FINITE = "embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _centroid_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and floored means as one WITH."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT rid, cluster, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i}) GROUP BY rid)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT cluster, i, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM v JOIN a{i} USING (rid)) GROUP BY cluster, i)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n, c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS n FROM m{i} GROUP BY cluster) USING (cluster))")
    steps.append(f"s AS (SELECT cluster, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS sha FROM c{rounds})")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, d::BIGINT AS distance, sum(d::BIGINT) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d::BIGINT) OVER ()::BIGINT AS inertia, sha AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN s USING (cluster)"""


ORACLES = {
    "op11_centroids": _centroid_sql(),
    # Words that are equal six at a time at a distance q make stretches; those long enough are runs.
    "op12_runs": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS w,
                  xor(list_reduce([4294967295::BIGINT] || list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT),
                                  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f),
s AS MATERIALIZED (SELECT rid, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5], w[i + 6]) AS g FROM (SELECT rid, w, unnest(range(0, n - 5)) AS i FROM t)),
q AS (SELECT x.rid, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.rid = y.rid AND x.g = y.g AND x.i < y.i),
z AS (SELECT rid, q, min(i) AS s, max(i) - min(i) + 6 + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM q) GROUP BY rid, q, island),
r AS MATERIALIZED (SELECT rid, s, len, min(q) AS q FROM z WHERE len >= greatest(12, 2 * q) GROUP BY rid, s, len),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM r),
left_over AS (SELECT rid, string_agg(x, ' ' ORDER BY i) AS x FROM (SELECT rid, unnest(w) AS x, unnest(range(n)) AS i FROM t WHERE rid IN (SELECT rid FROM r)) ANTI JOIN gone USING (rid, i) GROUP BY rid),
o AS (SELECT rid, count(*) AS n_runs, arg_min((s, len, q), (-len, s, q)) AS b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS rs FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b[1]::BIGINT AS start, b[2]::BIGINT AS length, b[3]::BIGINT AS period, (1000 * b[2] // b[3])::BIGINT AS exponent_milli,
       sha256(coalesce(rs, '')) AS runs_sha256, sha256(coalesce(x, array_to_string(w, ' '))) AS collapsed_sha256
FROM t LEFT JOIN o USING (rid) LEFT JOIN left_over USING (rid)""",
    "op13_topk_search": rf"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op1_line_dedup": r"""
WITH a AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host,
                  regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis') AS t FROM pages),
b AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '</?(p|div|li|ul|ol|nav|h[1-6]|br|tr|td|th|table|article|section|header|footer|title|head|body|html|aside|main|pre|blockquote)( [^>]*)?/?>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\r]+', ' ', 'g'))), lambda s: s <> '') AS ls FROM b),
e AS (SELECT page_id, host, unnest(list_distinct(ls)) AS l FROM c),
n AS (SELECT host, count(*) AS pages FROM c GROUP BY host),
bad AS (SELECT e.host, list(DISTINCT e.l) AS bl FROM (SELECT host, l, count(*) AS c FROM e GROUP BY host, l) e JOIN n USING (host) WHERE c >= 3 AND c > 0.1e0 * pages AND (c - 0.1e0 * pages) * (c - 0.1e0 * pages) > 1.64e0 * 1.64e0 * 0.1e0 * 0.9e0 * pages GROUP BY e.host),
f AS (SELECT page_id, c.host, ls, list_filter(ls, lambda s: NOT list_contains(coalesce(bl, []), s)) AS kept FROM c LEFT JOIN bad USING (host))
SELECT page_id, host, len(kept)::BIGINT AS n_kept, (len(ls) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM f""",
    # Exact: every pair of different shingle sets that share a shingle is counted; classes of equal sets go as one.
    "op3_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
{_SETS.format(split=_SPLIT, rows='d')},
z AS (SELECT rid, any_value(id) AS id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM s GROUP BY rid),
r AS (SELECT m, n, min(id) AS rep, arg_min(rid, id) AS rid FROM z GROUP BY m, n),
t AS MATERIALIZED (SELECT r.rep, r.n, s.g FROM r JOIN s USING (rid)),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * c >= 75 * (na + nb - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
walk(x, y) AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT w.x, e.y FROM walk w JOIN e ON w.y = e.x),
k AS (SELECT x, min(y) AS c FROM walk GROUP BY x)
SELECT d.id AS doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, coalesce(k.c, r.rep, d.id) AS component_id, d.id = coalesce(k.c, r.rep, d.id) AS kept
FROM d LEFT JOIN z USING (rid) LEFT JOIN r ON z.m = r.m AND z.n = r.n LEFT JOIN k ON k.x = r.rep""",
    "op5_suffix_dedup": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS g FROM (SELECT rid, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT rid, i FROM w JOIN m USING (g) WHERE doc_id > least),
o AS (SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, -1) AS new FROM c),
u AS (SELECT rid, i, sum(new::INT) OVER (PARTITION BY rid ORDER BY i) AS island FROM o),
v AS (SELECT rid, island, min(i) AS b, max(i) + 50 AS e FROM u GROUP BY rid, island),
x AS (SELECT v.rid, b, e, substr(h, 2 * coalesce(lag(e) OVER (PARTITION BY v.rid ORDER BY b), 0) + 1, 2 * (b - coalesce(lag(e) OVER (PARTITION BY v.rid ORDER BY b), 0))) AS piece FROM v JOIN d USING (rid)),
y AS (SELECT rid, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(piece, '' ORDER BY b) AS head, max(e) AS last FROM x GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN y USING (rid)""",
    "op6_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
{_SETS.format(split=_SPLIT, rows='d')},
bw AS (SELECT item_id, {_SPLIT} AS ws FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark)),
b AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
bn AS (SELECT item_id, count(*) AS q FROM b GROUP BY item_id),
h AS (SELECT rid, item_id, count(*) AS c FROM s JOIN b USING (g) GROUP BY rid, item_id),
f AS (SELECT rid, item_id, c / q::DOUBLE AS r FROM h JOIN bn USING (item_id) WHERE 100 * c >= 75 * q),
g AS (SELECT rid, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(r) AS r FROM f GROUP BY rid),
z AS (SELECT rid, count(*) AS n_shingles FROM s GROUP BY rid)
SELECT id AS doc_id, coalesce(n_shingles, 0)::BIGINT AS n_shingles, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items, coalesce(r, 0e0) AS containment, n IS NULL AS kept
FROM d LEFT JOIN z USING (rid) LEFT JOIN g USING (rid)""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_SPLIT} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
w AS (SELECT rid, unnest(range(0, len(words) - 4)) AS i, words FROM d WHERE len(words) >= 5),
x AS (SELECT rid, i, array_to_string(words[i + 1:i + 5], ' ') AS g FROM w),
y AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM x) WHERE c > 1),
z AS (SELECT rid, sum(least(5, nxt - i)) AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM y) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda s: length(s))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(z.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(words, lambda s: list_contains({list(quality_rules.STOP_WORDS)}, lower(s)))) AS n_stop
      FROM d LEFT JOIN z USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, greatest(n_words, 1)::DOUBLE AS q FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / q >= 1.5e0 AND (n_words < 30 OR n_stop / q >= 0.02e0) AND word_chars / q <= 2e1 AND n_symbols / q <= 0.1e0
       AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.5e0 AS kept
FROM b""",
    "op8_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_SPLIT})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, 2e0 * source_size AS cap,
             [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             sum(source_size) OVER () * 1.5e0 AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER p, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0e0)) AS level,
             row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS rk
      FROM r WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, budget, least(cap, coalesce(arg_min(level, rk) FILTER (WHERE cap / w > level) OVER () * w, cap)) AS target FROM l),
q AS (SELECT row_number() OVER () AS rid, doc_id, size, source_size, target, budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rid, size, budget, (upto + e * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) v(e) WHERE size > 0),
k AS (SELECT rid, count(*) AS n FROM (SELECT rid, budget, sum(size) OVER (ORDER BY finish) AS run FROM c) WHERE run <= budget GROUP BY rid)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (rid)""",
    "op10_chat_formatting": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_matches(role || chr(10) || text, '<s>|</s>|\[INST\]|\[/INST\]') AS clash,
             length(role) + length(text) AS plain,
             len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|\\')) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|\\')) AS added FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(plain + 10 + 8 + 1 + 5 + CASE WHEN clash THEN added + 1 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
