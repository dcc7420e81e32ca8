"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomix.llm import divergence, filters, html, lines, minhash, mixing, pieces, quality, secrets, simhash, suffixes, toxicity, vectors
from cytomix.llm.common import materialize, table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.default_model(spark)
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return coded.select("doc_id", "n_ids", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), html.fit(spark)).select("page_id", "url", "text", "n_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = materialize(simhash.edited_fingerprints(table(spark, sf_dir, "documents")), "op6-marks")
    return marks.join(simhash.near_counts(marks), "fingerprint", "left").select(*marks.columns, "n_near")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.scan(docs, secrets.fit(secrets.samples(docs))))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_vectors, op3_pieces, op4_html, op5_mixing, op6_simhash, op7_suffixes, op8_toxicity, op9_lines, op10_secrets, op11_divergence, op12_quality, op13_filters)}


#: Shingle sets as lists, joined by the hashes of their items.
OP1_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w)
- 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.h = b.h AND a.doc_id <> b.doc_id WHERE 100 * least(a.n, b.n) >= 85 *
greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT s.doc_id, CAST(max(len(s.s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept FROM sets s JOIN reach r ON r.a =
s.doc_id GROUP BY s.doc_id
"""
#: All pairs of vectors.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = v.vec_id AS kept, CAST(1 AS
DOUBLE) AS recall FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""
#: All strings of 200 bytes, in hex.
OP7_SQL = """
WITH hexed AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
grams AS (SELECT doc_id, i, hash(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m FROM hexed, LATERAL (SELECT unnest(range(0, greatest(0, len(h) // 2 -
199))) AS i) AS t),
again AS (SELECT m FROM grams GROUP BY m HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM grams SEMI JOIN again USING (m)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM hits GROUP BY doc_id, run),
marked AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS
fresh FROM runs),
joined AS (SELECT doc_id, a, b, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS part FROM marked),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM joined GROUP BY doc_id, part),
kept AS (SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * coalesce(prev, 0) + 1, 2 * (a - coalesce(prev, 0))),
'' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS rest FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM spans) AS s JOIN
hexed USING (doc_id) GROUP BY s.doc_id)
SELECT x.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS
n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM hexed x LEFT JOIN kept k ON k.doc_id = x.doc_id
"""
#: Rates in 128-bit integers.
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
sizes AS (SELECT d.lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v FROM (SELECT DISTINCT lang FROM docs) AS d),
groups AS (SELECT DISTINCT lang, source FROM docs),
hits AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN hits h ON h.lang = g.lang AND h.source = g.source GROUP BY ALL),
rate AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p FROM totals g JOIN kept k ON
k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN hits h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
whole AS (SELECT h.lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // ((SELECT sum(total) FROM totals t WHERE t.lang = h.lang) + 2 * max(v)) AS q FROM hits h JOIN
sizes s ON s.lang = h.lang GROUP BY h.lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM rate a JOIN rate b ON a.lang = b.lang AND
a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang =
a.lang AND p.source = a.source AND p.item = b.source),
own AS (SELECT r.lang, r.source, r.term AS item, (p - q) * (p - q) // (p + q) AS value FROM rate r JOIN whole w ON w.lang = r.lang AND w.term = r.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part FROM every UNION ALL SELECT *, 'term' AS part FROM own)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked
QUALIFY part = 'pair' OR rank <= 10
"""
#: Each order's first failing step of each combination of failures.
OP13_SQL = r"""
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS d FROM documents GROUP BY 1),
docs AS (SELECT doc_id, coalesce(source, '') AS part, t, d, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents JOIN firsts ON t =
coalesce(text, '')),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
cells AS (SELECT part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END) || (CASE WHEN 100 *
(length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) ||
(CASE WHEN d < docs.doc_id THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM docs LEFT JOIN marks ON
marks.doc_id = docs.doc_id GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before FROM orders, generate_series(1, 5) AS g(s)),
met AS (SELECT part, o, s, f, n, n_good, n_bad, fails, contains(fails, f) AS hit, length(translate(before, fails, '')) < length(before) AS gone FROM cells, steps),
sums AS (SELECT part, o AS filter_order, s AS step, f, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN n_good ELSE 0 END) AS
good_lost, sum(CASE WHEN hit AND NOT gone THEN n_bad ELSE 0 END) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails
AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM
sums
"""


def oracle_sql() -> dict[str, str]:
    """Classifiers, graphs of pieces and hashes of another engine have no counterpart in SQL; tests compare those with brute force."""
    return {"op1_minhash": OP1_SQL, "op2_vectors": OP2_SQL, "op7_suffixes": OP7_SQL, "op11_divergence": OP11_SQL, "op13_filters": OP13_SQL}
