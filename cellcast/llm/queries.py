"""The operators' queries over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.llm import html_text, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, toxicity, url_filter, vector_topk


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.col("mix_copy").cast("long").alias("copy"), F.round("mix_rate", 6).alias("rate"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select(*[F.round(c, 6).alias(c) if c.startswith("share_") else F.col(c) for c in judged.columns])


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLE_TOPK = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda t: coalesce(t[1] * t[2], 0))) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


ORACLE_MIXING = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(sqrt(n)) AS w, sum(n) AS n FROM sizes),
rates AS (SELECT source, sqrt(s.n) / t.w * t.n / s.n AS rate FROM sizes s, total t),
parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 16)) AS BIGINT) AS parts FROM rates),
terms AS (
  SELECT source, rate, parts, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p
  FROM parts, range(0, 96) AS t(k)
), laws AS (
  SELECT source, rate, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), drawn AS (
  SELECT d.doc_id, d.source, d.text, p.rate, j,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT *, row_number() OVER () AS row_no FROM documents) d
  JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, 1000) AS r(j)
  WHERE j <= p.parts
), counts AS (
  SELECT d.doc_id, d.source, d.text, d.rate, d.j, count(l.k) AS n
  FROM drawn d JOIN laws l ON d.source IS NOT DISTINCT FROM l.source AND l.c <= d.u
  GROUP BY ALL
), summed AS (SELECT doc_id, source, text, rate, sum(n) AS n FROM counts GROUP BY ALL)
SELECT doc_id, source, text, CAST(c AS BIGINT) AS copy, round(rate, 6) AS rate
FROM summed, range(1, 1000) AS r(c) WHERE c <= n
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_NGRAM = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM d
), n AS (SELECT doc_id, len(grams) AS n FROM s),
e AS (SELECT doc_id, unnest(grams) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT t.b, r.root FROM r JOIN both_ways t ON t.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""


ORACLE_LINES = f"""
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
l AS (SELECT doc_id, k, line, doc_id * 1000000 + k AS place, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT *, array_to_string(ws, ' ') AS words FROM l),
f AS (SELECT words, any_value(ws) AS ws, min(place) AS place FROM w WHERE len(ws) >= {line_dedup.MIN_WORDS} GROUP BY words),
long AS (SELECT * FROM f WHERE len(ws) >= {line_dedup.edit_words(line_dedup.EDITS, line_dedup.SIMILARITY)}),
p AS (SELECT *, unnest(range(1, len(ws) + 1)) AS pos FROM long),
v AS (SELECT words, place, pos, array_to_string(list_concat(ws[1:pos - 1], ws[pos + 1:]), ' ') AS rest FROM p),
s AS (SELECT pos, rest, min(place) AS first FROM v GROUP BY ALL),
near AS (
  SELECT v.words FROM v JOIN s USING (pos, rest) WHERE s.first < v.place
  UNION SELECT v.words FROM v JOIN long ON long.words = v.rest WHERE long.place < v.place
  UNION SELECT long.words FROM v JOIN long ON long.words = v.rest WHERE v.place < long.place
), j AS (
  SELECT w.doc_id, w.k, w.line, coalesce(near.words IS NOT NULL OR f.place <> w.place, FALSE) AND f.words IS NOT NULL AS gone
  FROM w LEFT JOIN f ON f.words = w.words LEFT JOIN near ON near.words = w.words
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM j GROUP BY doc_id
"""


def _oracle_rules() -> str:
    limits = quality_rules.COVERAGE_LIMITS
    lengths = sorted({*limits, quality_rules.WINDOW})
    grams = ", ".join(
        f"g{n} AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM d, range(1, 100000) AS t(i) WHERE i <= len(ws) - {n - 1}), "
        f"t{n} AS (SELECT doc_id, g FROM g{n} GROUP BY ALL HAVING count(*) > 1), "
        f"c{n} AS (SELECT DISTINCT doc_id, i + k AS i FROM g{n} JOIN t{n} USING (doc_id, g), range({n}) AS u(k)), "
        f"m{n} AS (SELECT doc_id, count(*) AS n, sum(length(ws[i])) AS chars FROM c{n} JOIN d USING (doc_id) GROUP BY ALL)"
        for n in lengths
    )
    joins = " ".join(f"LEFT JOIN m{n} ON m{n}.doc_id = d.doc_id" for n in lengths)
    shares = ", ".join(f"coalesce(m{n}.chars, 0) / greatest(word_chars, 1) AS share_{n}" for n in limits)
    kept = " AND ".join(f"share_{n} <= {limit}" for n, limit in limits.items())
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), {grams}, lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
again AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS turn FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM again WHERE turn > 1 GROUP BY ALL),
b AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
x AS (SELECT d.doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(m{quality_rules.WINDOW}.n, 0) AS n_repeat_words, {shares},
  coalesce(dup.chars, 0) / greatest(word_chars, 1) AS share_lines FROM d JOIN b ON b.doc_id = d.doc_id LEFT JOIN dup ON dup.doc_id = d.doc_id {joins}),
y AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND share_lines <= {quality_rules.LINE_LIMIT} AND n_symbols <= {quality_rules.SYMBOL_LIMIT} * n_words AND {kept} AS kept,
  {', '.join(f'round(share_{n}, 6) AS share_{n}' for n in limits)}, round(share_lines, 6) AS share_lines
FROM y
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_line_dedup, op4_html_text, op5_source_mixing, op6_packing, op7_quality_classifier, op8_ngram_join, op9_quality_rules, op10_vector_topk)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": ORACLE_LINES, "op5_source_mixing": ORACLE_MIXING, "op8_ngram_join": ORACLE_NGRAM, "op9_quality_rules": _oracle_rules(), "op10_vector_topk": ORACLE_TOPK}
