"""The queries of this subpackage: name to callable, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_planes, hard_negatives, html_crf, iblt, mixing, mpeg_audio, near_dedup, packing, parity_join, substring_dedup, toxicity, url_filter, vector_codes
from .common import table

VOCABULARY = "word_bpe_49k.json"


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.text_media(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.edit_prints(table(spark, sf_dir, "documents"))


def op4_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bit_planes.token_file(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids that seven divides move on by one first, so that some rows are labelled wrongly."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.linked(table(spark, sf_dir, "documents"), width=4, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mpeg_audio, op2_url_filter, op3_iblt, op4_html_crf, op5_toxicity, op6_compact_windows, op7_best_fit_packing, op8_bit_planes, op9_source_mix, op10_near_dedup, op11_vector_codes, op12_hard_negatives, op13_parity_join, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op9_source_mix": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_hard_negatives": OP12_SQL}


# Pages of the tables hold no canonical links or refreshes, so here an url without a rule is allowed; aliases are tested on fixtures.
OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rule, rhost, rpath) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, greatest(length(text), 1)::BIGINT AS size, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, pow(sum(size)::DOUBLE, 0.5) AS want FROM d GROUP BY source
), t AS (
  SELECT sum(n)::DOUBLE AS all_n, sum(want::DECIMAL(38, 6))::DOUBLE AS all_want FROM s
), r AS (
  SELECT source, rate, greatest(ceil(rate / 500.0), 1)::INTEGER AS draws FROM (SELECT source, want / all_want * all_n / n::DOUBLE AS rate FROM s, t)
), c(source, mean, k, p, upto) AS (
  SELECT source, rate / draws, 0, exp(-(rate / draws)), exp(-(rate / draws)) FROM r
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), upto + p * mean / (k + 1) FROM c WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
), l AS (
  SELECT source, list(upto ORDER BY k) AS upto FROM c GROUP BY source
), m AS (
  SELECT d.*, r.rate, list_sum(list_transform(generate_series(0, (r.draws - 1)::BIGINT), lambda j: len(list_filter(l.upto, lambda x: x <= ((CASE WHEN j = 0 THEN draw
      ELSE ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || j::VARCHAR), 1, 13))::BIGINT END)::DOUBLE + 0.5) / 4503599627370496.0)))) AS times
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN l ON d.source IS NOT DISTINCT FROM l.source
), e AS (
  SELECT doc_id, text, lang, source, n_chars, rate, unnest(generate_series(1, times::BIGINT))::INTEGER AS copy FROM m
)
SELECT *, (('0x' || substr(md5('18|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS mix_order FROM e
"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 2) -> str:
    """Every round as two subqueries: to which entry each part goes (by distance * 64 + index), then the entries' new values."""
    steps, last = "", "c0"
    for k in range(rounds + 1):
        steps += f""", a{k} AS (
  SELECT x.vec_id, x.label, x.p, min(list_sum([(x.v[j] - c.v[j]) * (x.v[j] - c.v[j]) for j in range(1, 5)])::BIGINT * 64 + c.e) AS best FROM parts x JOIN {last} c ON c.p = x.p GROUP BY ALL
)"""
        if k < rounds:
            steps += f""", c{k + 1} AS (
  SELECT c.p, c.e, coalesce(u.v, c.v) AS v FROM {last} c LEFT JOIN (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY j) AS v FROM (SELECT a.p, a.best % 64 AS e, j, sum(x.v[j])::DOUBLE AS s, count(*) AS n FROM a{k} a JOIN parts x ON x.vec_id = a.vec_id AND x.p = a.p, range(1, 5) t(j) GROUP BY ALL) GROUP BY ALL
  ) u ON u.p = c.p AND u.e = c.e
)"""
            last = f"c{k + 1}"
    return f"""WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_WHOLE}),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * 4 + 1:p * 4 + 4] AS v FROM q, range(16) t(p)),
c0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT 64)){steps},
r AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"""


OP11_SQL = _codes_sql()

OP12_SQL = f"""WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a, q b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5
), w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
) SELECT * FROM w WHERE rank <= 5"""
