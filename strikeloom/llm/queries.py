"""One query per operator, each over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeloom.llm import collocations, langid, media, mixing, neardup, negatives, packing, pii, resampling, sharding, substring, topk, toxicity
from strikeloom.llm.common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.train(pii.weak_labels(docs))))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store_texts(read(spark, sf_dir, "documents"))).drop("error")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "pages"), langid.train(read(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(toxicity.folds(F.col("doc_id")) != 0))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (toxicity.folds(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as the labels' share of good ones."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    marked = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    k = round(docs.count() * (1.0 if marked is None else marked))
    return resampling.resample(docs, labels.where("quality = 1").select("doc_id"), k)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shuffle_into_shards(read(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.participants(negatives.relabelled(read(spark, sf_dir, "embeddings")))
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_media_columns, op3_language_id, op4_toxicity, op5_quality_resampling, op6_packing, op7_mixing, op8_substring_dedup, op9_near_duplicates,
    op10_exact_top_k, op11_sharding, op12_hard_negatives, op13_collocations)}

ORACLES = {
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS w FROM per),
run AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
    coalesce(sum(source_size) OVER r, 0)::BIGINT AS size_before, coalesce(sum(w) OVER r, 0)::BIGINT AS w_before
  FROM w WINDOW r AS (ORDER BY source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, (total - 3 * size_before)::DOUBLE / (all_w - w_before) AS level FROM run),
lv AS (SELECT arg_min(level, (source_size / w, w_before)) AS level FROM lev WHERE level * w <= 3 * source_size),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM lv) * w, (3 * source_size)::DOUBLE)) AS target FROM w),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN rate ON d.source IS NOT DISTINCT FROM rate.source""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, r, p, sha256(array_to_string(w[p:p + 12], ' ')) AS h
  FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM win JOIN least_doc USING (h) WHERE m < doc_id OR m IS NOT NULL AND doc_id IS NULL),
per AS (SELECT r, list(i) AS g FROM gone GROUP BY r),
kept AS (
  SELECT doc_id, w, coalesce(g, []) AS g, d.r FROM d LEFT JOIN per ON d.r = per.r),
words AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
text AS (
  SELECT words.r, string_agg(word, ' ' ORDER BY words.i) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.i = gone.i
  WHERE gone.i IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN text ON kept.r = text.r""",
    "op9_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, r, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, r, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS p FROM d)),
bag AS (SELECT r, g, count(*) AS c FROM s GROUP BY r, g),
size AS (SELECT r, sum(c) AS n FROM bag GROUP BY r),
both_ AS (SELECT x.r AS a, y.r AS b, sum(least(x.c, y.c)) AS k FROM bag x JOIN bag y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
link AS (
  SELECT dx.doc_id AS a, dy.doc_id AS b FROM both_ JOIN size x ON x.r = a JOIN size y ON y.r = b JOIN d dx ON dx.r = a JOIN d dy ON dy.r = b
  WHERE k * 5 >= (x.n + y.n - k) * 4),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS seen FROM edge UNION SELECT reach.node, edge.b FROM reach JOIN edge ON reach.seen = edge.a),
lab AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_shingles
FROM d LEFT JOIN size USING (r) LEFT JOIN lab ON lab.node = d.doc_id""",
    "op10_exact_top_k": """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same)
  WHERE positive_rank <= 5),
r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score, positive_rank::INT AS positive_rank FROM r WHERE rank <= 10""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, len(p) AS k, count(*) AS f
  FROM (SELECT lang, ws[i:i + k - 1] AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)) GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS b FROM cut) WHERE b = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE coalesce(100 * longer < 80 * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept JOIN n USING (lang)) WHERE rank <= 2000""",
}
