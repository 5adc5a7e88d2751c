"""The registered queries of this subpackage: thin callers of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, hamming_search, language, mixing, near_dedup, prefix_bpe, quality, resampling, substring_dedup, suffix_dedup, token_counts
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    found = quality.score(docs, quality.fit(quality.sample(docs, labels)))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codes = hamming_search.sign_codes(vectors, "vec_id", "embedding", hamming_search.words_of(vectors, "embedding"))
    return hamming_search.top_k(codes, codes.filter("id % 20 = 0"), 10)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken().drop("source")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out("doc_id")))
    return language.identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_topk_search, op3_substring_dedup, op4_suffix_array_dedup, op5_mixing, op6_minhash_near_dedup, op7_language, op8_byte_bpe, op9_exact_dedup, op10_token_counts, op11_alignment, op12_prefix_bpe, op13_resampling)}


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


OP2_SQL = """
WITH c AS (
  SELECT vec_id AS id, list_sum(list_transform(range(64),
           lambda b: CASE WHEN embedding[b + 1] > 0 THEN (1::HUGEINT << b::INT) ELSE 0::HUGEINT END))::UBIGINT AS code
  FROM embeddings),
p AS (
  SELECT q.id AS query_id, n.id AS neighbor_id, bit_count(xor(q.code, n.code))::INT AS distance
  FROM c q JOIN c n ON q.id <> n.id WHERE q.id % 20 = 0)
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
WHERE rank <= 10
"""


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
first AS (SELECT h, min(doc_id) AS of FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM windows JOIN first USING (h) WHERE of < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


# Texts as hexadecimal digits, two a byte; cut to pieces first, as finding a place in a string costs its distance.
OP4_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
pieces AS (SELECT doc_id, a, substr(x, 2 * a + 1, 2 * (1024 + 199)) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 1024)) AS a FROM d)),
strings AS (SELECT doc_id, a + b AS p, md5(substr(x, 2 * b + 1, 400)) AS h FROM (SELECT doc_id, a, x, unnest(range(0, least(1024, length(x) // 2 - 199))) AS b FROM pieces)),
hits AS (SELECT doc_id, p FROM strings WHERE h IN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, (p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 200)::INT AS new FROM hits)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY doc_id, run),
rest AS (SELECT doc_id, b AS a, lead(a) OVER w AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS kept FROM rest JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id AND least(m.n, k.n) * 100 >= greatest(m.n, k.n) * 80
  GROUP BY x, y, m.n, k.n HAVING 100 * count(*) >= 80 * (m.n + k.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id, min(y) = x AS kept FROM reach LEFT JOIN sizes ON x = doc_id GROUP BY x, n
"""


# CRC-32 has no function there: the polynomial's remainder, bit by bit, of each different feature.
OP13_SQL = r"""
WITH texts AS (SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
d AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, doc_id, unnest(range(1, len(w) + 1)) AS p, w FROM d),
features AS (
  SELECT side, doc_id, w[p] AS f FROM runs UNION ALL
  SELECT side, doc_id, w[p] || ' ' || w[p + 1] FROM runs WHERE p + 1 <= len(w) UNION ALL
  SELECT side, doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] FROM runs WHERE p + 2 <= len(w)),
hashed AS (
  SELECT f, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x), 2), lambda k: ('0x' || substr(x, k + 1, 2))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 10000)::INT AS bucket
  FROM (SELECT f, lower(hex(encode(f))) AS x FROM (SELECT DISTINCT f FROM features))),
counted AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id),
scores AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id) WHERE side = 's'),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_suffix_array_dedup": OP4_SQL, "op6_minhash_near_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op13_resampling": OP13_SQL}
