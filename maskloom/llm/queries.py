"""Registered queries of this subpackage: thin calls of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import decontaminate, jaccard, langid, lm, pieces, shards, substring, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = _table(spark, sf_dir, "embeddings")
    vecs = emb.where(topk.finite(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding")).alias("vec"))
    return topk.top_k(vecs, vecs.where("id % 50 = 0"), k=5)


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=16)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, num=85, den=100, count_links=True)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_lattice_lm": op3_lattice_lm,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_byte_shards": op7_byte_shards,
    "op8_toxicity": op8_toxicity,
    "op9_url_rules": op9_url_rules,
    "op10_jaccard_join": op10_jaccard_join,
}



def _nibble(n: int) -> int:
    """CRC-32 of four bits."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


SQL = {
    "op1_decontamination": r"""
WITH t AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t
), n AS (
  SELECT id, count(*) AS n_item FROM s WHERE side = 1 GROUP BY id
)
SELECT d.id AS doc_id, i.id AS item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM s d JOIN s i ON d.g = i.g AND d.side = 0 AND i.side = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n_item HAVING 100 * count(*) >= 80 * n_item
""",
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM t WHERE len(w) >= 50
), s AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p
), m AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM s
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE first_id < doc_id
), c AS (
  SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id
), k AS (
  SELECT t.doc_id, w, coalesce(gone, []) AS gone,
         list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(coalesce(gone, []), j)) AS stay
  FROM t LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(stay, lambda j: w[j]), ' '), '')) AS kept_sha256
FROM k
""",
    "op7_byte_shards": f"""
WITH n AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h, coalesce(text, '') = '' AS bare FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], CASE WHEN bare THEN CAST([] AS BIGINT[]) ELSE
    list_transform(range(0, len(h)), lambda i: CAST(instr('0123456789ABCDEF', h[(i // 2) * 2 + 2 - i % 2]) - 1 AS BIGINT)) END),
    lambda c, x: xor(CAST({[_nibble(i) for i in range(16)]} AS BIGINT[])[(xor(c, x) & 15) + 1], c >> 4)), 4294967295::BIGINT) AS crc FROM n
), o AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS row, sum(size) OVER () AS total FROM c
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s AS (
  SELECT *, CAST(least(15, ((2 * upto - size) * 16) // (2 * total)) AS INTEGER) AS shard FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, CAST(row - min(row) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
""",
    "op9_url_rules": r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM p
), rules(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT h.*, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE na.n * 100 >= nb.n * 85 AND nb.n * 100 >= na.n * 85
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, (SELECT count(*) FROM e WHERE e.x = t.doc_id) AS n_links
FROM t JOIN r ON r.x = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
""",
}
