"""The registered queries of this subpackage and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import load


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.exact_dedup import exact_dedup

    return exact_dedup(load(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.minhash import minhash_dedup

    return minhash_dedup(load(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.suffix import digest_output, remove_repeats

    return remove_repeats(load(spark, sf_dir, "documents"), finish=digest_output)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.pii import find_personal_data

    return find_personal_data(load(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.warc import archive

    return archive(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.quality import fit_quality, score_quality

    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    scored = score_quality(docs, fit_quality(docs, labels.where(third != 1)))
    return scored.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.embedding import embedding_dedup

    return embedding_dedup(load(spark, sf_dir, "embeddings"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.llm.toxicity import fit_toxicity, score_toxicity

    docs = load(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels")))
    return scored.withColumn("kept", ~F.col("toxic"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.bpe import digest_output, encode_documents

    docs = load(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest_output)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lattica.llm.packing import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP4 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

_OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
q AS (
  SELECT page_id, size, sha1(body) AS digest,
         CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS response FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM q
"""

_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         label IS NOT NULL AND embedding IS NOT NULL
         AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
       c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = v.vec_id
"""


_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""

_OP6 = """
WITH p AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM p)),
m AS (SELECT g, min(doc_id) AS first FROM k GROUP BY g),
hit AS (SELECT doc_id, i FROM k JOIN m USING (g) WHERE first < doc_id),
b AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS j FROM p)),
c AS (SELECT b.doc_id, j, x, coalesce(max(i) OVER w >= j - 49, false) AS gone FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND i = j
  WINDOW w AS (PARTITION BY b.doc_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS begins FROM c),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(x, '' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM p LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": _OP4, "op5_minhash": _OP5, "op6_suffix_array": _OP6, "op8_warc": _OP8, "op10_embedding_dedup": _OP10}
