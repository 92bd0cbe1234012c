"""The thin queries opN_<name> over the whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import op01_topk, op02_sentencepiece, op03_embedding_dedup, op04_quality, op05_minhash, op06_toxicity, op07_mixture, op08_substrings, op09_langid
from docweft.llm import op10_records as records


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op02_sentencepiece.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"), with_text=True)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), similar=0.95)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, threshold=0.3)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", op07_mixture.word_count(F.col("text")).alias("words"), op07_mixture.uniform(F.col("doc_id"), F.col("text")).alias("draw"))
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    rated = docs.join(marks, F.col("doc_id") == F.col("label_id"), "left")
    mixed = op07_mixture.mix(rated, quality=op07_mixture.by_label(F.col("quality")), keep=("doc_id",), words="words", draw="draw")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_substrings.removals(table(spark, sf_dir, "documents"), length=35)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_langid.languages(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), folds=4, held=2)


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_topk, op2_sentencepiece, op3_embedding_dedup, op4_quality, op5_minhash, op6_toxicity, op7_mixture, op8_substrings, op9_langid, op10_records]
    return {f.__name__: f for f in every}


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_TOPK = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT l.b, r.root FROM reach r JOIN l ON l.a = r.node
), c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id
"""

_SETS = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] || ' ' || z[2])) END AS s FROM w
), g AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM n
  UNION
  SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node
), c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.node = n.doc_id
"""

_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS size FROM documents
), q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':' || coalesce(d.text, '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
    / CASE WHEN quality = 1 THEN 2.0 WHEN quality = 0 THEN 0.5 ELSE 1.0 END AS key
  FROM d LEFT JOIN q ON q.doc_id = d.doc_id
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM s
), f AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target FROM f
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), p AS (
  SELECT k.doc_id, k.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, CAST(k.doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN u ON u.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN before < rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p
"""

_REMOVED = rf"""
WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM t),
x AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
e AS (SELECT w.doc_id, w.w, coalesce(x.gone, []) AS gone FROM w LEFT JOIN x ON x.doc_id = w.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS kept FROM words
  LEFT JOIN g ON g.doc_id = words.doc_id AND g.i = words.i WHERE g.i IS NULL GROUP BY words.doc_id
)
SELECT e.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM e LEFT JOIN kept ON kept.doc_id = e.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": _TOPK, "op3_embedding_dedup": _LINKS, "op5_minhash": _SETS, "op7_mixture": _MIX, "op8_substrings": _REMOVED}
