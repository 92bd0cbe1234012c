"""The corpus pipeline: five stages over ``documents``, each one operator of ``docweft.llm``.

Quality classifier, MinHash near-dedup, substring dedup, mixing sources to
target weights, SentencePiece encoding. Each stage takes (spark, docs, sf_dir)
and returns a DataFrame; run() applies them in order through tables in the shared
folder. All but the last return the columns of ``documents``.

Defined cases: every stage gives no rows for an empty table, and all but the
last keep other columns under their names. Null and empty texts: quality scores them by the bias
alone, near_dedup and substring_dedup keep them, mixture takes none of them (no
words). Without labels of both classes quality accepts all. Of rows that repeat
an id and its words near_dedup keeps one; groups go by least id, null ids last.
substring_dedup drops texts that lose all words; a null source is a source of
its own in mixture. For the last stage's cases see its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import op02_sentencepiece, op04_quality, op05_minhash, op07_mixture, op08_substrings
from docweft.llm.queries import table, tokenizer_file
from docweft.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from all labels."""
    return op04_quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five-word shingles, 0.8), one row of it; rows without an id only if no other has their set."""
    return op05_minhash.deduplicated(docs, nulls=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 50 words that occur again; n_chars follows the text."""
    out = op08_substrings.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, documents labelled good likelier: a row for each time a document is taken."""
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    sized = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in places.items()], op07_mixture.word_count(F.col("text")).alias("words"), op07_mixture.uniform(F.col("doc_id"), F.col("text")).alias("draw"), op07_mixture.row_hash(docs).alias("tie"))
    # A merge at any size: labels grow with the corpus.
    rated = sized.join(marks.hint("merge"), F.col(places["doc_id"]) == F.col("label_id"), "left")
    mixed = op07_mixture.mix(rated, places["doc_id"], places["text"], places["source"], op07_mixture.by_label(F.col("quality")), keep=tuple(places.values()), words="words", draw="draw", tie="tie")
    return op07_mixture.repeated(mixed).select(*[F.col(p).alias(c) for c, p in places.items()])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, input_ids, n_tokens, ids_crc32, decodes."""
    return op02_sentencepiece.encode_decode(docs.drop("n_chars"), tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixture", mixture), ("tokens", tokens)]

#: Learned weights and hashes of five-word sets are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
