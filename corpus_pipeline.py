"""A training corpus from raw documents: language, near copies, benchmark leaks, secrets, packing.

Every stage takes all that its predecessor kept.  run() writes each stage's rows to the shared folder and reads them
again, so that a lost executor costs no more than the stage at hand.

In every stage: a null in any other column than text is carried along; columns beyond those named stay, whatever their
names; texts are taken whole, however long; an empty table gives an empty one with the same columns; repeated rows are
rows of their own but where a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontaminate, langid, packing, secretscan, simhash
from evenkeel.llm.common import Scratch, fresh
from evenkeel.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; those that it rejects go.

    Null texts, and texts without a letter, go.  Repeated rows are kept or go together, as their texts are equal.  Where no
    document has both text and lang there is nothing to learn from, and all are rejected.
    """
    made, c = langid.identify(spark, docs, langid.train(spark, docs))
    return made.where(~F.col(f"{c}.rejected")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a similarity of 0.8 or more (5-word shingles).

    Rows are told apart by a key of their own: of rows with one id in a group a single one stays, rows with a null id
    stay where their group has no other, and rows whose id recurs on another text are judged each by its text.  Of ids
    that tie, the row that was read first stays.  Texts that are null or have no words are in no group, and all stay.
    """
    scratch, key = Scratch(spark, "near-copies"), fresh(docs, "__key")
    docs, columns = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), docs.columns
    groups = simhash.similar_groups(spark, docs, size=5, similarity=0.8, id_col=key, key_col=key)
    best = groups.join(docs.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("best"))
    return docs.join(best.select(F.col(f"best.{key}").alias(key)), key, "left_semi").select(*columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark's words: ten of an item's words, or all of an item that has fewer, so
    that an item of one word takes every document with that word.  Null and wordless texts have none, and stay; with an
    empty benchmark all stay."""
    made, c = decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return made.where(F.col(f"{c}.n_hit") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret (one for secrets that overlap).  Null texts stay null; n_chars,
    where there is one, follows the text."""
    made, c = secretscan.scan(spark, docs)
    text = secretscan.redacted(F.col("text"), F.col(c))
    cleaned = made.withColumn("text", text).drop(c)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids.  A null text is its end id alone; repeated rows and null ids are documents of their
    own."""
    made = packing.pack(spark, docs, tokenizer_path("byte_bpe_50k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("secrets", secrets), ("pack", pack)]

#: The classifier, the fingerprints' bands and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
