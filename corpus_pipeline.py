"""Documents to training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, ngram_join, packing, quality_rules, recompress
from tidewater.llm.common import checkpointed, documents
from tidewater.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(result: DataFrame, text) -> DataFrame:
    return result.select("doc_id", text.alias("text"), F.col("keep0").alias("lang"), F.col("keep1").alias("source")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules and the base rules keep."""
    return quality_rules.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one."""
    return _with_text(line_dedup.remove_matches(docs, keep=("lang", "source")), F.col("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id (null is the largest; then of the smallest hash of the text).

    Rows are told apart by id and text, so rows of one id are judged one by one.
    Of rows equal in both, one stays; all rows without a word stay.
    """
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"), F.xxhash64("doc_id", "text").alias("_row"))
    worded = rows.filter(has_word)
    groups = ngram_join.near_duplicates(worded.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    known = worded.select("_row", "doc_id", "_text").distinct().join(groups, "_row")
    age = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    first = known.groupBy("component_id").agg(F.min(age).alias("first"))
    gone = known.join(first, "component_id").filter(age != F.col("first")).select("_row", F.col("doc_id").alias("_id"))
    single = worded.dropDuplicates(["_row", "doc_id"])
    kept = single.join(gone, (single["_row"] == gone["_row"]) & single["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
    return kept.select(*COLUMNS).unionByName(rows.filter(~has_word).select(*COLUMNS))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that start earlier elsewhere."""
    found = recompress.remove_repeats(docs, keep=("lang", "source", "text"))
    return _with_text(found, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("keep2")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", drop_bad), ("line dedup", dedup_lines), ("n-gram join", drop_near_duplicates), ("substring dedup", drop_passages), ("packing", pack)]

#: No stage but the last could be told apart in SQL: the rules are learned and the joins exceed it on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared checkpoint folder for the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
