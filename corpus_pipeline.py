"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_onoma.llm.decontaminate import drop_contaminated
from spark_onoma.llm.language import fit_languages, identify
from spark_onoma.llm.line_dedup import drop_recurring_lines
from spark_onoma.llm.near_dup import keep_one
from spark_onoma.llm.packing import packed_sequences
from spark_onoma.llm.scratch import Scratch

#: A document goes if its text has no letter or its best language is less likely than this.
LEAST_SCORE = 0.3
#: SQL cannot express the trained language model.
ORACLE_SQL = None


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; it learns from those with a lang whose crc32 remainder by 4 is not 2."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    return identify(docs, fit_languages(docs, train)).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(_own(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template an earlier document has; those of which nothing is left so go."""
    left = drop_recurring_lines(docs, min_tokens=1).where(F.col("text").rlike(r"\S") | (F.col("n_dropped") == 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by its present text or by the one it came with.

    The line stage leaves of a near copy only the lines that differ, so what is left of copies is not alike any more;
    the texts of ``documents`` still are. Both texts of an id count as that document's.
    """
    came = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return keep_one(docs, texts=docs.select("doc_id", "text").unionByName(came)).select(_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids."""
    return packed_sequences(docs)


STAGES = [("language id", language), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        came, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if number:
            scratch.drop(came)
    return STAGES[-1][1](spark, docs, sf_dir)
