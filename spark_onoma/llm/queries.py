"""The operators of this subpackage as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_onoma.llm import line_dedup
from spark_onoma.llm.decontaminate import flag_contaminated
from spark_onoma.llm.html_text import main_text
from spark_onoma.llm.language import fit_languages, identify
from spark_onoma.llm.near_dup import near_duplicates
from spark_onoma.llm.packing import packed_sequences
from spark_onoma.llm.span_dedup import drop_repeated_spans
from spark_onoma.llm.token_file import token_digest
from spark_onoma.llm.toxicity import fit_toxicity, score_toxicity
from spark_onoma.llm.vector_dedup import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(_table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(_table(spark, sf_dir, "documents"), with_ids=False)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_languages(docs, _remainder(4) != 2)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), _remainder(3) != 1)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_substring_dedup, op3_minhash_near_dedup, op4_embedding_near_dedup, op5_packing, op6_token_file, op7_language_id, op8_decontamination, op9_html_extraction, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL}
