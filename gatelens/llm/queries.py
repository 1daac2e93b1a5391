"""The registered queries over documents, pages and labels, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media as media_chunks
from . import rules, simhash, urls
from .bytebpe import byte_bpe
from .common import id_fold, table
from .maxent import WITHIN, lm_scores
from .media import media
from .packing import pack
from .records import token_records
from .rules import quality_rules
from .simhash import simhash_components
from .subwords import quality_scores
from .toxicity import toxicity
from .urls import url_filter

#: Rows of this fold of the ids are never learned from.
FOLDS, HELD_OUT = 5, 0


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    may = id_fold(F.col("doc_id"), FOLDS) != HELD_OUT
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may)
    return scored.withColumn("held_out", id_fold(F.col("doc_id"), FOLDS) == HELD_OUT)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    may = id_fold(F.col("doc_id"), FOLDS) != HELD_OUT
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may)
    return scored.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_fold(F.col("doc_id"), 7) == 2
    scored = lm_scores(table(spark, sf_dir, "documents"), ~held_out, within=WITHIN)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_simhash, op2_media, op3_urls, op4_toxicity, op5_packing, op6_records, op7_quality, op8_lm, op9_rules, op10_byte_bpe)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash": simhash.sql(), "op2_media": media_chunks.SQL, "op3_urls": urls.sql(), "op9_rules": rules.SQL}
