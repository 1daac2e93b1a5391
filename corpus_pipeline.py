"""A corpus pipeline: quality, toxicity, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.llm.common import fresh_path, id_fold, remove, scratch, table
from gatelens.llm.packing import pack
from gatelens.llm.queries import FOLDS, HELD_OUT
from gatelens.llm.simhash import keep_one
from gatelens.llm.subwords import keep_good
from gatelens.llm.toxicity import keep_clean


def learnable():
    return id_fold(F.col("doc_id"), FOLDS) != HELD_OUT


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Rows are judged one by one by their texts: null and empty ones get the bias'
    score, ids may be null or repeat, all columns come back as they are, and no
    rows in give no rows out. Without labels of both kinds every row has the
    labels' share as its score.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"), learnable())


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject; rows, ids, columns and empty tables fare as in the stage before. Without toxic labels all stay."""
    return keep_clean(docs, table(spark, sf_dir, "labels"), learnable())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest id's, of equal ids the least hash of the text; equal rows are one.

    Null ids come last and are told apart by their texts; null and empty texts
    are one component. Columns come back as they are.
    """
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences; a null or empty text is one token, every row is packed."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("simhash near-dedup", near_duplicates), ("best-fit packing", packing)]

#: SQL has no subword training, chains or XXH64 fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read again.

    A stage's input and its operators' own tables are deleted once its rows are
    written. Empty tables give no rows; columns besides doc_id and text may have
    any name and are handed on up to the last stage.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            remove(spark, held)
        docs, held = spark.read.parquet(path), path
    return docs
