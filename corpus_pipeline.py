"""A training corpus from documents: each stage calls an operator of hashloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm.common import Scratch
from hashloom.llm.line_dedup import keep_lines
from hashloom.llm.mixing import mix
from hashloom.llm.packing import pack
from hashloom.llm.quality import fit_quality, keep_good
from hashloom.llm.queries import importable
from hashloom.llm.setsketch import keep_first
from hashloom.llm.tokens import default_path
from hashloom.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    importable(spark)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before, exactly or nearly."""
    importable(spark)
    return keep_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words at 0.8."""
    importable(spark)
    return keep_first(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document taken twice has two rows."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    importable(spark)
    return pack(docs, default_path(), end_id=1)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with Scratch.swept():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
