"""The registered queries of this subpackage, and their DuckDB forms where SQL can say them."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hashloom
from hashloom.llm import oracles
from hashloom.llm.common import Scratch, bounded, held_out
from hashloom.llm.context_mixing import score_texts
from hashloom.llm.impact_topk import impact_top_k
from hashloom.llm.language_id import identify, learn
from hashloom.llm.line_dedup import dedup_lines
from hashloom.llm.mixing import fair_queue
from hashloom.llm.multi_index import nearest
from hashloom.llm.packing import pack
from hashloom.llm.quality import fit_quality, score_quality
from hashloom.llm.setsketch import near_duplicates
from hashloom.llm.token_store import read_tokens, write_tokens
from hashloom.llm.tokens import default_path
from hashloom.sources.tables import table


def op1_impact_topk(spark: SparkSession, d: str) -> DataFrame:
    return impact_top_k(table(spark, d, "embeddings"), F.col("id") % 100 == 0)


def op2_fair_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = fair_queue(table(spark, d, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_context_mixing(spark: SparkSession, d: str) -> DataFrame:
    return score_texts(table(spark, d, "documents"))


def op4_token_store(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    return read_tokens(write_tokens(table(spark, d, "documents"), default_path(), scratch.path("shards"), scratch, end_id=0))


def op5_bm25_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), default_path(), end_id=1, ids=False)


def op6_multi_index(spark: SparkSession, d: str) -> DataFrame:
    return nearest(table(spark, d, "embeddings"), F.col("id") % 50 == 0)


def op7_fuzzy_lines(spark: SparkSession, d: str) -> DataFrame:
    done = dedup_lines(table(spark, d, "documents"))
    return done.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__lines").alias("n_lines"), F.col("__grouped").alias("n_grouped"),
        F.size("__removed").cast("bigint").alias("n_removed"), F.array_join(F.col("__removed").cast("array<string>"), ",").alias("removed"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


def op8_setsketch_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"), width=2, percent=80)


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs, apart = table(spark, d, "documents"), held_out("doc_id", 4, 2)
    return identify(docs, learn(docs.where(~apart)), "doc_id", apart.alias("held_out"))


def op10_co_training(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, d, "labels")))


QUERIES = (op1_impact_topk, op2_fair_mix, op3_context_mixing, op4_token_store, op5_bm25_pack, op6_multi_index, op7_fuzzy_lines, op8_setsketch_dedup, op9_language_id, op10_co_training)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and
    bounds the bytes of what they get at once."""
    bounded(spark)
    root, env = str(Path(hashloom.__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        @functools.wraps(query)
        def run(spark: SparkSession, d: str) -> DataFrame:
            importable(spark)
            return query(spark, d)

        return run

    return {f.__name__: ready(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
