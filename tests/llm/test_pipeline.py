"""The corpus pipeline, stage by stage on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from hashloom.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, scratch = spark.read.parquet(f"{DATA}/documents.parquet"), Scratch(spark, "test")
    columns, before = docs.columns, None
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality":
            good = labels.where("quality = 1 and toxic = 0")
            assert docs.join(good, "doc_id").count() >= 0.95 * before.join(good, "doc_id").count()
        if name in ("lines", "near_duplicates", "mixing"):
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").distinct().collect()}


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
    before = len(Scratch.made)
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert len(Scratch.made) == before + 1  # what the stages wrote meanwhile is gone


LONG = "\n".join(f"line {i} of a very long text with words w{i} v{i * 7}" for i in range(20_000))
ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 2), (3, " \n\t", "en", "a", 3, "x", 3), (None, "a text without an id goes on for some words", "en", "a", 43, "x", 4),
    (4, LONG, "en", "b", len(LONG), "x", 5), (5, "one", None, "a", 3, "x", 6), (6, "the same text twice, the same text twice", "en", None, 40, "x", 7), (6, "the same text twice, the same text twice", "en", None, 40, "x", 7),
    (6, "another text of the same id, with other words", "de", None, 45, "x", 8), (7, "<|endoftext|> stands in this text <|endoftext|>", "en", "c", 46, "x", 9), (8, "x" * 100_000, "en", "c", 100_000, "x", 10),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `gone.x` string, component int"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_and_empty_rows_in_every_stage(spark, name, stage):
    docs = spark.createDataFrame(ODD, SCHEMA)
    none = stage(spark, docs.where("doc_id > 100"), DATA)
    assert none.count() == 0
    got = stage(spark, docs, DATA)
    if name == "packing":
        rows = got.collect()
        assert {r["doc_id"] for r in rows} == {r[0] for r in ODD} and sum(r["length"] for r in rows if r["start"] == 0) > 0
        assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
        return
    assert got.columns == docs.columns and got.schema == docs.schema
    ids = [r["doc_id"] for r in got.select("doc_id").collect()]
    if name == "quality":  # texts without words go
        assert set(ids) <= {None, 4, 5, 6, 7, 8}
    elif name == "lines":  # repeated rows are one text; rows without words stay as they are
        assert sorted(x or 0 for x in ids) == sorted(r[0] or 0 for r in ODD)
        assert got.where("doc_id = 4").first()["text"] == LONG
    elif name == "near_duplicates":  # of two equal rows one goes
        assert sorted(x or 0 for x in ids) == sorted([r[0] or 0 for r in ODD[:6]] + [6, 6, 7, 8])
    else:  # no text gives more than twice its words, and empty ones none
        assert set(ids) <= {None, 4, 5, 6, 7, 8} and max(ids.count(i) for i in (None, 4, 5, 7, 8)) <= 2
