"""Stages of the pipeline on null, empty, long and repeated rows, repeated ids, empty tables and extra columns."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(60_000))
ROWS = [
    (1, "A", "en", "s", 1), (1, "B", "en", "s", 1), (2, "a", "en", "s", 1), (3, None, "en", None, 0), (4, "", None, "s", 0), (None, "", "en", "s", 0), (5, LONG, "en", "t", 9), (6, LONG, "en", "t", 9),
    (7, "same row", "en", "s", 8), (7, "same row", "en", "s", 8), (8, LONG + " end", "en", "t", 9), (None, "lone", "en", "s", 4),
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(ROWS, KIND).withColumn("_row", F.lit("x")).withColumn("score", F.lit(1)).withColumn("ids", F.lit("y"))


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:8], len(r.text or "")) for r in df.collect()))


def test_exact_copies_by_row(spark, docs):
    got = cp.drop_exact_copies(spark, docs, "")
    assert got.columns == cp.COLUMNS
    assert rows_of(got) == sorted([(False, 1, "B", 1), (False, 2, "a", 1), (False, 4, "", 0), (False, 6, LONG[:8], len(LONG)), (False, 7, "same row", 8), (False, 8, LONG[:8], len(LONG) + 4), (True, 0, "lone", 4)])


def test_near_copies_by_row(spark, docs):
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == cp.COLUMNS
    assert rows_of(got) == sorted([(False, 1, "A", 1), (False, 1, "B", 1), (False, 3, "", 0), (False, 5, LONG[:8], len(LONG)), (False, 7, "same row", 8), (True, 0, "lone", 4)])


def test_mixing_and_pieces_keep_whole_rows(spark, docs):
    mixed = cp.mix_sources(spark, docs, "")
    assert mixed.columns == cp.COLUMNS and cp.encode_pieces(spark, docs, "").columns == [*cp.COLUMNS, "ids"]
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= texts
    assert {len(r.ids) == 0 for r in cp.encode_pieces(spark, docs, "").where("text IS NULL OR text = ''").collect()} == {True}
    assert cp.encode_pieces(spark, docs, "").count() == len(ROWS)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_quality_and_empty_tables(spark, docs):
    sf = "/root/testdata/sf0.001"
    assert cp.drop_low_quality(spark, docs, sf).columns == cp.COLUMNS
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_recall_on_planted_near_copies(spark):
    """Words changed so that the similarity of five-word shingles stays at 0.8 or more: all are found."""
    import random

    rng = random.Random(3)
    rows = []
    for g in range(150):
        size = rng.choice([30, 60, 120, 400])
        words = [f"w{rng.randrange(20_000)}" for _ in range(size)]
        rows.append((2 * g, " ".join(words), "en", "s", 1))
        edits = max(1, int(size * 0.1 / 5))
        copy = list(words)
        for at in rng.sample(range(0, size, 5), edits):
            copy[at] = f"new{g}_{at}"
        rows.append((2 * g + 1, " ".join(copy), "en", "s", 1))
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    near = [g for g in range(150) if len(cut(rows[2 * g][1]) & cut(rows[2 * g + 1][1])) >= 0.8 * len(cut(rows[2 * g][1]) | cut(rows[2 * g + 1][1]))]
    assert len(near) > 100
    kept = {r.doc_id for r in cp.drop_near_copies(spark, spark.createDataFrame(rows, KIND), "").collect()}
    assert all(2 * g in kept for g in range(150)) and sum(2 * g + 1 in kept for g in near) == 0
