"""The corpus pipeline: quality, exact and near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents`` and no others, whatever
the input has beside them; the last adds ``ids``. Decisions are carried by row,
not by id: stages that drop copies number the rows first, so a repeated id
loses no other text, and of rows repeated in full one stays. Null and empty
texts are documents like any other (all of them are copies of one another);
null ids come after all others when one of a group is chosen to stay. Empty
tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import exact_dedup, mixing, piece_codec, quality, shingle_sets, simhash  # noqa: F401  tests look at fingerprints
from tidegrid.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    docs = docs.select(COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model).where("predicted = 1").select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written down so that it stays."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "pipeline-rows")


def _only(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    return rows.join(dropped, "_row", "left_anti").select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest id."""
    rows = _numbered(docs)
    named = rows.select(F.struct("doc_id", "_row").alias("place"), "text")
    found = exact_dedup.exact_duplicates(named, id_col="place").where("NOT kept")
    return _only(rows, found.select(F.col("place._row").alias("_row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by a similarity of 0.8 or more the one with the smallest id."""
    rows = _numbered(docs)
    linked = materialize(shingle_sets.near_copies(rows.select("_row", "text"), SHINGLE, id_col="_row"), "pipeline-linked")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    members = linked.join(rows.select("_row", place.alias("place")), "_row")
    stays = members.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row"))
    return _only(rows, linked.join(stays, "_row", "left_anti").select("_row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.take(docs.select(COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of every text."""
    return piece_codec.encode(docs.select(COLUMNS), check=False)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The classifier and the shingle sets are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
