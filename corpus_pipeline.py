"""A corpus from documents: graded, freed of copies, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodex.llm import exact, mixing, near, packing, quality
from lodex.llm.queries import grades
from lodex.llm.support import numbered, stage

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The name of a row's number within a stage.
ROW = "lodex_row"


# What all stages share: docs is a table with the columns of documents, at rest, as stages read it more than once. Other
# columns are dropped, by their names only. An empty table gives no rows. Rows that are alike, in their id or whole, are told
# apart by their place in docs' files, which doesn't depend on how a scan is split over the executors that live just then.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't take for junk.

    Null and empty texts are graded as texts without words. A null id is graded like any other, but never learned from.
    Each of repeated rows stays or goes, all alike. Long texts are graded whole. A grade of 1 with just half the chance stays.
    """
    model = quality.train(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.select_quality(docs, model, at_least=1).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the one with the smallest id, of several the first in the files.

    Null and empty texts are equal. Null ids come after all others.
    """
    docs = numbered(docs.select(*COLUMNS), ROW)
    gone = exact.deduplicate(docs, row_col=ROW).where("not kept").select(F.col("row").alias(ROW))
    return docs.join(gone, ROW, "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, whose five-word shingles are similar by 0.8 or more: the one with the smallest id.

    Null and empty texts are alike. Null ids come after all others; of rows with the same id the first in the files stays.
    """
    docs = numbered(docs.select(*COLUMNS), ROW)
    gone = near.near_copies(docs, row_col=ROW).where("not kept").select(F.col("row").alias(ROW))
    return docs.join(gone, ROW, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once, or twice.

    Null is a source of its own. Null and empty texts have no words and stay as often as their source's share asks for.
    Repeated rows are drawn one by one.
    """
    docs = numbered(docs.select(*COLUMNS), ROW)
    times = mixing.mix(docs, row_col=ROW).where("times > 0").select(F.col("row").alias(ROW), "times")
    return docs.join(times, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; null and empty texts are one piece, null ids stay null."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The first stage's classifier and the mix aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' are written into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
