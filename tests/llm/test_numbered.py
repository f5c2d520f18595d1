from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodex.llm.support import numbered

SF = "/root/testdata/sf0.01"


def _alike(spark, tmp_path):
    """Many small files of rows that are alike in their ids."""
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") % 50).repartition(30).write.parquet(path)
    return path


def test_numbers_dont_depend_on_the_split(spark, tmp_path):
    path, found = _alike(spark, tmp_path), []
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = numbered(spark.read.parquet(path), "n")
        for cores in ("2", "40"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            found.append({r.n: (r.doc_id, r.text) for r in docs.collect()})
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] and len(found[0]) == 1000


def test_stages_give_the_same_rows_under_another_split(spark, tmp_path):
    """The table is split anew after the stage's operator has run and before its rows are picked."""
    docs = spark.read.parquet(_alike(spark, tmp_path))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for stage in (pipeline.drop_copies, pipeline.drop_near_copies, pipeline.mix_sources):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
            want = sorted(stage(spark, docs, SF).collect(), key=repr)
            out = stage(spark, docs, SF)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "40")
            assert sorted(out.collect(), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_that_are_in_no_file(spark):
    made = numbered(spark.range(100).select(F.lit(1).alias("doc_id")), "n")
    assert len({r.n for r in made.collect()}) == 100 and made.columns == ["doc_id", "n"]
    assert numbered(spark.range(0).select("id"), "n").count() == 0
