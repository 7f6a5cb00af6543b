"""What steps that write their results leave on the disks of executors."""

import pytest
from pyspark.sql import functions as F

from strandflow.llm import components, queries, substring_dedup
from strandflow.llm.common import dropping_shuffles

from .common import corpus, frame

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_op3_leaves_no_shuffle_files_between_its_steps(spark, tmp_path, monkeypatch):
    frame(spark, corpus()).write.parquet(str(tmp_path / "documents.parquet"))
    real, left, before = substring_dedup.materialize, [], shuffle_files(spark)

    def watched(df, label, *more):
        out = real(df, label, *more)
        left.append((label, sorted(shuffle_files(spark) - before)))
        return out

    monkeypatch.setattr(substring_dedup, "materialize", watched)
    monkeypatch.setattr(components, "materialize", watched)
    found = queries.op3_substring_dedup(spark, str(tmp_path))
    assert {"copies", "stretches", "links", "cc", "repeated"} <= {label for label, _ in left} and [x for x in left if x[1]] == []
    # What is lazy is read as often as anyone likes.
    assert sorted(found.collect(), key=str) == sorted(found.collect(), key=str) != []


def test_setting_is_put_back(spark):
    before = spark.conf.get(CLEANUP, None)
    try:
        for own in (None, "false", "true"):
            spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)
            then = spark.conf.get(CLEANUP, None)
            with pytest.raises(ZeroDivisionError), dropping_shuffles(spark):
                assert spark.conf.get(CLEANUP) == "true" and spark.range(9).repartition(3, "id").agg(F.sum("id")).first()[0] == 36
                raise ZeroDivisionError
            assert spark.conf.get(CLEANUP, None) == then
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
