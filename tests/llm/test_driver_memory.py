"""What many queries leave in the driver's memory goes, and plans stay small."""

import corpus_pipeline
from pyspark.sql import functions as F

from strandflow.llm import common, near_dedup

from .common import DOCS


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))


def test_a_stage_begins_without_what_the_one_before_left(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    before = full_collections(spark)
    corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert full_collections(spark) > before


def test_native_memory_is_given_back(spark):
    assert common.tidy(spark)


def test_tables_of_numbers_are_one_literal(spark):
    rows = spark.range(0, near_dedup.TABLE + 5)
    need = rows.select(near_dedup._required(F.col("id")).alias("need"))
    top = need._jdf.queryExecution().analyzed().expressions().head()
    size = 0
    todo = [top]
    while todo:
        x = todo.pop()
        size += 1
        assert size < 50
        todo += [x.children().apply(i) for i in range(x.children().size())]
    table = near_dedup.required_table()
    assert [r["need"] for r in need.collect()] == [table[min(i, near_dedup.TABLE)] for i in range(near_dedup.TABLE + 5)]
