"""Corpus preparation in five stages: language, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents. Every stage works on all that the one before kept, and none of them samples or caps.

Whole rows travel as one struct, so further columns may have any names, those of the operators' own columns too. Texts of any length are
worked on whole. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import drop_table, materialize, read_table, recorded, release, tidy
from strandflow.llm.decontaminate import find_overlaps
from strandflow.llm.language_id import identify
from strandflow.llm.near_dedup import first_documents
from strandflow.llm.packing import pack
from strandflow.llm.secrets import find_secrets


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


#: Intermediate tables of the stage before. Its result is written and read again by now, so they can go.
_of_stage_before: list[str] = []


def _stage(f):
    """A stage that first removes the intermediate tables of the one before and what it left in the driver's memory, and remembers its own tables."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _of_stage_before:
            drop_table(spark, _of_stage_before.pop())
        tidy(spark)
        with recorded(_of_stage_before):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; those that language identification rejects go (null and empty texts among them).

    A null lang teaches nothing; a null doc_id is never learned from; ties between languages go to the first name. Repeated rows are judged each.
    """
    found = identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return _as_documents(found.where(~F.col("rejected")), docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every group of near duplicates.

    Null and empty texts are alike to nothing and stay. Ties in doc_id, repeated rows among them, go to the row read first; a null doc_id comes last.
    """
    return _as_documents(first_documents(docs), docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a verified overlap with any benchmark item.

    Null and empty texts have none and stay; so has everything if the benchmark is empty. Rows are judged one by one, so ids, repeated or null, don't matter.
    """
    found = find_overlaps(docs, read_table(spark, sf_dir, "benchmark"))
    return _as_documents(found.where(F.size("hits") == 0), docs)


@_stage
def secret_links(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced by a mark; n_chars follows the text.

    Null and empty texts stay as they are, and so does n_chars, null or not, where nothing is replaced. Spans that overlap are replaced by one mark. Repeated rows are judged each.
    """
    found = find_secrets(docs, redact=True)
    changed = F.size("spans") > 0
    cols = {c: F.col("_row").getField(c) for c in docs.columns}
    cols["text"] = F.when(changed, F.col("redacted")).otherwise(cols["text"])
    cols["n_chars"] = F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return found.select(*[x.alias(c) for c, x in cols.items()])


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, the ids as four little-endian bytes each.

    A null or empty text is its separator alone; a null doc_id stays null; repeated rows are packed each.
    """
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secrets", secret_links),
    ("packing", packing),
]

#: Language models and token ids have no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
            if before is not None:
                release(before)
            before = docs
    _of_stage_before.clear()  # the caller has yet to read what the last stage made
    return docs
