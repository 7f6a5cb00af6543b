"""A corpus of programs as DataFrames: sources, the closure over macro members, and typed fact tables."""

from __future__ import annotations

import json
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import materialize, shared_dir
from .lines import MARGIN, Flags, invocations, read_lines
from .parse import parse_program

_ITEMS = "array<struct<kind:string,keyword:string,value:string>>"
CONDITIONS = "array<struct<kind:string,test:string,negated:boolean,fields:array<string>,after_failing:array<string>>>"
SCHEMAS = {
    "program": "parms array<string>",
    "file": "file string, line int, origin string, raw string, device string, organization string, recfm string, record_length int, block_size int, usage array<string>, exit_program string, "
    "key_fields array<string>, instream boolean, is_table boolean, is_virtual boolean, sql_text string, copied_from string",
    "table_row": "file string, line int, text string",
    "field": "owner string, name string, key string, storage string, location string, start int, length int, stop int, fmt string, decimals int, heading array<string>, mask string, value string, occurs int, "
    "index array<string>, redefines string, line int, origin string, raw string, notes array<string>",
    "macro_use": "name string, line int, arguments array<string>, resolved boolean, depth int, in_macro string",
    "activity": "kind string, name string, line int, origin string, inputs array<struct<file:string,is_null:boolean,keys:array<string>>>, sort_to string, sort_keys array<struct<field:string,descending:boolean>>, "
    "start_proc string, finish_proc string, before_proc string, notes array<string>",
    "report": "report string, activity_ord int, line int, summary boolean, printer string, sumfile string, linesize int, space int, spread boolean, nospread boolean, noadjust boolean, "
    f"sequence array<struct<field:string,descending:boolean>>, control array<struct<field:string,options:array<string>>>, sums array<string>, titles array<struct<index:int,items:{_ITEMS}>>, "
    f"headings map<string,array<string>>, lines array<struct<index:int,line:int,items:{_ITEMS}>>",
    "proc": "activity_ord int, name string, kind string, line int, in_report boolean",
    "statement": f"activity_ord int, activity string, verb string, operands array<string>, text string, line int, origin string, proc string, conditions {CONDITIONS}",
    "flag": "code string, line int, message string",
}
#: Between a member's name and its path, where the name alone is not enough.
PLACE = "@/"
_MEMBERS = "array<struct<name:string,status:string,text:string>>"


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """(program_id, source_name, text) of every member under a path, in one distributed read.

    The id is the member's name; members of one name in several libraries have their path added (NAME@path), so that no two are ever one program.
    """
    files = spark.read.text(path, wholetext=True)
    place = F.col("_metadata.file_path").alias("source_name")
    names = files.select(place).select(T.program_name(F.col("source_name")).alias("_name"))
    twice = names.groupBy("_name").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = files.select(place, F.col("value").alias("text")).withColumn("_name", T.program_name(F.col("source_name"))).join(twice, "_name", "left")
    own = F.when(F.col("_n").isNull(), F.col("_name")).otherwise(F.concat_ws(PLACE, "_name", "source_name"))
    return rows.select(own.alias("program_id"), "source_name", "text")


def member_name(program_id: Column) -> Column:
    """The name that job control knows a program by."""
    return F.substring_index(program_id, PLACE, 1)


def _invoked(margin: int):
    def run(batches):
        for batch in batches:
            ids, names = [], []
            for program, text in zip(batch.column("program_id").to_pylist(), batch.column("text").to_pylist()):
                for name in dict.fromkeys(invocations(read_lines(text or "", margin, Flags()))):
                    ids.append(program)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string())], names=["program_id", "name"])

    return run


def close_over(programs: DataFrame, members: DataFrame, margin: int = MARGIN, max_rounds: int = 12) -> DataFrame:
    """(program_id, name, status, text, round): every macro member a program needs, its members' members included.

    members: name, status (found, absent, error), text. One round is one level: a join with what isn't known yet. Names that no row answers are
    absent; names still open after max_rounds come as status bound, never silently.
    """
    known = None
    frontier = programs.select("program_id", "text").mapInArrow(_invoked(margin), "program_id string, name string").distinct()
    answers = members.select(F.upper("name").alias("name"), F.coalesce("status", F.lit("found")).alias("status"), "text").dropDuplicates(["name"])
    for turn in range(max_rounds + 1):
        if known is not None:
            frontier = frontier.join(known.select("program_id", "name"), ["program_id", "name"], "left_anti")
        if turn == max_rounds:
            level = frontier.select("program_id", "name", F.lit("bound").alias("status"), F.lit(None).cast("string").alias("text"), F.lit(turn).alias("round"))
        else:
            level = frontier.join(answers, "name", "left").select("program_id", "name", F.coalesce("status", F.lit("absent")).alias("status"), "text", F.lit(turn).alias("round"))
        level = materialize(level, "closure")
        if level.isEmpty():
            break
        known = level if known is None else known.unionAll(level)
        frontier = level.where("text is not null").select("program_id", "text").mapInArrow(_invoked(margin), "program_id string, name string").distinct()
    return known if known is not None else level


def _parse(margin: int):
    def run(batches):
        for batch in batches:
            ids, kinds, ords, rows = [], [], [], []
            for program, text, members in zip(*(batch.column(c).to_pylist() for c in ("program_id", "text", "members"))):
                answers = None if members is None else {m["name"]: (m["status"], m["text"]) for m in members}
                for kind, at, row in parse_program(text or "", answers or {}, margin):
                    ids.append(program)
                    kinds.append(kind)
                    ords.append(at)
                    rows.append(json.dumps(row))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ords, pa.int32()), pa.array(rows, pa.string()), pa.array(kinds, pa.string())], names=["program_id", "ord", "row", "kind"])

    return run


class Facts:
    """Typed fact tables of a parsed corpus; every table has program_id and ord."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def table(self, kind: str) -> DataFrame:
        own = self.rows.where(F.col("kind") == kind)
        return own.select("program_id", "ord", F.from_json("row", SCHEMAS[kind]).alias("r")).select("program_id", "ord", "r.*")


def parse_corpus(programs: DataFrame, members: DataFrame | None = None, margin: int = MARGIN, max_rounds: int = 12) -> Facts:
    """programs: program_id, text. Parses every program once, on the executors, and writes the facts by kind."""
    if members is None:
        rows = programs.select("program_id", "text", F.lit(None).cast(_MEMBERS).alias("members"))
    else:
        closed = close_over(programs, members, margin, max_rounds).groupBy("program_id").agg(F.collect_list(F.struct("name", "status", "text")).alias("members"))
        rows = programs.select("program_id", "text").join(closed, "program_id", "left")
    spark = programs.sparkSession
    path = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
    rows.mapInArrow(_parse(margin), "program_id string, ord int, row string, kind string").write.partitionBy("kind").option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return Facts(spark.read.schema("program_id string, ord int, row string, kind string").parquet(path))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
