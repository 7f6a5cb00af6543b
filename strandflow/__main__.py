"""Command line: `python -m strandflow SOURCES OUT`, or spark-submit with this file.

Exit codes: 0 done, 1 wrong input, 2 unreadable or contradictory arguments, 130 interrupted.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

if __package__ in (None, ""):  # run by its path
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow import api
from strandflow.frontend.corpus import read_programs
from strandflow.frontend.lines import MARGIN
from strandflow.sources.bindings import WrongFormat, read_jobs

VIEWS = {"lineage": ("lineage", "flow", "file-flow", "access", "unresolved", "flags"), "artifacts": ("artifacts", "excluded", "flags")}


class BadArguments(ValueError):
    """The arguments contradict each other."""


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandflow", description="Lineage and dependencies of a corpus of batch report programs.")
    p.add_argument("sources", help="a program, a folder of programs, or - for one program on standard input")
    p.add_argument("out", help="folder of the views")
    p.add_argument("--target", choices=["both", "artifacts", "lineage"], default="both")
    p.add_argument("-I", "--path", "--macro-path", dest="path", action="append", default=[], metavar="DIR", help="folder of macro members, looked through before the estate's table (repeatable)")
    p.add_argument("--macro-ext", action="append", default=[], metavar="EXT", help="one more suffix of macro members (repeatable)")
    p.add_argument("--estate", metavar="PARQUET", help="table of member answers: name, status, text")
    p.add_argument("--right-margin", type=int, default=MARGIN, metavar="COL", help="last column read; 0: whole lines")
    p.add_argument("--program-name", metavar="NAME", help="the name of a single program")
    p.add_argument("--bind", metavar="JSON", help="job documents, one file or a folder")
    p.add_argument("--bind-step", action="append", default=[], metavar="STEP", help="bind from this step only (repeatable); JOB.STEP for a step of one job")
    p.add_argument("--max-rounds", type=int, default=12, metavar="N", help="levels of macro members")
    p.add_argument("--synonyms", metavar="JSON", help="{table: base table}")
    p.add_argument("--dependents", metavar="JSON", help="{kind: {name: [dependents]}}; an empty list says that none were found")
    p.add_argument("--gather-only", metavar="DIR", help="write the member answers that the corpus needs, and stop")
    p.add_argument("--from-bundle", metavar="DIR", help="read member answers that --gather-only wrote")
    p.add_argument("--summary", action="store_true", help="print counts, FLOW and FLAG lines")
    p.add_argument("--debug", action="store_true")
    return p


def _read_json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise BadArguments(f"{path}: {e}") from e


def _programs(spark: SparkSession, args) -> DataFrame:
    if args.sources == "-":
        rows = spark.createDataFrame([("PROGRAM", "<stdin>", sys.stdin.read())], "program_id string, source_name string, text string")
    else:
        rows = read_programs(spark, args.sources)
    if args.program_name:
        if rows.limit(2).count() != 1:
            raise BadArguments("--program-name needs a single program")
        rows = rows.withColumn("program_id", F.lit(args.program_name.upper()))
    return rows


def _members(spark: SparkSession, args) -> DataFrame | None:
    if args.from_bundle:
        return spark.read.parquet(args.from_bundle)
    estate = spark.read.parquet(args.estate) if args.estate else None
    return api.read_members(spark, args.path, tuple(args.macro_ext), estate) if args.path or args.estate else None


def _steps(spark: SparkSession, programs: DataFrame, wanted: list[str]) -> DataFrame | None:
    """The caller's steps, for every program of the corpus."""
    if not wanted:
        return None
    rows = [(w.rpartition(".")[0] or None, w.rpartition(".")[2]) for w in wanted]
    if any(job for job, _ in rows) and not all(job for job, _ in rows):
        raise BadArguments("--bind-step: name the job of every step, or of none")
    steps = spark.createDataFrame(rows, "job string, step string")
    names = programs.select(F.substring_index("program_id", "@/", 1).alias("program")).distinct()
    return names.join(F.broadcast(steps if rows[0][0] else steps.drop("job")))  # what the command line lists


def run(args) -> None:
    if args.gather_only and args.from_bundle:
        raise BadArguments("--gather-only writes a bundle and --from-bundle reads one")
    synonyms, dependents = (_read_json(x) if x else None for x in (args.synonyms, args.dependents))
    if dependents is not None and not args.bind:
        raise BadArguments("--dependents asks about data sets, which --bind names")
    spark = SparkSession.builder.getOrCreate()
    programs, members = _programs(spark, args), _members(spark, args)
    if args.gather_only:
        api.gather(programs, members if members is not None else api.read_members(spark, []), args.gather_only, args.right_margin, args.max_rounds)
        return
    more = {}
    if synonyms is not None:
        more["synonyms"] = spark.createDataFrame(list(synonyms.items()), "name string, base string")
    if dependents is not None:
        more["dependents"] = spark.createDataFrame([(n, k, d) for k, own in dependents.items() for n, found in own.items() for d in found], "name string, kind string, dependent string")
        more["covered"] = spark.createDataFrame([(n, k) for k, own in dependents.items() for n in own], "name string, kind string")
    analysis = api.analyze(
        programs, members, margin=args.right_margin, max_rounds=args.max_rounds, jobs=read_jobs(spark, args.bind) if args.bind else None, steps=_steps(spark, programs, args.bind_step) if args.bind else None, **more
    )
    wanted = ["artifacts", "lineage"] if args.target == "both" else [args.target]
    if args.bind:
        analysis.bound_artifacts().write.mode("overwrite").json(f"{args.out}/bound")
        wanted = sorted({*wanted, "artifacts"})
    api.write_views(analysis, args.out, {v for w in wanted for v in VIEWS[w]})
    if dependents is not None:
        analysis.dependents_view().write.mode("overwrite").json(f"{args.out}/dependents")
    if args.summary:
        for r in analysis.summary_lines().orderBy("program_id", "rank", "line").toLocalIterator():
            print(f"[{r['program_id']}] {r['line']}")


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        run(args)
    except WrongFormat as e:
        print(e, file=sys.stderr)
        return 1
    except (BadArguments, AnalysisException) as e:
        if args.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        print("interrupted", file=sys.stderr)
        return 130
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
