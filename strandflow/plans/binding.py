"""Bindings of a corpus' files to data sets, and what depends on what its programs provide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frontend.corpus import member_name
from ..operators import manifest
from ..sources.bindings import JobDocuments
from .lineage import Lineage


def bind_files(lineage: Lineage, jobs: JobDocuments, steps: DataFrame | None = None) -> DataFrame:
    """program, ddname, dataset or candidates, route, identity for every file in the manifest.

    Steps are chosen by the caller's list (program, step), else by the program a step executes, else by the member its control
    input names, else by the file's name alone. A binding's null program matches no program of any name. Executed step names are
    compared as written with upper-case binding steps; the caller's and the members' are put in upper case. Steps of one name in several jobs are
    several steps; the caller's list may name the job too, and means the steps of every job where it doesn't. Documents without a job name count as one job.
    """
    spark = jobs.documents.sparkSession
    files = lineage.artifacts.where("kind = 'file'").select("program_id", member_name(F.col("program_id")).alias("program"), F.col("name").alias("ddname"))
    programs = files.select("program").distinct()
    job = F.coalesce("job", F.lit("")).alias("job")
    bindings = jobs.bindings.withColumn("job", job).withColumn("step", F.upper("step"))
    listed = jobs.steps.select(job, "step", "program").unionByName(jobs.bindings.select(job, "step", "program"))
    requested = (steps if steps is not None else spark.createDataFrame([], "program string, step string")).withColumn("step", F.upper("step"))
    if "job" not in requested.columns:
        requested = requested.join(bindings.select("job", "step").distinct(), "step")
    executed = listed.where("program is not null").select(F.upper("program").alias("program"), "job", "step").join(programs, "program", "left_semi").distinct()
    by_member = manifest.steps_running(jobs.allocations.withColumn("job", job), programs)
    chosen = manifest.chosen_steps(requested.select("program", "job", "step"), executed, by_member)
    return manifest.bound_files(files.select("program", "ddname").distinct(), bindings, chosen).join(files, ["program", "ddname"])


def provides(lineage: Lineage, bound: DataFrame) -> DataFrame:
    """(program, name, kind, ddname, asked): the program itself and every data set it writes; unbound or concatenated ones cannot be asked for."""
    # Asks are by the member's name, which is what others know a program by.
    own = bound.select("program").distinct().select("program", F.col("program").alias("name"), F.lit("program").alias("kind"), F.lit(None).cast("string").alias("ddname"), F.lit(True).alias("asked"))
    written = lineage.file_io.where("io in ('write', 'read-write')").select("program_id", F.col("file").alias("ddname"))
    sets = bound.join(written, ["program_id", "ddname"], "left_semi")
    single = F.col("dataset").isNotNull() & ~F.col("dataset").contains("+")
    return own.unionByName(sets.select("program", F.when(single, F.col("dataset")).alias("name"), F.lit("dataset").alias("kind"), "ddname", single.alias("asked")))


def dependents_of(asks: DataFrame, answers: DataFrame | None, covered: DataFrame | None) -> DataFrame | None:
    """state of every ask; None, not an empty answer, where no index was supplied."""
    if answers is None or covered is None:
        return None
    return manifest.dependents(asks.withColumn("asked", F.coalesce("asked", F.lit(False))), answers, covered)
