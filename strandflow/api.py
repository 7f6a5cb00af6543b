"""The public entry points: analyse a corpus, snapshot and replay its lookups, and write views as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frontend.corpus import close_over, parse_corpus
from .frontend.lines import MARGIN
from .functions import text as text_functions
from .operators import lexing, manifest
from .plans.binding import bind_files, dependents_of, provides
from .plans.lineage import Lineage, described_field
from .sources.bindings import JobDocuments

VIEW_VERSION = 3
# Suffixes of macro members.
MEMBER_SUFFIXES = ("mac", "ezm", "ezt", "ezy", "eas")


@dataclass
class Analysis:
    """Lazy tables over one corpus; each view is computed when it is first asked for."""

    programs: DataFrame
    lineage: Lineage
    jobs: JobDocuments | None = None
    steps: DataFrame | None = None
    synonyms: DataFrame | None = None
    resolved_synonyms: DataFrame | None = None
    dependents: DataFrame | None = None
    covered: DataFrame | None = None
    _bound: DataFrame | None = field(default=None, repr=False)

    def artifacts(self) -> DataFrame:
        """The manifest; a table's base comes from the supplied map first, then from the resolver's answers."""
        rows = self.lineage.artifacts
        if self.synonyms is None and self.resolved_synonyms is None:
            return rows.select("*", F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("resolved_via"))
        none = self.programs.sparkSession.createDataFrame([], "name string, base string")
        tables = manifest.with_base_tables(rows.where("kind = 'db2-table'"), self.synonyms or none, self.resolved_synonyms or none)
        return rows.where("kind <> 'db2-table'").unionByName(tables, allowMissingColumns=True)

    def bound_artifacts(self) -> DataFrame:
        if self.jobs is None:
            raise ValueError("no job documents were supplied")
        if self._bound is None:
            self.jobs.check()
            self._bound = bind_files(self.lineage, self.jobs, self.steps)
        return self._bound

    def dependents_view(self) -> DataFrame | None:
        if self.dependents is None:
            return None
        return dependents_of(provides(self.lineage, self.bound_artifacts()), self.dependents, self.covered)

    def summary_lines(self) -> DataFrame:
        """(program_id, rank, line): counts, then every flow between files, then every flag; text for a human reader."""
        n = self.summary()
        traced = self.lineage.field_flow.groupBy("program_id").agg(F.sum((F.size("origins") > 0).cast("int")).alias("traced"))
        counts = n.join(traced, "program_id", "left").select("program_id", F.lit(0).alias("rank"), F.concat_ws(
            ", ", *[F.concat_ws(" ", F.col(c).cast("string"), F.lit(c)) for c in n.columns if c != "program_id"], F.concat_ws(" ", F.coalesce("traced", F.lit(0)).cast("string"), F.lit("flows with an input")),
        ).alias("line"))
        flows = self.lineage.file_flow.select("program_id", F.lit(1).alias("rank"), F.concat(F.lit("FLOW "), "from_file", F.lit(" -> "), "to_file", F.lit(" ("), F.col("fields").cast("string"), F.lit(")")).alias("line"))
        flags = self.lineage.flags.select("program_id", F.lit(2).alias("rank"), F.concat(F.lit("FLAG "), "message").alias("line"))
        return counts.unionByName(flows).unionByName(flags)

    def summary(self) -> DataFrame:
        """Counts per program, as a reader wants them first."""
        n = {
            "files": self.lineage.file_io, "edges": self.lineage.edges, "flows": self.lineage.field_flow, "unresolved": self.lineage.unresolved, "flags": self.lineage.flags, "artifacts": self.lineage.artifacts,
        }
        out = self.programs.select("program_id").distinct()
        for name, df in n.items():
            out = out.join(df.groupBy("program_id").agg(F.count("*").alias(name)), "program_id", "left")
        return out.fillna(0)


def analyze(
    programs: DataFrame, members: DataFrame | None = None, *, margin: int = MARGIN, max_rounds: int = 12, jobs: JobDocuments | None = None, steps: DataFrame | None = None,
    synonyms: DataFrame | None = None, resolved_synonyms: DataFrame | None = None, dependents: DataFrame | None = None, covered: DataFrame | None = None,
) -> Analysis:
    """programs: program_id, text. members: name, status, text. See Analysis for what comes of it."""
    facts = parse_corpus(programs, members, margin, max_rounds)
    return Analysis(programs, Lineage(facts), jobs, steps, synonyms, resolved_synonyms, dependents, covered)


def gather(programs: DataFrame, members: DataFrame, path: str, margin: int = MARGIN, max_rounds: int = 12) -> DataFrame:
    """Write every member answer that the corpus needs as Parquet, for a replay without the estate."""
    answers = close_over(programs, members, margin, max_rounds).where("status <> 'bound'").select("name", "status", "text").dropDuplicates(["name"])
    answers.write.mode("overwrite").parquet(path)
    return programs.sparkSession.read.parquet(path)


def read_members(spark: SparkSession, folders: list[str], more_suffixes: tuple[str, ...] = (), estate: DataFrame | None = None) -> DataFrame:
    """(name, status, text) of macro members: of the first folder that has one, else what the estate's table answers."""
    suffixes = [s.lower().lstrip(".") for s in (*more_suffixes, *MEMBER_SUFFIXES)]
    found = None
    for rank, folder in enumerate(folders):
        files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        suffix = F.array_position(F.lit(suffixes), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
        part = files.select(text_functions.program_name(F.col("path")).alias("name"), F.struct(F.lit(rank).alias("rank"), suffix.alias("suffix"), "path").alias("place"), "text").where("place.suffix > 0")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return estate if estate is not None else spark.createDataFrame([], "name string, status string, text string")
    best = found.groupBy("name").agg(F.min("place").alias("place"))
    local = found.join(best, ["name", "place"]).select("name", F.lit("found").alias("status"), "text")
    if estate is None:
        return local
    rest = estate.select(F.upper("name").alias("name"), "status", "text").join(local.select("name"), "name", "left_anti")
    return local.unionByName(rest)


def looks_like_program(texts: DataFrame, key: str = "program_id", text_col: str = "text", name_col: str | None = None, suffixes: tuple[str, ...] = lexing.SUFFIXES) -> DataFrame:
    """(key, is_program, why) by the file name's suffix where there is a known one, else by the text's statements."""
    told = lexing.detected_languages(lexing.physical_lines(texts, key, text_col), key)
    told = texts.select(key, *([name_col] if name_col else [])).join(told, key, "left")
    known = F.lower(F.substring_index(name_col, ".", -1)).isin(*suffixes) if name_col else F.lit(False)
    return told.select(key, (known | F.coalesce("is_program", F.lit(False))).alias("is_program"), F.when(known, "suffix").otherwise(F.coalesce("why", F.lit("nothing found"))).alias("why"))


def view_rows(df: DataFrame, program_id: str) -> list[dict]:
    """One program's rows of a table without nulls, for JSON."""
    rows = df.where(F.col("program_id") == program_id).select(F.to_json(F.struct("*")).alias("j"))
    return [json.loads(r["j"]) for r in rows.toLocalIterator()]


def lineage_view(analysis: Analysis, program_id: str) -> dict:
    """One program's lineage as a nested document; a single program is small, so this is the one place where rows come to the driver."""
    lin, at = analysis.lineage, lambda df: view_rows(df, program_id)
    return {
        "formatVersion": VIEW_VERSION, "program": program_id, "files": at(lin._table("file").join(lin.file_io, ["program_id", "file"]).orderBy("file")), "fields": at(lin.fields.withColumn("field", described_field()).orderBy("ord")), "workingStorage": at(lin.fields.where("owner is null").orderBy("ord")),
        "activities": at(lin.activities.orderBy("ord")), "fieldLineage": at(lin.edges.orderBy("edge_ord")), "fieldFlow": at(lin.field_flow.join(lin.described.withColumnRenamed("key", "sink"), ["program_id", "sink"], "left").orderBy("sink")), "fileFlow": at(lin.file_flow.orderBy("from_file", "to_file")),
        "fileAccess": at(lin.access.orderBy("at").drop("at")), "reports": at(lin._table("report").orderBy("ord")), "calls": at(lin.calls.orderBy("st")), "sql": at(lin.sql.orderBy("st")),
        "unresolved": at(lin.unresolved.orderBy("st", "pos")), "flags": at(lin.flags.orderBy("place").drop("place")),
    }


def write_views(analysis: Analysis, path: str, only: set[str] | None = None) -> None:
    """The corpus' views (or some of them) as JSON lines, one folder each, written by the executors."""
    lin = analysis.lineage
    views = {
        "lineage": lambda: lin.edges, "flow": lambda: lin.field_flow, "file-flow": lambda: lin.file_flow, "access": lambda: lin.access, "artifacts": analysis.artifacts, "excluded": lambda: lin.excluded,
        "unresolved": lambda: lin.unresolved, "flags": lambda: lin.flags.drop("place"),
    }
    for name, made in views.items():
        if only is None or name in only:
            made().write.mode("overwrite").json(f"{path}/{name}")


def text_digest(document: dict) -> str:
    """SHA-256 of a view's JSON text, to compare two runs byte by byte."""
    import hashlib

    return hashlib.sha256((json.dumps(document, indent=2, ensure_ascii=False) + "\n").encode()).hexdigest()
