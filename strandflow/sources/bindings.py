"""Job-level inputs: steps, allocations and data set bindings from a lineage document in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How a document's format name ends, and its fields.
FORMAT_END = "-lineage"
_DD = "struct<ddname:string,io:string,dataset:string,member:string,generation:string,concatIndex:int>"
SCHEMA = (
    f"format string, job string, source string, steps array<struct<step:string,program:string,inputs:array<{_DD}>,outputs:array<{_DD}>>>, "
    "ddBindings array<struct<program:string,step:string,ddname:string,dataset:string,io:string,member:string,generation:string,concatIndex:int,conditions:array<string>>>"
)


class WrongFormat(ValueError):
    """The document isn't a lineage document."""


class JobDocuments:
    """All documents under a path: bindings, allocations and steps as tables with their order in the document."""

    def __init__(self, documents: DataFrame):
        self.documents = documents

    def check(self) -> None:
        wrong = self.documents.where(~F.coalesce(F.col("format").endswith(FORMAT_END), F.lit(False))).limit(1).collect()
        if wrong:
            raise WrongFormat(f"format {wrong[0]['format']!r} is no lineage document's")

    @property
    def bindings(self) -> DataFrame:
        return self.documents.select("job", F.posexplode("ddBindings").alias("ord", "b")).select("job", "ord", "b.*")

    @property
    def allocations(self) -> DataFrame:
        steps = self.documents.select("job", F.posexplode("steps").alias("s_ord", "s"))
        dds = steps.select("job", "s_ord", F.col("s.step").alias("step"), F.posexplode(F.concat(F.coalesce("s.inputs", F.array().cast(f"array<{_DD}>")), F.coalesce("s.outputs", F.array().cast(f"array<{_DD}>")))).alias("d_ord", "d"))
        return dds.select("job", "step", "d.*", (F.col("s_ord") * 10_000 + F.col("d_ord")).alias("ord"))

    @property
    def steps(self) -> DataFrame:
        return self.documents.select("job", F.posexplode("steps").alias("ord", "s")).select("job", "ord", F.col("s.step").alias("step"), F.col("s.program").alias("program"))


def read_jobs(spark: SparkSession, path: str) -> JobDocuments:
    return JobDocuments(spark.read.schema(SCHEMA).option("multiLine", True).json(path))
