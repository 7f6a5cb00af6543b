"""Dependency edges and file access: projections, unions and markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(parts: dict[str, DataFrame], tag: str = "via") -> DataFrame:
    """One table of all parts, each with its tag; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in parts.items()])


def accumulates(target: Column, sources: Column) -> Column:
    """A value that is among its own sources."""
    return F.array_contains(sources, target)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """A table lookup: rows keep their place, the result is null where no entry matches."""
    return rows.join(table, on, "left")


def lookup_sources(entries: DataFrame, table: list[str], ord_col: str, key: str) -> DataFrame:
    """A table's describing fields: all but its first, or the only one."""
    listed = entries.groupBy(*table).agg(F.transform(F.array_sort(F.collect_list(F.struct(ord_col, key))), lambda s: s[key]).alias("_all"))
    return listed.select(*table, F.when(F.size("_all") > 1, F.slice("_all", F.lit(2), F.size("_all"))).otherwise(F.col("_all")).alias("sources"))


def ordered_list(rows: DataFrame, by: list[str], order: list[str], value: str, alias: str, distinct: bool = False) -> DataFrame:
    """Values of a group in order; with distinct, first occurrences only."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"])
    return rows.groupBy(*by).agg((F.array_distinct(listed) if distinct else listed).alias(alias))


def first_seen(rows: DataFrame, by: list[str], order: list[str], value: str, alias: str) -> DataFrame:
    """Distinct values of a group by first occurrence: pre-aggregated, so repeats never meet in one list."""
    firsts = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v")))), lambda s: s["_v"]).alias(alias))


def file_directions(declared: DataFrame, access: DataFrame, key: list[str]) -> DataFrame:
    """read, write, read-write or unknown for every file that is declared or touched; an update is both."""
    reads, writes = F.col("io").isin("read", "update"), F.col("io").isin("write", "update")
    touched = access.groupBy(*key).agg(F.max(reads.cast("int")).alias("r"), F.max(writes.cast("int")).alias("w"))
    kind = F.when((F.col("r") == 1) & (F.col("w") == 1), "read-write").when(F.col("r") == 1, "read").when(F.col("w") == 1, "write").otherwise("unknown")
    return declared.select(*key).distinct().join(touched, key, "full").select(*key, kind.alias("io"))


def condition_depth(steps: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """How many control structures are open after each step (opening less closing steps so far)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
