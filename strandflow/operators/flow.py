"""End-to-end flow: backward walks over edges, origins, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

MAX_PATHS, MAX_DEPTH = 64, 24


def adjacency(edges: DataFrame, by: list[str], order: str) -> DataFrame:
    """Every target with its edges in emission order."""
    return edges.groupBy(*by, "target").agg(F.array_sort(F.collect_list(F.struct(order, "source"))).alias("incoming"))


def origins(nodes: DataFrame, edges: DataFrame, read_only: DataFrame, by: list[str]) -> DataFrame:
    """Nodes at which a walk stops: in a file that is only read (semi join), or written by nothing (anti join)."""
    from_files = nodes.join(read_only, [*by, "file"], "left_semi")
    unwritten = nodes.join(edges.select(*by, F.col("target").alias("node")).distinct(), [*by, "node"], "left_anti")
    return from_files.unionByName(unwritten).distinct()


def walk_levels(edges: DataFrame, starts: DataFrame, stops: DataFrame, by: list[str], max_depth: int) -> DataFrame:
    """All backward routes of at most max_depth hops: by, sink, node (the end), hops, kind (origin, cyclic, truncated).

    A breadth-first join, one level at a time; routes that end leave the frontier at once, so a level carries only open routes.
    starts: by, node. stops: by, node where a walk ends. A node without incoming edges ends it too.
    """
    e = edges.select(*by, F.col("target").alias("node"), F.col("source").alias("next")).distinct()
    ends = stops.select(*by, F.col("node").alias("next")).distinct().withColumn("_stop", F.lit(True))
    has_in = e.select(*by, F.col("node").alias("next")).distinct().withColumn("_in", F.lit(True))
    step = materialize(e.join(ends, [*by, "next"], "left").join(has_in, [*by, "next"], "left").select(*by, "node", "next", (F.col("_stop").isNotNull() | F.col("_in").isNull()).alias("_end")), "steps")
    frontier = starts.select(*by, F.col("node").alias("sink"), "node", F.array("node").alias("on_path"))
    found = None
    for hop in range(1, max_depth + 1):
        reached = frontier.join(step, [*by, "node"]).withColumn(
            "kind", F.when(F.array_contains("on_path", F.col("next")), "cyclic").when(F.col("_end"), "origin").when(F.lit(hop == max_depth), "truncated")
        )
        reached = materialize(reached, "walk")
        done = reached.where("kind is not null").select(*by, "sink", F.col("next").alias("node"), F.lit(hop).alias("hops"), "kind")
        found = done if found is None else found.unionAll(done)
        frontier = reached.where("kind is null").select(*by, "sink", F.col("next").alias("node"), F.concat("on_path", F.array("next")).alias("on_path"))
        if hop < max_depth and frontier.isEmpty():
            break
    return found


def rolled_up(ends: DataFrame, by: list[str]) -> DataFrame:
    """Per sink: sorted distinct origins, paths, and how many were cyclic or cut off."""
    return ends.groupBy(*by, "sink").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "truncated", F.col("node")))).alias("origins"), F.count("*").alias("paths"),
        F.sum((F.col("kind") == "cyclic").cast("int")).alias("cyclic"), F.sum((F.col("kind") == "truncated").cast("int")).alias("truncated"),
    )


def influence_origins(gates: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Where each gating node comes from: distinct origins of its own walk, without itself."""
    traced = gates.join(ends.select(*by, F.col("sink").alias("gate"), "node"), [*by, "gate"], "left")
    return traced.groupBy(*by, "sink", "gate").agg(F.array_sort(F.collect_set(F.when(F.col("node") != F.col("gate"), F.col("node")))).alias("traces_to"))


def no_origin_reason(bad: Column, gated: Column) -> Column:
    """Why a sink has no origin: something isn't modelled, else conditions alone decide it, else constants."""
    return F.when(bad, "unmodelled").when(gated, "conditions").otherwise("constants")


def between_files(paths: DataFrame, by: list[str]) -> DataFrame:
    """(from_file, to_file): how many paths run between two files, and the activities on them; no file with itself.

    paths: by, from_file, to_file, n (paths that a row stands for), activities (those on them).
    """
    rows = paths.where("from_file is not null and to_file is not null and from_file <> to_file")
    return rows.groupBy(*by, "from_file", "to_file").agg(F.sum("n").alias("fields"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("activities")))).alias("activities"))
