"""Name resolution: a preference join of references with declarations and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Why a reference stays unresolved.
NO_FIELD = "no definition of this name in the program"
AMBIGUOUS = "the definitions are several, and neither a qualifier nor a file of the activity picks one"


def symbol_index(fields: DataFrame, scope: list[str], name: str, value: str) -> DataFrame:
    """All declarations of each name, sorted."""
    return fields.groupBy(*scope, name).agg(F.array_sort(F.collect_list(value)).alias("declared"))


def resolve(refs: DataFrame, fields: DataFrame, scopes: DataFrame, program: list[str]) -> DataFrame:
    """Each reference with its field.

    refs: program columns, ref, scope_id, owner (null if not qualified), name. fields: program columns, owner, name, key.
    scopes: program columns, scope_id, pref (from 0), file. Adds outcome (qualified, qualified-missing, qualified-duplicate, unique,
    missing, scoped, ambiguous), key, scoped (the file that decided) and candidates (sorted keys).

    Candidates are counted per reference before any scope is looked at, and a scope's file counts only if it declares the name
    once; the first such file wins. Names are joined with pre-aggregated declarations, so a name declared very often is one row.
    """
    per_file = fields.groupBy(*program, "name", "owner").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    names = per_file.groupBy(*program, "name").agg(
        F.sum("n").alias("n_all"), F.min("key").alias("only_key"),
    )
    keys = fields.groupBy(*program, "name").agg(F.array_sort(F.collect_list("key")).alias("all_keys"))
    owned = per_file.select(*program, "name", F.col("owner").alias("_owner"), F.col("n").alias("n_own"), F.col("key").alias("own_key"))
    base = refs.join(names, [*program, "name"], "left").join(keys, [*program, "name"], "left")
    on = [base[c] == owned[c] for c in [*program, "name"]] + [base["owner"] == owned["_owner"]]
    base = base.join(owned, on, "left").select(*[base[c] for c in base.columns], "n_own", "own_key")
    open_refs = base.where("owner is null and n_all > 1").select(*program, "ref", "scope_id", "name")
    once = per_file.where("n = 1").select(*program, "name", F.col("owner").alias("file"), F.col("key").alias("in_scope"))
    chosen = (
        open_refs.join(scopes, [*program, "scope_id"]).join(once, [*program, "name", "file"])
        .groupBy(*program, "ref").agg(F.min(F.struct("pref", "file", "in_scope")).alias("best"))
    )
    out = base.join(chosen, [*program, "ref"], "left")
    outcome = (
        F.when(F.col("owner").isNotNull(), F.when(F.col("n_own") == 1, "qualified").when(F.col("n_own").isNull(), "qualified-missing").otherwise("qualified-duplicate"))
        .when(F.col("n_all") == 1, "unique").when(F.col("n_all").isNull(), "missing").when(F.col("best").isNotNull(), "scoped").otherwise("ambiguous")
    )
    none = F.array().cast("array<string>")
    return (
        out.withColumn("outcome", outcome)
        .withColumn("key", F.when(F.col("outcome") == "qualified", F.col("own_key")).when(F.col("outcome") == "unique", F.col("only_key")).when(F.col("outcome") == "scoped", F.col("best.in_scope")))
        .withColumn("scoped", F.when(F.col("outcome") == "scoped", F.col("best.file")))
        .withColumn(
            "candidates",
            F.when(F.col("outcome").isin("scoped", "ambiguous"), F.col("all_keys"))
            .when(F.col("outcome") == "qualified-duplicate", F.filter("all_keys", lambda k: k.startswith(F.concat("owner", F.lit(":"))))).otherwise(none),
        )
        .drop("n_all", "only_key", "all_keys", "n_own", "own_key", "best")
    )


def with_reason(resolved: DataFrame) -> DataFrame:
    """reason: why a reference has no field, null where it has one."""
    return resolved.withColumn(
        "reason",
        F.when(F.col("outcome") == "qualified-missing", F.concat_ws(" ", F.col("owner"), F.lit("declares no field"), F.col("name")))
        .when(F.col("outcome") == "qualified-duplicate", F.concat_ws(" ", F.col("owner"), F.lit("declares"), F.col("name"), F.lit("more than once")))
        .when(F.col("outcome") == "missing", NO_FIELD).when(F.col("outcome") == "ambiguous", AMBIGUOUS),
    )


def scopes_of(inputs: DataFrame, outputs: DataFrame, program: list[str]) -> DataFrame:
    """An activity's scope: its inputs in order, then what it sorts to."""
    rows = inputs.select(*program, "scope_id", F.lit(0).alias("side"), "ord", "file").unionByName(outputs.select(*program, "scope_id", F.lit(1).alias("side"), "ord", "file"))
    w = Window.partitionBy(*program, "scope_id").orderBy("side", "ord")
    return rows.withColumn("pref", F.row_number().over(w) - 1).drop("side", "ord")
