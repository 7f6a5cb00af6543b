"""What a program depends on: artifact rows, exclusions, synonyms, bindings and dependents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artifacts(classes: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """One row per artifact: rank and class, name, uses and where it is used; classes come in the order given.

    Each part has the columns by, name, used_at (null: used, but nowhere in particular), and status and role if its class has them.
    """
    out = None
    for rank, (kind, df) in enumerate(classes.items()):
        more = [c for c in ("status", "role") if c in df.columns]
        part = df.groupBy(*by, "name").agg(F.count("*").alias("uses"), F.array_sort(F.collect_set("used_at")).alias("touched_by"), *[F.min(c).alias(c) for c in more]).select(
            *by, F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "name", "uses", "touched_by", *more
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def split_exclusions(rows: DataFrame, reasons: dict[str, object]) -> DataFrame:
    """reason: the first test that holds, null for what stays in the manifest."""
    found = F.lit(None).cast("string")
    for reason, test in reversed(list(reasons.items())):
        found = F.when(test, F.lit(reason)).otherwise(found)
    return rows.withColumn("reason", found)


def with_base_tables(tables: DataFrame, supplied: DataFrame, answered: DataFrame) -> DataFrame:
    """base and its source: the caller's map first, then the resolver's answer, else the name itself."""
    joined = tables.join(supplied.select("name", F.col("base").alias("_map")), "name", "left").join(answered.select("name", F.col("base").alias("_answer")), "name", "left")
    return joined.select(
        *tables.columns, F.coalesce("_map", "_answer", "name").alias("base"), F.when(F.col("_map").isNotNull(), "map").when(F.col("_answer").isNotNull(), "resolver").alias("resolved_via")
    )


def _of_job(df: DataFrame) -> list[str]:
    """What tells a step: its job too, where the table has it."""
    return ["job", "step"] if "job" in df.columns else ["step"]


def steps_running(allocations: DataFrame, programs: DataFrame) -> DataFrame:
    """(program, job if given, step) for steps whose control input names the program: its member, else the last part of the data set's name."""
    member = F.upper(F.coalesce(F.col("member"), F.substring_index("dataset", ".", -1)))
    of = _of_job(allocations)
    named = allocations.where("upper(ddname) = 'SYSIN'").select(*of[:-1], F.upper("step").alias("step"), member.alias("program"), "ord")
    return named.join(programs.select("program"), "program").groupBy("program", *of).agg(F.min("ord").alias("ord"))


def chosen_steps(requested: DataFrame, executed: DataFrame, by_member: DataFrame, program: str = "program") -> DataFrame:
    """(program, job if given, step, route): the caller's steps, else steps that execute the program, else those whose input names it."""
    routes = None
    for rank, (route, df) in enumerate((("caller", requested), ("program", executed), ("member", by_member))):
        part = df.select(program, *_of_job(df), F.lit(rank).alias("rank"), F.lit(route).alias("route")).distinct()
        routes = part if routes is None else routes.unionByName(part)
    best = routes.groupBy(program).agg(F.min("rank").alias("rank"))
    return routes.join(best, [program, "rank"]).drop("rank")


def bound_files(files: DataFrame, bindings: DataFrame, steps: DataFrame, program: str = "program") -> DataFrame:
    """Each file with the data sets its name is bound to.

    files: program, ddname. bindings: job (optional), step, ddname, dataset, ord, and generation and concatIndex if known. Without any step for a
    program, the name alone binds (route name-alone). Per step the data sets are read in order (a concatenation); equal readings of several steps are one.
    One reading: dataset; several: candidates, sorted. Where bindings have generations, `readings` lists every reading's data sets in order.

    What a step reads by a name doesn't depend on the program, so readings are made before programs meet them.
    """
    of = _of_job(bindings)
    detail = [c for c in ("generation", "concatIndex") if c in bindings.columns]
    b = bindings.select(*of, F.upper("ddname").alias("_dd"), "dataset", "ord", *detail)
    item = F.array_sort(F.collect_list(F.struct("ord", "dataset", *detail)))
    listed = b.groupBy(*of, "_dd").agg(item.alias("items"), F.count("dataset").alias("n")).where("n > 0")
    of_item = lambda s: F.struct(*[s[c].alias(c) for c in ("dataset", *detail)])
    reading = F.struct(F.array_join(F.transform("items", lambda s: s["dataset"]), "+").alias("name"), *([F.transform("items", of_item).alias("items")] if detail else []))
    listed = listed.select(*of, "_dd", reading.alias("reading"))
    named = F.upper("ddname").alias("_dd")
    have = steps.select(program).distinct().withColumn("_has", F.lit(True))
    wanted = files.select(program, "ddname", named).join(have, program, "left")
    by_step = wanted.where("_has").drop("_has").join(steps.select(program, *of, "route"), program).join(listed, [*of, "_dd"]).groupBy(program, "ddname").agg(
        F.array_sort(F.collect_set("reading")).alias("readings"), F.min("route").alias("route")
    )
    by_name = listed.groupBy("_dd").agg(F.array_sort(F.collect_set("reading")).alias("readings"))
    alone = wanted.where("_has is null").join(by_name, "_dd").select(program, "ddname", "readings", F.lit("name-alone").alias("route"))
    out = files.join(by_step.unionByName(alone), [program, "ddname"], "left")
    n = F.coalesce(F.size("readings"), F.lit(0))
    names = F.transform("readings", lambda r: r["name"])
    return out.select(
        *files.columns, F.when(n == 1, F.get(names, F.lit(0))).alias("dataset"), F.when(n > 1, F.array_join(names, "|")).alias("candidates"), "route",
        F.when(n == 1, "global").when(n > 1, "candidates").otherwise("program-local").alias("identity"), *([F.transform("readings", lambda r: r["items"]).alias("readings")] if detail else []),
    )


def dependents(asks: DataFrame, answers: DataFrame, covered: DataFrame) -> DataFrame:
    """state of each ask (name, kind, asked): provided, none-found, unanswered (not covered by the index) or never-asked; null count unless answered."""
    counted = answers.groupBy("name", "kind").agg(F.count("*").alias("n"))
    joined = asks.join(covered.select("name", "kind", F.lit(True).alias("_covered")), ["name", "kind"], "left").join(counted, ["name", "kind"], "left")
    state = F.when(~F.col("asked"), "never-asked").when(F.col("_covered").isNull(), "unanswered").when(F.col("n").isNull(), "none-found").otherwise("provided")
    return joined.select(*asks.columns, state.alias("state"), F.when(F.col("asked") & F.col("_covered").isNotNull(), F.coalesce("n", F.lit(0))).alias("n_dependents"))
