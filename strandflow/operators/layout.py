"""Record layouts: positions, overlaps, aliases, and pairing of records by name or position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def high_water(fields: DataFrame, record: list[str], order: list[str]) -> DataFrame:
    """next_free: the first byte past every field declared before, 1 for a record's first field."""
    before = Window.partitionBy(*record).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return fields.withColumn("next_free", F.coalesce(F.greatest(F.lit(1), F.max(F.col("start") + F.col("length")).over(before)), F.lit(1)))


def overlaps(fields: DataFrame, record: list[str], ident: str, name: str) -> DataFrame:
    """Every field with the sorted distinct names of other fields of its record that share bytes with it (start..stop).

    An interval join with the record as equality key: each record's fields are compared only with one another.
    """
    a = fields.where("start is not null and stop is not null").select(*record, F.col(ident).alias("_a"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    b = fields.where("start is not null and stop is not null").select(*record, F.col(ident).alias("_b"), F.col("start").alias("_s2"), F.col("stop").alias("_e2"), F.col(name).alias("_name"))
    met = a.join(b, record).where("_a <> _b and _s2 <= _e and _s <= _e2")
    return met.groupBy(*record, F.col("_a").alias(ident)).agg(F.array_sort(F.collect_set("_name")).alias("others"))


def overlap_report(fields: DataFrame, record: list[str], ident: str, name: str, redefines: str | None = None, most: int = 8) -> DataFrame:
    """Per record, at most eight sorted names of fields that overlap without a declared redefinition."""
    met = overlaps(fields, record, ident, name).select(*record, ident)
    named = fields.join(met, [*record, ident], "left_semi")
    if redefines:
        explicit = fields.where(F.col(redefines).isNotNull()).select(*record, name).distinct()
        named = named.join(explicit, [*record, name], "left_anti")
    return named.groupBy(*record).agg(F.slice(F.array_sort(F.collect_list(name)), 1, most).alias("names"))


def aliases(fields: DataFrame, record: list[str], name: str, redefines: str) -> DataFrame:
    """Two edges, target and source, for every field that redefines another of its record (the first of that name)."""
    bases = fields.groupBy(*record, F.col(name).alias("_base")).agg(F.min("ord").alias("base_ord"))
    pairs = fields.where(F.col(redefines).isNotNull()).join(bases.withColumnRenamed("_base", redefines), [*record, redefines])
    one = pairs.select(*record, F.col(name).alias("target"), F.col(redefines).alias("source"), "ord", F.lit(0).alias("side"))
    return one.unionByName(pairs.select(*record, F.col(redefines).alias("target"), F.col(name).alias("source"), "ord", F.lit(1).alias("side")))


def pairs_by_name(targets: DataFrame, sources: DataFrame, on: list[str]) -> DataFrame:
    """Target rows with the source row of the same name; columns beside the keys come prefixed by t_ and s_."""
    t = targets.select(*on, *[F.col(c).alias(f"t_{c}") for c in targets.columns if c not in on])
    s = sources.select(*on, *[F.col(c).alias(f"s_{c}") for c in sources.columns if c not in on])
    return t.join(s, on)


def pairs_by_position(targets: DataFrame, sources: DataFrame, record: list[str]) -> DataFrame:
    """For each target (ident, start, length) the first source (by ord) of equal start and length; unknown equals unknown."""
    s = sources.groupBy(*record, F.col("start").alias("_start"), F.col("length").alias("_length")).agg(F.min(F.struct("ord", "source")).alias("first"))
    met = targets.join(s, [*[targets[c].eqNullSafe(s[c]) for c in record], targets["start"].eqNullSafe(s["_start"]), targets["length"].eqNullSafe(s["_length"])])
    return met.select(*[targets[c] for c in record], "target", F.col("first.source").alias("source"))


def positioned_by(fields: DataFrame, keys: DataFrame, record: list[str]) -> DataFrame:
    """Every field of a keyed record depends on the keys that chose the record."""
    return fields.join(keys, record)
