"""What the modelled programs do to records, as plans over whole tables: the part of the language that has a set form.

CALL, LINK, file exits and DO loops have none and are refused elsewhere (they stay opaque in the lineage).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def field_value(record: Column, start: int, length: int, fmt: str, decimals: int = 0, charset: str = "US-ASCII") -> Column:
    """The field at byte `start` (from 1) of a binary record: A text, N zoned, P packed, U unsigned packed, B binary; null where the bytes are no number."""
    part = F.substring(record, start, length)
    if fmt in ("A", "K", "M"):
        return F.decode(part, charset)
    digits = F.hex(part)
    if fmt == "N":
        # The low half of every byte is a digit; the high half of the last one is the sign.
        number, sign = F.regexp_replace(digits, "([0-9A-F])([0-9A-F])", "$2"), F.substring(digits, -2, 1)
    elif fmt == "P":
        number, sign = F.substring(digits, 1, 2 * length - 1), F.substring(digits, -1, 1)
    elif fmt == "U":
        number, sign = digits, F.lit("F")
    elif fmt == "B":
        whole = F.conv(digits, 16, 10).cast("decimal(20,0)")
        top = F.lit(1 << (8 * length - 1)).cast("decimal(20,0)")
        return F.when(whole >= top, whole - 2 * top).otherwise(whole) / F.lit(10**decimals)
    else:
        raise ValueError(f"no such format: {fmt}")
    value = F.when(number.rlike("^[0-9]+$"), number.cast("decimal(31,0)")) / F.lit(10**decimals)
    return F.when(sign.isin("D", "B", "7"), -value).otherwise(value)


def read_fixed(spark: SparkSession, path: str, length: int, fields: list[tuple[str, int, int, str, int]], charset: str = "US-ASCII") -> DataFrame:
    """Records of a fixed length without separators; fields: name, start, length, format, decimals."""
    # Spark has no DataFrame source for such files that splits them.
    rows = spark.sparkContext.binaryRecords(path, length).map(lambda record: (bytearray(record),))
    return spark.createDataFrame(rows, "record binary").select(*[field_value(F.col("record"), start, size, fmt, decimals, charset).alias(name) for name, start, size, fmt, decimals in fields])


def instream_table(spark: SparkSession, rows: list[str], fields: list[tuple[str, int, int]]) -> DataFrame:
    """A table whose rows stand in the program; fields: name, start, length."""
    lines = spark.createDataFrame([(r,) for r in rows], "line string")
    return lines.select(*[F.rtrim(F.substring("line", start, size)).alias(name) for name, start, size in fields])


def no_input(spark: SparkSession) -> DataFrame:
    """JOB INPUT NULL: the activity runs once."""
    return spark.range(1).select()


def copied_layout(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """COPY: the same bytes under another file's names."""
    return df.withColumnsRenamed(names)


def sorted_records(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """SORT ... USING: keys with a mark for descending order, nulls first as low values; a range partitioning, so every executor sorts its part."""
    return df.orderBy(*[F.desc_nulls_last(k) if down else F.asc_nulls_first(k) for k, down in keys])


def matched(inputs: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """JOB INPUT (A KEY(k) B KEY(k)): one row per combination of equal keys, in_<file> says which files have it; other columns come as <file>_<column>."""
    sides = [
        df.select(*key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in key], F.lit(True).alias(f"in_{name}")) for name, df in inputs.items()
    ]
    met = reduce(lambda a, b: a.join(b, key, "full"), sides)
    return met.withColumns({f"in_{name}": F.coalesce(f"in_{name}", F.lit(False)) for name in inputs})


def chosen(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """IF/ELSE-IF/ELSE and CASE/WHEN/OTHERWISE as a value: the first test that holds; null if none does and nothing else is said."""
    out = F.lit(None) if otherwise is None else otherwise
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def moved_like(source: DataFrame, target: list[str]) -> DataFrame:
    """MOVE LIKE: the target's columns, from the source's columns of the same name where there are any, else null."""
    return source.select(*[F.col(c) if c in source.columns else F.lit(None).alias(c) for c in target])


def positioned(df: DataFrame, file: DataFrame, on: list[str]) -> DataFrame:
    """POINT and GET, or SEARCH: every row with the file's record of that key, nulls and found = false where there is none."""
    return df.join(file.withColumn("found", F.lit(True)), on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def written(file: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """WRITE ADD, UPDATE and DELETE applied to a keyed file: changes has the file's columns and operation; the last operation of a key counts (by ord)."""
    last = Window.partitionBy(*key).orderBy(F.desc("ord"))
    final = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    kept = file.join(final.select(*key), key, "left_anti")
    return kept.unionByName(final.where("operation <> 'DELETE'").select(*file.columns))


def report(df: DataFrame, control: list[str], sums: list[str], final: bool = True) -> DataFrame:
    """Control breaks with their totals, level 0 being FINAL: control columns, level (how many of them a row is a total of), tally and sums."""
    parts = df.rollup(*control).agg(F.grouping_id().alias("_g"), F.count("*").alias("tally"), *[F.sum(c).alias(c) for c in sums])
    level = F.lit(len(control)) - F.bit_count("_g")
    out = parts.select(*control, level.cast("int").alias("level"), "tally", *sums)
    return out if final else out.where("level > 0")


def accumulated(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """N = N + x over a whole activity, read in its FINISH procedure: one row."""
    return df.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in counters.items()])
