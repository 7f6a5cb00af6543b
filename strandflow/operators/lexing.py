"""Lines, tokens, continuations and language detection over a whole corpus of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# First words by which a program's language is told, in the order they are tried.
LANGUAGE_SIGNALS = (
    r"(?i)^JOB\b.*\bINPUT\b", r"(?i)^SORT\b.+\bTO\b.+\bUSING\b", r"(?i)^REPORT\s+[A-Z@#$][A-Z0-9@#$_-]*", r"(?i)^FILE\s+[A-Z@#$][A-Z0-9@#$_-]*",
    r"(?i)^DEFINE\s+[A-Z@#$][A-Z0-9@#$_-]*\s+[WS0-9*]", r"(?i)^END-(IF|DO|PROC|CASE)\b", r"(?i)^[A-Z@#$][A-Z0-9@#$_-]*\.\s+PROC\b", r"(?i)^PRINT\s+[A-Z@#$][A-Z0-9@#$_-]*\s*$",
    r"(?i)^%[A-Z@#$][A-Z0-9@#$_-]*", r"(?i)^(SEQUENCE|CONTROL|LINE|TITLE|HEADING)\s+",
)
JOB_CONTROL = r"(?i)^//\S*\s+(JOB|PROC|EXEC|DD)\b"
OTHER_LANGUAGE = r"(?i)\b(IDENTIFICATION\s+DIVISION|PROGRAM-ID)\b"
SUFFIXES = ("ezt", "ezy", "eas", "ezp", "mac", "ezm")


def physical_lines(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line from 1, raw) for every physical line; a last empty line isn't one."""
    whole = texts.select(key, F.split(F.col(text_col), T.LINE_BREAK).alias("p"))
    kept = F.when(F.element_at("p", -1) == "", F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p"))
    return whole.select(key, F.posexplode(kept).alias("at", "raw")).select(key, (F.col("at") + 1).alias("line"), "raw")


def code_lines(lines: DataFrame, margin: int = T.RIGHT_MARGIN) -> DataFrame:
    """Lines that hold code, cut at the margin: no comments, no blanks."""
    return lines.where(~T.is_comment(F.col("raw"))).withColumn("code", T.inside_margin(F.col("raw"), margin)).where(F.trim("code") != "")


def lost_tails(lines: DataFrame, margin: int = T.RIGHT_MARGIN) -> DataFrame:
    """Lines whose text past the margin is ignored and isn't a sequence number: key, line, tail (30 characters)."""
    tail = T.past_margin(F.col("raw"), margin)
    return lines.where(~T.is_comment(F.col("raw")) & (tail != "") & ~T.is_sequence_area(tail)).withColumn("tail", F.substring(tail, 1, 30)).drop("raw")


def line_tokens(lines: DataFrame, text_col: str = "code") -> DataFrame:
    """One row per token: key columns, pos (from 0), token."""
    keep = [c for c in lines.columns if c not in (text_col, "raw")]
    return lines.select(*keep, F.posexplode(T.tokens(F.col(text_col))).alias("pos", "token"))


def joined_continuations(lines: DataFrame, key: str) -> DataFrame:
    """(key, line, text): islands of lines whose last sign, - (no blank) or + (one blank), asks for the next one.

    A sign inside an open literal, or alone on its line, joins nothing.
    """
    w = Window.partitionBy(key).orderBy("line")
    goes_on = F.col("code").rlike("[-+]$") & ~T.has_open_literal(F.col("code")) & (F.length(F.trim("code")) > 1)
    marked = lines.withColumn("_on", goes_on).withColumn("_starts", F.when(F.lag("_on", 1, False).over(w), 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_starts").over(w))
    body = F.trim("code")
    piece = F.when(F.col("_on"), F.concat(F.rtrim(F.expr("left(trim(code), length(trim(code)) - 1)")), F.when(F.col("code").endswith("+"), " ").otherwise(""))).otherwise(body)
    return (
        islands.withColumn("_piece", piece).groupBy(key, "_island")
        .agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_piece"))), lambda s: s["_piece"]), "").alias("text"))
        .select(key, "line", F.trim("text").alias("text"))
    )


def detected_languages(lines: DataFrame, key: str) -> DataFrame:
    """(key, is_program, why): two signal lines make a program, unless a job-control or other language's line comes before the second."""
    body = F.trim("raw")
    kind = F.when(body.rlike(JOB_CONTROL), "job control").when(body.rlike(OTHER_LANGUAGE), "other language")
    for signal in LANGUAGE_SIGNALS:
        kind = kind.when(body.rlike(signal), "signal")
    marked = lines.where(~T.is_comment(F.col("raw")) & (body != "")).withColumn("kind", kind)
    hits = marked.where("kind is not null")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = hits.withColumn("n", F.sum((F.col("kind") == "signal").cast("int")).over(w))
    first = counted.groupBy(key).agg(
        F.min(F.when(F.col("n") >= 2, F.col("line"))).alias("second"), F.min_by(F.when(F.col("kind") != "signal", F.col("kind")), F.when(F.col("kind") != "signal", F.col("line"))).alias("other"),
        F.min(F.when(F.col("kind") != "signal", F.col("line"))).alias("other_line"),
    )
    keys = lines.select(key).distinct()
    is_program = F.col("second").isNotNull() & (F.col("other_line").isNull() | (F.col("other_line") > F.col("second")))
    why = F.when(is_program, "statements").when(F.col("other").isNotNull() & (F.col("second").isNull() | (F.col("other_line") < F.col("second"))), F.col("other")).otherwise("nothing found")
    return keys.join(first, key, "left").select(key, F.coalesce(is_program, F.lit(False)).alias("is_program"), why.alias("why"))


def without_noise(tokens: DataFrame, noise: DataFrame, col: str = "token") -> DataFrame:
    """Tokens that are no words of the statement's own grammar."""
    return tokens.join(F.broadcast(noise), tokens[col] == noise["word"], "left_anti")  # a fixed list of words
