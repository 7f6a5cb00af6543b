"""Scalar functions on source lines and tokens, all as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language's lexical rules.
RIGHT_MARGIN = 72
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
TOKEN = r"[XPBCZxpbcz]?'[^']*(?:''[^']*)*'?|[<>]=|[=()+*/<>]|[^\s,=()+*/<>']+"
NUMBER = r"^[+-]?[0-9]+(\.[0-9]+)?$"
LITERAL = r"^[XPBCZxpbcz]?'.*'$"
NAME = r"^[A-Za-z@#$][A-Za-z0-9@#$_-]*(:[A-Za-z@#$][A-Za-z0-9@#$_-]*)?$"
SQL_NAME = r"^[A-Za-z@#$_][A-Za-z0-9@#$_]*(\.[A-Za-z@#$_][A-Za-z0-9@#$_]*)*$"
NOISE_WORDS = (
    "TO", "FROM", "WITH", "GIVING", "USING", "BY", "KEY", "EQ", "NE", "GT", "LT", "GE", "LE", "AND", "OR", "NOT", "EOF", "NULL", "THRU", "ALL",
    "ADD", "UPDATE", "DELETE", "NEWPAGE", "SKIP", "SPACE", "COL", "POS", "STATUS", "SEQUENTIAL", "D", "DESC",
)
FORMATS = {"A": "alphanumeric", "N": "zoned decimal", "P": "packed decimal", "U": "unsigned packed", "B": "binary", "K": "double-byte", "M": "mixed"}


def format_meaning(fmt: Column) -> Column:
    """What a field's format letter means; null for none that is known."""
    return F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[fmt]


def field_descriptor(name: Column, owner: Column, storage: Column, start: Column, stop: Column, length: Column, fmt: Column, decimals: Column) -> Column:
    """A field for a reader: its name, its file or else its storage, its bytes and its format."""
    place = F.when(start.isNotNull() & stop.isNotNull(), F.concat_ws("-", start.cast("string"), stop.cast("string")))
    return F.struct(
        name.alias("field"), owner.alias("file"), F.when(owner.isNull(), storage).alias("storage"), place.alias("bytes"), length.alias("length"), fmt.alias("format"), format_meaning(fmt).alias("meaning"),
        decimals.alias("decimals"),
    )


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def inside_margin(line: Column, margin: int = RIGHT_MARGIN) -> Column:
    """The part of a physical line that counts."""
    return right_trim(line if margin <= 0 else F.substring(line, 1, margin))


def past_margin(line: Column, margin: int = RIGHT_MARGIN) -> Column:
    return F.lit("") if margin <= 0 else F.trim(F.substring(line, margin + 1, 1_000_000_000))


def is_sequence_area(tail: Column) -> Column:
    """A short alphanumeric run: line numbers, not text that somebody loses."""
    return tail.rlike("^[A-Za-z0-9]{1,8}$")


def is_comment(line: Column) -> Column:
    return line.startswith("*")


def has_open_literal(text: Column) -> Column:
    return F.regexp_count(text, F.lit("'")) % 2 == 1


def tokens(line: Column) -> Column:
    """Tokens of one line; a literal that the line leaves open is closed."""
    raw = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    return F.transform(raw, lambda t: F.when(has_open_literal(t), F.concat(t, F.lit("'"))).otherwise(t))


def is_literal(token: Column) -> Column:
    return token.rlike(LITERAL)


def literal_value(token: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(token, r"^[XPBCZxpbcz]?'(.*)'$", 1), "''", "'")
    return F.when(is_literal(token), body).otherwise(token)


def is_number(token: Column) -> Column:
    return token.rlike(NUMBER)


def is_constant(token: Column) -> Column:
    return is_literal(token) | is_number(token)


def is_name(token: Column) -> Column:
    return token.rlike(NAME)


def token_class(token: Column) -> Column:
    return F.when(is_literal(token), "literal").when(is_number(token), "number").when(is_name(token), "name").otherwise("other")


def owner_part(token: Column) -> Column:
    """The file of FILE:FIELD, else null."""
    return F.when(token.contains(":"), F.upper(F.substring_index(token, ":", 1)))


def name_part(token: Column) -> Column:
    return F.upper(F.when(token.contains(":"), F.regexp_extract(token, "^[^:]*:(.*)$", 1)).otherwise(token))


def is_field_declaration(toks: Column) -> Column:
    """NAME location length ...: what separates a table's declarations from its rows."""
    where, length = F.get(toks, F.lit(1)), F.get(toks, F.lit(2))
    shaped = is_name(F.get(toks, F.lit(0))) & is_number(length) & ((where == "*") | is_number(where) | is_name(where))
    return (F.size(toks) >= 3) & F.coalesce(shaped, F.lit(False))


def program_name(path: Column) -> Column:
    """The member's stem in upper case, at most two suffixes removed."""
    base = F.substring_index(F.translate(path, "\\", "/"), "/", -1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"\.[^.]*$", "")
    return F.when(stem == "", "PROGRAM").otherwise(F.upper(stem))


def ordered_distinct(values: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(values)


def words_after(toks: Column, word: str) -> Column:
    """The tokens after the first occurrence of a keyword; empty if it is absent."""
    at = F.array_position(F.transform(toks, lambda t: F.upper(t)), word)
    return F.when(at > 0, F.slice(toks, (at + 1).cast("int"), F.size(toks))).otherwise(F.array().cast("array<string>"))


def words_between(toks: Column, start: str, stop: str) -> Column:
    rest = words_after(toks, start)
    at = F.array_position(F.transform(rest, lambda t: F.upper(t)), stop)
    return F.when(at > 0, F.slice(rest, F.lit(1), (at - 1).cast("int"))).otherwise(rest)


def sql_tables(words: Column, keywords: tuple[str, ...] = ("FROM", "INTO", "UPDATE", "JOIN")) -> Column:
    """Distinct table names after the keywords, upper case, sorted; host variables (:name) are skipped."""
    pairs = F.arrays_zip(words.alias("k"), F.slice(words, F.lit(2), F.size(words)).alias("t"))
    found = F.filter(pairs, lambda p: F.upper(p["k"]).isin(*keywords) & p["t"].isNotNull() & ~p["t"].startswith(":") & p["t"].rlike(SQL_NAME))
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: F.upper(p["t"]))))
