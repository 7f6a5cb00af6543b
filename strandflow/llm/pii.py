"""Personal data by DataFrame functions alone: patterns propose, checksums confirm, context words adjust the score.

Base kinds, kept whatever their score: email, ip (parts up to 255), card (16 to 19 digits, Luhn), phone (+, 8 to 15 digits). Further kinds,
reported from a score of THRESHOLD on: iban (mod 97), short_card (13 to 15 digits, Luhn, with a context word),
local_phone (ten digits in groups, with a context word). A score is the kind's own, plus CONTEXT_BONUS if
one of the kind's words stands in the CONTEXT characters before the span.

A kind's matches and the gaps between them come from regexp_extract_all and split with one pattern; a fold over both gives
positions in code points and carries the last CONTEXT characters, matches included, without a copy of anything else but confirmed spans. Patterns are possessive and
start only where a run of their characters starts, so they take linear time on runs of any length.

Null text is empty and has no spans; texts of any length are read whole. Rows are judged one by one, so repeated rows and ids don't matter. Spans of several kinds may
overlap and are all reported, by kind and start. The whole row travels as _row, so its columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, CONTEXT, CONTEXT_BONUS = 0.5, 40, 0.2
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "local_phone")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    # (?<!..)|\G: at the start of a run, or where the match before ended inside one.
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of fewer digits than 16 fail as a whole, so they need not be matched first.
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "short_card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to match at all, as a plain substring.
NEEDS = {"email": "@", "phone": "+"}
OWN_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "short_card": 0.35, "local_phone": 0.35}
CONTEXT_WORDS = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|addr|client",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax|sms",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "short_card": "card|visa|master|amex|credit|debit|payment",
    "local_phone": "phone|tel|call|mobile|cell|fax|sms",
}
SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _last(text: Column) -> Column:
    """The last CONTEXT characters."""
    return F.substring(text, -CONTEXT, CONTEXT)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def _mod97(iban: Column) -> Column:
    bare = F.regexp_replace(iban, "\\x20", "")
    turned = F.concat(F.substring(bare, 5, 60), F.substring(bare, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda r, c: F.when(c == "", r).when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(bare).between(15, 34) & (rest == 1)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return F.when(F.length(_digits(m)).between(low, high), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, text, score>> of one kind, by start."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("m"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        before = _last(F.concat(acc["before"], _last(x["gap"])))
        near = F.lower(before).rlike(rf"(?<![a-z])(?:{CONTEXT_WORDS[kind]})")
        score = F.lit(OWN_SCORE[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("text"), score.alias("score"))
        keep = _confirmed(kind, x["m"])
        if kind not in BASE_KINDS:
            keep = keep & (score >= THRESHOLD)
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), _last(F.concat(before, _last(x["m"]))).alias("before"), F.when(x["m"].isNotNull() & keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), none.alias("out")), step, lambda acc: acc["out"])
    possible = F.size(matches) > 0
    if kind in NEEDS:
        possible = (F.instr(text, NEEDS[kind]) > 0) & possible
    return F.when(possible, found).otherwise(none)


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """_row (the whole row) and spans (kind, start, end, text, score; by kind as listed in KINDS, then start)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, F.concat(*[spans_of(text, kind) for kind in KINDS]).alias("spans"))
