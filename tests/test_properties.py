import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.frontend.lines import Flags, read_lines, split_tokens
from strandflow.frontend.parse import parse_program
from strandflow.functions import text as T
from strandflow.operators import layout, lexing
from strandflow.plans.lineage import MAX_DEPTH, MAX_PATHS, Walker


def test_set_form_of_the_tokeniser_equals_the_program_form(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("AB1x'' ,=()+*/<>-.:&%") for _ in range(rng.randint(1, 40)))) for i in range(3000)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", T.tokens(F.col("t")).alias("k")).collect()
    assert all(r["k"] == split_tokens(rows[r["i"]][1]) for r in got)


def test_set_form_of_the_lexer_equals_the_program_form(spark):
    rng = random.Random(2)
    pieces = ["A = B", "* note", "MOVE A -", "TO B +", "", "   ", "X 1 4 N".ljust(72) + "00010000", "Y = 2".ljust(72) + "lost words here", "DISPLAY 'a-"]
    rows = [(i, "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    lines = lexing.physical_lines(spark.createDataFrame(rows, "i int, t string"), "i", "t")
    joined = {}
    for r in lexing.joined_continuations(lexing.code_lines(lines), "i").orderBy("i", "line").collect():
        joined.setdefault(r["i"], []).append((r["line"], r["text"]))
    lost = {(r["i"], r["line"]) for r in lexing.lost_tails(lines).collect()}
    for i, text in rows:
        flags = Flags()
        want = [(x.line, x.text) for x in read_lines(text, 72, flags)]
        tails = {(i, line) for code, line, _ in flags.rows if code == "margin"}
        assert tails == {x for x in lost if x[0] == i}
        # A blank line after a continuation sign is part of the statement in the program form; the set form drops blanks first.
        code = [x for x in text.split("\n") if not x.startswith("*")]
        if not any(a.endswith(("-", "+")) and not b.strip() for a, b in zip(code, code[1:])) and "'" not in text:
            assert joined.get(i, []) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.lists(st.integers(0, 7), max_size=3)), max_size=25))
def test_walks_keep_their_bounds(edges):
    rows = [{"target": str(t), "sources": [str(s) for s in ss], "constants": [], "conditions": []} for t, ss in edges]
    walker = Walker(rows, set(), {str(i): None for i in range(8)})
    for start in {e["target"] for e in rows}:
        found, cut = walker.routes(start)
        widest = max(sum(len(e["sources"]) or 1 for e in own) for own in walker.incoming.values())
        assert len(found) <= MAX_PATHS + widest and (len(found) >= MAX_PATHS or not cut)
        for p in found:
            nodes = [e["target"] for e in p["hops"]]
            assert len(nodes) <= MAX_DEPTH and len(set(nodes)) == len(nodes)
            assert p["cyclic"] == (p["origin"] in nodes)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="AB1'*%&+-.=( )\nFILEJOBINPUTEND ", max_size=200))
def test_no_text_breaks_the_parser(text):
    kinds = [k for k, _, _ in parse_program(text, {}, 72)]
    assert kinds[0] == "program"


def test_overlap_is_symmetric_and_partitioning_changes_nothing(spark):
    rng = random.Random(3)
    rows = [(r, i, f"F{i}", s := rng.randint(1, 60), s + rng.randint(0, 9)) for r in range(20) for i in range(15)]
    fields = spark.createDataFrame(rows, "rec int, ord int, name string, start int, stop int")
    got = {(r["rec"], r["ord"]): r["others"] for r in layout.overlaps(fields, ["rec"], "ord", "name").collect()}
    assert all(f"F{i}" in got[rec, int(o[1:])] for (rec, i), others in got.items() for o in others)
    again = {(r["rec"], r["ord"]): r["others"] for r in layout.overlaps(fields.repartition(7, "name"), ["rec"], "ord", "name").collect()}
    assert got == again
