import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm.extract_html import extract_pages, page_lines, shared_lines
from strandflow.llm.vector_search import search


def brute(rows, k, queries):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, (i, v) in enumerate(good):
        if queries(i):
            others = sorted((-(w * v).sum(), j) for r, (j, w) in enumerate(good) if r != q)[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in others])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, _rid string, part int")


def test_search_equals_brute_force_where_one_part_holds_all(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]  # equal vectors: ties go to the smaller id
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0, None] + [0.0] * 6), (260, [float("nan")] * 8), (280, [float("inf")] + [0.0] * 7), (300, [1.0]), (None, rows[1][1]), (320, [])]
    got = {}
    for r in search(table(spark, rows), F.col("id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {q: x[0] for q, x in brute(rows, 5, lambda i: i % 20 == 0).items()}
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(got[q], want[q]))


def test_few_and_no_rows(spark):
    few = search(table(spark, [(0, [1.0] * 8), (1, [2.0] * 8)]), F.col("id") % 20 == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]
    assert search(table(spark, []), F.col("id") % 20 == 0).count() == 0


def test_recall_of_learned_partitions(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(4000)]
    got = {}
    for r in search(table(spark, rows), F.col("id") % 40 == 0, k=10, sample_rows=1500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(rows, 10, lambda i: i % 40 == 0)
    recall = sum(len(got[q] & {j for j, _ in x[0]}) for q, x in want.items()) / (10 * len(want))
    assert all(len(x) == 10 for x in got.values()) and recall >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x --><div class="ad">Buy {n}</div>
<article><h1>Title &amp; {n}</h1><p>First   <b>bold</b> text&nbsp;here<br>more<p>Second {n}<div class="comments"><p>me too</p></div></article><footer>&copy; site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")


def test_articles_without_their_surroundings(spark):
    rows = [(i, f"http://h.example/{i}?x=1", PAGE.format(n=i)) for i in range(5)] + [(10, None, None), (11, "", ""), (12, "http://h.example/9", "<p>unclosed <b>x"), (0, "http://h.example/0", PAGE.format(n=0))]
    got = [(r["page_id"], r["text"]) for r in extract_pages(pages(spark, rows)).collect()]
    assert len(got) == len(rows)
    text = dict(got)
    assert all(text[i] == f"Title & {i}\nFirst bold text here more\nSecond {i}" for i in range(5))
    assert text[10] == text[11] == "" and text[12] == "unclosed x"
    assert extract_pages(pages(spark, [])).count() == 0


def test_differencing_where_there_is_no_article(spark):
    body = "<div>Top menu</div><p>Own words {n}, a long enough line</p><p>And further {n}</p><p>More about {n}</p><div>All rights</div>"
    rows = [(i, f"https://plain.example/en/{i}.html", body.format(n=i)) for i in range(6)] + [(50, "https://alone.example/x", body.format(n=50))]
    got = {r["page_id"]: r["text"] for r in extract_pages(pages(spark, rows)).collect()}
    assert all(got[i] == f"Own words {i}, a long enough line\nAnd further {i}\nMore about {i}" for i in range(6))
    assert got[50].startswith("Top menu\n")


def test_copies_keep_their_text(spark):
    rows = [(i, f"https://c.example/{i}", "<p>same words</p><p>again the same</p>") for i in range(3)]
    assert {r["text"] for r in extract_pages(pages(spark, rows)).collect()} == {"same words\nagain the same"}


def test_common_subsequence_against_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.permutation(12)[:8].tolist(), rng.permutation(12)[:9].tolist()
        best = np.zeros((9, 10), dtype=int)
        for i in range(8):
            for j in range(9):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        got = sorted(shared_lines(a, b))
        assert len(got) == best[8, 9] and [b.index(a[i]) for i in got] == sorted(b.index(a[i]) for i in got)


def test_odd_markup_takes_linear_time():
    for page in ("<nav>" * 20_000 + "x</nav>", "<" * 100_000, "<!--" * 30_000, "<div class='" * 5_000, "<script>" * 10_000, "<p>" * 50_000):
        page_lines(page)
    assert page_lines("<header>h</header><p>a &lt; b &#233;</p><form>f</form>") == [("h", False, True), ("a < b é", False, False), ("f", False, True)]


def test_quotes_and_brackets_in_attributes():
    texts = lambda page: [t for t, _, away in page_lines(page) if not away]
    assert texts("""<p><a href="/x" title="Anna's house">first link</a> and the text that follows, which doesn't end.</p><p>More</p>""") == ["first link and the text that follows, which doesn't end.", "More"]
    assert texts('<p data-x="' + "<b>1</b>" * 20 + '">own text</p>') == ["own text"]
    assert texts("<p title='say \"hi\" > 3' hidden>a</p><p title = \"it's >\">b</p><p x=a'b>c</p><a href=/q?x=\"y>d</a>") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><p title=\"never closed>b</p><p>c</p>") == ["a", "b", "c"]
    for page in ("<a b='" * 50_000, "<a b=" * 50_000, "<a b=\"'>" * 50_000, "=" * 100_000 + "<a " + "=" * 100_000):
        page_lines(page)


def test_much_in_common_around_few_lines(spark):
    menu, footer = "".join(f"<div>Menu {k}</div>" for k in range(6)), "".join(f"<div>Footer {k}</div>" for k in range(4))
    rows = [(i, f"https://rich.example/{i}", f"{menu}<p>Own words {i}</p><p>Further words {i}</p>{footer}") for i in range(6)]
    # What the markup names doesn't count: ten lines in nav, one unnamed line in common, one of its own.
    nav = "<nav>" + "".join(f"<div>Link {k}</div>" for k in range(10)) + "</nav>"
    rows += [(10 + i, f"https://nav.example/{i}", f"{nav}<div>In common</div><p>Own words {i}</p><p>Further words {i}</p>") for i in range(3)]
    # Nearly copies next to another page keep what they share with each other only.
    body = "".join(f"<p>Text {k}</p>" for k in range(8))
    rows += [(20, "https://near.example/a", f"<div>Top</div>{body}<p>on Monday</p>"), (21, "https://near.example/b", f"<div>Top</div>{body}<p>on Tuesday</p>"), (22, "https://near.example/c", "<div>Top</div><p>Else</p>")]
    got = {r["page_id"]: r["text"] for r in extract_pages(pages(spark, rows)).collect()}
    assert all(got[i] == f"Own words {i % 10}\nFurther words {i % 10}" for i in (*range(6), 10, 11, 12))
    assert got[21] == "\n".join([*(f"Text {k}" for k in range(8)), "on Tuesday"])
