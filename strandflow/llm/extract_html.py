"""Main text of web pages by nearest-URL page differencing, with the page's own markup as a guard.

Every page becomes lines (block elements, white space folded, character references decoded). Pages of one host are
put in the order of their URL paths; each is paired with its neighbours on either side, which share the longest path
prefix with it. The lines of a pair are aligned by a longest common subsequence, and shared lines are deleted.

Differencing alone would delete an article that two pages of a host share, and can't see a menu or advert that no
neighbour repeats. So elements that the markup names a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment go
whether shared or not, and where a page has an article (else main) element, only lines inside it count. Inside it, prose (paragraphs, headings,
quotes, cells, loose text) is never deleted as shared. Other lines there are differenced: what is all link goes if one neighbour shares it, text in bare
containers and lists if both do. On pages without such an element differencing decides about every line.

A class, id or role names an element only by a whole word of it, beside words of layout at most: `comments`, `ad-slot` and `site-footer`
do, `social-history` and `comments-free-note` don't.

Differencing takes no account of lines that the markup has named. A neighbour is a copy, which deletes nothing, if it or the page has no line
of its own beside the shared ones. Pages that share most lines but have some of their own may be nearly copies, or have much in common
around short texts: the other neighbour decides. What all three share goes; if the other neighbour shares
only a lesser part, only that goes; without another neighbour, what the two share goes.

Null and empty html give an empty text. Pages without a host are paired among themselves. Rows that repeat an id
are pages of their own; rows equal in id, URL and html are one page for the pairing. Nothing is cut from long pages. Further columns, whatever
their names, are left out; an empty table gives no rows. Ties in the order of paths go by id, then by a hash of the page.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is text of no markup, or none at all.
RAW = frozenset("script style textarea title noscript template iframe svg".split())
AWAY = frozenset("head nav footer aside form menu dialog button select script style textarea title noscript template iframe svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words that name boilerplate in a class, id or role, and words of layout that may stand beside them.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer header masthead menu nav navbar "
    "navigation newsletter notice pager pagination popup promo promoted related search share sharing sidebar social sponsored subscribe toolbar widget widgets".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box button buttons center col column container content entry first form global group holder icons inner item items last left link links list main mobile "
    "module outer page panel posts primary reply replies respond right row secondary section site slot sticky text thread title top unit wrap wrapper".split()
)
#: Elements whose own text, inside an article, differencing may delete.
LOOSE = frozenset("aside center details dir div dl fieldset legend li ol optgroup option section select summary ul".split())
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Of two pages that share this part of the shorter one's lines, a third one says what is common to all pages.
CLOSE_SHARE = 0.8


#: What may stand in a tag before its '>': a quoted value begins after '='; a quote elsewhere is an ordinary character.
IN_TAG = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?+)*+""")


def _tag_end(page: str, at: int) -> int:
    """The end of the tag whose name ends at `at`; '>' inside a quoted value doesn't end it. A value that is never closed isn't quoted."""
    return IN_TAG.match(page, at).end()


def _names_boilerplate(value: str) -> bool:
    """Whether a class, id or role holds a word of NAMED with nothing but such words, words of LAYOUT and numbers beside it."""
    for token in value.strip("\"'").split():
        words = [w for w in re.split(r"[^a-z]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if w]
        if any(w in NAMED for w in words) and all(w in NAMED or w in LAYOUT for w in words):
            return True
    return False


#: How differencing may delete a line inside an article: not at all, if both neighbours share it, if one does.
PROSE, PLAIN, LINK = 0, 1, 2


def page_lines(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside article or main, boilerplate by its markup) of every block in page order."""
    return [x[:3] for x in block_lines(page)]


def block_lines(page: str | None) -> list[tuple[str, bool, bool, int]]:
    """page_lines() and, for each, PROSE, PLAIN or LINK."""
    if not page:
        return []
    never_closed: set[str] = set()
    while True:
        lines, open_away = _lines(page, never_closed)
        if open_away is None or open_away in never_closed:
            return lines
        never_closed.add(open_away)


def _lines(page: str, never_closed: set[str]) -> tuple[list, str | None]:
    low = page.lower()
    last_close: dict[str, int] = {}
    lines: list[tuple[str, bool, bool, int]] = []
    buffer: list[str] = []
    block, in_link, unlinked = "", 0, False
    depth = {"article": 0, "main": 0}
    away, away_depth, until_block = None, 0, False
    has_article = "<article" in low

    def flush():
        nonlocal buffer, unlinked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer = []
            if text:
                inside = depth["article"] > 0 if has_article else depth["main"] > 0
                how = PROSE if block not in LOOSE else PLAIN if unlinked else LINK
                lines.append((text, inside, away is not None or until_block, how))
        unlinked = False

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buffer.append(page[at:])
            unlinked = True
            break
        if lt > at:
            buffer.append(page[at:lt])
            unlinked = unlinked or not in_link and not page[at:lt].isspace()
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            at = _tag_end(page, lt) + 1
            continue
        closing = nxt == "/"
        name_at = lt + 1 + closing
        stop = name_at
        while stop < n and (low[stop].isalnum() or low[stop] in "-:"):
            stop += 1
        name = low[name_at:stop]
        if not name or not name[0].isalpha():
            buffer.append("<")  # not a tag
            at = lt + 1
            continue
        end = _tag_end(page, stop)
        at = end + 1
        if name in BLOCKS:
            flush()
            until_block = False
            block, in_link = "" if closing else name, 0
        if name in ("a", "button"):
            in_link = not closing
        if closing:
            if name == away:
                away_depth -= 1
                if away_depth == 0:
                    flush()
                    away = None
            elif name in depth and away is None:
                depth[name] = max(0, depth[name] - 1)
            continue
        if name in VOID:
            if name == "br":
                buffer.append(" ")
            continue
        if page[end - 1 : end] == "/":
            continue
        if name in RAW:
            close = low.find("</" + name, end)
            if name in ("title", "textarea", "noscript"):
                flush()
            at = n if close < 0 else _tag_end(page, close) + 1
            continue
        if away is not None:
            if name == away:
                away_depth += 1
            continue
        boilerplate = name in AWAY or name == "header" and not depth["article"] and not depth["main"]
        if not boilerplate and name not in ("html", "body", "article", "main") and "=" in page[stop:end]:
            boilerplate = any(_names_boilerplate(m[1]) for m in ATTRIBUTE.finditer(page, stop, end))
        if boilerplate:
            if name not in last_close:
                last_close[name] = low.rfind("</" + name)
            flush()
            if name in never_closed or last_close[name] < end:
                until_block = True
            else:
                away, away_depth = name, 1
        elif name in depth:
            depth[name] += 1
    flush()
    return lines, away


def _common_lengths(own: list, other: list) -> list[int]:
    """Lengths of the longest common subsequences of own with other[:0], other[:1], ...; one bit of a long number for each line of other."""
    places: dict = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for x in own:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    out = [0]
    for bit in reversed(f"{row:0{len(other)}b}" if other else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions in own of a longest common subsequence with other, lines that repeat included; halved until one line is left, so memory stays linear."""
    both = set(own) & set(other)
    found: set[int] = set()
    todo = [([(i, x) for i, x in enumerate(own) if x in both], [x for x in other if x in both])]
    while todo:
        a, b = todo.pop()
        while a and b and a[0][1] == b[0]:
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x[1] != y), min(len(a), len(b)))
            found.update(i for i, _ in a[:n])
            a, b = a[n:], b[n:]
        if not a or not b:
            continue
        if len(a) == 1:
            if a[0][1] in b:
                found.add(a[0][0])
            continue
        half = len(a) // 2
        before = _common_lengths([x for _, x in a[:half]], b)
        after = _common_lengths([x for _, x in reversed(a[half:])], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: before[j] + after[len(b) - j])
        todo += [(a[:half], b[:cut]), (a[half:], b[cut:])]
    return found


def deleted_lines(hashes: list[int], neighbours: list[list[int]], how: list[int] | None = None) -> list[int]:
    """Positions of the lines that a page shares with its neighbours and that are not its own text; how: for pages with an article, what may go of each line."""
    far: set[int] = set()
    close: list[set[int]] = []
    twice: set[int] = set()
    has_far = False
    for other in neighbours:
        shared = shared_lines(hashes, other)
        shorter = min(len(hashes), len(other))
        if len(shared) == shorter:
            continue  # a copy, or a page without lines
        if len(shared) < CLOSE_SHARE * shorter:
            has_far = True
            twice |= far & shared
            far |= shared
        else:
            close.append(shared)
    if how is not None:
        return sorted(i for i in far if how[i] == LINK or how[i] == PLAIN and i in twice)
    if close and not has_far:
        return sorted(set.intersection(*close))
    return sorted(far)


def has_main(lines: list[tuple[str, bool, bool, int]]) -> bool:
    return any(main for _, main, away, _ in lines if not away)


def _ways(lines: list[tuple[str, bool, bool, int]]) -> list[int] | None:
    """For a page with an article: what may go of each line that the markup hasn't named; None for other pages."""
    return [how if main else PROSE for _, main, away, how in lines if not away] if has_main(lines) else None


def main_text(lines: list[tuple[str, bool, bool, int]], gone: list[int]) -> str:
    """The page's text: inside its article or main element if it has one, without the deleted lines (positions among those not named by the markup)."""
    inside, gone = has_main(lines), set(gone)
    kept = ((text, main) for text, main, away, _ in lines if not away)
    return "\n".join(text for i, (text, main) in enumerate(kept) if (main or not inside) and i not in gone)


def _hash_batches(batches):
    """Adds the hashes of the lines that the markup hasn't named, what may go of each (null: all), and whether differencing has anything to decide."""
    import xxhash

    for batch in batches:
        parsed = [block_lines(p) for p in batch.column("_html").to_pylist()]
        hashes = pa.array([[xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1 for t, _, away, _ in own if not away] for own in parsed], pa.list_(pa.int64()))
        ways = [_ways(own) for own in parsed]
        kept = [c for c in batch.schema.names if c != "_html"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), hashes, pa.array(ways, pa.list_(pa.int32())), pa.array([own is None or any(own) for own in ways], pa.bool_())], names=[*kept, "hashes", "ways", "open"]
        )


def _number_batches(batches):
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "local"])
        at += batch.num_rows


def _delete_batches(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("hashes", "before", "after", "ways")))
        gone = [deleted_lines(own, [x for x in (before, after) if x is not None], ways) for own, before, after, ways in rows]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(gone, pa.list_(pa.int32()))], names=["k1", "k2", "gone"])


def _text_batches(batches):
    for batch in batches:
        texts = [main_text(block_lines(page), gone or []) for page, gone in zip(batch.column("_html").to_pylist(), batch.column("gone").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], names=["_id", "_url", "text"])


def _deletions(pages: DataFrame) -> DataFrame:
    """(k1, k2, gone): the lines that go because the pages before and after in their host's path order share them.

    Only hashes of lines travel. Rows are dealt by ranges of (host, path, id), so a hot host is split over tasks; running numbers inside
    the ranges and the ranges' totals (one row each) give every page its global number, and neighbours join by number.
    """
    spark = pages.sparkSession
    order = ("host", "path", "_id", "k1", "k2")
    parsed = materialize(pages.mapInArrow(_hash_batches, "k1 long, k2 long, _id long, _url string, host string, path string, hashes array<long>, ways array<int>, open boolean").drop("_url").dropDuplicates(["k1", "k2"]), "hashes")
    numbered = materialize(
        parsed.select("k1", "k2", "_id", "host", "path", "open").repartitionByRange(*order).sortWithinPartitions(*order)
        .select("k1", "k2", "host", "open", F.spark_partition_id().alias("part")).mapInArrow(_number_batches, "k1 long, k2 long, host string, open boolean, part int, local long"),
        "order",
    )
    bases, at = [], 0
    for part, n in sorted(numbered.groupBy("part").count().collect()):
        bases.append((part, at))
        at += n
    placed = numbered.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select("k1", "k2", "host", "open", (F.col("base") + F.col("local")).alias("i"))
    asking = placed.where("open")
    wanted = asking.select("i").unionAll(asking.select(F.col("i") - 1)).unionAll(asking.select(F.col("i") + 1)).distinct()
    hashes = placed.join(wanted, "i", "left_semi").join(parsed.select("k1", "k2", "hashes", "ways"), ["k1", "k2"]).select("i", "host", "hashes", "ways")
    own = asking.select("i", "k1", "k2", F.col("host").alias("own_host")).join(hashes.drop("host"), "i")
    for name, step in (("before", 1), ("after", -1)):
        side = hashes.drop("ways").select((F.col("i") + step).alias("i"), F.col("host").alias("side_host"), F.col("hashes").alias(name))
        own = own.join(side, "i", "left").withColumn(name, F.when(F.col("side_host") == F.col("own_host"), F.col(name))).drop("side_host")
    found = own.select("k1", "k2", "hashes", "before", "after", "ways").mapInArrow(_delete_batches, "k1 long, k2 long, gone array<int>").where(F.size("gone") > 0)
    return materialize(found, "gone")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (lines joined by a line feed)."""
    url = F.col(url_col).cast("string")
    bare = F.regexp_replace(url, "[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1))
    path = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    html = F.col(html_col).cast("string")
    page = [F.col(id_col).cast("long"), url, html]
    # Rows equal in id, URL and html are one page for the pairing; this key, unlike a row number, is the same in every scan.
    rows = pages.select(
        F.xxhash64(*page).alias("k1"), F.xxhash64(F.lit(1), *page, F.lit(2)).alias("k2"), page[0].alias("_id"), url.alias("_url"),
        F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), html.alias("_html"),
    )
    # The deletions are a written table: where it is small, the planner sends it to the pages, and pages don't move at all.
    joined = rows.select("k1", "k2", "_id", "_url", "_html").join(_deletions(rows), ["k1", "k2"], "left")
    return joined.drop("k1", "k2").mapInArrow(_text_batches, "_id long, _url string, text string").withColumnsRenamed({"_id": "page_id", "_url": "url"})


ship(__name__)
