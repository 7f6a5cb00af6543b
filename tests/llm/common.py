"""Small documents with every awkward case, and brute-force versions."""

import random
import re
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rid string, hits string"


def words(rng, n):
    return [rng.choice(string.ascii_lowercase) + "".join(rng.choice("aeiounrst") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed=1):
    """(doc_id, text) with nulls, empties, blanks, copies, near copies, repeats of an id and a very long text."""
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "a null id with some words in it here")]
    base = words(rng, 200)
    rows += [(10, " ".join(base)), (11, " ".join(base)), (12, " ".join(base).upper())]
    for i in range(12):
        near = list(base)
        for j in rng.sample(range(200), i):
            near[j] = "changed"
        rows.append((20 + i, " ".join(near)))
    rows += [(40 + i, " ".join(words(rng, rng.randint(1, 120)))) for i in range(20)]
    rows += [(70, " ".join(words(rng, 30_000))), (71, "word " * 20_000), (40, "the id forty again with other words"), (10, " ".join(base))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows], DOCS)


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
