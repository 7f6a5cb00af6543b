"""Repeated passages: paragraph MinHash banding, exact verification, removal by components.

Passages are pasted into the middle of other text, so line breaks alone don't bound them. The units compared are
paragraphs in a narrow sense: lines cut at sentence ends. Sentences of more than LONG words, and runs of sentences under MIN_WORDS words
taken together, are cut after words whose hash is 0 modulo CUT (the same words are cut alike wherever they stand). Units under
MIN_WORDS words are not compared by bands; an exact repeat that they belong to is found by step 5.

1. Documents of the same words as one before them (least doc_id, row) go as a whole. Equal units (words, A-Z in lower case) form one class each, by a 63-bit hash.
2. MinHash bands over five-word shingles, as many as RECALL at similarity 0.75 asks for (single-row bands: 4). Units that collide in a band meet in blocks of
   bounded size; exact Jaccard similarity of at least 0.75 confirms; each block hands on a spanning forest of its links, so a hot band never makes all its pairs.
3. Components over classes. The document of each one's first unit (least doc_id, row) keeps its units, those of other documents are
   removable; what one document alone repeats stays, since it is no duplicate across documents.
4. Neighbouring removable units of a document make a run.
5. Units depend on the sentences around a passage, so exact repeats are also found without them: of every SEED_WINDOW neighbouring
   sequences of SEED words the one of least hash is a seed, so that any SEED + SEED_WINDOW - 1 (51) words that two documents
   share hold a common one. A seed is compared with its first document and with the one before, word by word to both sides.
6. Runs of units and shared stretches that overlap or touch are one run; runs of at least RUN_WORDS words are removed.

One row per removed run. Texts, units and seeds that nothing else shares are never shuffled: bounded key filters pick the others.

Null and empty texts have no units. Rows that repeat a doc_id are documents of their own; ties between them go by row, and a null doc_id comes last. Texts of any
length are compared whole. Further columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropping_shuffles, together, materialize, mix64, only_keys, release, shingle_sets, ship, without_keys, words_of
from .components import connected_components

WIDTH, NUMERATOR, DENOMINATOR = 5, 75, 100
MIN_WORDS, LONG, CUT, RUN_WORDS = 8, 60, 16, 30
SEED, SEED_WINDOW = 16, 36
RECALL = 0.995
BLOCK = 512
#: Documents in a group of those that hold a very frequent seed.
CROWD = 512
#: Bytes of an Arrow batch. Beside every slice stands the other document's whole text, so rows alone don't bound a batch.
BATCH_BYTES = 8 << 20


def bands(recall: float = RECALL, similarity: float = NUMERATOR / DENOMINATOR, rows: int = 1) -> int:
    """The fewest bands of so many rows that find a pair of this similarity with this probability."""
    return ceil(log(1 - recall) / log(1 - similarity**rows))


def _code_points(codes: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])


def text_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, is a unit's last word, hashes) of all words; offsets in code points. A word with . ! or ? at its end, or before a line break, is a unit's last."""
    codes, starts, ends, hashes, _ = words_of([text.encode("utf-8", "replace")])
    end = codes[ends - 1]
    final = (end == 46) | (end == 33) | (end == 63)
    breaks = np.cumsum(codes == 10, dtype=np.int32)
    final[:-1] |= breaks[starts[1:]] > breaks[ends[:-1] - 1]
    final[-1:] = True
    if len(codes) > len(text):
        place = _code_points(codes)
        starts, ends = place[starts], place[ends]
    return starts, ends, final, hashes


def units(text: str) -> tuple[np.ndarray, ...]:
    """(first word, last word, start, end, word hashes, span of all words): the units of at least MIN_WORDS words, offsets in code points, the end exclusive."""
    starts, ends, final, hashes = text_words(text)
    last = np.flatnonzero(final)
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    odd = (size > LONG) | (size < MIN_WORDS)
    if odd.any():
        # Long sentences, and runs of short ones taken together, are cut after words that the hash picks.
        by_content = np.repeat(odd, size)
        joined = np.concatenate([(size[:-1] < MIN_WORDS) & (size[1:] < MIN_WORDS), [False]])
        final[last[joined]] = False
        final |= by_content & (mix64(hashes) % np.uint64(CUT) == 0)
        last = np.flatnonzero(final)
        first = np.concatenate([[0], last[:-1] + 1])
    keep = last - first + 1 >= MIN_WORDS
    first, last = first[keep], last[keep]
    return first, last, starts[first], ends[last], hashes, (int(starts[0]), int(ends[-1]))


def _min_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """(units, n): the least of each of n hash functions over a unit's shingles, made a key of its band."""
    size = len(hashes) - WIDTH + 1
    whole = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            whole *= np.uint64(0x9E3779B97F4A7C15)
            whole += hashes[j : j + size]
        whole = mix64(whole)
        # Every other segment is a unit's shingles; the ones between are looked at and left out.
        bounds = np.stack([first, last - WIDTH + 2], axis=1).ravel()
        bounds = bounds[:-1] if bounds[-1] >= size else bounds
        # An odd factor orders the mixed hashes anew for each band.
        order = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = [mix64(np.minimum.reduceat((whole ^ order[2 * k]) * (order[2 * k + 1] | np.uint64(1)), bounds)[::2] + np.uint64(k)) for k in range(n)]
    return (np.stack(out, axis=1) >> np.uint64(1)).astype(np.int64)


def _text_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """63-bit hashes of the units' word sequences: sums of word hashes that are mixed with their place in the unit."""
    n = last - first + 1
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    place = (at - np.repeat(first, n) + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.add.reduceat(mix64(hashes[at] + place * np.uint64(0x9E3779B97F4A7C15)), np.concatenate([[0], np.cumsum(n)[:-1]]))
    return (mix64(total) >> np.uint64(1)).astype(np.int64)


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, 63-bit hashes) of the seeds: the least of every SEED_WINDOW neighbouring sequences of SEED words, or of all where there are fewer."""
    n = len(hashes) - SEED + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    whole = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SEED):
            whole *= np.uint64(0x9E3779B97F4A7C15)
            whole += hashes[j : j + n]
    whole = mix64(whole)
    # The place in the low bits tells equal values apart and says where a window's least one stands.
    low, mask = whole & np.uint64(0xFFFFFFFFFFF00000) | np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFF), 0xFFFFF
    width, size = 1, min(SEED_WINDOW, n)
    while width < size:
        step = min(width, size - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    window = np.arange(len(low))
    at = np.unique(window + (((low & np.uint64(mask)).astype(np.int64) - window) & mask))
    return at, (whole[at] >> np.uint64(1)).astype(np.int64)


#: One row for each document with words: its span, a 128-bit hash of all words, its units, the texts and bands of those that its task saw first, and its seeds.
_UNIT_FIELDS = (
    "_rid long, _id long, _key long, whole binary, start int, end int, last_word int, unit_start array<int>, unit_end array<int>, unit_first array<int>, unit_last array<int>, unit_hash array<long>, "
    "new_hash array<long>, texts array<string>, bands array<long>, seed_at array<int>, seed_hash array<long>"
)
_LISTS = {
    "unit_start": pa.int32(), "unit_end": pa.int32(), "unit_first": pa.int32(), "unit_last": pa.int32(), "unit_hash": pa.int64(), "new_hash": pa.int64(), "texts": pa.string(), "bands": pa.int64(),
    "seed_at": pa.int32(), "seed_hash": pa.int64(),
}


def _listed(parts: list, kind) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32())
    if kind == pa.string():
        flat = pa.array([x for own in parts for x in own], kind)
    else:
        flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)).cast(kind)
    return pa.ListArray.from_arrays(offsets, flat)


def _unit_batches(batches):
    from xxhash import xxh3_128_digest

    most, seen = bands(), set()
    for batch in batches:
        heads: dict[str, list] = {c: [] for c in ("_rid", "_id", "_key", "whole", "start", "end", "last_word")}
        lists: dict[str, list] = {c: [] for c in _LISTS}
        for rid, doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("_rid", "_id", "_key", "_text"))):
            if not text or text.isspace():
                continue
            first, last, start, end, hashes, span = units(text)
            for col, x in zip(heads.values(), (rid, doc, key, xxh3_128_digest(hashes.tobytes()), *span, len(hashes) - 1)):
                col.append(x)
            whole = _text_hashes(hashes, first, last) if len(first) else np.empty(0, np.int64)
            # A text that this task has banded already needs no more.
            new = []
            for i, h in enumerate(whole.tolist()):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            if len(seen) > 500_000:
                seen.clear()
            own = _min_hashes(hashes, first[new], last[new], most).ravel() if new else np.empty(0, np.int64)
            texts = [text[x:y] for x, y in zip(start[new].tolist(), end[new].tolist())]
            for col, x in zip(lists.values(), (start, end, first, last, whole, whole[new], texts, own, *seeds(hashes))):
                col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([*(pa.array(col, kind) for col, kind in zip(heads.values(), kinds)), *(_listed(lists[c], kind) for c, kind in _LISTS.items())], names=[*heads, *lists])


class _Words:
    """(starts, ends, word hashes) of texts, remembered by key up to a bounded number of words."""

    def __init__(self):
        self.seen, self.size = {}, 0

    def __call__(self, key: int, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if key not in self.seen:
            if self.size > 500_000:
                self.seen.clear()
                self.size = 0
            starts, ends, _, hashes = text_words(text)
            self.seen[key] = (starts, ends, hashes)
            self.size += len(self.seen[key][0])
        return self.seen[key]


_ASK = "_rid long, _id long, other_id long, other_rid long, other_key long, apart int, text_hash long"


def _slice_batches(batches):
    """For each stretch that a document (_text) is asked for: its words and SEED_WINDOW - 1 more on either side, as far as the text goes."""
    kept = [x.split()[0] for x in _ASK.split(", ")]
    for batch in batches:
        out: dict[str, list] = {c: [] for c in (*kept, "first", "offset", "slice")}
        for asks, text in zip(batch.column("asks").to_pylist(), batch.column("_text").to_pylist()):
            starts, ends, _, _ = text_words(text)
            for ask in asks:
                low, high = max(0, ask["low"] - SEED_WINDOW + 1), min(len(starts), ask["high"] + SEED + SEED_WINDOW - 1)
                at = int(starts[low])
                for c in kept:
                    out[c].append(ask[c])
                out["first"].append(low)
                out["offset"].append(at)
                out["slice"].append(text[at : int(ends[high - 1])])
        kinds = [pa.int32() if c in ("apart", "first", "offset") else pa.string() if c == "slice" else pa.int64() for c in out]
        yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(out.values(), kinds)], names=list(out))


def _stretch_batches(batches):
    """The stretches of at least SEED words in which a slice equals the other document, word by word."""
    words = _Words()
    for batch in batches:
        key, apart, first, offset, text, own = (batch.column(c).to_pylist() for c in ("other_key", "apart", "first", "offset", "_text", "slice"))
        # A line that repeats brings the same slice against the same place again and again.
        distinct: dict[tuple, int] = {}
        which = [distinct.setdefault((k, f - x, t), len(distinct)) for k, f, x, t in zip(key, first, apart, own)]
        texts = dict(zip(key, text))
        slices = [t.encode("utf-8", "replace") for _, _, t in distinct]
        asked = list(distinct)
        runs: list[list] = []
        for begin, end in together(slices):
            codes, starts, ends, hashes, counts = words_of(slices[begin:end])
            place = _code_points(codes)
            base = place[np.cumsum([0, *(len(x) + 1 for x in slices[begin : end - 1])])].tolist()
            starts, ends = place[starts], place[ends]
            at = 0
            for (other_key, shift, _), n, zero in zip(asked[begin:end], counts.tolist(), base):
                other = words(other_key, texts[other_key])[2]
                low, high = max(0, -shift), min(n, len(other) - shift)
                equal = np.zeros(n + 2, dtype=bool)
                if low < high:
                    equal[low + 1 : high + 1] = hashes[at + low : at + high] == other[shift + low : shift + high]
                turns = np.flatnonzero(equal[1:] != equal[:-1]).tolist()
                runs.append([(x, y - 1, int(starts[at + x]) - zero, int(ends[at + y - 1]) - zero) for x, y in zip(turns[::2], turns[1::2]) if y - x >= SEED])
                at += n
        whose, cols = [], ([], [], [], [])
        for i, (u, f, o) in enumerate(zip(which, first, offset)):
            for x, y, start, end in runs[u]:
                whose.append(i)
                for col, v in zip(cols, (f + x, f + y, o + start, o + end)):
                    col.append(v)
        kept = ("_rid", "_id", "other_id", "other_rid", "text_hash")
        taken = pa.array(whose, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(taken) for c in kept), *(pa.array(col, pa.int32()) for col in cols)],
            names=[*kept, "first_word", "last_word", "start", "end"],
        )


def _forest(rows: list):
    """Links that join all units of a block that exact Jaccard similarity connects; rows: (side, text_hash, shingles)."""
    side = [r[0] for r in rows]
    if len(rows) < 2 or any(side) and all(side):
        return
    sets = [r[2] for r in rows]
    if len(rows) == 2:
        a, b = (set(s.tolist()) for s in sets)
        if len(a & b) * DENOMINATOR >= NUMERATOR * len(a | b):
            yield tuple(sorted((rows[0][1], rows[1][1])))
        return
    side, sizes = np.array(side), np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    m = np.zeros((len(rows), at.max() + 1), dtype=np.float32)
    m[np.repeat(np.arange(len(rows)), sizes), at] = 1
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    shared = m[left] @ m[right].T
    ok = shared * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (sizes[left][:, None] + sizes[right][None, :])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*(i.tolist() for i in np.nonzero(ok))):
        a, b = find(int(left[x])), find(int(right[y]))
        if a != b:
            root[max(a, b)] = min(a, b)
            yield rows[left[x]][1], rows[right[y]][1]


def _block_batches(batches):
    key, rows, out = None, [], []

    def flush():
        a, b = [p[0] for p in out], [p[1] for p in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        hashes = batch.column("text_hash").to_pylist()
        texts = dict(zip(hashes, batch.column("text").to_pylist()))
        sets = dict(zip(texts, shingle_sets([t.encode("utf-8", "replace") for t in texts.values()], WIDTH)))
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side")), hashes, (sets[h] for h in hashes)):
            if row[:3] != key:
                if rows:
                    out += _forest(rows)
                key, rows = row[:3], []
            rows.append(row[3:])
        yield flush()
    if rows:
        out += _forest(rows)
    yield flush()


def _links(colliding: DataFrame, texts: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between text hashes, from (key, text_hash) of bands with several texts."""
    sizes = colliding.groupBy("key").agg(F.count("*").alias("m"))
    rows = colliding.join(sizes, "key").join(texts, "text_hash")
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int"))
    meets = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "text_hash", "text"
    )
    return meets.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_block_batches, "a long, b long").distinct()


def _first(*more: str):
    """The document that comes first: the least (doc_id, row), null ids last."""
    return F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id"), F.col("_rid"), *more))


_STRETCH = "_rid long, _id long, other_id long, other_rid long, text_hash long, first_word int, last_word int, start int, end int"


def _copies(docs: DataFrame) -> DataFrame:
    """Documents of the same words as one before them, as stretches over their whole length."""
    classes = materialize(docs.groupBy("whole").agg(F.count("*").alias("n"), _first().alias("other")).where("n > 1").drop("n"), "classes")
    same = docs.join(classes, "whole").where(F.col("_rid") != F.col("other._rid"))
    return materialize(same.select(
        "_rid", "_id", F.col("other._id").alias("other_id"), F.col("other._rid").alias("other_rid"), F.xxhash64("whole").alias("text_hash"), F.lit(0).alias("first_word"), "last_word", "start", "end"
    ), "copies")


def _stretches(rows: DataFrame, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Stretches of words that a document shares with the first one that holds a seed of them, and with the one before it in the order of documents.

    marks: the seeds (text_hash, _rid, first_word). Of seeds in very many documents, the ones before are looked for in groups of at most about CROWD.
    """
    held = marks.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("_rid").alias("lo"), F.max("_rid").alias("hi")).where("lo < hi").select("text_hash", F.ceil(F.col("n") / CROWD).cast("int").alias("groups"))
    held = materialize(held, "held")
    found = only_keys(marks, "text_hash", held.select("text_hash")).join(docs.select("_rid", "_id", "_key"), "_rid")
    placed = materialize(found.join(held, "text_hash").withColumn("crowd", F.pmod(F.xxhash64("_rid"), "groups")).drop("groups"), "seeds")
    firsts = materialize(placed.groupBy("text_hash").agg(_first("first_word", "_key").alias("one")), "firsts")
    in_order = Window.partitionBy("text_hash", "crowd").orderBy(F.col("_id").isNull(), "_id", "_rid", "first_word")
    at = F.struct("_id", "_rid", "first_word", "_key")
    found = placed.withColumn("two", F.lag(at).over(in_order)).join(firsts.select("text_hash", F.struct("one._id", "one._rid", "one.first_word", "one._key").alias("one")), "text_hash").where("one._rid <> _rid")
    before = F.when(F.col("two._rid").isin(F.col("_rid"), F.col("one._rid")), None).otherwise(F.col("two"))
    pairs = found.select("text_hash", "_rid", "_id", "_key", "first_word", F.explode(F.array_compact(F.array("one", before))).alias("other"))
    # Seeds of one pair of documents that lie equally far apart belong together.
    together = ["_rid", "_id", "_key", F.col("other._id").alias("other_id"), F.col("other._rid").alias("other_rid"), F.col("other._key").alias("other_key"), (F.col("first_word") - F.col("other.first_word")).alias("apart")]
    asked = pairs.groupBy(*together).agg(F.min("first_word").alias("low"), F.max("first_word").alias("high"), F.min_by("text_hash", "first_word").alias("text_hash"))
    asked = materialize(asked, "asked")
    keys = materialize(asked.select("_key").unionAll(asked.select("other_key")).distinct(), "keys")
    texts = materialize(only_keys(rows.select("_key", "_text"), "_key", keys).dropDuplicates(["_key"]), "texts")
    # A document's asks are as many as its seeds at most, so they fit beside its text.
    asks = F.collect_list(F.struct(*[x.split()[0] for x in _ASK.split(", ")], "low", "high")).alias("asks")
    slices = asked.groupBy("_key").agg(asks).join(texts, "_key").select("asks", "_text").mapInArrow(_slice_batches, f"{_ASK}, first int, offset int, slice string")
    both = slices.join(texts.withColumnRenamed("_key", "other_key"), "other_key")
    out = materialize(both.mapInArrow(_stretch_batches, _STRETCH), "stretches", BATCH_BYTES)
    for table in (held, placed, firsts, asked, keys, texts):
        release(table)
    return out


def _further_batches(batches):
    """The rows whose words those before them in the same document don't cover already."""
    rid, cover = None, []
    for batch in batches:
        keep = []
        for own, first, last in zip(*(batch.column(c).to_pylist() for c in ("_rid", "first_word", "last_word"))):
            if own != rid:
                rid, cover = own, []
            at = bisect_right(cover, (first, last + 1))
            low = at - 1 if at and cover[at - 1][1] >= first else at
            if low < len(cover) and cover[low][0] <= first and cover[low][1] > last:
                keep.append(False)
                continue
            high = low
            while high < len(cover) and cover[high][0] <= last + 1:
                high += 1
            touched = cover[low:high]
            cover[low:high] = [(min([first, *(x for x, _ in touched)]), max([last + 1, *(y for _, y in touched)]))]
            keep.append(True)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _merged(pieces: DataFrame) -> DataFrame:
    """Pieces of a document that overlap or touch, made one."""
    by_doc = Window.partitionBy("_rid").orderBy("first_word", "last_word", "component_id")
    before = F.max("last_word").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    dealt = pieces.withColumn("apart", F.when(F.col("first_word") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("apart").over(by_doc))
    return dealt.groupBy("_rid", "island").agg(
        F.first("_id").alias("_id"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_units").alias("n_units"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept_doc_ids")))).alias("kept_doc_ids"), F.min_by("component_id", F.struct("first_word", "component_id")).alias("component_id"),
    ).drop("island")


def _unit_runs(written: DataFrame, docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Runs of neighbouring units whose component has its first unit in another document."""
    postings = written.select("new_hash", F.posexplode("bands").alias("at", "key")).select("key", F.get("new_hash", F.floor(F.col("at") / bands()).cast("int")).alias("text_hash"))
    crowded = materialize(postings.groupBy("key").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo < hi").select("key"), "crowded")
    colliding = materialize(only_keys(postings, "key", crowded).select("key", "text_hash").distinct(), "colliding")
    banded = materialize(colliding.select("text_hash").distinct(), "banded")
    shown = written.select("texts", F.posexplode("new_hash").alias("at", "text_hash")).select("text_hash", F.get("texts", F.col("at")).alias("text"))
    texts = materialize(only_keys(shown, "text_hash", banded).groupBy("text_hash").agg(F.min("text").alias("text")), "texts")
    links = materialize(_links(colliding, texts), "links", BATCH_BYTES)
    for done in (crowded, colliding, texts, banded):
        release(done)
    components = materialize(connected_components(links), "components")
    # A document of the same words as one before goes as a whole; its units have no part in what follows.
    parts = {"start": "unit_start", "end": "unit_end", "first_word": "unit_first", "last_word": "unit_last"}
    own = without_keys(written.select("_rid", *parts.values(), "unit_hash"), "_rid", copies.select("_rid")).select("_rid", *parts.values(), F.posexplode("unit_hash").alias("unit", "text_hash"))
    own = own.select("_rid", "unit", "text_hash", *[F.get(x, F.col("unit")).alias(c) for c, x in parts.items()])
    repeated = own.groupBy("text_hash").agg(F.count("*").alias("n")).where("n > 1").select("text_hash")
    wanted = materialize(repeated.unionAll(components.select(F.col("node").alias("text_hash"))).distinct(), "wanted")
    some = only_keys(own, "text_hash", wanted).join(docs.select("_rid", "_id"), "_rid")
    held = materialize(some.join(components.withColumnRenamed("node", "text_hash"), "text_hash", "left").withColumn("component_id", F.coalesce("component", "text_hash")).drop("component", "text_hash"), "repeated")
    firsts = materialize(held.groupBy("component_id").agg(_first("unit").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    gone = held.join(firsts, "component_id").where(F.col("_rid") != F.col("first._rid"))
    by_doc = Window.partitionBy("_rid").orderBy("unit")
    return gone.withColumn("island", F.col("unit") - F.row_number().over(by_doc)).groupBy("_rid", "island").agg(
        F.first("_id").alias("_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.count("*").alias("n_units"),
        F.array_sort(F.collect_set("first._id")).alias("kept_doc_ids"), F.min_by("component_id", "unit").alias("component_id"),
    ).drop("island")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per removed run: doc_id, start, end (code points), n_words, n_units, kept_doc_ids (where its units stay), component_id (of its first unit), and text if asked for."""
    with dropping_shuffles(docs.sparkSession):
        return _repeated_passages(docs, id_col, text_col, with_text)


def _repeated_passages(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    own = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    # Unlike a row number, the key is the same in every scan.
    rows = docs.select(own[0].alias("_id"), own[1].alias("_text"), F.xxhash64(*own).alias("_key"))
    written = materialize(rows.withColumn("_rid", F.monotonically_increasing_id()).mapInArrow(_unit_batches, _UNIT_FIELDS), "units", BATCH_BYTES)
    table = written.select("_rid", "_id", "_key", "whole", "start", "end", "last_word")
    copies = _copies(table)
    marks = without_keys(written.select("_rid", "seed_at", "seed_hash"), "_rid", copies.select("_rid")).select("_rid", "seed_at", F.posexplode("seed_hash").alias("at", "text_hash"))
    marks = marks.select("text_hash", "_rid", F.get("seed_at", F.col("at")).alias("first_word"))
    stretches = copies.unionAll(_stretches(rows, table, marks))
    runs = _unit_runs(written, table, copies)
    alike = stretches.select(
        "_rid", "_id", "start", "end", "first_word", "last_word", F.lit(0).cast("long").alias("n_units"), F.array_compact(F.array("other_id")).alias("kept_doc_ids"),
        F.col("text_hash").alias("component_id"), F.struct(F.lit(1).alias("rank"), F.col("other_id").isNull().alias("x"), "other_id", "other_rid").alias("place"),
    )
    # Of stretches that cover the same words, the one shared with the first document says where they stay.
    pieces = runs.withColumn("place", F.lit(None).cast(alike.schema["place"].dataType)).unionByName(alike)
    pieces = pieces.repartition("_rid").sortWithinPartitions("_rid", "place", "first_word", "last_word").drop("place")
    pieces = pieces.mapInArrow(_further_batches, pieces.schema)
    whole = _merged(pieces).withColumn("n_words", F.col("last_word") - F.col("first_word") + 1).where(F.col("n_words") >= RUN_WORDS)
    out = [F.col("_id").alias("doc_id"), "start", "end", "n_words", "n_units", "kept_doc_ids", "component_id"]
    if not with_text:
        return whole.select(*out)
    whole = materialize(whole.join(table.select("_rid", "_key"), "_rid"), "runs")
    texts = only_keys(rows.select("_key", "_text"), "_key", whole.select("_key").distinct()).dropDuplicates(["_key"])
    return whole.join(texts, "_key").select(*out, F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


ship(__name__)
