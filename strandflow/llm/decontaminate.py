"""Benchmark decontamination by spaced-seed hashing.

Words (lower case, without the punctuation around them) of benchmark items are hashed under fixed masks; a
mask's zeros are positions that may differ. Documents hash the same windows, hits join by hash, and every hit's
diagonal (document position less item position) is verified: the best run of aligned words, with a match worth 1 and
a substitution -1, must hold MIN_MATCHED equal words, at least MIN_IDENTITY of its length. An item of fewer words
is hashed whole, and matches where all its words stand one after the other.

The benchmark is taken in blocks of about BLOCK_WORDS words, each small enough to broadcast and gone before the next one comes; a larger
benchmark takes more passes and loses nothing. A seed that many items share is met in pieces of bounded size.

Null or empty texts on either side match nothing; texts of any length are scanned whole. Repeated rows and ids are judged row by row; an item_id
may be null. Overlaps of a document come by block, item and place. The whole row travels as _row, so its columns may have any names; an empty
table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, release, ship

MASKS = ("111111", "1111011", "1110111", "11011011")
MIN_MATCHED, MIN_IDENTITY = 10, 0.65
BLOCK_WORDS = 500_000
#: Pairs of a document's seed and an item's seed that are held at once.
PAIRS = 1_000_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

HITS = "array<struct<item_id:bigint,first_word:int,last_word:int,matched:int,identity:double>>"


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split() if text else []


def _known_before(ids: np.ndarray) -> np.ndarray:
    """How many known words come before each position."""
    return np.concatenate([[0], np.cumsum(ids >= 0)])


def _seeds(ids: np.ndarray, mask: str, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window has only known words under the mask, and their hashes."""
    at = [j for j, bit in enumerate(mask) if bit == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if known is None:
        known = _known_before(ids)
    # Windows with enough known words first: there are few of them.
    where = np.flatnonzero(known[len(mask) :] - known[:n] >= len(at))
    ok = np.ones(len(where), dtype=bool)
    for j in at:
        ok &= ids[where + j] >= 0
    where = where[ok]
    key = np.full(len(where), np.uint64(int(mask, 2)))
    with np.errstate(over="ignore"):
        for j in at:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[where + j].astype(np.uint64))
    return where, key


def index_items(items: list[tuple]) -> dict:
    """Vocabulary, words of each item, and a sorted hash array with the item and position of each seed."""
    vocabulary: dict[bytes, int] = {}
    names, texts, keys, owner, position = [], [], [], [], []
    short = set()
    for item_id, text in items:
        words = [w for w in (x.strip(PUNCTUATION) for x in _words(text)) if w]
        if not words:
            continue
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
        if len(words) < MIN_MATCHED:
            short.add("1" * len(words))
        for mask in MASKS if len(words) >= MIN_MATCHED else ("1" * len(words),):
            where, key = _seeds(ids, mask)
            keys.append(key)
            position.append(where)
            owner.append(np.full(len(where), len(texts)))
        names.append(item_id)
        texts.append(ids)
    if not texts:
        return {"names": []}
    key, own, pos = np.concatenate(keys), np.concatenate(owner), np.concatenate(position)
    order = np.argsort(key, kind="stable")
    return {"names": names, "texts": texts, "vocabulary": vocabulary, "masks": sorted({*MASKS, *short}), "key": key[order], "owner": own[order], "position": pos[order]}


def _best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(first, last, matched) of the run with the largest sum of +1 for equal and -1 for different words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(total[:-1])
    end = int(np.argmax(total[1:] - low))
    first = int(np.argmin(total[: end + 1]))
    return first, end, int(equal[first : end + 1].sum())


def overlaps(index: dict, ids: np.ndarray) -> list[tuple]:
    """(item_id, first word, last word, matched, identity) of every verified overlap in a document's word ids."""
    diagonals = set()
    known = _known_before(ids)
    for mask in index["masks"]:
        where, key = _seeds(ids, mask, known)
        if not len(where):
            continue
        lo, hi = np.searchsorted(index["key"], key, "left"), np.searchsorted(index["key"], key, "right")
        hit = hi > lo
        if not hit.any():
            continue
        lo, n, where = lo[hit], (hi - lo)[hit], where[hit]
        group = np.cumsum(n) // PAIRS
        for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(group)) + 1):
            some = n[own]
            at = np.repeat(lo[own] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
            pairs = np.unique(np.stack([index["owner"][at], np.repeat(where[own], some) - index["position"][at]], axis=1), axis=0)
            diagonals.update(map(tuple, pairs.tolist()))
    found = []
    for owner, shift in sorted(diagonals):
        item = index["texts"][owner]
        lo, hi = max(0, shift), min(len(ids), shift + len(item))
        first, last, matched = _best_run(ids[lo:hi] == item[lo - shift : hi - shift])
        if matched >= min(MIN_MATCHED, len(item)) and matched >= MIN_IDENTITY * (last - first + 1):
            found.append((index["names"][owner], lo + first, lo + last, matched, matched / (last - first + 1)))
    return found


def _scan(shared):
    def run(batches):
        index = shared.value
        known: dict[bytes, int] = {}
        vocabulary = index["vocabulary"]
        for batch in batches:
            out = []
            for text, before in zip(batch.column("_text").to_pylist(), batch.column("hits").to_pylist()):
                if len(known) > 300_000:
                    known.clear()
                words = _words(text)
                ids = [*map(known.get, words)]
                if None in ids:
                    for w in set(words).difference(known):
                        bare = w.strip(PUNCTUATION)
                        known[w] = vocabulary.get(bare, -1) if bare else -2
                    ids = [*map(known.get, words)]
                ids = np.array(ids, dtype=np.int64)
                ids = ids[ids != -2]  # words of punctuation only
                names = ("item_id", "first_word", "last_word", "matched", "identity")
                out.append((before or []) + [dict(zip(names, x)) for x in overlaps(index, ids)])
            kept = [c for c in batch.schema.names if c != "hits"]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("matched", pa.int32()), ("identity", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, kind)], names=[*kept, "hits"])

    return run


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """_row (the whole row of docs) and hits: every verified overlap with a benchmark item, positions in words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    blocks = max(1, -(-words // BLOCK_WORDS))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).cast("string").alias("_text"), F.lit(None).cast(HITS).alias("hits"))
    schema = f"_row {docs.schema.simpleString()}, _text string, hits {HITS}"
    before = None
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        index = index_items([tuple(r) for r in own.orderBy("item", "text").collect()])  # at most about BLOCK_WORDS words
        if not index["names"]:
            continue
        shared = spark.sparkContext.broadcast(index)
        out = out.mapInArrow(_scan(shared), schema)
        if block < blocks - 1:
            # Written, so that no task ever holds more than one block of the benchmark.
            out = materialize(out, "scanned")
            shared.unpersist()
            if before is not None:
                release(before)
            before = out
    return out.select("_row", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


ship(__name__)
