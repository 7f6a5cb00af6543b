"""Language identification by interpolated Kneser-Ney character language models, one per language.

Texts are put in lower case; everything but letters and the marks that combine with them becomes one blank. Counts of character 4-grams cover
all learning documents; continuation counts of the lower orders follow from the distinct 4-grams. The models are whole.
Languages are scored in as many passes as it takes to keep a pass at PASS_CELLS cells (a language alone may have more); a text's bits
in a language don't depend on the passes. The models of a pass lie in common sorted arrays of packed gram keys, with one row of
log-probabilities (a column per language) for each key, back-off already resolved where only some languages know a gram.

A text gets the language of the lowest cross-entropy per character (ties: the first name). It is rejected if it has no letter, or if
that cross-entropy is above what learning documents of like length show (per power of two of the length: the
REJECT_QUANTILE plus REJECT_MARGIN bits; a power with fewer than REJECT_LEAST_DOCS learning documents takes those of the
powers around it, as far on both sides as it takes to have as many, or all there are).

Null and empty texts, and texts without letters, are `und` with score 0 and rejected. Rows without a language are never learned from
but are predicted. With nothing to learn from, every row is `und`. Rows are judged one by one, so repeated ids and rows don't matter. Texts of any
length are read whole, a slice at a time. The whole row travels as _row, so its columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship, worker_cache

ORDER = 4
PASS_CELLS = 32_000_000
SLICE = 1_000_000
REJECT_QUANTILE, REJECT_MARGIN, REJECT_LEAST_DOCS = 0.999, 0.5, 200
SCORE_CHARS = 60
#: Powers of two of a text's length.
LONGEST = 40
_BLANK = 32


def _letters() -> np.ndarray:
    """Which characters words are made of: letters, and the marks that combine with them."""
    return np.fromiter((chr(i).isalpha() or i < 0x10000 and unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), dtype=bool, count=0x110000)


def _marks() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x10000)), dtype=bool, count=0x10000)


def _kept_before(text: str, at: int) -> str:
    """The last ORDER - 1 characters that _grams keeps of text[:at], blanks before them if there are fewer."""
    letters = worker_cache("letters", _letters)
    out, gap = "", False
    while at > 0 and len(out) < ORDER - 1:
        at -= 1
        if not letters[ord(text[at])]:
            gap = True
            continue
        out = text[at] + " " * gap + out
        gap = False
    return out.lower()[-(ORDER - 1) :].rjust(ORDER - 1)


def _grams(texts: list[str], before: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-gram keys of all texts, and the index of each one's text; before: the last characters kept of what comes before each."""
    letters = worker_cache("letters", _letters)
    pad = " " * (ORDER - 1)
    low = [(p or pad) + t.lower() for p, t in zip(before or [pad] * len(texts), texts)]
    lengths = np.array([len(t) for t in low], dtype=np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), lengths)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    is_letter = letters[codes]
    packed = np.where(codes > 0xFFFF, 0xD800 + (codes - np.uint32(0x10000)) % 8448, codes)  # codes that no letter has
    chars = np.where(is_letter, packed, _BLANK).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first blank after a letter
    keep |= within < ORDER - 1
    chars, owner, within = chars[keep], owner[keep], within[keep]
    key = chars.copy()
    for j in range(1, ORDER):
        key[j:] |= chars[:-j] << np.uint64(16 * j)
    own = within >= ORDER - 1
    return key[own], owner[own]


def _slices(texts: list[str | None]):
    """Groups of (index, piece, characters before it) with a bounded number of characters in all; a very long text comes in pieces, which give the grams of the whole."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), SLICE):
            piece = t[at : at + SLICE]
            if group and size + len(piece) > SLICE:
                yield group
                group, size = [], 0
            group.append((i, piece, _kept_before(t, at) if at else ""))
            size += len(piece)
    if group:
        yield group


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def _count_batches(batches):
    held: dict[str, list] = {}

    def batch_of(lang, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for group in _slices(texts):
            by_lang: dict[str, tuple[list[str], list[str]]] = {}
            for i, piece, before in group:
                own = by_lang.setdefault(langs[i], ([], []))
                own[0].append(piece)
                own[1].append(before)
            for lang, own in by_lang.items():
                keys, _ = _grams(*own)
                if len(keys):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(keys, return_counts=True))
                    if len(parts) >= 8:
                        held[lang] = [_merged(parts)]
                        if len(held[lang][0][0]) > 2_000_000:
                            yield batch_of(lang, *held.pop(lang)[0])
    for lang, parts in held.items():
        yield batch_of(lang, *_merged(parts))


def _interpolated(keys: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Orders ORDER..1 of one language: sorted keys, probabilities, and the contexts' back-off weights."""
    levels = []
    for order in range(ORDER, 0, -1):
        context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        total = np.bincount(at, weights=counts)
        kinds = np.bincount(at)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.75
        discount = min(max(discount, 0.1), 0.9)
        levels.append({"keys": keys, "own": (counts - discount) / total[at], "context": context, "weight": discount * kinds / total, "at": at, "order": order})
        if order > 1:
            keys, counts = np.unique(keys & np.uint64((1 << (16 * (order - 1))) - 1), return_counts=True)
    lowest = levels[-1]
    lowest["uniform"] = 1.0 / (len(lowest["keys"]) + 1)
    lowest["p"] = lowest["own"] + lowest["weight"][lowest["at"]] * lowest["uniform"]
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels)):
        mask = np.uint64((1 << (16 * (upper["order"] - 1))) - 1)
        upper["p"] = upper["own"] + upper["weight"][upper["at"]] * lower["p"][np.searchsorted(lower["keys"], upper["keys"] & mask)]
    return levels


def _found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool)


def build_model(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """Common sorted arrays for all languages from {language: (sorted 4-gram keys, counts)}."""
    langs = sorted(grams)
    levels = [_interpolated(*grams[lang]) for lang in langs]
    model: dict = {"langs": langs, "levels": []}
    uniform = [own[-1]["uniform"] for own in levels]
    below = None
    for k in range(ORDER - 1, -1, -1):
        order = ORDER - k
        context = np.unique(np.concatenate([own[k]["context"] for own in levels]))
        weight = np.zeros((len(context), len(langs)), dtype=np.float32)
        keys = np.unique(np.concatenate([own[k]["keys"] for own in levels]))
        logp = np.empty((len(keys), len(langs)), dtype=np.float32)
        for j, own in enumerate(levels):
            at, hit = _found(own[k]["context"], context)
            weight[hit, j] = np.log2(own[k]["weight"][at[hit]])
        for j, own in enumerate(levels):
            at, hit = _found(own[k]["keys"], keys)
            logp[hit, j] = np.log2(own[k]["p"][at[hit]])
            rest = ~hit
            if below is None:
                logp[rest, j] = np.log2(uniform[j]) + weight[0, j]
            else:
                cat, chit = _found(context, keys[rest] >> np.uint64(16))
                bat, _ = _found(below["keys"], keys[rest] & np.uint64((1 << (16 * (order - 1))) - 1))
                logp[rest, j] = np.where(chit, weight[cat, j], 0) + below["logp"][bat, j]
        below = {"keys": keys, "logp": logp, "context": context, "weight": weight}
        model["levels"].insert(0, below)
    model["unknown"] = np.array([np.log2(u) for u in uniform], dtype=np.float32) + model["levels"][-1]["weight"][0]
    model["uniform_bits"] = float(-np.log2(min(uniform)))
    return model


def _log_probabilities(model: dict, keys: np.ndarray, level: int = 0) -> np.ndarray:
    own = model["levels"][level]
    at, hit = _found(own["keys"], keys)
    out = own["logp"][at]
    if not hit.all():
        rest = keys[~hit]
        if level == ORDER - 1:
            out[~hit] = model["unknown"]
        else:
            cat, chit = _found(own["context"], rest >> np.uint64(16))
            mask = np.uint64((1 << (16 * (ORDER - level - 1))) - 1)
            out[~hit] = np.where(chit[:, None], own["weight"][cat], 0) + _log_probabilities(model, rest & mask, level + 1)
    return out


def cross_entropies(model: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits per character for each text and language, characters scored, letters)."""
    n_langs = len(model["langs"])
    bits, chars, letters = np.zeros((len(texts), n_langs)), np.zeros(len(texts)), np.zeros(len(texts))
    for group in _slices(texts):
        keys, owner = _grams([piece for _, piece, _ in group], [before for _, _, before in group])
        if not len(keys):
            continue
        index = np.array([i for i, _, _ in group])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = index[owner[starts]]
        np.add.at(bits, who, -np.add.reduceat(_log_probabilities(model, keys), starts, axis=0).astype(float))
        np.add.at(chars, who, np.diff(np.r_[starts, len(owner)]))
        last = (keys & np.uint64(0xFFFF)).astype(np.int64)
        np.add.at(letters, who, np.add.reduceat(((last != _BLANK) & ~worker_cache("marks", _marks)[last]).astype(float), starts))
    return bits / np.maximum(chars, 1)[:, None], chars, letters


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[list[str]]]:
    """(lang, gram, n) of all rows with a language, and the languages of each pass, in order of their names."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = materialize(rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    passes: list[list[str]] = []
    size = 0
    for lang, n in sorted(counts.groupBy("lang").count().collect()):
        if passes and (size + n) * (len(passes[-1]) + 1) <= PASS_CELLS:
            passes[-1].append(lang)
            size += n
        else:
            passes.append([lang])
            size = n
    return counts, passes


def _model(counts: DataFrame, langs: list[str]) -> dict:
    found = counts.where(F.col("lang").isin(langs)).toPandas()
    grams = {}
    for lang, own in found.groupby("lang"):
        keys = own["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        grams[lang] = (keys[order], own["n"].to_numpy(np.int64)[order])
    return build_model(grams)


def _score(model):
    """Adds the bits of one more pass's languages to _bits."""

    def run(batches):
        m = model.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            bits = cross_entropies(m, texts)[0]
            before = batch.column("_bits").to_pylist()
            cols = [batch.column(c) for c in batch.schema.names if c != "_bits"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x + y for x, y in zip(before, bits.tolist())], pa.list_(pa.float64()))], names=[*(c for c in batch.schema.names if c != "_bits"), "_bits"])

    return run


def _predict(model, langs):
    """langs: those of all passes; this is the last one."""

    def run(batches):
        m = model.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            bits, chars, letters = cross_entropies(m, texts)
            if "_bits" in batch.schema.names:
                bits = np.hstack([np.array(batch.column("_bits").to_pylist(), dtype=float).reshape(len(texts), -1), bits])
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(texts)), best] if len(texts) else np.empty(0)
            size = np.minimum(chars, SCORE_CHARS)
            score = 1 / np.exp2(-np.minimum((bits - least[:, None]) * size[:, None], 500)).sum(axis=1)
            ok = letters > 0
            kept = [c for c in batch.schema.names if c not in ("_text", "_bits")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([langs[b] if o else "und" for b, o in zip(best, ok)], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, least, np.nan)), pa.array(chars.astype(np.int64))],
                names=[*kept, "lang_pred", "score", "bits", "n_scored"],
            )

    return run


def _neighbours(sizes: dict[int, int], bucket: int) -> list[int]:
    """The buckets nearest to this one that have REJECT_LEAST_DOCS documents together, or all."""
    for reach in range(LONGEST):
        near = [b for b in sizes if abs(b - bucket) <= reach]
        if sum(sizes[b] for b in near) >= REJECT_LEAST_DOCS:
            return near
    return list(sizes)


def identify(docs: DataFrame, learn_if: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """_row (the whole row), lang_pred, score, bits (per character), n_scored, rejected; learns from rows where learn_if holds."""
    spark = docs.sparkSession
    counts, passes = learn(docs.where(learn_if), text_col, lang_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    if not passes:
        return docs.select(row, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(0).cast("long").alias("n_scored"), F.lit(True).alias("rejected"))
    learned = F.coalesce(learn_if & F.col(lang_col).isNotNull(), F.lit(False)).alias("_learned")
    rows = docs.select(row, learned, F.col(text_col).cast("string").alias("_text"))
    kept = f"_row {docs.schema.simpleString()}, _learned boolean"
    uniform_bits, before = 0.0, None
    if len(passes) > 1:
        rows = rows.withColumn("_bits", F.array().cast("array<double>"))
    for i, langs in enumerate(passes):
        model = _model(counts, langs)
        uniform_bits = max(uniform_bits, model["uniform_bits"])
        shared = spark.sparkContext.broadcast(model)
        if i < len(passes) - 1:
            rows = materialize(rows.mapInArrow(_score(shared), f"{kept}, _text string, _bits array<double>"), "passes")
        else:
            scored = materialize(rows.mapInArrow(_predict(shared, [x for own in passes for x in own]), f"{kept}, lang_pred string, score double, bits double, n_scored long"), "languages")
        if before is not None:
            release(before)
        before = rows if i < len(passes) - 1 else None
        shared.unpersist()
    bucket = F.floor(F.log2(F.col("n_scored"))).cast("int")
    usual = scored.where("_learned and lang_pred <> 'und'").select(bucket.alias("bucket"), "bits")
    sizes = dict(usual.groupBy("bucket").count().collect())
    limit = F.lit(uniform_bits)
    if sizes:
        around = [(b, x) for b in range(LONGEST) for x in _neighbours(sizes, b)]
        pooled = usual.join(F.broadcast(spark.createDataFrame(around, "b int, bucket int")), "bucket").groupBy("b")
        found = pooled.agg(F.percentile_approx("bits", REJECT_QUANTILE, 10_000).alias("q")).collect()
        limit = F.element_at(F.create_map(*[F.lit(x) for b, q in found for x in (b, q + REJECT_MARGIN)]), bucket)
    return scored.select("_row", "lang_pred", "score", "bits", "n_scored", ((F.col("lang_pred") == "und") | (F.col("bits") > limit)).alias("rejected"))


ship(__name__)
