"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct five-word shingles, hashed once to 63 bits. Its sketch is the
k smallest hashes. The steps:

1. Documents with equal sets form one class; only its first row goes on.
2. Inverted lists of retained values. The k = 64 smallest values of a union are a sample of it without return, so
   two sets with similarity of 0.75 share at least T(size) of their retained values, but for a probability under
   MISS (a hypergeometric tail; 26 for very large sets, 43 for a set of 64, all common ones for smaller sets). Documents
   that share fewer of their retained values with any others drop out here.
3. By the same argument one of the HEADS = 15 smallest values of a union is a shared one (0.25 ** 15 is under MISS), so the lists of
   each document's 15 smallest values hold all pairs. In every list, members meet a leader (a few rounds with other
   leaders follow where a list still holds several components). Then what a list still holds from different components meets in
   blocks of bounded size, so that no link is lost, whatever the length of a list. What shares an earlier long list meets there only.
4. The union sketch estimates the similarity and drops pairs that are far below the threshold; the rest is
   confirmed on full sets, streamed by leader, in salted groups.
5. Connected components of the confirmed links.

What only some documents need (texts of possible partners, rows of copies) is picked by a key filter of bounded size, so that
the others are never shuffled.

Nulls and empty texts have the empty set: linked with nothing, each its own component. Rows that repeat a
doc_id are rows of their own, in one component if their texts match. A null doc_id takes part; the
component_id is the least non-null doc_id in its component, or null. Of rows that tie in doc_id, the one read first is the first. Texts of any length are
hashed whole. With keep_rows, the whole row travels as _row, so its columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate
from math import ceil, exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_table, likely_keys, materialize, only_keys, release, shingle_sets, ship, tidy, without_keys
from .components import connected_components

K = 64
#: The probability that two sets of similarity 0.75 share fewer retained values than asked for.
MISS = 1.3e-9
#: Sizes from which the bound of very large sets is used.
TABLE = 3000
#: So many smallest values of a document are in inverted lists.
HEADS = ceil(log(MISS) / log(1 - 0.75))
WIDTH = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Members of one block in the exact rest; rounds of leaders before it; salts of a leader's group; columns at once in a block.
BLOCK, LEADER_ROUNDS, SALTS, CHUNK = 512, 3, 32, 2048

_SKETCH_FIELDS = "n_shingles long, digest binary, sketch array<long>"


def _sketch_batches(batches):
    for batch in batches:
        n, digests, sketches = [], [], []
        for s in shingle_sets(batch.column("_text").cast(pa.binary()).to_pylist(), WIDTH):
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(s[:K].astype(np.int64))
        lengths = np.array([len(s) for s in sketches], dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int64), *sketches])
        names = batch.schema.names
        kept = [c for c in names if c != "_text"] + ([] if "_row" in names else ["_body"])  # the whole row holds the text already
        cols = [batch.column("_text") if c == "_body" else batch.column(c) for c in kept]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            names=[*kept, "n_shingles", "digest", "sketch"],
        )


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """One written row per document: _rid, _id, _body (text), n_shingles, digest, sketch, and _row if asked for."""
    cols = [F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")]
    types = "_rid long, _id long, "
    if keep_rows:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        types += f"_row {docs.schema.simpleString()}, "
    else:
        types += "_body string, "
    table = materialize(docs.select(*cols).mapInArrow(_sketch_batches, f"{types}{_SKETCH_FIELDS}"), "sketch")
    return table.withColumn("_body", F.col("_row").getField(text_col).cast("string")) if keep_rows else table


def shared_in_sample(union: int | None) -> int:
    """The least number of shared values among the K smallest of a union of this size (None: unbounded), but for MISS."""
    if union is not None and union <= K:
        return -(-NUMERATOR * union // DENOMINATOR)
    if union is None:
        logs = [lgamma(K + 1) - lgamma(x + 1) - lgamma(K - x + 1) + x * log(0.75) + (K - x) * log(0.25) for x in range(K + 1)]
    else:
        both = -(-NUMERATOR * union // DENOMINATOR)

        def choose(n, r):
            return lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1) if 0 <= r <= n else float("-inf")

        logs = [choose(both, x) + choose(union - both, K - x) - choose(union, K) for x in range(K + 1)]
    total = 0.0
    for x, p in enumerate(logs):
        total += exp(p)
        if total >= MISS:
            return x
    return K


def required_table() -> list[int]:
    """For a set of size 0, 1, ..., TABLE: shared retained values that a partner must have at least.

    A partner's union with a set of size n has at most n / 0.75 values. A set under K values is retained whole; its partner
    may have lost up to a quarter of the union, so K - K / 3 values are the most to ask for.
    """
    of_union = sample_table(TABLE * DENOMINATOR // NUMERATOR)
    small = [min(-(-NUMERATOR * n // DENOMINATOR), K - K // 3) for n in range(K)]
    return small + [min(of_union[n * DENOMINATOR // NUMERATOR], small[-1]) for n in range(K, TABLE)] + [of_union[-1]]


def sample_table(size: int = TABLE) -> list[int]:
    """For a union of at most 0, 1, ..., size values: shared ones among its K smallest, at least. Rounding makes the
    bound of single sizes go up and down by one, so it is the least of all sizes so far."""
    small = [shared_in_sample(n) for n in range(K)]
    return small + list(accumulate((shared_in_sample(n) for n in range(K, size)), min)) + [shared_in_sample(None)]


def _required(n):
    """Shared retained values that a partner must have at least, for a set of n values."""
    return F.element_at(int_table(required_table()), (F.least(n, F.lit(TABLE)) + 1).cast("int"))


def _with_lists(reps: DataFrame) -> DataFrame:
    """(_rid, n_shingles, sketch, heads): documents that share enough retained values with others, and those of their HEADS smallest that others hold too."""
    need = _required(F.col("n_shingles"))
    spread = reps.select("_rid", need.alias("need"), F.posexplode("sketch").alias("at", "v"))
    # One small number besides the keys: the need, and whether the value is among the smallest.
    postings = spread.select("v", "_rid", (F.col("need") * 2 + (F.col("at") < HEADS).cast("int")).cast("short").alias("mark"))
    # A written table, so that the join with it can be split where a value is in very many documents.
    held = materialize(postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "held")
    shared = postings.join(held, "v").groupBy("_rid").agg(
        F.count("*").alias("n"), F.first("mark").alias("mark"), F.collect_list(F.when(F.col("mark") % 2 == 1, F.col("v"))).alias("heads")
    )
    chosen = materialize(shared.where((F.col("n") >= F.floor(F.col("mark") / 2)) & (F.size("heads") > 0)).select("_rid", "heads"), "heads")
    release(held)
    return only_keys(reps, "_rid", chosen.select("_rid")).join(chosen, "_rid")


def _similar_enough(na, nb):
    return (F.least(na, nb) * DENOMINATOR) >= (F.greatest(na, nb) * NUMERATOR)


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch doesn't exclude the threshold."""
    a = sketches.select(F.col("_rid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("_rid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(a, "a").join(b, "b").where(_similar_enough(F.col("na"), F.col("nb")))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("union")))
    most = F.floor((F.col("na") + F.col("nb")) * DENOMINATOR / (DENOMINATOR + NUMERATOR))  # the union at the threshold
    needed = F.element_at(int_table(sample_table()), (F.least(most, F.lit(TABLE)) + 1).cast("int"))
    return joined.withColumn("union", union).where(shared >= F.least(needed, F.ceil(F.size("union") * 0.75))).select("a", "b")


def _verify_batches(batches):
    """Rows (a, salt, b, text) sorted by a, salt, b, the leader's own row (b = -1) first: links with exact similarity."""
    of, own = None, None
    for batch in batches:
        a_out, b_out, inter_out, union_out = [], [], [], []
        sets = shingle_sets(batch.column("_body").cast(pa.binary()).to_pylist(), WIDTH)
        for a, salt, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), sets):
            if b < 0:
                of, own = (a, salt), s
                continue
            assert of == (a, salt)
            inter = len(np.intersect1d(own, s, assume_unique=True))
            union = len(own) + len(s) - inter
            if DENOMINATOR * inter >= NUMERATOR * union:
                a_out.append(a)
                b_out.append(b)
                inter_out.append(inter)
                union_out.append(union)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a_out, b_out, inter_out, union_out)], names=["a", "b", "n_shared", "n_union"])


def _verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Confirmed links (a, b, n_shared, n_union); every leader's group is salted, so no task holds a hot one alone."""
    texts = table.select("_rid", "_body")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    leaders = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("_rid")).select("a", "salt", F.lit(-1).cast("long").alias("b"), "_body")
    members = salted.join(texts, F.col("b") == F.col("_rid")).select("a", "salt", "b", "_body")
    rows = leaders.unionAll(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return rows.mapInArrow(_verify_batches, "a long, b long, n_shared long, n_union long")


def _shared_counts(left: list, right: list) -> np.ndarray:
    """How many values each list of the left shares with each of the right; columns in bounded chunks."""
    values = np.concatenate([*left, *right])
    _, at, held = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    keep = held[at] > 1
    column, owner = (np.cumsum(held > 1) - 1)[at][keep], owner[keep]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int((held > 1).sum()), CHUNK):
        own = (column >= first) & (column < first + CHUNK)
        m = np.zeros((len(left) + len(right), CHUNK), dtype=np.float32)
        m[owner[own], column[own] - first] = 1
        shared += m[: len(left)] @ m[len(left) :].T
    return shared


def _near_by_sketch(sketches: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Whether the union sketch of each pair doesn't exclude the threshold; sketches are padded with -1."""
    both = np.sort(np.concatenate([sketches[a], sketches[b]], axis=1).view(np.uint64), axis=1)  # -1 comes last
    real = both != np.uint64(0xFFFFFFFFFFFFFFFF)
    twice = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(np.concatenate([real[:, :1], real[:, 1:] & ~twice], axis=1), axis=1)
    shared = (twice & (rank[:, 1:] <= K)).sum(axis=1)
    union = np.minimum(rank[:, -1], K)
    most = (n[a] + n[b]) * DENOMINATOR // (DENOMINATOR + NUMERATOR)  # the union at the threshold
    return shared >= np.minimum(needed[np.minimum(most, TABLE)], -(-NUMERATOR * union // DENOMINATOR))


def _candidates(rows: list, needed: np.ndarray, required: np.ndarray, v: int):
    """Pairs of one block whose union sketch doesn't exclude the threshold, and that share no value before v.

    Rows: (side, _rid, comp, n_shingles, sketch).
    """
    side, comp, n = (np.array([r[j] for r in rows]) for j in (0, 2, 3))
    if len(rows) < 2 or (comp == comp[0]).all() or side.any() and side.all():
        return
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    place = np.array([np.searchsorted(r[4], v) for r in rows])
    ok = place[left][:, None] + place[right][None, :] < HEADS  # the rank of v in the union
    ok &= comp[left][:, None] != comp[right][None, :]
    ok &= np.minimum(n[left][:, None], n[right][None, :]) * DENOMINATOR >= np.maximum(n[left][:, None], n[right][None, :]) * NUMERATOR
    if not side.any():
        ok &= np.triu(np.ones_like(ok), 1)
    if not ok.any():
        return
    need = required[np.minimum(n, TABLE)]
    ok &= _shared_counts([rows[i][4] for i in left], [rows[i][4] for i in right]) >= np.minimum(need[left][:, None], need[right][None, :])
    if not ok.any():
        return
    before = [r[4][:p] for r, p in zip(rows, place)]
    ok &= _shared_counts([before[i] for i in left], [before[i] for i in right]) == 0  # else found in that value's list
    x, y = np.nonzero(ok)
    a, b = left[x], right[y]
    sketches = np.full((len(rows), K), -1, dtype=np.int64)
    for i, r in enumerate(rows):
        sketches[i, : len(r[4])] = r[4]
    for at in range(0, len(a), 4 * CHUNK):
        some = slice(at, at + 4 * CHUNK)
        near = _near_by_sketch(sketches, n, a[some], b[some], needed)
        yield from zip(a[some][near].tolist(), b[some][near].tolist())


def _streamed(batches, columns, make, finish):
    """Runs make(key, rows) on every group of rows sorted by v, i, j; hands on what finish makes of its results, batch by batch."""
    key, rows, out = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_numpy(zero_copy_only=False) if c == "sketch" else batch.column(c).to_pylist() for c in ("v", "i", "j", *columns))):
            if row[:3] != key:
                if rows:
                    out += make(key, rows)
                key, rows = row[:3], []
            rows.append(row[3:])
        yield finish(out)
        out = []
    if rows:
        out += make(key, rows)
    yield finish(out)


def _block_batches(batches):
    """Rows (v, i, j, side, _rid, comp, n_shingles, sketch): every document with candidates, and its partners."""
    needed, required = np.array(sample_table()), np.array(required_table())

    def make(key, rows):
        partners: dict[int, list[int]] = {}
        for a, b in _candidates(rows, needed, required, key[0]):
            partners.setdefault(rows[a][1], []).append(rows[b][1])
            partners.setdefault(rows[b][1], [])
        return [(*key, rid, own) for rid, own in partners.items()]

    def finish(out):
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["v", "i", "j", "_rid", "partners"])

    return _streamed(batches, ("side", "_rid", "comp", "n_shingles", "sketch"), make, finish)


def _confirm_batches(batches):
    """Rows (v, i, j, _rid, partners, text): a spanning forest of each block's links, confirmed on full sets."""

    def make(key, rows):
        sets = dict(zip((r[0] for r in rows), shingle_sets([r[2].encode() for r in rows], WIDTH)))
        root = {rid: rid for rid in sets}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for rid, partners, _ in rows:
            for other in partners:
                a, b = find(rid), find(other)
                if a == b:
                    continue
                inter = len(np.intersect1d(sets[rid], sets[other], assume_unique=True))
                union = len(sets[rid]) + len(sets[other]) - inter
                if DENOMINATOR * inter >= NUMERATOR * union:
                    root[max(a, b)] = min(a, b)
                    yield min(rid, other), max(rid, other), inter, union

    def finish(out):
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n_shared", "n_union"])

    return _streamed(batches, ("_rid", "partners", "_body"), make, finish)


def _with_components(lists: DataFrame, components: DataFrame) -> DataFrame:
    return lists.join(components, lists["_rid"] == components["node"], "left").select(
        "_rid", "n_shingles", "sketch", "heads", F.coalesce("component", "_rid").alias("comp")
    )


def _open_lists(postings: DataFrame, turn: int) -> DataFrame:
    """(v, m, lead, lead_comp): lists that hold more than one component, their sizes and leaders; written, so that joins with it can be split."""
    order = F.struct(F.lit(0).cast("long") if turn == 0 else F.xxhash64("_rid", F.lit(turn)), F.col("_rid"), F.col("comp"))
    found = postings.groupBy("v").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(order).alias("lead")).where("lo < hi")
    return materialize(found.select("v", "m", F.col("lead._rid").alias("lead"), F.col("lead.comp").alias("lead_comp")), "lists")


def _dealt(state: DataFrame) -> DataFrame:
    """(v, _rid, own, partners): the open lists' members, the block that each is in, and how many blocks, from 0 on, it meets (its own among them, if it meets that).

    In a list v that needs several blocks, two members have nothing to find if they are of one component, or if they share a value before v, in whose list they
    meet. So each has a label: its first value in a long list if that comes before v, else its component. Members of the commonest label, who are
    in the last blocks, meet only the others, who are in the first ones and meet all.
    """
    rows = state.select(F.explode("heads").alias("v"), "_rid", "comp")
    lists = _open_lists(rows, 0)
    held = materialize(rows.join(lists.select("v", "m"), "v"), "open")
    release(lists)
    short = held.where(F.col("m") <= BLOCK).select("v", "_rid", F.lit(0).alias("own"), F.lit(1).alias("partners"))
    long = held.where(F.col("m") > BLOCK)
    label = F.when(F.col("s") < F.col("v"), -1 - F.col("s")).otherwise(F.col("comp"))  # values and components are not negative
    labelled = materialize(long.join(long.groupBy("_rid").agg(F.min("v").alias("s")), "_rid").select("v", "_rid", "m", label.alias("label")), "labels")
    tally = labelled.groupBy("v", "label").agg(F.count("*").alias("c")).groupBy("v").agg(F.max("c").alias("most"), F.max(F.struct("c", "label"))["label"].alias("common"))
    placed = labelled.join(materialize(tally, "tally"), "v")
    others = F.col("m") - F.col("most")

    def blocks(n):
        return F.ceil(n / BLOCK).cast("int")

    apart = F.col("most") * blocks(others) + others * (blocks(others) + blocks(F.col("most"))) < F.col("m") * blocks(F.col("m"))
    placed = placed.withColumns({"first": F.when(apart, blocks(others)).otherwise(blocks(F.col("m"))), "last": F.when(apart, blocks(F.col("most"))).otherwise(0), "late": apart & (F.col("label") == F.col("common"))})
    turn = F.xxhash64("_rid")
    own = F.when(F.col("late"), F.col("first") + F.pmod(turn, F.greatest("last", F.lit(1)))).otherwise(F.pmod(turn, F.greatest("first", F.lit(1)))).cast("int")
    met = F.when(F.col("late"), F.col("first")).otherwise(F.col("first") + F.col("last")).cast("int")
    return short.unionAll(placed.select("v", "_rid", own.alias("own"), met.alias("partners")).where("partners > 0"))


def _meetings(state: DataFrame) -> DataFrame:
    """(v, i, j, side, _rid, comp, n_shingles, sketch): every member of an open list, once for each pair of blocks that it has a part in."""
    # Only members of open lists take their sketches along.
    rows = materialize(_dealt(state), "dealt").join(state.select("_rid", "comp", "n_shingles", "sketch"), "_rid")
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("partners") - 1))).select(
        "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        "_rid", "comp", "n_shingles", "sketch",
    )


def _rest_in_blocks(state: DataFrame, table: DataFrame) -> DataFrame:
    """Links (a, b, n_shared, n_union) that join components, from all lists that still hold several, in bounded blocks.

    Sketches meet first; texts follow only for documents with candidates, once for each block, however many partners they have there.
    """
    dealt = _meetings(state).repartition("v", "i", "j").sortWithinPartitions("v", "i", "j")
    found = materialize(dealt.mapInArrow(_block_batches, "v long, i int, j int, _rid long, partners array<long>"), "rest")
    with_text = found.join(table.select("_rid", "_body"), "_rid").repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "_rid")
    return with_text.mapInArrow(_confirm_batches, "a long, b long, n_shared long, n_union long")


def _first():
    """The row that comes first: the least (doc_id, row), null ids last."""
    return F.min(F.struct(F.col("_id").isNull().alias("x"), F.col("_id"), F.col("_rid")))["_rid"]


def link_documents(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From sketch_documents(): (copies: _rid, rep), (links between representatives: a, b, n_shared, n_union)."""
    slim = table.where("n_shingles > 0").select("_rid", "_id", "digest")
    classes = materialize(slim.groupBy("digest").agg(F.count("*").alias("n"), _first().alias("rep")).where("n > 1").drop("n"), "classes")
    copies = materialize(slim.join(classes, "digest").where("_rid <> rep").select("_rid", "rep"), "copies")
    reps = without_keys(table.where("n_shingles > 0").select("_rid", "n_shingles", "sketch"), "_rid", copies.select("_rid"))
    lists = materialize(_with_lists(reps), "heads")
    # From here on only documents with a possible partner count: their texts are set apart once, so that no later join moves all texts.
    # A text that the key filter lets through besides them meets nothing, so no exact join moves them all.
    table = materialize(likely_keys(table.select("_rid", "_body"), "_rid", lists.select("_rid")), "texts")
    spark = table.sparkSession
    links = spark.createDataFrame([], "a long, b long, n_shared long, n_union long")
    components = spark.createDataFrame([], "node long, component long")
    for turn in range(LEADER_ROUNDS):
        tidy(spark)  # each round has some dozens of queries
        state = _with_components(lists, components)
        postings = state.select(F.explode("heads").alias("v"), "_rid", "comp")
        leaders = _open_lists(postings, turn)
        pairs = postings.join(leaders.drop("m"), "v").where("comp <> lead_comp").select(F.least("_rid", "lead").alias("a"), F.greatest("_rid", "lead").alias("b")).distinct()
        found = materialize(_verified(_estimated(pairs, lists), table), "links")
        release(leaders)
        if found.isEmpty():
            break
        links = links.unionAll(found)
        components = materialize(connected_components(links), "components")
    tidy(spark)
    found = materialize(_rest_in_blocks(_with_components(lists, components), table), "links")
    links = materialize(links.unionAll(found).distinct(), "links")
    release(table)
    release(lists)
    return copies, links


def _groups(table: DataFrame) -> DataFrame:
    """(_rid, component_id, first): the rows of every component with more than one row."""
    copies, links = link_documents(table)
    tidy(table.sparkSession)
    components = materialize(connected_components(links), "components")
    members = copies.unionAll(copies.select(F.col("rep").alias("_rid"), "rep")).unionAll(components.select(F.col("node").alias("_rid"), F.col("node").alias("rep"))).distinct()
    comps = members.join(components, members["rep"] == components["node"], "left").select("_rid", F.coalesce("component", "rep").alias("comp"))
    held = materialize(only_keys(table.select("_rid", "_id"), "_rid", members.select("_rid").distinct()).join(comps, "_rid"), "members")
    ids = materialize(held.groupBy("comp").agg(F.min("_id").alias("component_id"), _first().alias("first")), "ids")
    return materialize(held.join(ids, "comp").select("_rid", "component_id", "first"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """One row per row of docs: _rid, _id, n_shingles, component_id, is_first, _row if asked for.

    is_first marks the one row of each component that a corpus keeps: the least (doc_id, row).
    """
    table = sketch_documents(docs, id_col, text_col, keep_rows)
    groups = _groups(table)
    out = table.select("_rid", "_id", "n_shingles", *(["_row"] if keep_rows else [])).join(groups, "_rid", "left")
    grouped = F.col("first").isNotNull()
    return out.withColumns({"component_id": F.when(grouped, F.col("component_id")).otherwise(F.col("_id")), "is_first": ~grouped | (F.col("_rid") == F.col("first"))}).select(
        "_rid", "_id", "n_shingles", "component_id", "is_first", *(["_row"] if keep_rows else [])
    )


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row (the whole row) of the one row of each component that a corpus keeps. Only rows that may go are shuffled."""
    table = sketch_documents(docs, id_col, text_col, keep_rows=True)
    gone = materialize(_groups(table).where("_rid <> first").select("_rid"), "gone")
    return without_keys(table.select("_rid", "_row"), "_rid", gone).select("_row")


ship(__name__)
