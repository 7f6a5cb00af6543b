"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample (SAMPLE rows, by a hash of the id) the exact neighbour graph is made and cut into parts
   of nearly equal size, few edges between them: balanced clusters first, then moves to the part that most neighbours are in.
   There is one part for every PART_ROWS rows of the table, at least LEAST_PARTS, and as many as the sample can tell apart at most.
2. A small classifier (one hidden layer) learns from a vector the parts in which its neighbours are.
3. Every row of the table is put into its most probable part. A query goes to its most probable parts: as many as held-back rows of
   the sample need to find TARGET of their neighbours, and more while they hold fewer rows than asked for. How many that is
   depends on the data: a few parts where vectors cluster, most of them where they lie evenly in many dimensions.
4. Candidates are ranked again by the exact inner product in double precision. A part's rows come in blocks of bounded size, and so do
   its queries; equal vectors are scored once, so a hot part or vector stays cheap.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
the most frequent one. Ties go to the smaller id. Rows that repeat an id are rows of their own; a null id is neither query nor
candidate. An empty table gives no rows. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

SAMPLE, PART_ROWS, LEAST_PARTS, HIDDEN, STEPS, NEIGHBOURS = 8192, 4096, 16, 64, 400, 20
#: Every HELD-th row of the sample is held back from the classifier, to count the parts that a query visits.
TARGET, HELD = 0.93, 4
BLOCK, QUERY_BLOCK = 8192, 4096


def _balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng) -> np.ndarray:
    n = len(x)
    most = int(np.ceil(1.05 * n / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=int)
    for _ in range(10):
        far = ((x[:, None, :] - centres[None]) ** 2).sum(-1) if n * parts * x.shape[1] < 5e7 else -2 * x @ centres.T + (centres**2).sum(1)
        room = np.full(parts, most)
        part[:] = -1
        for flat in np.argsort(far, axis=None):
            i, p = divmod(int(flat), parts)
            if part[i] < 0 and room[p] > 0:
                part[i] = p
                room[p] -= 1
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
    size = np.bincount(part, minlength=parts)
    for _ in range(10):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[graph[i]], minlength=parts).astype(float)
            votes[(size >= most) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def _probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    h = np.tanh((x * model["scale"]) @ model["w1"] + model["b1"])
    o = h @ model["w2"] + model["b2"]
    o = np.exp(o - o.max(1, keepdims=True))
    return o / o.sum(1, keepdims=True)


def _neighbour_graph(sample: np.ndarray) -> np.ndarray:
    """The NEIGHBOURS nearest rows of each, by inner product; a block of rows at once."""
    graph = np.empty((len(sample), NEIGHBOURS), dtype=np.int32)
    for at in range(0, len(sample), 512):
        score = sample[at : at + 512] @ sample.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        graph[at : at + 512] = np.argpartition(-score, NEIGHBOURS, axis=1)[:, :NEIGHBOURS]
    return graph


def fit(sample: np.ndarray, parts: int = LEAST_PARTS, seed: int = 7) -> dict:
    """The classifier, and how many parts a query visits, from sample vectors."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    parts = max(1, min(parts, n // (4 * NEIGHBOURS)))
    if parts == 1:
        return {"parts": 1, "visit": 1}
    graph = _neighbour_graph(sample)
    part = _balanced_parts(sample, graph, parts, rng)
    want = np.zeros((n, parts))
    for j in range(NEIGHBOURS):
        want[np.arange(n), part[graph[:, j]]] += 1
    want[np.arange(n), part] += 2  # a row's own part
    want /= want.sum(1, keepdims=True)
    model = {
        "parts": parts, "scale": 1 / max(1e-12, float(np.sqrt((sample**2).mean()))), "w1": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), "b2": np.zeros(parts),
    }
    learned, held = np.flatnonzero(np.arange(n) % HELD), np.arange(0, n, HELD)
    names = ("w1", "b1", "w2", "b2")
    first, second = {k: np.zeros_like(model[k]) for k in names}, {k: np.zeros_like(model[k]) for k in names}
    for step in range(1, STEPS + 1):
        pick = rng.choice(learned, min(len(learned), 1024), replace=False)
        x = sample[pick] * model["scale"]
        h = np.tanh(x @ model["w1"] + model["b1"])
        g = (_probabilities(model, sample[pick]) - want[pick]) / len(pick)
        back = (g @ model["w2"].T) * (1 - h * h)
        grads = {"w2": h.T @ g, "b2": g.sum(0), "w1": x.T @ back, "b1": back.sum(0)}
        for k in names:  # Adam
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            model[k] -= 0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    p = _probabilities(model, sample)
    home, order = p.argmax(1), np.argsort(-p[held], axis=1)
    rank = np.argsort(order, axis=1)  # how late a query visits each part
    late = rank[np.arange(len(held))[:, None], home[graph[held]]]
    visit = next(v for v in range(1, parts + 1) if (late < v).mean() >= TARGET)
    return model | {"visit": visit}


def _vectors(batch, name: str = "vec") -> np.ndarray:
    values = batch.column(name)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1) if len(values) else np.empty((0, 0))


def _route(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            x = _vectors(batch)
            if model["parts"] == 1:
                order = np.zeros((len(x), 1), dtype=np.int32)
            else:
                order = np.argsort(-_probabilities(model, x), axis=1, kind="stable").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(order[:, 0]), pa.array(list(order), pa.list_(pa.int32()))], names=[*batch.schema.names, "part", "visits"]
            )

    return run


def _top(query_rids, queries, rids, ids, vectors, k: int):
    """(query index, candidate id, score) of the k best candidates for each query; own rows left out."""
    flat = np.ascontiguousarray(vectors)
    _, first, of = np.unique(flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel(), return_index=True, return_inverse=True)
    distinct = flat[first]
    members: list[list] = [[] for _ in first]
    for i in np.argsort(ids, kind="stable"):
        if len(own := members[of[i]]) <= k:
            own.append((int(ids[i]), int(rids[i])))
    rough = queries @ distinct.T
    width = min(k + 1, rough.shape[1])
    least = np.partition(rough, rough.shape[1] - width, axis=1)[:, rough.shape[1] - width]
    for q in range(len(queries)):
        at = np.flatnonzero(rough[q] >= least[q] - 1e-9 * (1 + abs(least[q])))
        exact = (distinct[at] * queries[q]).sum(axis=1)
        found = [(-s, vec_id) for s, j in zip(exact.tolist(), at) for vec_id, rid in members[j] if rid != query_rids[q]]
        found.sort()
        for s, vec_id in found[:k]:
            yield q, vec_id, -s


def _rerank(k: int):
    """Rows of (part, block, query_block), sorted with queries (side 0) first."""

    def run(batches):
        key, queries, rows = None, [], []
        out: list[tuple] = []

        def close():
            if queries and rows:
                q = np.array([r[2] for r in queries])
                x = np.array([r[2] for r in rows])
                for i, vec_id, score in _top([r[0] for r in queries], q, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), x, k):
                    out.append((queries[i][0], queries[i][1], vec_id, score))

        def batch_of():
            cols = list(zip(*out)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.float64())], names=["query_rid", "query_id", "vec_id", "score"])

        for batch in batches:
            x = _vectors(batch)
            for i, (part, block, query_block, side, rid, vec_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "block", "query_block", "side", "_rid", "id")))):
                if (part, block, query_block) != key:
                    close()
                    key, queries, rows = (part, block, query_block), [], []
                (rows if side else queries).append((rid, vec_id, x[i]))
            yield batch_of()
        close()
        yield batch_of()

    return run


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE, parts: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row where is_query (on column `id`) holds."""
    found = scored_candidates(table, is_query, k, id_col, vector_col, sample_rows, parts)
    best = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_scored(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE, parts: int | None = None) -> float:
    """The part of all pairs of a query and a row that search() scores."""
    plan = _routes(table, is_query, k, id_col, vector_col, sample_rows, parts)
    if plan is None:
        return 0.0
    sizes, asked, queries = plan[1], plan[2], plan[0].where(is_query).count()
    return sum(sizes.get(p, 0) * n for p, n in asked.items()) / max(1, queries * sum(sizes.values()))


def _routes(table: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, sample_rows: int, parts: int | None):
    """(rows with their part and the parts that each would visit, rows in each part, queries that visit each part), or None without vectors."""
    spark = table.sparkSession
    kind = "array<float>" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats travel as floats, scores are of doubles
    rows = table.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(good)
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    rows = rows.where(F.size("vec") == lengths["d"])
    chosen = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    model = fit(np.array(chosen["vec"].tolist(), dtype=float), parts or max(LEAST_PARTS, lengths["count"] // PART_ROWS))
    routed = materialize(rows.mapInArrow(_route(spark.sparkContext.broadcast(model)), f"_rid long, id long, vec {kind}, part int, visits array<int>"), "routed")
    sizes = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}  # one row for each part
    counts = F.create_map(*[F.lit(x) for p in range(model["parts"]) for x in (p, sizes.get(p, 0))])
    # As many parts as learned, and on while they hold no more than k rows.
    taken = F.aggregate("visits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("taken")),
        lambda acc, p: F.when((acc["taken"] < model["visit"]) | (acc["n"] <= k), F.struct((acc["n"] + counts[p]).cast("long").alias("n"), (acc["taken"] + 1).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"])
    routed = routed.withColumn("visits", F.slice("visits", F.lit(1), taken))
    asked = {r["part"]: r["count"] for r in routed.where(is_query).select(F.explode("visits").alias("part")).groupBy("part").count().collect()}
    return routed, sizes, asked


def scored_candidates(table: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, sample_rows: int, parts: int | None) -> DataFrame:
    """query_rid, query_id, vec_id, score: the k best of every block of rows that a query meets."""
    spark = table.sparkSession
    plan = _routes(table, is_query, k, id_col, vector_col, sample_rows, parts)
    if plan is None:
        return spark.createDataFrame([], "query_rid long, query_id long, vec_id long, score double")
    routed, sizes, asked = plan
    # Rows of parts that no query visits go no further.
    of = spark.createDataFrame([(p, -(-sizes[p] // BLOCK), -(-n // QUERY_BLOCK)) for p, n in sorted(asked.items()) if p in sizes], "part int, blocks int, query_blocks int")
    candidates = (
        routed.join(F.broadcast(of), "part")
        .select("part", F.pmod(F.xxhash64("_rid"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), F.lit(1).alias("side"), "_rid", "id", "vec")
    )
    visits = (
        routed.where(is_query).select(F.explode("visits").alias("part"), "_rid", "id", "vec").join(F.broadcast(of), "part")
        .select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("_rid"), F.col("query_blocks")).cast("int").alias("query_block"), F.lit(0).alias("side"), "_rid", "id", "vec")
    )
    dealt = candidates.unionAll(visits).repartition("part", "block", "query_block").sortWithinPartitions("part", "block", "query_block", "side")
    return dealt.mapInArrow(_rerank(k), "query_rid long, query_id long, vec_id long, score double")


ship(__name__)
