"""Shared pieces: the shared scratch folder, written intermediate tables, word hashes."""

from __future__ import annotations

import contextlib
import gc
import sys
import tempfile
import types
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Send this module's functions to executors by value, so that they need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: Rows of an Arrow batch while intermediate tables are written.
BATCH_ROWS = 2000
_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded(paths: list[str]):
    """Adds the paths of all tables that materialize() writes meanwhile."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.pop()


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. Where none is set: a temporary one if all runs on this machine, else one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="strandflow-")
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{sc.applicationId}"
        sc.setCheckpointDir(base)
    return base


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_table(spark: SparkSession, path: str) -> None:
    p, fs = _filesystem(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The files are removed when the application ends. batch_bytes: where Arrow batches end meanwhile, if not at Spark's own limit; a longer row is one alone.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}  # long texts: fewer rows at once in a Python worker
    if batch_bytes:
        limits["spark.sql.execution.arrow.maxBytesPerBatch"] = batch_bytes
    before = {k: spark.conf.get(k) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, str(v))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for paths in _recorders:
        paths.append(path)
    p, fs = _filesystem(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """Whatever runs meanwhile removes its shuffle files when it ends, instead of leaving them until the driver happens to collect its garbage.

    For steps that write what they find: nothing reads their shuffles again. What is still lazy afterwards isn't touched.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and nothing reads any more."""
    drop_table(df.sparkSession, df.scratch_path)


def tidy(spark: SparkSession) -> bool:
    """Gives back the driver's memory that nothing uses any more; whether native memory was given back too.

    Many queries leave plans behind, compiled classes, and freed native memory that the C library keeps in the arena of each thread. Collecting
    shrinks the heap, and lets Spark remove shuffles and broadcasts that nothing refers to. Nothing that is still in use changes.
    """
    gc.collect()  # plans held by Python first
    jvm = spark._jvm
    jvm.System.gc()
    try:
        found = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        next(m for m in found if m.getName() == "invoke").invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without this command
        return False
    return True


def int_table(values: list[int]) -> Column:
    """An array<int> column of many numbers as one literal: a literal for each number makes every plan with it large."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


#: The most bits of a key filter: 16 MB, whatever the number of keys.
FILTER_BITS = 1 << 27
#: Words of 64 bits in a page of it.
_PAGE = 512


def _filtered(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows and _hit: false only for keys that are not among `keys`.

    The filter is a bitmap of hashed keys, sent to the rows in pages of 4 kB. It has 64 bits a key, up to FILTER_BITS in all: with very many
    keys it says `maybe` more often, which costs time and changes nothing.
    """

    def shifted(name: str, x, n):
        return F.call_function(name, x, n.cast("int"))

    bits = min(FILTER_BITS, max(64 * _PAGE, 1 << (64 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    page, slot, place = F.shiftright(at, 15), F.shiftright(at, 6).bitwiseAND(_PAGE - 1).cast("int"), at.bitwiseAND(63)
    one = F.lit(1).cast("long")
    # Every word of the bitmap has a row, most of them zero, so that a page is its words in order.
    words = keys.select(F.shiftright(at, 6).alias("_at"), place.alias("_place")).select("_at", shifted("shiftleft", one, F.col("_place")).alias("_word"))
    words = words.unionAll(keys.sparkSession.range(bits // 64).select("id", F.lit(0).cast("long"))).groupBy("_at").agg(F.bit_or("_word").alias("_word"))
    pages = words.groupBy(F.shiftright("_at", 9).alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_at", "_word")))["_word"].alias("_bits"))
    hit = F.coalesce(shifted("shiftright", F.get("_bits", slot), place).bitwiseAND(one) != 0, F.lit(False))
    return rows.withColumn("_page", page).join(F.broadcast(pages), "_page", "left").withColumn("_hit", hit).drop("_page", "_bits")


def likely_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among the (distinct) keys of the one-column table `keys`, and a few more; nothing is shuffled."""
    return _filtered(rows, key, keys).where("_hit").drop("_hit")


def only_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among the (distinct) keys of the one-column table `keys`. Rows that the key filter excludes are not shuffled."""
    return likely_keys(rows, key, keys).join(keys, key, "left_semi")


def without_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among the (distinct) keys of the one-column table `keys`. Rows that the key filter excludes are not shuffled."""
    marked = _filtered(rows, key, keys)
    return marked.where("not _hit").drop("_hit").unionAll(marked.where("_hit").drop("_hit").join(keys, key, "left_anti"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MASK63 = np.uint64(0x7FFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def worker_cache(key, make):
    """What make() returns, made once in each Python worker and kept there for later tasks."""
    held = sys.modules.setdefault("_strandflow_worker", types.ModuleType("_strandflow_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def _hash_tables() -> dict:
    with np.errstate(over="ignore"):
        numbers = np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return {"byte": mix64(numbers[:256]) | np.uint64(1), "place": mix64(numbers + np.uint64(1)), "blank": np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))}


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words between ASCII white space, in bytes."""
    blank = np.ones(len(codes) + 2, dtype=bool)
    blank[1:-1] = worker_cache("hash-tables", _hash_tables)["blank"][codes]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def hash_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of bytes, all at once: the sum of each byte's number times its place's number, mixed with the length."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    tables = worker_cache("hash-tables", _hash_tables)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    inside = codes[place + np.repeat(starts, length)]
    numbers = tables["place"]
    with np.errstate(over="ignore"):
        if (most := int(length.max())) > len(numbers):
            numbers = mix64(np.arange(1, most + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return mix64(np.add.reduceat(tables["byte"][inside] * numbers[place], first) + length.astype(np.uint64))


#: Bytes of texts that are hashed together.
TOGETHER = 1 << 20


def together(texts: list[bytes]):
    """Runs (first, last + 1) of texts with about TOGETHER bytes in all; a longer text alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > TOGETHER:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, counts): the words of several texts one after the other, A-Z in lower case, and how many each text has."""
    codes = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
    starts, ends = word_bounds(codes)
    bounds = np.cumsum(np.array([len(t) + 1 for t in texts]))
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return codes, starts, ends, hash_words(codes, starts, ends), counts


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    total = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for j in range(width):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += hashes[j : j + n]
    return mix64(total) & MASK63


def shingle_sets(texts: list[bytes | None], width: int = 5) -> list[np.ndarray]:
    """For each text, the distinct 63-bit hashes of all word n-grams of this width, ascending; one for fewer words, none for none."""
    texts = [t or b"" for t in texts]
    out = []
    for low, high in together(texts):
        _, _, _, hashes, counts = words_of(texts[low:high])
        whole = _shingles(hashes, width) if len(hashes) >= width else None
        at = 0
        for n in counts.tolist():
            if n >= width:
                own = np.sort(whole[at : at + n - width + 1])
                keep = np.ones(len(own), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                out.append(own[keep])
            else:
                out.append(_shingles(hashes[at : at + n], n) if n else np.empty(0, dtype=np.uint64))
            at += n
    return out


ship(__name__)
