"""Concatenate and cut: all documents, one after the other, cut into sequences of a fixed length.

1. Every partition tokenises its documents and writes ids and its own running offsets.
2. The partitions' totals (one row each) give every partition's global offset by a prefix sum.
3. A second pass cuts each document at the multiples of the sequence length: one boundary record per piece.

Every sequence but the last is full. A null text counts as empty: just the separator. No rows give no
pieces. Rows that repeat a doc_id are packed each. Ids are those of the `tokenizers` file; texts
of Latin letters, ASCII and Latin-1 signs take the same vocabulary through its faster rank table (the tests hold both
against each other). Strings of special tokens count as ordinary text. Texts of any length are packed whole. A null doc_id stays null. Documents come in the
order in which they are read, so there are no ties. Further columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, worker_cache

SEQUENCE = 1024
#: Letters and signs on which both tokenizer libraries split alike: up to the end of Latin Extended-A.
PLAIN = "[\x00-ſ]*"


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """text -> ids, as the `tokenizers` file gives them."""

    def __init__(self, json_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.general = Tokenizer.from_file(json_path)
        self.general.encode_special_tokens = True
        self.plain = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_plain = re.compile(PLAIN).fullmatch

    def __call__(self, text: str) -> list[int]:
        if self.plain is not None and self.is_plain(text):
            return self.plain.encode_ordinary(text)
        return self.general.encode(text, add_special_tokens=False).ids


def _tokenise(json_path: str, ranks_path: str | None, separator: int):
    def run(batches):
        encode = worker_cache(("encoder", json_path, ranks_path), lambda: Encoder(json_path, ranks_path))
        at = 0
        for batch in batches:
            starts, counts, ids = [], [], []
            for text in batch.column("_text").to_pylist():
                own = np.array([*encode(text or ""), separator], dtype="<u4")
                starts.append(at)
                counts.append(len(own))
                ids.append((own.astype("<u2") if own.max() < 65536 else own).tobytes())
                at += len(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_part"), batch.column("_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["_part", "_id", "local", "n", "ids"],
            )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("_id", "first", "n", "ids"))):
                own = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    for k, v in zip(out, (doc, start, size, own[start : start + size].tobytes(), n, sequence, offset)):
                        out[k].append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, separator: int = 0,
    json_path: str | None = None, ranks_path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, four little-endian bytes each), doc_tokens, sequence_id, offset."""
    if json_path is None:
        json_path, ranks_path = tokenizer_files()
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().alias("_part"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    tokens = materialize(rows.mapInArrow(_tokenise(json_path, ranks_path, separator), "_part int, _id long, local long, n long, ids binary"), "tokens")
    totals = sorted(tokens.groupBy("_part").agg(F.sum("n")).collect())  # one row for each partition of the input
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    offsets = spark.createDataFrame(bases, "_part int, base long")
    placed = tokens.join(F.broadcast(offsets), "_part").select("_id", (F.col("base") + F.col("local")).alias("first"), "n", "ids")
    return placed.mapInArrow(_cut(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


ship(__name__)
