"""The thin queries opN_<name> over the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, secrets
from .common import read_table
from .decontaminate import find_overlaps
from .extract_html import extract_pages
from .language_id import identify
from .near_dedup import near_duplicates
from .packing import pack
from .substring_dedup import repeated_passages
from .toxicity import score_toxicity
from .vector_search import search


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def _span(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def _digest(spans: Column, base: tuple[str, ...]) -> list[Column]:
    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter(spans, lambda s: s["kind"].isin(*base))
    counts = [of(kind) for kind in base]
    return [*counts, F.sha2(F.array_join(F.transform(own, _span), ","), 256).alias("base_sha256"), F.array_join(F.transform(spans, _span), ",").alias("spans")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), *_digest(F.col("spans"), ("assign", "access", "hex")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold("doc_id", 5) != 0)
    return scored.select(
        F.col("_row.doc_id").alias("doc_id"), F.coalesce(fold("_row.doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold("doc_id", 4) != 2)
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.coalesce(fold("_row.doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op8_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("_id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), *_digest(F.col("spans"), pii.BASE_KINDS))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_links": op2_secret_links,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_concatenate_and_cut": op5_concatenate_and_cut,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_extract_html": op8_extract_html,
    "op9_near_dedup": op9_near_dedup,
    "op10_personal_data": op10_personal_data,
}

#: The other operators have no SQL form (models, tokenizers, look-around, order-dependent folds); the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 3, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT a AS doc_id, a AS peer FROM l UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.peer),
k AS (SELECT doc_id, min(peer) AS component_id FROM c GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k.component_id, doc_id) AS component_id, coalesce(k.component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
}
