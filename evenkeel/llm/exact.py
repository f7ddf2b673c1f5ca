"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

Each normalised text is cut where its content says so; a chunk's identifier is its 64-bit
digest, verified by gathering the distinct (digest, chunk) pairs once. Documents are then
compared by their ordered identifier lists (recipes), which are written once: a text moves as chunks,
once for each distinct chunk of a task, and never again.
A digest that two different chunks share gets a variant number per chunk, and recipes that
hold such a digest carry the variants too, so lists are equal only when texts are.

Hot groups: recipes are counted with map-side aggregation; the way back to the documents is a
join whose hot keys adaptive execution can split, over rows of identifiers without texts.

Defined cases: a null text equals an empty one; very long texts are long recipes; of rows with equal
text, length and id the one that the scan meets first stays; ids may repeat, be of any type that
sorts, or be null (null sorts after all others); an empty table gives an empty result; other columns
are ignored, whatever their names, and `drop_exact` keeps them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, match_rows, pick, settled

#: A chunk ends after 512 to 2048 characters, at the first mark, symbol, digit or rare letter after the 512th,
#: so that prose in any script, tables, logs and code are all cut by their content.
CHUNK = r"(?s).{512,2047}?[\p{P}\p{S}\p{N}qxzQXZ]|.{1,2048}"


def normalised(text: Column) -> Column:
    """Without space, tab, line feed, vertical tab, form feed and carriage return; null: empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256, n_chunks.

    digest: any function of a chunk to a long; equal results do not depend on it.
    """
    source = settled(pick(docs, id=id_col, text=text_col))
    base = source.withColumn("row", F.monotonically_increasing_id()).withColumn("norm", normalised(F.col("text")))
    chunked = base.withColumn("chunks", chunks_of(F.col("norm")))

    # Verification: each distinct (digest, chunk) pair is gathered once; a digest with two chunks is a clash.
    pieces = chunked.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("d"), "chunk")
    pairs = pieces.groupBy("d", "chunk").agg(F.lit(1).alias("one"))
    clashes = pairs.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    recipes = chunked.select(
        "id", "row",
        F.coalesce(F.length("text"), F.lit(0)).alias("length"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform("chunks", lambda c: digest(c)).alias("recipe"),
    )
    recipes = cut(recipes, "recipes")
    if clashes.limit(1).count():  # a fact about the digest, found over all chunks: resolve it exactly
        known = clashes.join(pairs, "d").groupBy("d").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
        each = chunked.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("d", digest(F.col("chunk")))
        variant = each.join(known, "d").select("row", F.struct("at", F.array_position("all", F.col("chunk")).alias("v")).alias("v"))
        variants = variant.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["v"]).alias("variants"))
        recipes = recipes.join(variants, "row", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<bigint>")))
    else:
        recipes = recipes.withColumn("variants", F.array().cast("array<bigint>"))

    by = ["recipe", "variants"]
    rank = F.struct((-F.col("length")).alias("shorter"), F.col("id").isNull().alias("unknown"), "id", "row")
    groups = recipes.groupBy(*by).agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    back = recipes.join(groups, by)
    return back.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
        F.col("row").alias("row_number"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups does not keep; all columns stay."""
    docs = settled(docs)
    return match_rows(docs, exact_groups(docs, id_col, text_col).where("kept").select(F.col("row_number").alias("row")), "left_semi")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_number", "n_chunks")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t,
         CASE WHEN text IS NULL THEN 0 ELSE length(text) END AS cp FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY cp DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
