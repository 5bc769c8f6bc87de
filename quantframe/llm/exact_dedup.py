"""Exact deduplication by skew-safe combining, with DataFrame functions alone.

Texts are equal when they are identical after each run of ASCII white space becomes one space. Equal texts meet in
three stages, each of which compares the whole content beside its digest:

1. each map task merges its own equal texts (the partial aggregate before the first exchange);
2. the survivors meet by (digest, salt): a text that a third of all rows share is spread over ``salts`` tasks;
3. the at most ``salts`` winners of each text meet once more.

Members then look their group up by digest. Digests with more than one content (none under SHA-256, but any digest may
be given) are looked up by digest and content. The lookup of digests that hold over 1/1000 of all rows, of which there
are fewer than 1000, is broadcast; the rest have at most 1/1000 of the rows each and meet in a shuffle join.

Defined cases: null text counts as empty; a null doc_id loses to any other and is kept only where all of its group are
null; rows that repeat both doc_id and text count in group_size, and just one of them is kept; an empty table gives an
empty result; other columns pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantframe.llm.common import SPACE, materialise, or_empty

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: A digest with over 1/HOT of all rows is hot; fewer than HOT can be.
HOT = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(or_empty(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def winners(rows: DataFrame, salts: int) -> DataFrame:
    """rows (digest, content, id) -> one row per content: digest, content, keep, size."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "content").agg(F.min("low").alias("keep"), F.sum("n").alias("size"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256, carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns of ``carry``) with keep_id, group_size, kept and text_sha256; see the module for the method and the defined cases."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    rows = docs.select(F.struct(*carried).alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content")).withColumn("digest", digest(F.col("content")))
    best = winners(rows.select("digest", "content", "id"), salts)
    groups = materialise(best.groupBy("digest").agg(F.count(F.lit(1)).alias("contents"), F.min("keep").alias("keep"), F.sum("size").alias("size")), "exact-groups")
    total, clashes = groups.agg(F.sum("size"), F.sum((F.col("contents") > 1).cast("long"))).first()
    lone = groups.filter("contents = 1").drop("contents")
    hot = lone.filter(F.col("size") > (total or 0) / HOT)
    cold = lone.filter(F.col("size") <= (total or 0) / HOT)
    found = (
        rows.withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))
        .drop("content")
        .join(F.broadcast(hot.select(F.col("digest"), F.col("keep").alias("hot_keep"), F.col("size").alias("hot_size"))), "digest", "left")
        # a hot row has its answer: another key, which no digest has, keeps it from meeting its like in one task
        .withColumn("key", F.when(F.col("hot_size").isNull(), F.concat(F.lit("d"), F.hex("digest"))).otherwise(F.concat(F.lit("h"), F.xxhash64("id").cast("string"))))
        .join(cold.select(F.concat(F.lit("d"), F.hex("digest")).alias("key"), "keep", "size"), "key", "left")
        .select("row", "id", "sha", "key", F.coalesce("hot_keep", "keep").alias("keep"), F.coalesce("hot_size", "size").alias("size"))
    )
    if clashes:
        shared = groups.filter("contents > 1").select("digest")
        apart = rows.join(shared, "digest", "left_semi").join(best, ["digest", "content"])
        apart = apart.select("row", "id", F.sha2(F.col("content").cast("binary"), 256).alias("sha"), F.col("content").alias("key"), "keep", "size")
        found = found.filter(F.col("size").isNotNull()).unionByName(apart)
    first = F.row_number().over(Window.partitionBy("key", "id", "sha").orderBy("size")) == 1  # a hot key is shared by texts: sha parts them
    return found.select("row.*", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("id").eqNullSafe(F.col("keep")) & first).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of docs, with the columns of docs."""
    marked = mark_duplicates(docs.select(F.struct(*docs.columns).alias("whole"), F.col(options.pop("id_col", "doc_id")).alias("id"), F.col(options.pop("text_col", "text")).alias("text")), id_col="id", text_col="text", **options)
    return marked.filter("kept").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_duplicates(docs, carry=["doc_id"])


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
