import hashlib
import re

from pyspark.sql import functions as F

from quantframe.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return out


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (None, "z"), (None, "q q"), (8, "q\n q"), (7, "x" * 50000), (6, "x" * 50000), (4, "é b"), (4, "é b")]


def run(df, **kw):
    return [tuple(r) for r in exact_dedup.mark_duplicates(df, **kw).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for kw in ({}, {"salts": 1}, {"digest": lambda t: F.lit(1)}, {"digest": lambda t: F.length(t)}):
        got = run(df, **kw)
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((r[:4] for r in got), key=key) == sorted(brute(ROWS), key=key), kw
        assert sum(r[4] for r in got) == len({r[3] for r in got})


def test_hot_group_empty_table_and_clashing_columns(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same  text', concat('t', id)) AS text", "'x' AS kept", "1 AS keep_id", "2 AS digest", "id AS key")
    got = exact_dedup.mark_duplicates(df)
    assert got.columns == ["doc_id", "text", "digest", "key", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000 AND keep_id = 0").count() == 1000
    assert exact_dedup.drop_duplicates(df).columns == df.columns and exact_dedup.drop_duplicates(df).count() == 2001
    assert run(df.limit(0)) == []


def test_each_text_is_kept_once_where_ids_are_null_or_repeat(spark):
    pairs = [(None, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "d"), (7, "d")]
    small = spark.createDataFrame(pairs, "doc_id long, text string")  # under 1000 rows: every text is hot
    large = spark.createDataFrame(pairs * 10, "doc_id long, text string").union(spark.range(100, 2100).selectExpr("id", "concat('t', id)"))  # 10 and 20 rows of 2060: hot
    cold = spark.createDataFrame(pairs, "doc_id long, text string").union(spark.range(100, 4100).selectExpr("id", "concat('t', id)"))
    for df, n in ((small, 0), (large, 2000), (cold, 4000)):
        marked = exact_dedup.mark_duplicates(df)
        kept = sorted((str(r[0]), r[1]) for r in exact_dedup.drop_duplicates(df).filter("doc_id IS NULL OR doc_id = 7").collect())
        assert kept == [("7", "c"), ("7", "d"), ("None", "a"), ("None", "b")]
        assert marked.filter("kept").count() == n + 4
        assert marked.groupBy("text_sha256").agg(F.count(F.when(F.col("kept"), 1)).alias("n")).filter("n <> 1").count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = exact_dedup.query(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
