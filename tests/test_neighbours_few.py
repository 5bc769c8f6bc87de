"""Keys of few rows are imputed where their rows meet: little is written, and results are those of all pairs."""

import pytest
from pyspark.sql import functions as F
from test_neighbours import brute

from quantframe.operators import neighbours


def rows_of(keys, n):
    return [(key, i * 1000 + o, *[None if (o * 7 + c * 5 + i) % (9 + c) == 0 else float((o * 37 + c * c * 11) % 101) / (c + 1) for c in range(3)]) for i, key in enumerate(keys) for o in range(n)]


def test_few_rows_across_batches_equal_all_pairs(spark):
    rows = rows_of(["a", None, "b", "c"], 40) + [("one", 9000, None, 1.0, None), ("two", 9001, None, None, None), ("two", 9002, 4.0, float("nan"), None)]
    df = spark.createDataFrame([(*r, f"t{r[1]}") for r in rows], "key string, o int, x double, y float, z double, note string").select("note", "z", "key", "y", "o", "x").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["o"]: r for r in neighbours.impute(df, ["key"], "o", ["x", "y", "z"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = [tuple(None if v != v else v for v in r) for r in rows]
    want = brute(plain, 3, 5)
    assert len(got) == len(rows)
    for key, o, *x in plain:
        assert (got[o]["key"], got[o]["note"]) == (key, f"t{o}")
        for c, v in enumerate(x):
            expected = v if v is not None else want[o, c]
            assert got[o]["xyz"[c]] == (None if expected is None else pytest.approx(expected, rel=1e-6)), (o, c)


def test_few_rows_are_written_once_and_many_go_through_indexes(spark, monkeypatch):
    written = {}
    real = neighbours.materialise

    def counted(df, label):
        out = real(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(neighbours, "materialise", counted)
    df = spark.createDataFrame(rows_of(list("abcdefgh"), 120), "key string, o long, x double, y double, z double")
    small = {r["o"]: r for r in neighbours.impute(df, ["key"], "o", ["x", "y", "z"]).collect()}
    assert len(small) == 960 and sum(written.values()) == 960  # before: 3 indexes, blocks, queries and results of each round
    hot = df.filter("key = 'a'").unionByName(df.filter("key = 'b'").limit(20))
    both = neighbours.impute(hot, ["key"], "o", ["x", "y", "z"], block=8)
    assert written["knn-keys"] == 1 and "knn-blocks" in written
    assert both.count() == 140
    for r in both.filter(F.col("key") == "a").collect():
        assert tuple(r) == pytest.approx(tuple(small[r["o"]]))
