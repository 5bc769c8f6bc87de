import zlib
from collections import Counter

import numpy as np

from quantframe.llm import sharding


def check(rows, n, shards):
    assert len(rows) == n
    sizes = Counter(r["shard"] for r in rows)
    assert all(0 <= s < shards for s in sizes) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k))


def test_query_places_every_row_exactly(spark, sf_dir):
    rows = sharding.query(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(rows, len(texts), 40)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "rows" and r["grown_shard"] is None
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.query(spark, sf_dir).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_cells_smaller_than_shards_nulls_repeats_and_names(spark):
    df = spark.range(5003).selectExpr("if(id % 3 = 0, 1, id) AS doc_id", "if(id % 7 = 0, null, 'é') AS text", "id AS slot", "id AS cell", "id AS row", "id AS order").repartition(6)
    got = sharding.shuffle_into_shards(df, 7, cell_rows=50)
    assert got.columns == ["doc_id", "text", "cell", "row", "order", "shard", "slot"]
    rows = got.collect()
    check(rows, 5003, 7)
    assert sorted(r["cell"] for r in rows) == list(range(5003))
    assert sharding.shuffle_into_shards(df.limit(0), 7).collect() == []
    check(sharding.shuffle_into_shards(df.limit(3), 7).collect(), 3, 7)


def test_order_is_uniform(spark):
    """Each source row is as likely in each shard; neighbours are no likelier together."""
    df = spark.range(0, 40, 1, 4)
    hits = np.zeros((40, 4))
    for seed in range(24):
        for r in sharding.shuffle_into_shards(df, 4, seed=seed, stable=True).collect():
            hits[r["id"], r["shard"]] += 1
    assert (((hits - 6) ** 2 / 6).sum() - 120) < 5 * np.sqrt(240)


def test_matrix_has_the_margins():
    counts, sizes = [5, 0, 17, 3, 100], sharding.cell_sizes(125, 4, 3)
    m = np.array([sharding.matrix_row(3, np.array(counts), sizes, p) for p in range(5)])
    assert m.sum(1).tolist() == counts and (m.sum(0) == sizes).all() and (m >= 0).all()


def test_large_populations():
    rng = np.random.default_rng(1)
    draws = np.array([sharding.hypergeometric(rng, 3 * 10**9, 10**9, 4000) for _ in range(2000)])
    assert abs(draws.mean() - 3000) < 4 and abs(draws.std() - np.sqrt(4000 * 0.75 * 0.25)) < 2
    sizes = np.full(9, 10**9)
    got = sharding.split_sizes(rng, sizes, 9000)
    assert got.sum() == 9000 and abs(got - 1000).max() < 200
