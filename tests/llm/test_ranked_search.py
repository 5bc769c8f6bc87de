import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quantframe.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    found = [(i, Counter(words(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for doc, c, n in found:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(docs, items, **kw):
    return sorted((tuple(r) for r in rs.search(docs, items, **kw).collect()), key=str)


def test_terms():
    texts = ["Ab-cD, 12x_ÉÀ \x00q\tZ", "", " \n", "naïve’s", "a" * 70000]
    for t in texts:
        assert [w.decode() for w in rs.terms_of(t.encode())] == words(t)


def fixture():
    rng = random.Random(8)
    vocabulary = [f"w{int(rng.paretovariate(0.5))}" for _ in range(4000)]
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(int(rng.lognormvariate(3, 1)) + 1))) for d in range(900)]
    docs += [(2000 + i, docs[7][1]) for i in range(60)] + [docs[7], (None, docs[8][1]), (None, None), (1000, None), (1001, ""), (1002, "w1 " * 30000), (1003, "..!!")]
    items = [(i, docs[i * 20][1][:200] + " w1 W1") for i in range(40)] + [(3, docs[7][1]), (None, docs[8][1]), (90, None), (91, ""), (92, "unknownterm"), (93, "w1 " * 500)]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert run(df, asked) == want
    assert run(df.withColumn("length", F.lit("x")).withColumn("id", F.lit(1)), asked.withColumn("place", F.lit(2)), block_items=7) == want
    assert run(df, asked, k=3) == brute(docs, items, 3)
    monkeypatch.setattr(rs, "BUCKET_ROWS", 16)  # many buckets
    assert run(df, asked) == want


def test_buckets_and_candidates_leave_out_most(monkeypatch):
    """Within a bucket, the coordinate bound lets few rows through that don't reach the threshold; none that do are lost."""
    rng = np.random.default_rng(9)
    weights = rng.integers(500, 9000, 200)
    sizes = rng.integers(5, 30, 600)
    terms = np.concatenate([rng.choice(200, s, replace=False) for s in sizes]).astype(np.int32)
    d = rng.integers(10_000, 500_000, len(terms))
    row = np.repeat(np.arange(600), sizes)
    bucket = rs.Bucket(np.arange(600), np.sqrt(np.bincount(row, weights=weights[terms] * d.astype(float) ** 2)), sizes, terms, d, weights)
    item = rs.Item(rng.choice(200, 12, replace=False).tolist(), [1] * 12, weights)
    whole = np.zeros(200, np.int64)
    whole[item.terms] = item.whole
    exact = bucket.scores(np.arange(600), whole)
    assert exact.tolist() == [int(sum(int(whole[t]) * int(x) for t, x in zip(terms[row == i], d[row == i]))) for i in range(600)]
    least = int(np.sort(exact)[-10])
    left = bucket.candidates(item, least)
    assert set(np.flatnonzero(exact >= least)) <= set(left) and len(left) < 150


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(5, "a")], "item_id int, text string")
    assert run(docs.limit(0), items) == [] and run(docs, items.limit(0)) == []
    got = rs.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 1


def test_query_matches_brute_force(spark, sf_dir):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted((tuple(r) for r in rs.query(spark, sf_dir).collect()), key=str) == brute(docs, items)
