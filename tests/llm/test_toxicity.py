import zlib

import numpy as np
import pytest

from quantframe.llm import toxicity


def test_held_out_accuracy_and_folds(spark):
    d = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = toxicity.query(spark, d).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    test = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hit = sum(p and t for p, t in test)
    assert hit / sum(t for _, t in test) >= 0.75 and hit / max(1, sum(p for p, _ in test)) >= 0.9


def test_held_out_labels_change_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    a = toxicity.train(docs, labels)
    b = toxicity.train(docs, labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 3 = 1, 1 - toxic, toxic) AS toxic"))
    assert a.index == b.index and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_risk_estimator_separates_without_negatives():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (400, 2)), rng.normal(-1.5, 1, (1200, 2))
    w, b = toxicity.fit_nnpu(pos[:200], np.vstack([pos[200:], neg]), 200 / 1400)
    assert ((pos @ w + b) > 0).mean() > 0.9 and ((neg @ w + b) > 0).mean() < 0.05


def test_shapes(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["you idiot", "fine text", None, "", "word " * 40000])] * 2 + [(None, "idiot", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels))
    assert got.columns == ["doc_id", "text", "held_out", "score", "predicted"] and got.count() == 11
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), none).collect() == []


def test_risk_and_direction_match_brute_force():
    rng = np.random.default_rng(4)
    xp, xu = rng.random((7, 3)), rng.random((11, 3))
    signs = set()
    for prior in (0.05, 0.4, 0.9):
        for scale in (0.1, 1.0, 4.0):
            theta = rng.normal(size=4) * scale
            loss = lambda z, y: np.log1p(np.exp(-y * z))
            z = [[float(np.dot(r, theta[:3]) + theta[3]) for r in x] for x in (xp, xu)]
            first = prior * np.mean([loss(v, 1) for v in z[0]])
            second = np.mean([loss(v, -1) for v in z[1]]) - prior * np.mean([loss(v, -1) for v in z[0]])
            assert np.allclose(toxicity.risk(theta, xp, xu, prior), (first, second))
            signs.add(second >= 0)
            part = lambda t: sum(toxicity.risk(t, xp, xu, prior)) if second >= 0 else -toxicity.risk(t, xp, xu, prior)[1]  # noqa: E731, B023
            numeric = [(part(theta + e) - part(theta - e)) / 2e-5 for e in np.eye(4) * 1e-5]
            assert np.allclose(toxicity.direction(theta, xp, xu, prior), numeric, atol=1e-5)
    assert signs == {True, False}
    assert toxicity.prior_threshold(np.array([9.0, 8.5, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]), 0.2) == 4.75
