import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quantframe.llm import suffix_dedup
from quantframe.llm.suffix_sort import repeated


def brute(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - depth + 1):
            if seen[d[i : i + depth]] > 1:
                gone[i : i + depth] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_induced_sorting_matches_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, depth = rng.randrange(1, 60), rng.choice([1, 2, 3, 5, 9])
        t = [rng.randrange(rng.choice([1, 2, 3, 6])) + 1 for _ in range(n)]
        t += t[: rng.randrange(n + 1)] + t if rng.random() < 0.3 else []
        grams = [tuple(t[i : i + depth]) for i in range(len(t) - depth + 1)]
        want = [g in [x for x, k in Counter(grams).items() if k > 1] for g in grams]
        got = repeated(np.array([*t, 0], np.int16), depth, memory=rng.choice([1 << 28, 300]))
        assert got[: len(want)].tolist() == want and (depth == 1 or not got[len(want) :].any()), t


def planted():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "é", "word", "and", "of", str(rng.randrange(10**6))]) for _ in range(n))
    passage, copy = prose(80), prose(300)
    texts = [prose(rng.randrange(5, 150)) for _ in range(60)]
    texts += [prose(30) + passage + prose(20) for _ in range(25)] + [copy] * 7 + [copy[50:700] + prose(10), passage[:-1], passage[:199], passage[:200]]
    texts += ["ab" * 400, "x" * 199, "x" * 200, "y" * 201, "For " * 5000, None, "", None]
    return texts


def rows_of(df):
    return {r["k"]: tuple(r[c] for c in suffix_dedup.RESULTS) for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20000}, {"shard_bytes": 5000, "memory": 2000}])
def test_matches_brute_force(spark, options):
    texts = planted()
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "k long, text string, n_bytes int, digest int")
    got = suffix_dedup.measure(df, **options)
    assert got.columns == ["k", "text", "digest", *suffix_dedup.RESULTS]
    assert rows_of(got) == dict(enumerate(brute(texts, 200)))


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute([r["text"] for r in docs], 200)))
    assert rows_of(suffix_dedup.query(spark, sf_dir).withColumnRenamed("doc_id", "k")) == want


def test_cut_texts_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 250, 0), (2, "b", 0), (3, None, 0)], "doc_id long, text string, at int")
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "", 2: "b", 3: ""}
    assert suffix_dedup.measure(df.limit(0)).collect() == []


def test_crowded_passage_in_many_contexts(spark, monkeypatch):
    """A passage in every text, with few kinds of neighbours: split by window ends, in tasks that forget what they saw."""
    monkeypatch.setattr(suffix_dedup, "SEEN", 5)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcde fgh") for _ in range(450))
    texts = ["".join(rng.choice("xy") for _ in range(rng.randrange(1, 40))) + passage + "".join(rng.choice("zw") for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(5)
    assert rows_of(suffix_dedup.measure(df, shard_bytes=4000, memory=3000)) == dict(enumerate(brute(texts, 200)))
