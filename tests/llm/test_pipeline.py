import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_mixing import brute_targets
from test_near_dedup import brute
from test_packing import plain, whole


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_filters_keep_whole_rows(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and set(rows(after)) <= set(rows(before)) and after.count()


def test_toxic_documents_go(spark):
    d = "/root/testdata/sf0.01"  # the smallest tables have eleven toxic labels, too few to learn from
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r[0] for r in rows(corpus_pipeline.drop_toxic(spark, docs, d).select("doc_id"))}
    gone = [t for i, t in toxic.items() if i not in kept]
    assert sum(gone) >= 0.8 * sum(toxic.values()) and sum(gone) >= 0.9 * len(gone)


def test_copies_go(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    before, after = map(rows, stages[1])
    best = {}
    for r in before:
        best[norm(r[1])] = min(best.get(norm(r[1]), r[0]), r[0])
    assert sorted(r[0] for r in after) == sorted(best.values())
    before, after = sorted(rows(stages[2][0])), rows(stages[2][1])
    classes = brute([r[1] for r in before])
    assert sorted(r[0] for r in after) == sorted(before[k][0] for k in set(classes))


def test_mix_meets_targets(stages):
    before, after = map(rows, stages[3])
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, most = Counter(), Counter(), Counter()
    for r in before:
        size[r[3]] += words(r[1])
        most[r[3]] = max(most[r[3]], words(r[1]))
    for r in after:
        taken[r[3]] += words(r[1])
    for s, t in brute_targets(size).items():
        assert abs(taken[s] - t) <= 2 * most[s]
    assert max(Counter(r[0] for r in after).values()) <= 3


def test_packing_holds_every_token(stages):
    before, packed = rows(stages[4][0]), stages[4][1]
    tokens = sum(len(plain(r[1])) for r in before)
    placed = packed.collect()
    assert sum(r["length"] for r in placed) == tokens and whole(placed) <= -(-tokens // 2048) * 1.02 + 1


def test_run_is_registered_and_counts_alike(spark, sf_dir, stages):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert got.count() == stages[-1][1].count() and got.agg(F.sum("length")).first() == stages[-1][1].agg(F.sum("length")).first()
