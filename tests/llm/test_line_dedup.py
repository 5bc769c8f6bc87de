import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quantframe.llm import line_dedup as ld


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least=20, min_docs=3):
    holders = {}
    for i, (_, text) in enumerate(rows):
        for k in {key_of(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                holders.setdefault(k, []).append(i)
    low = -(2**63)
    number = lambda i: low if rows[i][0] is None else rows[i][0]
    keeper = {k: max(map(number, h)) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, (doc, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key_of(x), number(i)) == number(i)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in ld.dedup_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text").collect()), key=str)


def test_perfect_hash_numbers_its_keys_without_gaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        high, low = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64)
        if n > 2:
            high[: n // 2] = high[0]  # keys that share half their bits
        got = ld.PerfectHash.of(high, low)
        assert sorted(got.slots(high, low)) == list(range(n))
        if n == 5000:
            assert len(got.words) * 64 < 5 * n and len(got.slots(low, high)) == n


def test_other_keys_miss():
    rng = np.random.default_rng(2)
    high, low = rng.integers(0, 2**63, 1000, np.uint64), rng.integers(0, 2**63, 1000, np.uint64)
    mph = ld.PerfectHash.of(high, low)
    order = np.argsort(mph.slots(high, low))
    shard = ld.Shard({"keys": 1000, "bits": mph.words.tobytes(), "sizes": mph.sizes, "prints": low[order].tobytes(), "counts": np.arange(3, 1003, dtype="<u2")[order].tobytes(), "keepers": np.arange(1000, dtype="<i8")[order].tobytes()})
    counts, keepers = shard.look_up(high, low)
    assert (counts == np.arange(3, 1003)).all() and (keepers == np.arange(1000)).all()
    assert (shard.look_up(low, high)[0] == 0).all()


def fixture():
    rng = random.Random(3)
    common = [f"  This line {i} is in very many documents\t" for i in range(12)]
    rows = []
    for d in range(160):
        lines = [f"Own line number {rng.random()} of {d}" for _ in range(3)] + rng.sample(common, 4) + ["short", "", "é" * 19, "É" * 20 + str(d % 40)]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    same = "a line of just over twenty characters"
    rows += [(None, same + "\nx"), (200, same.upper() + "\r\n" + same), (201, " " + same), (300, None), (301, ""), (302, "\n\n")]
    rows += [(400, same + "!\n" + same), (400, same + "!\n" + same), (399, same + "!"), (500, "w " * 200_000 + "\n" + common[0])]
    rows += [(None, "only rows without an id have it"), (None, "only rows without an id have it"), (None, "only rows without an id have it")]
    return rows


def test_matches_brute_force_by_broadcast_and_by_shards(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert run(df) == want
    assert run(df, broadcast_bytes=0, shard_keys=4) == want  # all keys stay in shards
    assert run(df, broadcast_bytes=8 * ld.KEY_BYTES, shard_keys=3) == want  # some are broadcast
    assert run(df, least=5, min_docs=2) == brute(rows, 5, 2)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "t", "a")], "doc_id long, text string, n_lines string").withColumn("row", F.lit(1)).withColumn("id", F.lit("z"))
    got = ld.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "row", "id", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
    assert [tuple(r)[:6] for r in got.collect()] == [(1, "t", 1, "z", 1, 0)]
    assert ld.dedup_lines(df.limit(0)).collect() == []


def test_query_matches_brute_force(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ld.query(spark, sf_dir).collect()), key=str)
    assert got == [r[:4] for r in brute(docs)] and sum(r[2] for r in got) > 0
