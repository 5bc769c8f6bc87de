import random
import re
from collections import Counter


from quantframe.llm import near_dedup as nd
from quantframe.llm.graph import components


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(x, y):
    joint = sum((x | y).values())
    return sum((x & y).values()) / joint if joint else 1.0


def classes(pairs, n):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def brute(texts):
    bags = [bag(t) for t in texts]
    holders = {}
    for i, b in enumerate(bags):
        for s in b or [()]:
            holders.setdefault(s, set()).add(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    return classes([(i, j) for i, j in pairs if similarity(bags[i], bags[j]) >= 0.8], len(texts))


def prose(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_signatures_agree_as_weighted_jaccard():
    rng = random.Random(2)
    for rate in (0, 2, 8, 30):
        got = want = 0
        for _ in range(12):
            base = prose(rng, 200) + ["same", "word"] * 40
            texts = [" ".join(base), edited(rng, base, rate)]
            s = nd.signatures(texts, 400)
            got += (s[0] == s[1]).mean() / 12
            want += similarity(*map(bag, texts)) / 12
        assert abs(got - want) < 0.04
    assert nd.signatures(["a b c", None, "", "w " * 30000], 50)[[0, 3]].all() and not nd.signatures([None, " "], 50).any()
    assert (nd.signatures(["x y z", "q r s t u v"], 64)[1] == nd.signatures(["q r s t u v"], 64)[0]).all()


def test_classes_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(prose(rng, 60)) for _ in range(40)]
    for _ in range(12):  # groups of near copies around the threshold, chains among them
        base = prose(rng, 120)
        texts += [edited(rng, base, rng.randrange(0, 5)) for _ in range(rng.randrange(2, 30))]
    passage = prose(rng, 90)
    texts += [" ".join(passage + prose(rng, 25)) for _ in range(40)]  # a shared passage, but no copies
    texts += [None, "", " \n", "a b", "A  b", "a b c d e f " * 3000, "a b c d e f " * 3001]
    order = rng.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(i, texts[k], 1, 2) for i, k in enumerate(order)], "doc_id long, text string, class_id int, at int")
    want = brute([texts[k] for k in order])
    for small, block in ((16, 1024), (3, 1024), (3, 4)):
        monkeypatch.setattr(nd, "BLOCK", block)
        got = nd.mark_classes(df, small=small)
        assert got.columns == ["doc_id", "text", "at", "class_id"]
        assert {r["doc_id"]: r["class_id"] for r in got.collect()} == dict(enumerate(want))
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_query_on_small_tables_matches_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    want = brute([docs[i] for i in ids])
    got = {r["doc_id"]: r["class_id"] for r in nd.query(spark, sf_dir).collect()}
    assert got == {i: ids[want[k]] for k, i in enumerate(ids)}


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["class_id"]) for r in nd.mark_classes(df, carry=["doc_id"]).collect()), key=str) == [(1, 1), (1, 1), (None, 1), (None, None)]
    assert nd.mark_classes(df.limit(0)).collect() == []


def test_keep_one_of_rows_that_share_id_and_words(spark):
    rows = [(None, "Red green blue"), (None, " red GREEN blue\n"), (None, "red green blue"), (None, "other words here"), (4, "One two three"), (4, "one two three"), (4, "one two three"), (5, "ONE two three"), (4, "seven eight nine")]
    kept = nd.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["doc_id"]), r["text"].strip().lower()) for r in kept.collect()) == [("4", "one two three"), ("4", "seven eight nine"), ("None", "other words here"), ("None", "red green blue")]
    assert "WindowGroupLimit" in plan


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301), (302, 301)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {300: 300, 301: 300, 302: 300}
