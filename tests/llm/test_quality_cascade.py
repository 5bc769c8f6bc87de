import re
from collections import Counter

from quantframe.llm import quality_cascade as q

WORDS = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = re.findall(WORDS, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORDS, line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    cov = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cov)


HARD = [None, "", "a", "a b c a b c", "a b c \x1c \x85 d", "x\n x\nx\nx\n\n\n", "é # *$ <>|& \x0b\x0c\r\t z", "w " * 30000, "the same words here " * 20, " ".join(f"w{i % 70} v{i}" for i in range(3000))]


def test_counts_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in q.query(spark, sf_dir).collect():
        b = brute(texts[r["doc_id"]])
        assert tuple(r[1:6]) == b and r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r["base_failed"] and r["kept"])
    for t in HARD:
        assert tuple(getattr(q.Text(t), c) for c in q.COUNTS) == brute(t), t


def test_order_changes_cost_not_verdict():
    rules = q.default_rules()
    names = list(rules)
    for t in HARD:
        want = any(r(q.Text(t)) for r in rules.values())
        assert all(any(rules[n](q.Text(t)) for n in o) == want for o in (names, names[::-1]))


def test_order_goes_by_rejections_per_cost(spark):
    import time

    rules = {"slow_strong": lambda d: time.sleep(0.002) or True, "fast_strong": lambda d: d.n_words < 5, "never": lambda d: False}
    df = spark.createDataFrame([(i, f"t {i}") for i in range(50)], "doc_id long, text string")
    order = q.order_rules(df, rules)
    assert order[0] == "fast_strong" and set(order) == set(rules)


def test_clean_stays_junk_goes_and_shapes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = q.judge_documents(docs).collect()
    long = [r for r in rows if not r["base_failed"]]
    assert all(r["kept"] == (r["quality"] == 1) for r in long) and len(long) > 20
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(HARD)] * 2, "doc_id long, text string, kept int, row int")
    got = q.judge_documents(df)
    assert got.columns == ["doc_id", "text", "row", *q.RESULTS] and got.count() == 2 * len(HARD)
    assert q.judge_documents(df.limit(0)).collect() == []


def test_shared_work_counts_once_and_order_can_be_given(spark):
    import time

    def split(d):
        time.sleep(0.003)
        return d.words

    rules = {"a_lines": lambda d: len(d.lines) == 1, "b_lines": lambda d: len(d.lines) == 2, "c_sleep": lambda d: bool(split(d)) and len(d.words) == 5}
    df = spark.createDataFrame([(i, ["one", "two\nlines", "three\nl\nx", "a b c d e\n\n"][i % 4]) for i in range(80)], "doc_id long, text string")
    assert q.order_rules(df, rules)[-1] == "c_sleep"
    got = q.judge_documents(df, order=["symbols", "few_words"]).collect()
    assert {r["rejected_by"] for r in got} == {"few_words"}
    hot = spark.createDataFrame([(i, "same text") for i in range(3000)], "doc_id long, text string")
    assert set(q.order_rules(hot, rules, sample_rows=50)) == set(rules)


def test_measures_time_themselves_without_what_they_use():
    doc = q.Timed("a b c a b c")
    assert doc.n_repeat_words == 6 and set(doc.spent) == {"n_repeat_words", "ids", "words", "n_words"} and all(x >= 0 for x in doc.spent.values())
    assert abs(sum(doc.spent.values()) - doc.within[0]) < 1e-6
