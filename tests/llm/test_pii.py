import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quantframe.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        x = [int(c) for c in d[::-1]]
        return 13 <= len(d) <= 19 and (sum(x[0::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=list("aZ09.@+-%_ ()é\n1234,"), max_size=60) | st.lists(st.sampled_from(["a.b@c.de", "@", "x@y", "1.2.3.4", "999.1.1.1", ".", "4539 1488 0343 6467", "4111111111111111", "+1 (651) 555-8500", "+", " ", "-", "0000.1.2.3", "5"]), max_size=12).map("".join))
def test_patterns_match_brute_force(text):
    assert pii.base_spans(text) == brute(text)


def test_patterns_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1(" * 100_000, "1 " * 150_000, "a@" * 100_000):
        pii.base_spans(text)
    assert time.time() - began < 8


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_query_base_and_terms(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        b = brute(docs[r["doc_id"]])
        n = Counter(k for k, _, _ in b)
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == tuple(n[k] for k in pii.KINDS) and r["base_sha256"] == digest(b)
        text = docs[r["doc_id"]] or ""
        secrets = [("secret", *m.span()) for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", text) if len(re.findall("[0-9]", m[0])) > 3 and len(re.findall("[A-Za-z]", m[0])) > 3 and -sum(n / len(m[0]) * math.log2(n / len(m[0])) for n in Counter(m[0]).values()) > 3]
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert r["spans"].startswith(",".join(f"{k}:{s}:{e}" for k, s, e in b)) and (b or secrets or not r["spans"]) and r["n_spans"] == len(spans)
        assert [(k, int(s), int(e)) for k, s, e in spans if k == "secret"] == secrets


def measured(texts, support, group_support):
    """Brute force: (entity, term) -> share, over whole documents."""
    words, names = [], []
    for t in texts:
        spans = pii.base_spans(t or "") + pii.secret_spans(t or "")
        names.append({x for k, s, e in spans for x in pii.entities_of(k, t[s:e])})
        words.append({m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", t or "") if not any(m.start() < e and s < m.end() for _, s, e in spans)})
    anywhere = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", t or "")} for t in texts]
    n_t, n_e, n_te = Counter(w for x in anywhere for w in x), Counter(e for x in names for e in x), Counter((e, w) for x, y in zip(names, words) for e in x for w in y)
    n = len(texts)
    shares = {p: math.log(n * k / (n_t[p[1]] * n_e[p[0]])) / math.log(n / n_e[p[0]]) for p, k in n_te.items() if n_e[p[0]] < n and k >= (group_support if re.match("[a-z]+/", p[0]) else support)}
    return {p: x for p, x in shares.items() if x >= 0.8}, names, words


def test_terms_of_groups_and_kinds_act_on_the_tables(spark, sf_dir):
    """On the given tables no value stands in three documents, but kinds do: the whole result against brute force."""
    rows = sorted(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect())
    df = spark.createDataFrame([(r["doc_id"], r["text"], 1, 2) for r in rows], "doc_id long, text string, base int, terms int")
    told, names, words = measured([r["text"] for r in rows], 3, 5)
    assert ("secret/", "token") in told
    got = pii.report_documents(df, group_support=5)
    assert got.columns == ["doc_id", "text", "base", "terms", *pii.RESULTS]
    masks = 0
    for r, x, y in zip(got.sort("doc_id").collect(), names, words):
        terms = {w for e, w in told if e in x and w in y}
        places = {(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", r["text"] or "") if m[0].lower() in terms}
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        found = {(int(s), int(e)) for k, s, e in spans if k in pii.ACTIONS}
        assert found <= places and {(r["text"] or "")[s:e].lower() for s, e in found} == terms
        masks += len(found)
    assert masks > 10


def test_terms_that_reveal_an_entity(spark):
    texts = [f"write to jane.doe@mail.example.com or ask Quillfeather there, number {i}" for i in range(4)] + [f"there is other text {i} about nothing to ask" for i in range(60)] + ["Quillfeather alone"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    found = pii.find_base(df, "text", ["doc_id"])
    told = {(r["entity"], r["term"]): r for r in pii.disclosures(df, found, "text", 3, 0.8, 0.95).collect()}
    # brute force of the measure
    n, n_e = 65, 4
    for term in ("quillfeather", "write", "there", "number"):
        n_t, n_te = sum(term in t.lower() for t in texts), 4
        share = math.log(n * n_te / (n_t * n_e)) / math.log(n / n_e)
        r = told.get(("email:jane.doe@mail.example.com", term))
        assert (r is not None) == (share >= 0.8) and (r is None or (abs(r["share"] - share) < 1e-9 and r["action"] == ("remove" if share >= 0.95 else "generalise")))
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "jane" not in out[0] and "<EMAIL>" in out[0] and "Quillfeather" not in out[0] and "there" in out[0]
    assert out[64] == texts[64] and out[10] == texts[10]


def test_terms_far_from_the_entity_and_in_other_documents(spark):
    mail, far = "jane.doe@mail.example.com", " ".join(f"filler{'abcdefghij'[k % 10]} is" for k in range(40))
    texts = [f"{mail} {far} Quillfeather said, number {i}, quillfeather too; Öljyvär {far} Öljyvär" for i in range(4)] + [f"there is other text {i} {far}" for i in range(60)] + ["Quillfeather alone", "an öljyvär", "öljyvär", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = [set(w.lower() for w in re.findall(r"[^\W\d_]{4,}", (t or "").replace(mail, ""))) for t in texts]
    want = {}
    for term in set.union(*words):  # brute force over whole documents
        n_t, n_te = sum(term in w for w in words), sum(term in w and mail in t for w, t in zip(words, texts) if t)
        share = math.log(len(texts) * n_te / (n_t * 4)) / math.log(len(texts) / 4) if n_te >= 3 else 0
        if share >= 0.8:
            want[term] = "remove" if share >= 0.95 else "generalise"
    assert {"quillfeather", "öljyvär"} <= set(want) and "there" not in want and not any(t.startswith("filler") for t in want)
    for everywhere in (False, True):
        for r in pii.find_personal_data(df, everywhere=everywhere).collect():
            t = r["text"] or ""
            places = [(want[m[0].lower()], *m.span()) for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in want and m.start() >= len(mail) * (mail in t)]
            assert [tuple(s) for s in r["terms"]] == (sorted(places) if everywhere or mail in t else [])
    assert [r["text"] for r in pii.sanitise(df, everywhere=True).filter("doc_id >= 64").sort("doc_id").collect()] == [masked_alone(want["quillfeather"], "Quillfeather", " alone"), "an " + masked_alone(want["öljyvär"], "öljyvär", ""), masked_alone(want["öljyvär"], "öljyvär", ""), None]


def masked_alone(action, word, rest):
    return ("" if action == "remove" else "".join("X" if c.isupper() else "x" for c in word)) + rest


def test_shapes(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "a@b.co", 1), (3, "word " * 40000 + "a@b.co", 1)], "doc_id long, text string, spans int")
    got = pii.report(pii.find_personal_data(df))
    assert got.columns == ["doc_id", "text", *pii.RESULTS]
    assert sorted(((r["n_email"], r["spans"]) for r in got.collect())) == [(0, ""), (0, ""), (0, ""), (1, "email:0:6"), (1, "email:200000:200006")]
    assert pii.report(pii.find_personal_data(df.limit(0))).collect() == []
    assert pii.sanitise(df).columns == df.columns


def test_terms_too_frequent_to_reveal_anything_are_not_counted_everywhere(spark):
    """They are out by a part of the documents, the result is that of brute force, and a task writes a term once however many batches it has."""
    mail = "jane.doe@mail.example.com"
    texts = [f"{mail} asks Quillfeather about common matters today, number {i} {'rarely' if i < 8 else ''}" for i in range(12)] + [f"common matters of today {i}" for i in range(600)] + [f"rarely {i}" for i in range(9)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = pii.find_base(df, "text", ["doc_id"])
    for generalise in (0.8, 0.3, 0.0):
        want, _, _ = measured(texts, 3, 5)
        words = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", t.replace(mail, ""))} for t in texts]
        share = lambda w: math.log(len(texts) * sum(w in x for x in words[:12]) / (sum(w in x for x in words) * 12)) / math.log(len(texts) / 12)
        told = {(r["entity"], r["term"]): r["share"] for r in pii.disclosures(df, found, "text", 3, generalise, 0.95, 5).collect()}
        terms = {w for w in set.union(*words[:12]) if sum(w in x for x in words[:12]) >= 5 and share(w) >= generalise}
        assert {t for e, t in told if e == "email/"} == terms and all(abs(v - share(t)) < 1e-9 for (_, t), v in told.items())
        assert generalise != 0.8 or set(told) == set(want)
    n_te = spark.createDataFrame([("email/", t, 12, 12) for t in ("common", "matters", "quillfeather")], "entity string, term string, n_te long, n_e long")
    assert {r["term"] for r in pii.possible_terms(df, n_te, "text", len(texts), 0.8).collect()} == {"quillfeather"}
    batch = pa.record_batch([pa.array(texts[12:])], names=["text"])
    out = list(pii.counted(np.full(1024, 2**64 - 1, np.uint64))(iter([batch] * 5)))
    assert sum(b.num_rows for b in out) == 4 and {r["n"] for b in out for r in b.to_pylist()} == {3000, 45}
