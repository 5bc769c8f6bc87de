"""Personal data: patterns, and information-theoretic sanitisation of the terms that give it away.

1. Patterns find e-mail addresses, IP addresses, card and phone numbers in every whole text, and long tokens of high entropy
   are secrets. Protected entities are each value, its group (mail domain, address block, number prefix) and its kind.
2. Terms (letters only, at least MIN_LETTERS) anywhere in a document of an entity are candidates. Over all documents,
   n(e), n(t, e) and n(t) give how strongly a term reveals an entity: its pointwise mutual information with the entity as
   a share of the entity's information, log(N n(t,e) / n(t) n(e)) / log(N / n(e)). 1 says that who sees the term can
   tell the entity.
3. Candidates with at least ``support`` documents in common (``group_support`` with a group or kind, so that chance
   doesn't count) and a share over ``generalise`` are generalised to their shape
   at each of their places in every document of that entity; over ``remove`` they are removed. With ``everywhere``, this
   holds for every place in any document, also where the entity is not written.

n(t, e) is counted in each task first, for entities in at least ``support`` documents (no other can have that many in
common). n(t) is counted over all documents, for candidate terms that may still reach ``generalise``: n(t) of a term must
not be over the largest n(t, e) (N / n(e)) ^ (1 - generalise) of its entities, so one that is over it in an eighth of the
documents already is out, without any change of the result. A Bloom filter of at most 8 MB lets each pass drop
other entities, words or pairs early; what it lets through by chance is dropped by the count or the join that follows.

Defined cases: null text counts as empty; terms inside a pattern's span are no candidates; equal spans count once, the
stronger action wins; rows that repeat each count as documents; an entity in all documents reveals nothing; an empty table
gives an empty result; other columns pass through, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.bloom import build_filter, in_filter
from quantframe.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
SECRET = "secret"
COUNTS = tuple(f"n_{k}" for k in KINDS)
RESULTS = (*COUNTS, "base_sha256", "spans", "n_spans")
MIN_LETTERS = 4
CACHED_WORDS = CACHED_PAIRS = 300_000
#: A pair with over 1/HOT of all places' rows is hot; fewer than HOT can be.
HOT = 1000
#: One in so many documents, by hash, is counted first: most terms are too frequent there already.
FIRST = 8

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
# a match can only start where its run of digits does, and takes whole runs: no try is repeated from inside a run
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}+")
TERM = re.compile(rf"[^\W\d_]{{{MIN_LETTERS},}}")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.tld: from each @ to the left over local characters, so that time is linear."""
    end, before, at = 0, -1, text.find("@")
    while at >= 0:
        if at >= end:
            start = max(end, before + 1)
            run = at - start - len(text[start:at].rstrip(LOCAL))
            found = DOMAIN.match(text, at + 1) if run else None
            if found:
                end = found.end()
                yield at - run, end
        before, at = at, text.find("@", at + 1)


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (d > "4") for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind, then start; in code points."""
    spans = [("email", *s) for s in emails(text)]
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return spans


def entropy(token: str) -> float:
    """Bits per character, by the token's own character counts."""
    return sum(n / len(token) * math.log2(len(token) / n) for n in Counter(token).values())


def secret_spans(text: str) -> list[Span]:
    """Long tokens that look drawn at random: four digits and four letters at least, and over 3 bits per character."""
    if not DIGIT.search(text):
        return []
    return [(SECRET, *m.span()) for m in TOKEN.finditer(text) if sum(map(str.isdigit, m[0])) >= 4 and sum(map(str.isalpha, m[0])) >= 4 and entropy(m[0]) > 3]


def entities_of(kind: str, value: str) -> tuple[str, ...]:
    """What is protected: the value (kind:value), the group that it belongs to (kind/group) and its kind (kind/)."""
    if kind == "email":
        return f"email:{value.lower()}", f"email/{value.lower().rpartition('@')[2]}", "email/"
    if kind == "ip":
        return f"ip:{value}", f"ip/{value.rpartition('.')[0]}", "ip/"
    if kind == SECRET:
        return f"secret:{value}", "secret/"
    digits = "".join(DIGIT.findall(value))
    return f"{kind}:{digits}", f"{kind}/{digits[: 6 if kind == 'card' else 4]}", f"{kind}/"


def terms_of(text: str, spans: list[tuple[int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Places of each term outside the spans (start, end)."""
    taken = sorted(spans)
    reach = list(accumulate((e for _, e in taken), max))  # the furthest end of the spans so far
    found: dict[str, list[tuple[int, int]]] = {}
    for m in TERM.finditer(text):
        k = bisect.bisect_left(taken, (m.end(),)) - 1
        if k < 0 or reach[k] <= m.start():
            found.setdefault(m[0].lower(), []).append(m.span())
    return found


PLACE = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *PLACE]))
ENTITIES = T.ArrayType(T.StringType())


def searched(whole: bool):
    """The function for mapInArrow: .., text -> .., base, secrets, entities, text: null without entities unless ``whole``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans: tuple[list, list] = ([], [])
            names, texts = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                both = base_spans(text or ""), secret_spans(text or "")
                for out, found in zip(spans, both):
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                names.append(sorted({x for found in both for k, s, e in found for x in entities_of(k, text[s:e])}))
                texts.append(text if names[-1] or whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, span_type) for x in spans), pa.array(names, pa.list_(pa.string())), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "base", "secrets", "entities", "text"])

    return search


def find_base(docs: DataFrame, text_col: str, carried: list[str], whole: bool = False) -> DataFrame:
    """row, uid, base, secrets, entities, text (of documents with entities, or of all): a table with a row per document."""
    rows = docs.select(F.struct(*carried).alias("row"), F.col(text_col).alias("searched_text"))
    out = rows.mapInArrow(searched(whole), T.StructType([rows.schema["row"], T.StructField("base", SPANS), T.StructField("secrets", SPANS), T.StructField("entities", ENTITIES), T.StructField("text", T.StringType())]))
    return materialise(out.withColumn("uid", F.monotonically_increasing_id()), "pii-base")


def hashed(term: str) -> int:
    return xxhash.xxh64_intdigest(term)


def counted(bits: np.ndarray):
    """The function for mapInArrow: texts -> term, n: the documents of each part that have a term the filter may hold."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = {t.lower() for t in TERM.findall(text or "")}
                fresh = [t for t in terms if t not in known]
                if fresh:
                    if len(known) > CACHED_WORDS:
                        known.clear()
                        fresh = list(terms)
                    h = np.fromiter(map(hashed, fresh), np.uint64, len(fresh))
                    known.update(zip(fresh, in_filter(bits, h).tolist()))
                seen.update(t for t in terms if known[t])
                if len(seen) > CACHED_WORDS:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return count


def term_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"h": pa.array(np.fromiter(map(hashed, terms), np.uint64, len(terms)).view(np.int64))})


def may_have(bits: np.ndarray, keys: list[str]) -> list[str]:
    """The keys that the filter may hold."""
    hit = in_filter(bits, np.fromiter(map(hashed, keys), np.uint64, len(keys)))
    return [k for k, h in zip(keys, hit.tolist()) if h]


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, list[str], list[tuple[int, int]]]]:
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            yield r[0], r[1], r[2], [(s["start"], s["end"]) for s in r[3]]


def paired(bits: np.ndarray):
    """The function for mapInArrow: uid, text, entities, spans -> entity, term, n: the documents of each part that have both."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"entity": pa.array([e for e, _ in seen], pa.string()), "term": pa.array([t for _, t in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, text, names, spans in texts_of(batches):
            names = may_have(bits, names)
            terms = terms_of(text, spans) if names else ()
            for name in names:
                seen.update((name, t) for t in terms)
                if len(seen) > CACHED_PAIRS:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    return count


def placed(bits: np.ndarray, everywhere: bool):
    """The function for mapInArrow: uid, text, entities, spans -> uid, key, places of the keys (pairs or terms) that the filter may hold."""
    place_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"uid": pa.array([o[0] for o in out], pa.int64()), "key": pa.array([o[1] for o in out], pa.string()), "places": pa.array([[{"start": s, "end": e} for s, e in o[2]] for o in out], place_type)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for uid, text, names, spans in texts_of(batches):
            terms = terms_of(text, spans)
            for name in [""] if everywhere else names:
                out += [(uid, k, terms[k[len(name) + 1 :]]) for k in may_have(bits, [f"{name}\0{t}" for t in terms])]
                if len(out) > 10_000:
                    yield rows(out)
                    out = []
        yield rows(out)

    return place


def documents_with(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n_t: the number of texts that have the term, for ``terms`` and a few that the filter lets through."""
    bits = build_filter(terms.mapInArrow(term_hashes, "h long"))
    return texts.mapInArrow(counted(bits), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def possible_terms(docs: DataFrame, pairs: DataFrame, text_col: str, total: int, generalise: float) -> DataFrame:
    """The terms whose share may reach ``generalise`` with one of their entities, by their number in a part of the documents: n_t can only be larger."""
    never = 0.0 if generalise > 0 else math.inf  # the share of an entity in all documents is 0
    most = F.when(F.col("n_e") < total, F.col("n_te") * F.pow(F.lit(float(total)) / F.col("n_e"), F.lit(1.0 - generalise)) * (1 + 1e-9)).otherwise(F.lit(never))
    terms = materialise(pairs.groupBy("term").agg(F.max(most).alias("most")), "pii-candidates")
    some = docs.select(text_col).filter(F.pmod(F.xxhash64(text_col), F.lit(FIRST)) == 0)
    some = some.coalesce(max(some.sparkSession.sparkContext.defaultParallelism, some.rdd.getNumPartitions() // FIRST))  # tasks of the usual size
    return terms.join(documents_with(some, terms.select("term")), "term", "left").filter(F.coalesce("n_t", F.lit(0)) <= F.col("most")).select("term")


def disclosures(docs: DataFrame, found: DataFrame, text_col: str, support: int, generalise: float, remove: float, group_support: int = 20) -> DataFrame:
    """entity, term, share, action of the pairs that exceed a threshold, with n_te and n_t."""
    total = found.count()
    least = F.when(F.col("entity").rlike("^[a-z]+/"), group_support).otherwise(support)
    n_e = materialise(found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= least), "pii-entities")
    bits = build_filter(n_e.select("entity").mapInArrow(term_hashes, "h long"))
    pairs = found.filter(F.size("entities") > 0).select("uid", "text", "entities", F.concat("base", "secrets").alias("spans")).mapInArrow(paired(bits), "entity string, term string, n long")
    pairs = materialise(pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_te")).filter(F.col("n_te") >= least), "pii-pairs")
    terms = materialise(possible_terms(docs, pairs.join(n_e, "entity"), text_col, total, generalise), "pii-terms")
    n_t = documents_with(docs.select(text_col), terms)
    known = pairs.join(n_e, "entity").join(n_t.join(terms, "term", "left_semi"), "term")
    mutual = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.when(F.col("n_e") < total, mutual / F.log(F.lit(float(total)) / F.col("n_e"))).otherwise(0.0)
    action = F.when(share >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    return materialise(known.withColumn("share", share).filter(F.col("share") >= generalise).select("entity", "term", "share", action.alias("action"), "n_te", "n_t"), "pii-disclosures")


def find_places(found: DataFrame, told: DataFrame, everywhere: bool) -> DataFrame:
    """uid, start, end, kind (the action) of all places of the disclosing terms."""
    name = F.lit("") if everywhere else F.col("entity")
    keys = told.groupBy(F.concat(name, F.lit("\0"), F.col("term")).alias("key")).agg(F.max("action").alias("action"), F.max("n_t" if everywhere else "n_te").alias("n"))
    keys = materialise(keys, "pii-keys")
    bits = build_filter(keys.select("key").mapInArrow(term_hashes, "h long"))
    least = (keys.agg(F.sum("n")).first()[0] or 0) / HOT
    hot, cold = keys.filter(F.col("n") > least), keys.filter(F.col("n") <= least)
    places = found.filter(F.col("text").isNotNull() if everywhere else F.size("entities") > 0).select("uid", "text", "entities", F.concat("base", "secrets").alias("spans")).mapInArrow(placed(bits, everywhere), T.StructType([T.StructField("uid", T.LongType()), T.StructField("key", T.StringType()), T.StructField("places", T.ArrayType(T.StructType(PLACE)))]))
    places = places.join(F.broadcast(hot.select("key", F.col("action").alias("hot_action"))), "key", "left")
    # a hot row has its answer: a key of its own, without the zero that all others have, keeps it from meeting its like in one task
    places = places.withColumn("key", F.when(F.col("hot_action").isNull(), F.col("key")).otherwise(F.col("uid").cast("string"))).join(cold.select("key", "action"), "key", "left")
    places = places.withColumn("action", F.coalesce("hot_action", "action")).filter(F.col("action").isNotNull())
    return places.select("uid", "action", F.inline("places")).groupBy("uid", "start", "end").agg(F.max("action").alias("kind"))


def marked(docs: DataFrame, text_col: str, carried: list[str], support: int = 3, generalise: float = 0.8, remove: float = 0.95, everywhere: bool = False, group_support: int = 20) -> DataFrame:
    """row (of the carried columns), base and terms of each document."""
    found = find_base(docs, text_col, carried, everywhere)
    told = disclosures(docs, found, text_col, support, generalise, remove, group_support)
    hits = find_places(found, told, everywhere)
    terms = hits.groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("terms"))  # of one document
    added = F.array_sort(F.concat(F.coalesce("terms", F.array().cast(SPANS)), "secrets"))
    return found.select("uid", "row", "base", "secrets").join(terms, "uid", "left").select("row", "base", added.alias("terms"))


def find_personal_data(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """docs (or the columns of ``carry``) with base (pattern spans) and terms (spans of secrets, and of revealing terms: kind is the action)."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("base", "terms")]
    return marked(docs, text_col, carried, **options).select("row.*", "base", "terms")


def written_out(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def measures() -> list[Column]:
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.concat("base", "terms")
    return [*counts, F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans")]


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the pattern spans, all spans as text and their number, from find_personal_data."""
    return found.select(*[c for c in found.columns if c.lower() not in (*RESULTS, "base", "terms")], *measures())


def report_documents(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """docs (or the columns of ``carry``), columns named base or terms too, with what ``report`` gives."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    return marked(docs, text_col, carried, **options).select(F.col("row"), *measures()).select("row.*", *RESULTS)


def shape(word: str) -> str:
    return "".join("X" if c.isupper() else "x" for c in word)


def masked(text: str | None, spans) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            kind, word = s["kind"], text[s["start"] : s["end"]]
            out += [text[at : s["start"]], "" if kind == "remove" else shape(word) if kind == "generalise" else f"<{kind.upper()}>"]
            at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with its text sanitised: entities by their kind, terms generalised or removed."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).alias("text"))
    found = find_personal_data(whole, "text", carry=["whole", "text"], **options)
    mask = F.pandas_udf(lambda t, s: pd.Series([masked(x, y) for x, y in zip(t, s)], dtype=object), T.StringType())
    clean = mask("text", F.concat("base", "terms"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("whole")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report_documents(docs, carry=["doc_id"])
