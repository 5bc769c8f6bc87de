"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic documents (P) and unlabelled text (U): documents without a label. With
class prior pi, the risk is pi R_P(+) + max(0, R_U(-) - pi R_P(-)); where the second part turns negative, the step goes
against it, which keeps the classifier from fitting U. The prior is a parameter; left out, it is the share of confirmed rows
among the labelled ones. Known negatives are used for nothing else.

Features are words and word beginnings of 4 to 7 letters, by their share of the document's words; from all those in the
sample, the ``features`` that tell P from U best (likelihood ratio) are kept. P and U are bounded samples, ``sample_rows``
each at most, drawn by hash. The score is shifted so that 0.7 is the middle of the widest gap between outputs on U that
leaves between half and twice the prior above it. Every document is scored on its whole text.

Only rows whose crc32(doc_id as text) mod 3 isn't 1 are learnt from. Defined cases: a null doc_id counts as the text '';
null and empty texts get the score of no feature; a null label is unlabelled; rows that repeat score alike; without any
confirmed toxic row every score is 0; an empty table gives an empty result; other columns pass through, and a column named
like a result is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.llm.common import Recent, materialise, sliced

RESULTS = ("held_out", "score", "predicted")
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 150_000
#: Features that a task counts before it hands the counts on.
COUNTED = 300_000
#: Bytes of text that a step takes from a batch at once.
TAKEN = 1 << 21


def words(text: str | None) -> Counter:
    return Counter(LETTERS.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6, 7) if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float


def values(counts: Counter, index: dict[str, int], known: Recent) -> dict[int, float]:
    """Value of each feature that the document has. known: cache of the features of a word."""
    total, found = max(1, counts.total()), Counter()
    known.trim()
    for w, n in counts.items():
        try:
            hit = known[w]
        except KeyError:
            hit = known[w] = tuple([index[f] for f in features_of(w) if f in index])
        for k in hit:
            found[k] += n
    return {k: min(1.0, (40 * n / total) ** 0.5) for k, n in found.items()}


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, positive) -> feature, p, u: in how many documents of either sample it stands, for each part of the input."""
    p, u = Counter(), Counter()
    for batch in (part for whole in batches for part in sliced(whole, whole.schema.names[0], TAKEN)):
        for text, confirmed, plain in zip(*(c.to_pylist() for c in batch.columns)):
            seen = {f for w in words(text) for f in features_of(w)}
            if confirmed:
                p.update(seen)
            if plain:
                u.update(seen)
        if len(u) + len(p) > COUNTED:
            yield from flushed(p, u)
    yield from flushed(p, u)


def flushed(p: Counter, u: Counter) -> Iterator[pa.RecordBatch]:
    names = list(p.keys() | u.keys())
    yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "p": pa.array([p[x] for x in names], pa.int64()), "u": pa.array([u[x] for x in names], pa.int64())})
    p.clear()
    u.clear()


def likelihood_ratio(p: Column, u: Column, all_p: int, all_u: int) -> Column:
    def log_likelihood(k: Column, n: Column, rate: Column) -> Column:
        return F.when(k > 0, k * F.log(rate)).otherwise(0.0) + F.when(n > k, (n - k) * F.log1p(-rate)).otherwise(0.0)

    np_, nu = F.lit(float(all_p)), F.lit(float(all_u))
    return log_likelihood(p, np_, p / np_) + log_likelihood(u, nu, u / nu) - log_likelihood(p + u, np_ + nu, (p + u) / (np_ + nu))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def outputs(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """In the precision of x: a product of mixed ones would copy x each time."""
    return x @ theta[:-1].astype(x.dtype, copy=False) + theta[-1]


def beyond(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """R_U(-) - pi R_P(-) of the outputs."""
    return np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def risk(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with the logistic loss: pi R_P(+), and R_U(-) - pi R_P(-), which the minimum keeps from going below zero."""
    zp, zu = outputs(theta, xp), outputs(theta, xu)
    return prior * np.logaddexp(0, -zp).mean(), beyond(zp, zu, prior)


def direction(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of both parts where the second is positive; elsewhere minus that of the second, which takes the step back."""
    zp, zu = outputs(theta, xp), outputs(theta, xu)
    sp, su = sigmoid(zp), sigmoid(zu)
    unlabelled, shared = su / len(su), -prior * sp / len(sp)  # gradients of R_U(-) and -pi R_P(-) by the output
    if beyond(zp, zu, prior) >= 0:
        gp, gu = prior * (sp - 1) / len(sp) + shared, unlabelled
    else:
        gp, gu = -shared, -unlabelled
    return np.append(gp.astype(xp.dtype, copy=False) @ xp + gu.astype(xu.dtype, copy=False) @ xu, gp.sum() + gu.sum())


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam steps on all rows."""
    theta = np.zeros(xp.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = direction(theta, xp, xu, prior) + ridge * np.append(theta[:-1], 0.0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def prior_threshold(z: np.ndarray, prior: float) -> float:
    """The middle of the widest gap between neighbouring outputs of U that leaves between half and twice the prior above it."""
    z = np.sort(z)[::-1]
    low, high = int(prior * len(z) / 2), int(min(len(z) - 2, np.ceil(2 * prior * len(z))))
    if high < low:
        return float(z[-1]) - 1.0
    k = low + int((z[low : high + 1] - z[low + 1 : high + 2]).argmax())
    return float(z[k] + z[k + 1]) / 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, features: int = 1024, seed: int = 5, prior: float | None = None) -> Model:
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("id")) & F.col("id").isNotNull())
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    labelled = labels.filter(F.col("toxic").isNotNull()).select(F.col(id_col).alias("id"))
    drawn = F.xxhash64(F.lit(seed), "id")
    confirmed = known.filter("toxic = 1").orderBy(drawn, "id").limit(sample_rows).select("id", F.lit(True).alias("p"))
    plain = ids.join(labelled, "id", "left_anti").distinct().orderBy(drawn, "id").limit(sample_rows)
    plain = materialise(plain.select("id", F.lit(False).alias("p")), "pu-unlabelled")
    if not plain.limit(1).count():  # every document has a label: U is drawn from all, their labels not looked at
        plain = ids.distinct().orderBy(drawn, "id").limit(sample_rows).select("id", F.lit(False).alias("p"))
    chosen = confirmed.unionByName(plain).groupBy("id").agg(F.max("p").alias("p"), F.max(~F.col("p")).alias("u"))
    # at most 2 * sample_rows ids, so the broadcast is bounded
    sample = materialise(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id"), "pu-sample")
    if prior is None:
        prior = known.agg(F.avg((F.coalesce("toxic", F.lit(0)) == 1).cast("double"))).first()[0]
    all_p, all_u = sample.agg(F.sum(F.col("p").cast("long")), F.sum(F.col("u").cast("long"))).first()
    if not all_p or not all_u or prior >= 1:
        return Model({}, np.zeros(0), -1e9)
    told = sample.select("text", "p", "u").mapInArrow(counted, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    told = told.filter((F.col("p") >= 3) & (F.col("p") / F.lit(float(all_p)) > 2 * F.col("u") / F.lit(float(all_u))))
    best = told.select("feature", likelihood_ratio(F.col("p"), F.col("u"), all_p, all_u).alias("g")).orderBy(F.desc("g"), "feature").limit(features).collect()
    index = {r["feature"]: k for k, r in enumerate(best)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Recent(CACHED_WORDS)
        for batch in (part for whole in batches for part in sliced(whole, "text", TAKEN)):
            found = [values(words(t), index, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.float32()))], names=["p", "u", "at", "value"])

    # at most 2 * sample_rows rows, each with the few features that it has
    rows = sample.select("text", "p", "u").mapInArrow(sparse, "p boolean, u boolean, at array<int>, value array<float>").toArrow()
    x = np.zeros((rows.num_rows, len(index)), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"].to_pylist(), rows["value"].to_pylist())):
        x[k, at] = value
    p, u = (rows[c].to_numpy().astype(bool) for c in ("p", "u"))
    order = np.argsort(x @ np.linspace(1, 2, x.shape[1], dtype=np.float32), kind="stable")  # sums don't depend on the order of arrival
    x, p, u = x[order], p[order], u[order]
    prior = min(0.99, max(1e-4, prior))
    weights, bias = fit_nnpu(x[p], x[u], prior)
    at = prior_threshold((x @ weights + bias)[u], prior)
    return Model(index, weights, bias - at + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Recent(CACHED_WORDS)
        for batch in (part for whole in batches for part in sliced(whole, "scored_text", TAKEN)):
            at = batch.schema.get_field_index("scored_text")
            out = []
            for text in batch.column(at).to_pylist():
                found = values(words(text), model.index, cache)
                out.append(model.bias + sum(model.weights[k] * v for k, v in found.items()))
            rest = batch.drop_columns(["scored_text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sigmoid(np.array(out, float)) if model.index else np.zeros(len(out)))], names=[*rest.schema.names, "score"])

    return score


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns of ``carry``) with held_out, score and predicted."""
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    rows = docs.select(F.struct(*carried).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("scored_text"))
    out = rows.mapInArrow(scored(model), T.StructType([rows.schema["row"], rows.schema["id"], T.StructField("score", T.DoubleType())]))
    return out.select("row.*", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with the columns of docs."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return score_documents(whole, model, "id", carry=["whole"]).filter("predicted = 0").select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs.select("doc_id", "text"), train(docs, labels), carry=["doc_id"])
