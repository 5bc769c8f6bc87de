"""Quality rules as a short-circuit cascade.

Each rule looks at one document and may reject it; a document is kept if no rule rejects it, so the order of the rules
changes the cost and not the verdict. A sample of rows estimates what each rule costs and how many it rejects, each on the
documents that the rules before it let through; work that rules share (splitting words) counts for the first of them only.
Rules then run by rejections per second, best first, and a document leaves at its first rejection. The sample is drawn by row,
about ``sample_rows`` and at most twice as many, and it only orders the rules: every document is judged on its whole text.

Rules (their thresholds are parameters): too few words, repeated three-word windows, mean word length, symbols per word,
repeated lines, words without a letter, bars between words, shouting (words in capitals only), one word over and over.

Defined cases: null text has no words, fails the base rules and is not kept; ties in rejections per second go by rule
name; rows that repeat are judged alike; an empty table gives an empty result; other columns pass through, and a column
named like a result is replaced by it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "kept", "rejected_by")
WORD = re.compile(r"[^ \t\n\v\f\r]+")
LETTER = re.compile(r"[^\W\d_]")


class Text:
    """One document; each measure is worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        seen: dict[str, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words < 4:
            return 0
        kinds = int(self.ids.max()) + 1
        pair = self.ids[:-1] * kinds + self.ids[1:]
        if kinds > 2_000_000:  # the next product would leave 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * kinds + self.ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : k + len(window)] |= twice
        return int(covered.sum())

    @cached_property
    def most_common(self) -> int:
        return int(np.bincount(self.ids).max()) if self.n_words else 0


Rule = Callable[[Text], bool]


def default_rules(min_words: int = 50, repeat_percent: int = 50, shortest: int = 2, longest: int = 12, symbols_percent: int = 30, dup_lines_percent: int = 50, letters_percent: int = 60, bars_percent: int = 15, capitals_percent: int = 60, common_percent: int = 50) -> dict[str, Rule]:
    """name -> True if the document is rejected."""
    return {
        "few_words": lambda d: d.n_words < min_words,
        "repeated_windows": lambda d: 100 * d.n_repeat_words > repeat_percent * d.n_words,
        "word_length": lambda d: not shortest * d.n_words <= d.word_chars <= longest * d.n_words,
        "symbols": lambda d: 100 * d.n_symbols > symbols_percent * d.n_words,
        "repeated_lines": lambda d: 100 * d.n_dup_lines > dup_lines_percent * len(d.lines),
        "letters": lambda d: 100 * sum(w[0].isalpha() or LETTER.search(w) is not None for w in d.words) < letters_percent * d.n_words,
        "bars": lambda d: 100 * d.text.count("|") > bars_percent * d.n_words,
        "capitals": lambda d: 100 * sum(map(str.isupper, d.words)) > capitals_percent * d.n_words,
        "one_word": lambda d: 100 * d.most_common > common_percent * d.n_words,
    }


BASE = ("few_words", "repeated_windows")


class Timed(Text):
    """A text that notes the seconds of each measure without those of the measures that it uses."""

    def __init__(self, text: str | None):
        super().__init__(text)
        self.spent: dict[str, float] = {}
        self.within = [0.0]  # of each measure that is being worked out: the seconds of the measures that it uses


def timed(name: str) -> cached_property:
    work_out = getattr(Text, name).func

    def get(doc: Timed):
        began = time.perf_counter()
        doc.within.append(0.0)
        value = work_out(doc)
        took = time.perf_counter() - began
        doc.spent[name] = took - doc.within.pop()
        doc.within[-1] += took
        return value

    return cached_property(get)


MEASURES = tuple(name for name, x in vars(Text).items() if isinstance(x, cached_property))
for _name in MEASURES:
    setattr(Timed, _name, timed(_name))
    getattr(vars(Timed)[_name], "__set_name__")(Timed, _name)


def measured(rules: dict[str, Rule]):
    """For each set of rules that reject a sampled document: documents (of ""), and seconds of each rule alone and of each measure that it uses."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, str, str], float] = {}
            for text in batch.column(0).to_pylist():
                mask, spent = 0, {}
                for k, (name, rule) in enumerate(rules.items()):
                    doc = Timed(text)
                    began = time.perf_counter()
                    mask |= bool(rule(doc)) << k
                    spent[name, ""] = time.perf_counter() - began - doc.within[0]
                    spent |= {(name, m): x for m, x in doc.spent.items()}
                for (name, m), x in [*spent.items(), (("", ""), 1.0)]:
                    out[mask, name, m] = out.get((mask, name, m), 0.0) + x
            yield pa.RecordBatch.from_pydict({"mask": pa.array([k[0] for k in out], pa.int64()), "rule": pa.array([k[1] for k in out], pa.string()), "measure": pa.array([k[2] for k in out], pa.string()), "n": pa.array(list(out.values()), pa.float64())})

    return measure


def order_rules(docs: DataFrame, rules: dict[str, Rule], text_col: str = "text", sample_rows: int = 2000, seed: int = 3) -> list[str]:
    """Rule names by rejections per second, each on what the rules before it let through; a measure that an earlier rule worked out costs nothing."""
    total = docs.count()
    sample = docs.select(text_col).sample(min(1.0, sample_rows / max(1, total)), seed).limit(2 * sample_rows)
    found = sample.mapInArrow(measured(rules), "mask long, rule string, measure string, n double").groupBy("mask", "rule", "measure").agg(F.sum("n").alias("n")).collect()  # at most a set of rules per sampled row
    bit = {name: 1 << k for k, name in enumerate(rules)}
    order: list[str] = []
    known: set[str] = set()
    past = 0
    while len(order) < len(rules):
        cost, hits = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0.0)
        for r in found:
            if r["mask"] & past:
                continue
            if not r["rule"]:
                for x in rules:
                    hits[x] += r["n"] * bool(r["mask"] & bit[x])
            elif r["measure"] not in known:
                cost[r["rule"]] += r["n"]
        best = min((x for x in rules if x not in order), key=lambda x: (-hits[x] / max(cost[x], 1e-9), cost[x] if not hits[x] else 0, x))
        known |= {r["measure"] for r in found if r["rule"] == best and r["measure"]}
        past |= bit[best]
        order.append(best)
    return order


def judged(rules: dict[str, Rule], order: list[str], counts: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ((*COUNTS, "rejected_by") if counts else ("rejected_by",))}
            for text in batch.column(batch.schema.get_field_index("judged_text")).to_pylist():
                doc = Text(text)
                out["rejected_by"].append(next((name for name in order if rules[name](doc)), None))
                if counts:  # measures that the rules worked out are there already
                    for x in COUNTS:
                        out[x].append(getattr(doc, x))
            keep = batch.drop_columns(["judged_text"])
            types = {"rejected_by": pa.string()}
            yield pa.RecordBatch.from_arrays([*keep.columns, *(pa.array(v, types.get(k, pa.int64())) for k, v in out.items())], names=[*keep.schema.names, *out])

    return judge


def judge_documents(docs: DataFrame, text_col: str = "text", counts: bool = True, sample_rows: int = 2000, carry: list[str] | None = None, order: list[str] | None = None, **thresholds) -> DataFrame:
    """docs (or the columns of ``carry``) with the counts, base_failed, kept and rejected_by, the first rule that rejected the document.

    Measured seconds differ between runs, so the order and ``rejected_by`` may: a rerun that must agree passes the ``order`` of the first.
    """
    rules = default_rules(**thresholds)
    order = order or order_rules(docs, rules, text_col, sample_rows)
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    rows = docs.select(F.struct(*carried).alias("row"), F.col(text_col).alias("judged_text"))
    added = [*(T.StructField(x, T.LongType()) for x in COUNTS if counts), T.StructField("rejected_by", T.StringType())]
    out = rows.mapInArrow(judged(rules, order, counts), T.StructType([rows.schema["row"], *added]))
    base = [((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed")] if counts else []
    return out.select("row.*", *(COUNTS if counts else ()), *base, F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_documents(docs, carry=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
t3 AS (SELECT doc_id, pos, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM t3 WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, word, count(*) AS n FROM p GROUP BY ALL) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '\pL'))) AS lettered, length(regexp_replace(t, '[^|]', '', 'g')) AS bars,
    len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) AS capitals, coalesce(most, 0) AS most
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 100 * n_symbols > 30 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR 100 * lettered < 60 * n_words OR 100 * bars > 15 * n_words OR 100 * capitals > 60 * n_words OR 100 * most > 50 * n_words) AS kept
FROM c
"""
