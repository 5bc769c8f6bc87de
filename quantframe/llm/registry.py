"""The queries opN_<name> over the whole driver tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


from quantframe.llm import exact_dedup, hard_negatives, line_dedup, mixing, near_dedup, packing, pii, quality_cascade, ranked_search, sharding, suffix_dedup, toxicity, warc  # noqa: E402

_add("op1_sharding", sharding.query)
_add("op9_exact_dedup", exact_dedup.query, exact_dedup.ORACLE)
_add("op10_mixing", mixing.query)
_add("op4_quality_cascade", quality_cascade.query, quality_cascade.ORACLE)
_add("op7_packing", packing.query)
_add("op3_warc", warc.query, warc.ORACLE)
_add("op6_toxicity", toxicity.query)
_add("op2_near_dedup", near_dedup.query)
_add("op5_pii", pii.query)
_add("op8_suffix_dedup", suffix_dedup.query)
_add("op11_ranked_search", ranked_search.query, ranked_search.ORACLE)
_add("op12_line_dedup", line_dedup.query, line_dedup.ORACLE)
_add("op13_hard_negatives", hard_negatives.query, hard_negatives.ORACLE)
