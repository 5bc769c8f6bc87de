"""Registered queries over the driver tables: name -> (spark, sf_dir) -> DataFrame, and the SQL that must agree."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where SQL can express it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def flagship(spark, sf_dir):
    return QUERIES["indicators_features"](spark, sf_dir)


from quantframe.jobs import model_queries, portfolio_queries, queries, run_queries  # noqa: E402, F401  they register their functions
