"""Option strategies run over time: books whose next step depends on what they hold, as one sorted stream per key.

Rows are dealt by key, sorted by day within each task and streamed through a small state per key, so a key of any length needs
no more memory than a batch and its open legs. One key's steps follow from each other and stay in one task.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantframe.functions.windows import ordered
from quantframe.operators.performance import YEAR, safe


class Leg(NamedTuple):
    """A leg that each entry trades: its strike as a share of the spot price, its sign and its quotes."""

    kind: str
    strike: float
    sign: int
    bid: float
    ask: float
    volume: float


#: Strikes, signs and quotes of the two strategies.
CONDOR = [Leg("put", 0.90, 1, 0.50, 0.55, 100), Leg("put", 0.95, -1, 1.50, 1.55, 200), Leg("call", 1.05, -1, 1.50, 1.55, 200), Leg("call", 1.10, 1, 0.50, 0.55, 100)]
STRANGLE = [Leg("put", 0.95, -1, 2.00, 2.10, 150), Leg("call", 1.05, -1, 2.00, 2.10, 150)]


class Costs(NamedTuple):
    per_trade: float = 1.0
    per_contract: float = 0.65

    def fill(self, leg: Leg, n: int) -> tuple[float, float, float]:
        """Price, commission and slippage of n contracts at market: half the spread, and its share of the volume by the square root."""
        half = (leg.ask - leg.bid) / 2
        slip = half + half * math.sqrt(n / leg.volume) * 0.5
        price = max(0.01, leg.ask + slip if leg.sign > 0 else leg.bid - slip)
        return price, self.per_trade + n * self.per_contract, n * slip


def option_value(kind: str, strike: float, spot: float) -> float:
    """What the contract pays now, and a tenth of it, 0.05 at least, for the time left."""
    inner = max(0.0, spot - strike if kind == "call" else strike - spot)
    return inner + max(0.05, inner * 0.1)


class Book:
    """Cash and open legs of one portfolio; all legs last as long, so they leave in the order in which they came."""

    def __init__(self, capital: float, legs: list[Leg], days: int, costs: Costs):
        self.capital, self.legs, self.days, self.costs = capital, legs, days, costs
        self.open: deque[tuple] = deque()  # expiry, kind, strike, quantity

    def step(self, day: int, spot: float, enters: bool, share: float) -> tuple:
        """A day: mark, record, trade if it enters, then settle what expires. capital, value, total, leverage, legs traded, commission, slippage, open legs."""
        values = [q * option_value(kind, strike, spot) for _, kind, strike, q in self.open]
        value, gross = sum(values), sum(map(abs, values))
        total = self.capital + value
        row = [self.capital, value, total, gross / total if total > 0 else 0.0, 0, 0.0, 0.0]
        if enters:
            cost = sum(leg.ask if leg.sign > 0 else leg.bid for leg in self.legs)
            n = max(1, int(self.capital * share / cost)) if cost > 0 else 1
            for leg in self.legs:
                price, commission, slipped = self.costs.fill(leg, n)
                self.capital -= leg.sign * n * price + commission + slipped
                self.open.append((day + self.days, leg.kind, leg.strike * spot, leg.sign * n))
                row[4:7] = row[4] + 1, row[5] + commission, row[6] + slipped
        while self.open and self.open[0][0] <= day:
            _, kind, strike, q = self.open.popleft()
            self.capital += q * max(0.0, spot - strike if kind == "call" else strike - spot)
        return (*row, len(self.open))


CURVE = [("capital", "double"), ("position_value", "double"), ("total", "double"), ("leverage", "double"), ("legs_traded", "int"), ("commission", "double"), ("slippage", "double"), ("open_legs", "int")]


def rebalances(day: str, how: str) -> Column:
    """daily, weekly (Mondays) or monthly (the first of a month)."""
    return {"daily": F.lit(True), "weekly": F.weekday(day) == 0, "monthly": F.dayofmonth(day) == 1}[how]


def keyed_stream(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *by)


def by_key(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """A sorted batch's stretches of equal keys; null keys are equal to each other."""
    if len(batch):
        k = batch[keys]
        new = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()
        new[0] = True
        cuts = [*new.nonzero()[0], len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(None if pd.isna(v) else v for v in k.iloc[a]), batch.iloc[a:b]


def option_backtest(market: DataFrame, keys: list[str], day: str, spot: str, signal: str, legs: list[Leg] = CONDOR, capital: float = 100_000.0, share: float | Column = 0.1, rebalance: str = "monthly", days: int = 30, costs: Costs = Costs()) -> DataFrame:
    """keys, day, capital, position_value, total, leverage, legs_traded, commission, slippage, open_legs: each portfolio's curve.

    On a rebalance day with a signal over 0.5 the strategy's legs are traded, as many of each as ``share`` of the capital then left
    pays for, at quotes and costs that grow with the number. Open legs are marked each day and settle at what they pay from
    ``days`` after their entry on. Rows without a spot price are left out; a null signal is none; rows of a repeated day are steps of their own.
    """
    enters = rebalances(day, rebalance) & (F.coalesce(F.col(signal), F.lit(0.0)) > 0.5)
    rows = market.filter(F.col(spot).isNotNull()).select(*keys, F.col(day).alias("_day"), F.datediff(day, F.lit("1970-01-01")).alias("_at"), F.col(spot).cast("double").alias("_spot"), enters.alias("_enters"), (share if isinstance(share, Column) else F.lit(share)).cast("double").alias("_share"))
    schema = T.StructType([*[market.schema[k] for k in keys], T.StructField(day, market.schema[day].dataType), *[T.StructField(n, T.DoubleType() if t == "double" else T.IntegerType()) for n, t in CURVE]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, book = object(), None
        for batch in batches:
            out = []
            for key, part in by_key(batch, keys):
                if key != now:
                    now, book = key, Book(capital, legs, days, costs)
                out += [book.step(*row) for row in zip(part["_at"], part["_spot"], part["_enters"], part["_share"])]
            curve = pd.DataFrame(out, columns=[n for n, _ in CURVE], index=batch.index)
            yield pd.concat([batch[keys], batch["_day"].rename(day), curve], axis=1)

    return keyed_stream(rows, keys, ["_day", "_spot"]).mapInPandas(run, schema)


def backtest_metrics(curve: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Per portfolio: total and annual return, volatility, Sharpe, deepest drawdown, share of rows that gain, legs traded, commissions, slippage, final total and mean leverage."""
    w = ordered(keys, day)
    first = F.first("total").over(w)
    moved = curve.withColumn("_ret", safe(F.col("total"), F.lag("total").over(w)) - 1).withColumn("_grown", safe(F.col("total"), first)).withColumn("_row", F.row_number().over(w))
    # growth is followed from the first return on, so the first row is no peak
    peak = F.max(F.when(F.col("_row") > 1, F.col("_grown"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    moved = moved.withColumn("_fall", F.when(F.col("_row") > 1, safe(F.col("_grown"), peak) - 1)).withColumn("_last", F.lead(day).over(w).isNull())
    table = moved.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_last"), F.col("_grown"))).alias("grown"), F.stddev_samp("_ret").alias("sd"), F.min("_fall").alias("max_drawdown"), F.avg((F.col("_ret") > 0).cast("double")).alias("win_rate"), F.sum("legs_traded").alias("trades"),
        F.sum("commission").alias("commissions"), F.sum("slippage").alias("slippage"), F.max(F.when(F.col("_last"), F.col("total"))).alias("final"), F.avg("leverage").alias("mean_leverage"),
    )
    annual, volatility = F.when(F.col("grown") >= 0, F.pow("grown", YEAR / F.col("n"))) - 1, F.col("sd") * math.sqrt(YEAR)
    return table.select(*keys, (F.col("grown") - 1).alias("total_return"), annual.alias("annual_return"), volatility.alias("volatility"), F.when(volatility > 0, annual / volatility).otherwise(0.0).alias("sharpe"), "max_drawdown", "win_rate", "trades", "commissions", "slippage", "final", "mean_leverage")


RUN = [("entry_day", "date"), ("exit_day", "date"), ("strike", "double"), ("entry_spot", "double"), ("exit_spot", "double"), ("call_sold", "double"), ("call_bought", "double")]


def covered_call_run(quotes: DataFrame, keys: list[str], low: float = 1.02, high: float = 1.08, hold: int = 20, commission: float = 1.0, shares: int = 100, day: str = "day", strike: str = "strike", spot: str = "spot", price: str = "price", tie: str = "contract") -> DataFrame:
    """keys, entry_day, exit_day, strike, entry_spot, exit_spot, call_sold, call_bought, stock_pnl, call_pnl, closed: one position after the other.

    quotes: the calls of each day. Without a position, the day's call with the lowest strike between low and high times its spot is sold
    against ``shares`` bought at the spot. It is bought back, and they are sold, on the first day at least ``hold`` days later on
    which its strike is quoted; the next position opens on a later day. The last may stay open (closed false, no exit). The call's
    result is the quoted move and the premium of the shares, as for one contract. Rows with a null among the columns read are left out.
    """
    rows = quotes.select(*keys, F.col(day).cast("date").alias("_day"), *[F.col(c).cast("double").alias(f"_{n}") for n, c in (("strike", strike), ("spot", spot), ("price", price))], F.col(tie).alias("_tie"))
    schema = T.StructType([*[quotes.schema[k] for k in keys], *[T.StructField(n, T.DateType() if t == "date" else T.DoubleType()) for n, t in RUN]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, acted, done = object(), None, None, []

        def left():
            return [] if held is None else [(*now, held[0], None, held[1], held[2], None, held[3], None)]

        for batch in batches:
            for key, part in by_key(batch, keys):
                if key != now:
                    done += left()
                    now, held, acted = key, None, None
                for d, k, s, p in zip(part["_day"], part["_strike"], part["_spot"], part["_price"]):
                    if d == acted or d is None or k != k or s != s or p != p:
                        continue
                    if held is None:
                        if low * s < k < high * s:
                            held, acted = (d, k, s, p), d
                    elif k == held[1] and (d - held[0]).days >= hold:
                        done.append((*key, held[0], d, k, held[2], s, held[3], p))
                        held, acted = None, d
            yield pd.DataFrame(done, columns=[f.name for f in schema.fields])
            done = []
        yield pd.DataFrame(left(), columns=[f.name for f in schema.fields])

    runs = keyed_stream(rows, keys, ["_day", "_strike", "_tie"]).mapInPandas(run, schema)
    stock = (F.col("exit_spot") - F.col("entry_spot")) * shares - commission
    call = F.col("call_sold") - F.col("call_bought") + F.col("call_sold") * shares - commission
    return runs.withColumn("stock_pnl", stock).withColumn("call_pnl", call).withColumn("closed", F.col("exit_day").isNotNull())
