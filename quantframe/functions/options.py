"""Option prices, Greeks, costs and margins as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MULTIPLIER = 100
#: The coefficients of the five-term rational approximation of the normal tail (absolute error under 7.5e-8).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_RATE = 0.2316419


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """Spark has no erf: the tail by a polynomial in 1 / (1 + rate |x|), mirrored."""
    t = 1 / (1 + TAIL_RATE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    tail = density(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def with_greeks(df: DataFrame, spot: str = "spot", strike: str = "strike", years: str = "years", iv: str = "iv", kind: str = "option_type", rate: float = 0.02) -> DataFrame:
    """price, delta, gamma, theta (a day), vega and rho (a point) per option. At expiry: the payoff, delta 0 or 1 (in the money) and no other Greek."""
    s, k, t, v = (F.col(c) for c in (spot, strike, years, iv))
    call, live = F.col(kind) == "call", (F.col(years) > 0)
    root = F.sqrt(F.when(live, t))
    out = df.withColumn("d1", (F.ln(s / k) + (rate + v * v / 2) * t) / (v * root))
    out = out.withColumn("d2", F.col("d1") - v * root)
    n1, n2 = normal_cdf(F.col("d1")), normal_cdf(F.col("d2"))
    out = out.withColumn("n1", n1).withColumn("n2", n2).withColumn("pdf", density(F.col("d1"))).withColumn("discount", F.exp(-rate * t))
    payoff = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    call_price = s * F.col("n1") - k * F.col("discount") * F.col("n2")
    price = F.when(call, call_price).otherwise(call_price - s + k * F.col("discount"))
    decay = -s * F.col("pdf") * v / (2 * root)
    carry = rate * k * F.col("discount")
    none = F.lit(0.0)
    return out.select(
        *df.columns,
        F.when(live, F.greatest(price, none)).otherwise(payoff).alias("price"),
        F.when(live, F.when(call, F.col("n1")).otherwise(F.col("n1") - 1)).otherwise(F.when(payoff > 0, 1.0).otherwise(0.0)).alias("delta"),
        F.when(live, F.col("pdf") / (s * v * root)).otherwise(none).alias("gamma"),
        F.when(live, (decay - F.when(call, carry * F.col("n2")).otherwise(-carry * (1 - F.col("n2")))) / 365).otherwise(none).alias("theta"),
        F.when(live, s * F.col("pdf") * root / 100).otherwise(none).alias("vega"),
        F.when(live, k * t * F.col("discount") * F.when(call, F.col("n2")).otherwise(F.col("n2") - 1) / 100).otherwise(none).alias("rho"),
    )


def portfolio_greeks(options: DataFrame, keys: list[str], quantity: str = "quantity", spot: str = "spot") -> DataFrame:
    """Sums of greek * quantity, and in money: delta and gamma by price * 100, theta and vega by 100."""
    sums = [F.sum(F.col(g) * F.col(quantity)).alias(g) for g in ("delta", "gamma", "theta", "vega", "rho")]
    money = [F.sum(F.col(g) * F.col(quantity) * (F.col(spot) if g in ("delta", "gamma") else F.lit(1.0)) * MULTIPLIER).alias(f"dollar_{g}") for g in ("delta", "gamma", "theta", "vega")]
    return options.groupBy(*keys).agg(*sums, *money)


def surface(options: DataFrame, day_bins: list[float], moneyness_bins: list[float]) -> DataFrame:
    """Mean volatility by days and moneyness bins (right-closed; outside the edges dropped)."""
    def number(value: Column, edges: list[float]) -> Column:
        return sum(((value > e).cast("int") for e in edges), F.lit(0)) - 1

    binned = options.withColumn("moneyness", F.col("spot") / F.col("strike")).withColumn("day_bin", number(F.col("days"), day_bins)).withColumn("moneyness_bin", number(F.col("moneyness"), moneyness_bins))
    inside = binned.filter(F.col("day_bin").between(0, len(day_bins) - 2) & F.col("moneyness_bin").between(0, len(moneyness_bins) - 2))
    return inside.groupBy("day_bin", "moneyness_bin").agg(F.avg("iv").alias("mean_iv"), F.count(F.lit(1)).alias("n"), F.avg("moneyness").alias("mean_moneyness"), F.avg("days").alias("mean_days"))


def condor_margin(legs: DataFrame, key: str) -> DataFrame:
    """Per condor: premium taken, wider wing, margin (wing less premium), most profit and loss, break-evens; legs with option_type, strike, quantity (< 0 short), premium."""
    short, call = F.col("quantity") < 0, F.col("option_type") == "call"
    taken = F.sum(-F.col("quantity") * F.col("premium")) * MULTIPLIER
    strike = {(s, c): F.max(F.when((short if s else ~short) & (call if c else ~call), F.col("strike"))) for s in (True, False) for c in (True, False)}
    size = F.max(F.abs("quantity"))
    wide = F.greatest(strike[False, True] - strike[True, True], strike[True, False] - strike[False, False]) * MULTIPLIER * size
    out = legs.groupBy(key).agg(taken.alias("premium"), wide.alias("width"), strike[True, True].alias("short_call"), strike[True, False].alias("short_put"), size.alias("size"))
    margin = F.greatest(F.col("width") - F.col("premium"), F.lit(0.0))
    per_share = F.col("premium") / (MULTIPLIER * F.col("size"))
    return out.select(key, "premium", "width", margin.alias("margin"), (margin * 0.75).alias("maintenance"), F.col("premium").alias("most_profit"), margin.alias("most_loss"), (F.col("short_put") - per_share).alias("break_even_low"), (F.col("short_call") + per_share).alias("break_even_high"))


def trade_pnl(df: DataFrame) -> DataFrame:
    move = F.when(F.col("direction") == "long", F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price"))
    return df.withColumn("pnl", move * F.col("quantity") - F.col("commission"))


def exps(x: np.ndarray) -> np.ndarray:
    """e ** x by the C library's exp, as SQL engines have it; numpy's own loops and Java's StrictMath may end in other bits, and lose the smallest values. x is at most 0."""
    return np.fromiter(map(math.exp, x.tolist()), float, len(x))


def logs(x: np.ndarray) -> np.ndarray:
    """ln x by the C library's log; -inf at 0 and NaN below."""
    out, live = np.where(x == 0, -np.inf, np.nan), x > 0
    out[live] = np.fromiter(map(math.log, x[live].tolist()), float, int(live.sum()))
    return out


def numpy_cdf(x: np.ndarray, bell: np.ndarray) -> np.ndarray:
    """The same approximation as normal_cdf, over arrays; bell is exp(-x * x / 2)."""
    t = 1 / (1 + TAIL_RATE * np.abs(x))
    poly = np.zeros_like(t)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    tail = bell / math.sqrt(2 * math.pi) * poly
    return np.where(x >= 0, 1 - tail, tail)


def model_price(v: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, call: np.ndarray, rate: float, ratio: np.ndarray, root: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Price of each row at volatility v, and its vega; ratio is ln(s / k), root the square root of t."""
    d1 = (ratio + (rate + v * v / 2) * t) / (v * root)
    d2 = d1 - v * root
    bell = exps(-d1 * d1 / 2)
    price = s * numpy_cdf(d1, bell) - k * discount * numpy_cdf(d2, exps(-d2 * d2 / 2))
    return np.where(call, price, price - s + k * discount), s * bell / math.sqrt(2 * math.pi) * root


def newton_volatility(market: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, call: np.ndarray, rate: float, steps: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Volatility that gives the market price, all rows at once from 0.2; at least 0.001; a row without vega stays where it is; 0 at expiry."""
    out = np.where(t > 0, 0.2, 0.0)
    at = np.flatnonzero(t > 0)  # rows that still move
    with np.errstate(all="ignore"):
        market, s, k, t, call = (x[at] for x in (market, s, k, t, call))
        ratio, root, discount = logs(s / k), np.sqrt(t), exps(-rate * t)
        for _ in range(steps):
            v = out[at]
            price, vega = model_price(v, s, k, t, call, rate, ratio, root, discount)
            moves = np.isfinite(price) & (np.abs(price - market) >= tolerance) & (vega > 0)
            at = at[moves]
            if not len(at):
                break
            out[at] = np.maximum(v[moves] - (price[moves] - market[moves]) / vega[moves], 0.001)
            market, s, k, t, call, ratio, root, discount = (x[moves] for x in (market, s, k, t, call, ratio, root, discount))
    return out


def implied_volatility(df: DataFrame, price: str = "price", spot: str = "spot", strike: str = "strike", years: str = "years", kind: str = "option_type", rate: float = 0.02) -> DataFrame:
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(newton_volatility(*(x.to_numpy(float) for x in (p, s, k, t)), (c == "call").to_numpy(), rate))

    return df.withColumn("implied", F.pandas_udf(solve, T.DoubleType())(price, spot, strike, years, kind))


def with_price(df: DataFrame, spot: str = "spot", strike: str = "strike", years: str = "years", iv: str = "iv", kind: str = "option_type", rate: float = 0.02) -> DataFrame:
    """price as with_greeks has it, in the same arithmetic as implied_volatility: where vega is next to none, Newton steps make much of a price's last bits."""

    def priced(s: pd.Series, k: pd.Series, t: pd.Series, v: pd.Series, c: pd.Series) -> pd.Series:
        s, k, t, v = (x.to_numpy(float) for x in (s, k, t, v))
        call = (c == "call").to_numpy()
        out = np.fmax(np.where(call, s - k, k - s), 0.0)  # what is null counts as 0, as in greatest()
        live = t > 0
        with np.errstate(all="ignore"):
            s, k, t, v, call = (x[live] for x in (s, k, t, v, call))
            price = model_price(v, s, k, t, call, rate, logs(s / k), np.sqrt(t), exps(-rate * t))[0]
            out[live] = np.fmax(price, 0.0)
        return pd.Series(out)

    return df.withColumn("price", F.pandas_udf(priced, T.DoubleType())(spot, strike, years, iv, kind))


def execution_costs(df: DataFrame, half_commission: float = 0.65) -> DataFrame:
    """spread, slippage, commission and fill of market orders with mid, bid, ask, volume, quantity and side (1 buys, -1 sells).

    spread: ask - bid where both are quoted, else 10 % of mid, by a liquidity factor max(.5, 1 - ln(volume + 1) / 10), within .05 and 2;
    slippage: half of it, times 1 + .5 sqrt(quantity / volume) (1.1 without volume); fills stay over .01.
    """
    quoted = (F.col("bid") > 0) & (F.col("ask") > 0)
    liquidity = F.greatest(F.lit(0.5), 1 - F.ln(F.coalesce("volume", F.lit(0.0)) + 1) / 10)
    guess = F.greatest(F.lit(0.05), F.least(F.lit(2.0), F.col("mid") * 0.1 * liquidity))
    impact = F.when(F.col("volume") > 0, 1 + 0.5 * F.sqrt(F.col("quantity") / F.col("volume"))).otherwise(1.1)
    out = df.withColumn("spread", F.when(quoted, F.col("ask") - F.col("bid")).otherwise(guess))
    out = out.withColumn("slippage", F.col("spread") / 2 * impact).withColumn("commission", F.col("quantity") * half_commission)
    return out.withColumn("fill", F.greatest(F.lit(0.01), F.col("mid") + F.col("side") * F.col("slippage")))


#: Strikes of the legs as shares of the spot price, and their signs.
CONDOR_LEGS = [("put", 0.90, 1), ("put", 0.95, -1), ("call", 1.05, -1), ("call", 1.10, 1)]
STRANGLE_LEGS = [("put", 0.95, -1), ("call", 1.05, -1)]


def strategy_legs(df: DataFrame, legs: list[tuple[str, float, int]], spot: str = "spot") -> DataFrame:
    """One row per leg: option_type, strike, sign."""
    made = [F.struct(F.lit(t).alias("option_type"), (F.col(spot) * m).alias("strike"), F.lit(s).alias("sign")) for t, m, s in legs]
    return df.select("*", F.inline(F.array(*made)))


def covered_calls(chain: DataFrame, keys: list[str], low: float = 1.02, high: float = 1.08) -> DataFrame:
    """Per key and day the call with the lowest strike within low and high times the spot price."""
    calls = chain.filter((F.col("option_type") == "call") & (F.col("strike") > low * F.col("spot")) & (F.col("strike") < high * F.col("spot")))
    return calls.groupBy(*keys, "day").agg(F.min(F.struct("strike", "spot", "iv", "contract")).alias("first")).select(*keys, "day", "first.*")


def pnl_attribution(df: DataFrame, keys: list[str], by: list) -> DataFrame:
    """From row to row: delta, gamma, theta and vega parts of a position's change, and their sum."""
    from quantframe.functions.windows import ordered

    w = ordered(keys, *by)
    ds, dv, dt = F.col("spot") - F.lag("spot").over(w), F.col("iv") - F.lag("iv").over(w), F.datediff("day", F.lag("day").over(w))
    g = {n: F.lag(n).over(w) for n in ("delta", "gamma", "theta", "vega")}
    out = df.withColumn("delta_pnl", g["delta"] * ds * MULTIPLIER).withColumn("gamma_pnl", g["gamma"] * ds * ds * (MULTIPLIER / 2)).withColumn("theta_pnl", g["theta"] * dt * MULTIPLIER).withColumn("vega_pnl", g["vega"] * dv * MULTIPLIER)
    return out.withColumn("total_pnl", F.col("delta_pnl") + F.col("gamma_pnl") + F.col("theta_pnl") + F.col("vega_pnl"))


def hedge_quantities(portfolios: DataFrame, least: tuple[float, float, float] = (0.01, 0.001, 0.01)) -> DataFrame:
    """Instruments that bring delta, gamma or vega to zero; null where the instrument's own is too small. Columns delta.., hedge_delta.. ."""
    found = [F.when(F.abs(f"hedge_{g}") > m, -F.col(g) / F.col(f"hedge_{g}")).alias(f"{g}_hedge") for g, m in zip(("delta", "gamma", "vega"), least)]
    return portfolios.select("*", *found)


def surface_pivot(chain: DataFrame, expirations: list, strike: str = "strike", expiration: str = "days", iv: str = "iv") -> DataFrame:
    """Mean volatility by strike, a column per expiration."""
    return chain.groupBy(strike).pivot(expiration, expirations).agg(F.avg(iv))


def moneyness(spot: str = "spot", strike: str = "strike") -> Column:
    return F.when(F.col(strike) != 0, F.col(spot) / F.col(strike))


def days_to_expiry(expiration: Column, reference: Column) -> Column:
    return F.datediff(expiration, reference)


def mark_to_market(positions: DataFrame, keys: list[str], cash: float) -> DataFrame:
    """Value of each portfolio's positions (intrinsic and a tenth of it, 0.05 at least, as time value), unrealised result, total and leverage."""
    call = F.col("option_type") == "call"
    inner = F.greatest(F.lit(0.0), F.when(call, F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot")))
    value = (inner + F.greatest(F.lit(0.05), inner * 0.1)) * F.col("quantity")
    table = positions.groupBy(*keys).agg(F.sum(value).alias("value"), F.sum(value - F.col("quantity") * F.col("mean_price")).alias("unrealised"), F.sum(F.abs(value)).alias("gross"))
    total = F.col("value") + cash
    return table.select(*keys, "value", "unrealised", total.alias("total"), F.when(total > 0, F.col("gross") / total).otherwise(0.0).alias("leverage"))


def steady_sum(x: Column) -> Column:
    """An aggregate's sum of doubles, rounded once and so the same to the last bit in any order of the rows: the multiples of 2 ** -20 in them and what is left add up exactly, up to 8e9 in all."""
    coarse = F.rint(x * 2.0**20) / 2.0**20
    return F.sum(coarse) + F.sum(F.when(F.abs(x) < 2.0**33, x - coarse).otherwise(0.0))


def margins(legs: DataFrame, key: str, least: float = 100.0, share: float = 0.2, equity_share: float = 0.5, risk: float = 1.0) -> DataFrame:
    """Margin of each position by its strategy: condor, strangle, straddle, vertical, covered_call, cash_secured_put; others, and legs that don't fit, by leg.

    legs: key, strategy, spot, option_type, strike, quantity (< 0 short), premium (of a whole contract). A short leg alone
    needs a share of the underlying and its premium less what it is out of the money. Premiums paid are positive.
    """
    call, short, q = F.col("option_type") == "call", F.col("quantity") < 0, F.abs("quantity")
    away = F.greatest(F.lit(0.0), F.when(call, F.col("strike") - F.col("spot")).otherwise(F.col("spot") - F.col("strike")))
    naked = F.greatest(share * F.col("spot") * MULTIPLIER * q + F.col("premium") * q - away * MULTIPLIER * q, F.lit(least))
    of = lambda test, value: F.max(F.when(test, value))
    low = lambda test, value: F.min(F.when(test, value))
    t = legs.groupBy(key, "strategy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(call).alias("calls"), F.count_if(~call).alias("puts"), F.count_if(short).alias("shorts"), F.count_if(short & call).alias("short_calls"), F.count_if(short & ~call).alias("short_puts"),
        F.first("spot").alias("spot"), steady_sum(F.col("premium") * F.col("quantity")).alias("premium"), steady_sum(F.when(short, naked).otherwise(F.col("premium") * F.col("quantity"))).alias("by_leg"),
        of(call, F.col("strike")).alias("high_call"), low(call, F.col("strike")).alias("low_call"), of(~call, F.col("strike")).alias("high_put"), low(~call, F.col("strike")).alias("low_put"),
        of(call, naked).alias("call_margin"), of(~call, naked).alias("put_margin"), steady_sum(F.when(short & call, F.col("premium") * q)).alias("call_premium"), F.min(F.when(short & ~call, F.struct("strike", (F.col("premium") * q).alias("taken")))).alias("put"),
        (F.max("strike") - F.min("strike")).alias("width"),
    )
    s, premium = F.col("strategy"), F.col("premium")
    wide = F.greatest(F.col("high_call") - F.col("low_call"), F.col("high_put") - F.col("low_put")) * MULTIPLIER
    kind = (
        F.when((s == "condor") & (F.col("calls") == 2) & (F.col("puts") == 2), "condor")
        .when(s.isin("strangle", "straddle") & (F.col("calls") == 1) & (F.col("puts") == 1), F.when(F.col("shorts") == 0, "long_pair").otherwise("short_pair"))
        .when((s == "vertical") & (F.col("n") == 2) & ((F.col("calls") == 2) | (F.col("puts") == 2)), F.when(premium < 0, "credit").otherwise("debit"))
        .when((s == "covered_call") & (F.col("short_calls") > 0), "covered_call")
        .when((s == "cash_secured_put") & (F.col("short_puts") > 0), "cash_secured_put")
        .otherwise("by_leg")
    )
    t = t.withColumn("kind", kind)
    k = F.col("kind")
    stock = F.col("spot") * MULTIPLIER
    at_least = lambda x: F.greatest(x, F.lit(least)) * risk
    pair = F.greatest("call_margin", "put_margin") + F.abs(premium)
    secured = F.col("put.strike") * MULTIPLIER - F.col("put.taken")
    initial = F.when(k == "condor", at_least(wide + premium)).when(k == "long_pair", premium).when(k == "short_pair", pair * risk).when(k == "credit", at_least(F.col("width") * MULTIPLIER + premium)).when(k == "debit", at_least(premium)).when(k == "covered_call", at_least(stock * equity_share - F.col("call_premium"))).when(k == "cash_secured_put", secured).otherwise(at_least(F.col("by_leg")))
    maintenance = F.when(k == "long_pair", 0.0).when(k == "short_pair", pair * 0.75).when(k == "cash_secured_put", secured).otherwise(initial * 0.75)
    endless = F.lit(float("inf"))
    loss = F.when(k == "condor", wide + premium).when(k.isin("long_pair", "debit"), premium).when(k == "short_pair", endless).when(k == "credit", F.col("width") * MULTIPLIER + premium).when(k == "covered_call", stock + F.col("call_premium")).when(k == "cash_secured_put", secured)
    profit = F.when(k == "long_pair", endless).when(k.isin("condor", "short_pair", "credit"), -premium).when(k == "debit", F.col("width") * MULTIPLIER - premium).when(k == "covered_call", F.col("high_call") * MULTIPLIER - stock + F.col("call_premium")).when(k == "cash_secured_put", F.col("put.taken"))
    return t.select(key, "strategy", "kind", "premium", initial.alias("initial"), maintenance.alias("maintenance"), loss.alias("most_loss"), profit.alias("most_profit"))


def portfolio_margin(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.sum("initial").alias("initial"), F.sum("maintenance").alias("maintenance"), F.sum("premium").alias("premium"), F.count(F.lit(1)).alias("positions"))
