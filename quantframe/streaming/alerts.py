"""Live risk of portfolios: drawdown, concentration and volatility spikes, alerts by threshold with cooldowns, and their history.

Each portfolio is a key of ``transformWithState``: its state is the candidates for the peak of its last results, a ring of the last
values of each strategy, and when each threshold last fired. A day's alerts are held as a list that expires by itself, and a
timer drops the state of a portfolio that has sent nothing for a day. The same steps run over a table as one sorted stream
per portfolio (``replay``), so a stream that has read all of it gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quantframe.operators.option_runs import by_key, keyed_stream

DAY_MS = 24 * 3600 * 1000


class Threshold(NamedTuple):
    """Fires where the metric is over the limit, at most once in ``cooldown`` seconds of the rows' time. Metrics: max_drawdown, max_position_pct, volatility_spike, or a column of the input."""

    name: str
    metric: str
    limit: float
    level: str = "warning"
    cooldown: float = 300.0


#: The type of an alert by what its metric's name holds, tried in this order, and the action advised for each.
TYPES = [("drawdown", "drawdown"), ("var", "var_breach"), ("position", "position_size"), ("volatility", "volatility")]
ACTIONS = {
    "drawdown": "Consider reducing position sizes or closing losing positions",
    "var_breach": "Review portfolio risk and consider hedging",
    "position_size": "Reduce position concentration",
    "volatility": "Monitor for market stress and consider hedging",
    "system": "Review system parameters",
}


def alert_type(metric: str) -> str:
    return next((kind for part, kind in TYPES if part in metric), "system")


RESULTS = ("max_drawdown", "max_position_pct", "volatility_spike")
ROW = "portfolio string, ts timestamp, id long, max_drawdown double, max_position_pct double, volatility_spike double, threshold string, type string, level string, value double, limit double, message string, action string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]


class Monitor:
    """State and steps of one portfolio."""

    def __init__(self, thresholds: list[Threshold], results: int = 10_000, values: int = 1000):
        self.thresholds, self.results, self.values = thresholds, results, values
        self.seen, self.peaks, self.rings, self.fired = 0, [], {}, {}
        self.spikes, self.moments = {}, {}  # what follows from the rings, kept while they don't change

    def drawdown(self, pnl: float | None) -> float | None:
        """Distance from the peak of the last results, by the peak; from the second result on."""
        if pnl is None:
            return None
        # results that a later one reaches can't be the peak any more
        while self.peaks and self.peaks[-1][1] <= pnl:
            self.peaks.pop()
        self.peaks.append((self.seen, pnl))
        self.seen += 1
        while self.peaks[0][0] < self.seen - self.results:
            self.peaks.pop(0)
        peak = self.peaks[0][1]
        return abs((pnl - peak) / peak) if self.seen > 1 and peak else None

    def spike(self) -> float | None:
        """Deviation of the last 20 returns over that of all in the ring, the largest over strategies with ten values or more."""
        for strategy in self.rings:
            if strategy not in self.spikes:  # a new value came
                self.spikes[strategy] = self.spike_of(strategy)
        return max((v for v in self.spikes.values() if v is not None), default=None)

    def spike_of(self, strategy: str) -> float | None:
        ring = self.rings[strategy]
        if len(ring) >= self.values:  # every value moves the oldest out
            v = np.array(ring)
            if len(ring) < 10 or (v[:-1] == 0).any():
                return None
            r = v[1:] / v[:-1] - 1
            last, whole = float(r[-20:].std(ddof=1)), float(r.std(ddof=1))
        else:  # until then its returns only grow in number: their mean and squares are carried along
            n, mean, squares, zero = self.moments.get(strategy, (0, 0.0, 0.0, False))
            for before, now in zip(ring[n:-1], ring[n + 1 :]):
                zero = zero or before == 0
                n += 1
                away = (now / before - 1 if before else 0.0) - mean
                mean += away / n
                squares += away * away * (n - 1) / n
            self.moments[strategy] = n, mean, squares, zero
            if len(ring) < 10 or zero:
                return None
            r = [b / a - 1 for a, b in zip(ring[-21:-1], ring[-20:] if len(ring) > 20 else ring[1:])]
            middle = sum(r) / len(r)
            last, whole = math.sqrt(sum((x - middle) ** 2 for x in r) / (len(r) - 1)), math.sqrt(squares / (n - 1))
        return last / whole if whole > 0 else None

    def step(self, ts: float, pnl: float | None, positions: list[tuple[str, float]], more: dict[str, float | None]) -> tuple[dict, list[tuple]]:
        metrics = {"max_drawdown": self.drawdown(pnl)}
        for strategy, value in positions:
            ring = self.rings.setdefault(strategy, [])
            ring.append(value)
            del ring[: -self.values]
            self.spikes.pop(strategy, None)
        sizes = [abs(v) for _, v in positions]
        metrics["max_position_pct"] = (max(sizes) / sum(sizes) if sum(sizes) > 0 else 0.0) if sizes else None
        metrics["volatility_spike"] = self.spike()
        known, alerts = more | metrics, []
        for t in self.thresholds:
            value = known.get(t.metric)
            if value is None or not value > t.limit or ts - self.fired.get(t.name, -np.inf) < t.cooldown:
                continue
            self.fired[t.name] = ts
            kind = alert_type(t.metric)
            alerts.append((t.name, kind, t.level, float(value), t.limit, f"{t.metric} breach: {value:.3f} > {t.limit:.3f}", ACTIONS[kind]))
        return metrics, alerts

    def rows(self, key: str | None, batch: pd.DataFrame, more: list[str]) -> list[tuple]:
        """A row of metrics for each input row, and one for each alert."""
        out, number = [], lambda v: None if v is None or v != v else float(v)
        for ts, i, pnl, positions, *extra in zip(batch["ts"], batch["id"], batch["pnl"], batch["positions"], *[batch[c] for c in more]):
            held = [] if positions is None else [(p["strategy"], float(p["value"])) for p in positions if number(p["value"]) is not None]
            metrics, alerts = self.step(ts.timestamp(), number(pnl), held, {c: number(v) for c, v in zip(more, extra)})
            own = (key, ts, int(i), *[metrics[c] for c in RESULTS])
            out.append((*own, *[None] * 7))
            out += [(*own, *a) for a in alerts]
        return out


def extra_columns(df: DataFrame, thresholds: list[Threshold]) -> list[str]:
    return sorted({t.metric for t in thresholds} & set(df.columns) - {"portfolio", "ts", "id", "pnl", "positions", *RESULTS})


def replay(updates: DataFrame, thresholds: list[Threshold], results: int = 10_000, values: int = 1000) -> DataFrame:
    """A table of updates (portfolio, ts, id, pnl, positions: array of strategy and value, and columns that thresholds name) -> the rows of ``monitor``."""
    more = extra_columns(updates, thresholds)
    rows = keyed_stream(updates.select("portfolio", "ts", "id", "pnl", "positions", *more), ["portfolio"], ["ts", "id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = object(), None
        for batch in batches:
            out = []
            for (key,), part in by_key(batch, ["portfolio"]):
                if key != now:
                    now, own = key, Monitor(thresholds, results, values)
                out += own.rows(key, part, more)
            yield pd.DataFrame(out, columns=COLUMNS)

    return rows.mapInPandas(run, ROW)


class Watch(StatefulProcessor):
    """Monitor with its state in the store, between micro-batches."""

    def __init__(self, thresholds: list[Threshold], more: list[str], results: int, values: int):
        self.thresholds, self.more, self.results, self.values = thresholds, more, results, values

    def init(self, handle) -> None:
        self.handle = handle
        self.peaks = handle.getValueState("peaks", "seen long, at array<long>, value array<double>")
        self.rings = handle.getMapState("rings", "strategy string", "values array<double>")
        self.fired = handle.getMapState("fired", "threshold string", "at double")
        self.day = handle.getListState("day", "ts double, threshold string, type string, level string, value double", DAY_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = Monitor(self.thresholds, self.results, self.values)
        if self.peaks.exists():
            seen, at, value = self.peaks.get()
            own.seen, own.peaks = int(seen), [(int(a), float(v)) for a, v in zip(at, value)]
        own.rings = {k[0]: [float(x) for x in v[0]] for k, v in self.rings.iterator()}
        own.fired = {k[0]: float(v[0]) for k, v in self.fired.iterator()}
        batch = pd.concat(list(rows)).sort_values(["ts", "id"])  # a portfolio's rows of one micro-batch
        out = own.rows(key[0], batch, self.more)
        self.peaks.update((own.seen, [a for a, _ in own.peaks], [v for _, v in own.peaks]))
        for strategy, ring in own.rings.items():
            self.rings.updateValue((strategy,), (ring,))
        for name, at in own.fired.items():
            self.fired.updateValue((name,), (at,))
        fired = [(r[1].timestamp(), r[6], r[7], r[8], r[9]) for r in out if r[6] is not None]
        if fired:
            self.day.appendList(fired)
        for timer in list(self.handle.listTimers()):  # one timer, a day after the latest rows
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + DAY_MS)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.peaks, self.rings, self.fired, self.day):
            state.clear()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession, available_now: bool = False) -> None:
    """State with expiry and timers needs the store on disk: to be called before the stream starts. Timers ask for another batch for ever, so a run over
    what is available now ends only without batches that have no data (its timers then fire with the next run's data)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not available_now).lower())


def monitor(updates: DataFrame, thresholds: list[Threshold], results: int = 10_000, values: int = 1000) -> DataFrame:
    """A stream of updates -> for each one a row of metrics, and a row for each alert (threshold and what follows are null in rows of metrics)."""
    more = extra_columns(updates, thresholds)
    watch = Watch(thresholds, more, results, values)
    return updates.select("portfolio", "ts", "id", "pnl", "positions", *more).groupBy("portfolio").transformWithStateInPandas(statefulProcessor=watch, outputStructType=ROW, outputMode="Append", timeMode="ProcessingTime")


def alerts_of(rows: DataFrame) -> DataFrame:
    return rows.filter("threshold IS NOT NULL")


def active_alerts(rows: DataFrame) -> DataFrame:
    """The latest alert of each portfolio, type and level (ties: the larger id, then threshold), and how many there were."""
    w = Window.partitionBy("portfolio", "type", "level")
    latest = F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id"), F.desc("threshold")))
    return alerts_of(rows).withColumn("_at", latest).withColumn("n", F.count(F.lit(1)).over(w)).filter("_at = 1").drop("_at")


def alert_history(rows: DataFrame, now, hours: float = 24) -> DataFrame:
    """Alerts of the last hours up to ``now`` (a timestamp column or value)."""
    at = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    return alerts_of(rows).filter((F.col("ts") >= at - F.make_dt_interval(hours=F.lit(int(hours)))) & (F.col("ts") <= at))


def dashboard(rows: DataFrame, now: str, hours: float = 24) -> DataFrame:
    """Per portfolio: active alerts in all and by the two highest levels, alerts of the last hours, and its latest metrics."""
    active = active_alerts(rows).groupBy("portfolio").agg(F.count(F.lit(1)).alias("active"), F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "emergency").alias("emergency"))
    recent = alert_history(rows, now, hours).groupBy("portfolio").agg(F.count(F.lit(1)).alias("recent"))
    latest = rows.groupBy("portfolio").agg(F.max_by(F.struct("ts", *RESULTS), F.struct("ts", "id")).alias("x")).select("portfolio", "x.*")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return latest.join(active, "portfolio", "left").join(recent, "portfolio", "left").select("portfolio", "ts", *RESULTS, *[none(c) for c in ("active", "critical", "emergency", "recent")])
