"""Stateful alerts: the stream equals the replay, restarts included, and both equal plain histories."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantframe.streaming import alerts

SCHEMA = "portfolio string, ts timestamp, id long, pnl double, positions array<struct<strategy:string,value:double>>, daily_var double"
LIMITS = [
    alerts.Threshold("deep", "max_drawdown", 0.1, "critical", 600),
    alerts.Threshold("deeper", "max_drawdown", 0.2, "emergency", 60),
    alerts.Threshold("one place", "max_position_pct", 0.6, "warning", 300),
    alerts.Threshold("jumpy", "volatility_spike", 1.3, "warning", 120),
    alerts.Threshold("risk", "daily_var", 0.05, "critical", 0),
]
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def updates(n=150):
    rng, rows = random.Random(6), []
    for p in ("a", "b", "c"):
        pnl, values = 1000.0, {"condor": 100.0, "strangle": 80.0}
        for i in range(n):
            pnl *= 1 + rng.gauss(0, 0.04)
            values = {s: v * (1 + rng.gauss(0, 0.05 if 60 < i < 80 else 0.01)) for s, v in values.items()}
            positions = None if i % 31 == 5 else [(s, v if s == "condor" or i % 7 else v / 20) for s, v in values.items()]
            rows.append((p, START + dt.timedelta(seconds=45 * i), i, None if i % 41 == 3 else pnl, positions, 0.06 if i % 50 == 0 else None))
    return rows


def plain(rows, keep):
    """Histories as lists, looked through in full each time."""
    out = []
    for p in sorted({r[0] for r in rows}):
        pnls, prices, fired = [], {}, {}
        for _, ts, i, pnl, positions, var in sorted((r for r in rows if r[0] == p), key=lambda r: r[1]):
            values = {"daily_var": var}
            if pnl is not None:
                pnls = (pnls + [pnl])[-10_000:]
                values["max_drawdown"] = abs(pnl - max(pnls)) / max(pnls) if len(pnls) > 1 else None
            for s, v in positions or []:
                prices[s] = (prices.get(s, []) + [v])[-keep:]
            if positions:
                values["max_position_pct"] = max(abs(v) for _, v in positions) / sum(abs(v) for _, v in positions)
            spikes = []
            for v in prices.values():
                if len(v) >= 10:
                    r = np.diff(v) / np.array(v[:-1])
                    spikes.append(r[-20:].std(ddof=1) / r.std(ddof=1))
            values["volatility_spike"] = max(spikes, default=None)
            for t in LIMITS:
                x = values.get(t.metric)
                if x is not None and x > t.limit and (t.name not in fired or (ts - fired[t.name]).total_seconds() >= t.cooldown):
                    fired[t.name] = ts
                    out.append((p, i, t.name, t.level, round(float(x), 9)))
    return sorted(out)


def told(df):
    return sorted((r["portfolio"], r["id"], r["threshold"], r["level"], round(r["value"], 9)) for r in alerts.alerts_of(df).collect())


def test_replay_equals_plain_histories(spark):
    rows = updates()
    df = spark.createDataFrame(rows, SCHEMA)
    got = alerts.replay(df, LIMITS, values=40)
    assert told(got) == plain(rows, 40) and {x[2] for x in told(got)} == {t.name for t in LIMITS}
    assert got.filter("threshold IS NULL").count() == len(rows)


def test_stream_equals_replay_across_a_restart(spark, tmp_path):
    rows = updates()
    alerts.use_state_store(spark, available_now=True)
    cuts = [rows_of for rows_of in (lambda i: i < 55, lambda i: 55 <= i < 100, lambda i: i >= 100)]
    for k, cut in enumerate(cuts):  # each run goes on from the checkpoint of the one before
        spark.createDataFrame([r for r in rows if cut(r[2])], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = alerts.monitor(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), LIMITS, values=40)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    for c in ("providerClass", ""):
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass" if c else "spark.sql.streaming.noDataMicroBatches.enabled")
    got, want = spark.read.parquet(str(tmp_path / "out")), alerts.replay(spark.createDataFrame(rows, SCHEMA), LIMITS, values=40)
    assert told(got) == told(want)
    metrics = ["portfolio", "id", "max_drawdown", "max_position_pct", "volatility_spike"]
    a, b = (sorted(map(tuple, t.filter("threshold IS NULL").select(*metrics).collect())) for t in (got, want))
    assert len(a) == len(b) == len(rows) and all(x[:2] == y[:2] and [v if v is None else pytest.approx(v) for v in x[2:]] == list(y[2:]) for x, y in zip(a, b))


def test_active_history_and_dashboard(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [("a", at(0), 1, "x", "drawdown", "critical"), ("a", at(30), 2, "x", "drawdown", "critical"), ("a", at(31), 3, "y", "drawdown", "emergency"), ("a", at(40), 4, None, None, None), ("b", at(2), 5, "z", "volatility", "warning")]
    df = spark.createDataFrame([(p, ts, i, 0.1 * i, None, None, th, ty, lv, 1.0, 0.5, "", "") for p, ts, i, th, ty, lv in rows], alerts.ROW)
    active = {(r["portfolio"], r["type"], r["level"]): (r["id"], r["n"]) for r in alerts.active_alerts(df).collect()}
    assert active == {("a", "drawdown", "critical"): (2, 2), ("a", "drawdown", "emergency"): (3, 1), ("b", "volatility", "warning"): (5, 1)}
    now = at(48).strftime("%Y-%m-%d %H:%M:%S")
    assert sorted(r["id"] for r in alerts.alert_history(df, now).collect()) == [2, 3]
    board = {r["portfolio"]: r for r in alerts.dashboard(df, now).collect()}
    assert (board["a"]["active"], board["a"]["critical"], board["a"]["emergency"], board["a"]["recent"]) == (2, 1, 1, 2) and board["a"]["max_drawdown"] == pytest.approx(0.4)
    assert board["b"]["recent"] == 0 and board["b"]["active"] == 1


def test_types_and_no_rows(spark):
    assert [alerts.alert_type(m) for m in ("max_drawdown", "daily_var", "max_position_pct", "volatility_spike", "cash")] == ["drawdown", "var_breach", "position_size", "volatility", "system"]
    assert alerts.replay(spark.createDataFrame([], SCHEMA), LIMITS).count() == 0
