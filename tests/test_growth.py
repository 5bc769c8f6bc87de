"""Steps that must not grow with the tables: plans, partitions, bounded parts; and values that chance must not decide."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quantframe.jobs import registry
from quantframe.jobs import queries  # after the registry, which imports it
from quantframe.operators import align, bars, hidden, neighbours, regressions
from quantframe.sources import tables
from quantframe.streaming import alerts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_sources_are_not_broadcast(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (None, 1, 4.0)], "k int, t int, v double")
    b = spark.createDataFrame([(1, 2, 5.0)], "k int, t int, v double")
    for how, want in (("inner", [(1, 2, 3.0, 5.0)]), ("left", [(1, 1, 2.0, None), (1, 2, 3.0, 5.0), (None, 1, 4.0, None)])):
        both = align.merge({"a": a, "b": b}, ["k"], "t", how)
        assert "Broadcast" not in plan(both)
        assert sorted(map(tuple, both.collect()), key=str) == sorted(want, key=str)


def test_compared_blocks_are_plain_arrays_written_in_parts():
    """No Python object per value: batches in are flat arrays, and batches out are bounded however many pairs come in one."""
    rng, n = np.random.default_rng(3), 400
    asked = rng.normal(size=(n, 60, 2))
    asked[:, :, 1] = np.nan
    rows = rng.normal(size=(n, 90, 2))
    whole = lambda v, kind: pa.array([x.ravel().tolist() for x in v], pa.list_(kind))
    batch = pa.record_batch([whole(np.arange(n * 60).reshape(n, 60), pa.int64()), whole(asked, pa.float64()), whole(np.arange(n * 90).reshape(n, 90) + 10**6, pa.int64()), whole(rows, pa.float64())], names=["asked_o", "asked_x", "row_o", "row_x"])
    out = list(neighbours.compare(2, 5)(iter([batch])))
    assert sum(b.num_rows for b in out) == n * 60 and max(b.num_rows for b in out) < neighbours.WRITTEN + 60 * 2
    first = out[0].slice(0, 1).to_pylist()[0]
    near = np.argsort(abs(asked[0, 0, 0] - rows[0, :, 0]))[:5]
    assert [b["v"] for b in first["best"]] == rows[0, near, 1].tolist() and [b["o"] for b in first["best"]] == (near + 10**6).tolist() and first["pairs"] == 90


def test_short_series_are_one_block_each(spark):
    df = spark.range(2000).selectExpr("id % 50 AS k", "id AS at", "(id * 37 % 101) / 10.0D AS v")
    blocks = hidden.as_blocks(df, ["k"], ["at"], "v", 40)
    assert blocks.count() == 50 and blocks.filter("first AND last AND size(xs) = 40").count() == 50
    assert hidden.as_blocks(df, ["k"], ["at"], "v", 15).selectExpr("max(size(xs))", "count(*)").first()[:] == (15, 150)


def test_session_ends_at_its_last_instant(spark):
    ticks = [(1, "2024-01-04 " + t, i, 1.0, 1.0) for i, t in enumerate(["09:29:59.999999", "09:30:00", "15:59:59.999999", "16:00:00", "16:00:00.000001", "16:00:00.500000"])]
    df = spark.createDataFrame(ticks, "symbol int, at string, id int, price double, volume double").selectExpr("symbol", "CAST(at AS TIMESTAMP_NTZ) AS ts", "id", "price", "volume")
    assert bars.session_bars(df, ["symbol"], "09:30", "16:00", "hour", 1).agg(F.sum("n")).first()[0] == 3


def test_values_that_last_bits_decide(spark):
    df = spark.createDataFrame([(33420.158812499995, 1648263419990.815), (33420.1588125, 1648263419990.816), (33420.158812500005, 0.12349)], "a double, v double")
    assert {r[0] for r in queries.shown(queries.settled(df.select("a"))).collect()} == {33420.158813}
    assert [r[0] for r in df.select(queries.legible(F.col("v"))).collect()] == [1.648e12, 1.648e12, 0.123]


def test_equal_portfolios_share_the_front(spark, tmp_path):
    """A copy with its rows in another order is as good as the first."""
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    copy = line.withColumn("l_suppkey", F.col("l_suppkey") + 1000).orderBy(F.desc("l_extendedprice"))
    line.orderBy("l_quantity", "l_extendedprice").coalesce(1).unionByName(copy.coalesce(1)).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    front = [r["portfolio"] for r in registry.QUERIES["sweep_pareto"](spark, str(tmp_path)).collect()]
    assert front and {p + 1000 for p in front if p < 1000} == {p for p in front if p >= 1000}


def test_lines_at_once_are_those_alone():
    rng, grid, sets = np.random.default_rng(5), np.logspace(-4, 1, 7), []
    for n in (40, 300, 12):
        v = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4))
        sets.append(regressions.Moments(float(n), v.mean(axis=0), (v - v.mean(axis=0)).T @ (v - v.mean(axis=0))))
    for kind in ("ridge", "lasso", "mixed"):
        w, b = regressions.lines(sets, kind, grid)
        found = regressions.errors(sets, w, b)
        for i, m in enumerate(sets):
            for j, p in enumerate(grid):
                weights, zero = regressions.line(m, kind, p)
                assert np.allclose(w[i, j], weights, atol=1e-9) and np.isclose(b[i, j], zero) and np.isclose(found[i, j], m.error(weights, zero))


def test_tasks_along_series_hold_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    assert tables.by_series(spark.range(5000), "id").rdd.getNumPartitions() == 50
    assert tables.by_series(spark.range(3), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_spikes_are_worked_out_for_new_values_alone(monkeypatch):
    def plain(ring):
        v = np.array(ring)
        if len(v) < 10 or (v[:-1] == 0).any():
            return None
        r = v[1:] / v[:-1] - 1
        return r[-20:].std(ddof=1) / r.std(ddof=1)

    rng, own, calls = np.random.default_rng(8), alerts.Monitor([], values=70), []
    real = alerts.Monitor.spike_of
    monkeypatch.setattr(alerts.Monitor, "spike_of", lambda self, s: (calls.append(s), real(self, s))[1])
    for i in range(400):
        metrics, _ = own.step(float(i), 1.0, [("abc"[i % 3], 0.0 if i == 60 else float(rng.normal(50, 9)))], {})
        want = max((x for x in map(plain, own.rings.values()) if x is not None), default=None)
        assert (metrics["volatility_spike"] is None) == (want is None) and (want is None or np.isclose(metrics["volatility_spike"], want, rtol=1e-10))
    assert len(calls) == 400


def test_folds_of_a_series_are_fitted_at_once():
    """Plain least squares too, equal columns included."""
    rng, sets = np.random.default_rng(6), []
    for n in (40, 300, 12):
        v = rng.normal(size=(n, 4))
        v[:, 1] = v[:, 0] if n == 300 else v[:, 1]
        sets.append(regressions.Moments(float(n), v.mean(axis=0), (v - v.mean(axis=0)).T @ (v - v.mean(axis=0))))
    train, test = regressions.plain_errors(sets, sets[::-1])
    for m, other, a, b in zip(sets, sets[::-1], train, test):
        fit = regressions.line(m)
        assert np.isclose(m.error(*fit), a) and np.isclose(other.error(*fit), b)
