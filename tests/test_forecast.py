"""The Spark ARIMA fit against a NumPy restatement of the exact likelihood, by its covariance matrix."""

import datetime as dt
import math

import numpy as np
import pytest

from ledgerlens.operators import forecast as fc


def deviance(w, phi, theta):
    """-2 log likelihood of an ARMA(1,1) over its best sigma^2 (but for a constant), from the covariance matrix of all months."""
    n = len(w)
    first = (1 + 2 * phi * theta + theta**2) / (1 - phi**2)
    second = (1 + phi * theta) * (phi + theta) / (1 - phi**2)
    lags = np.array([first] + [second * phi ** (k - 1) for k in range(1, n)])
    cov = lags[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    _, logdet = np.linalg.slogdet(cov)
    return n * math.log(w @ np.linalg.solve(cov, w) / n) + logdet


def best(w):
    """Local search from every point of a grid that is the best of its neighbours."""
    grid = [round(-0.9 + 0.1 * i, 2) for i in range(19)]
    at = min((deviance(w, p, t), p, t) for p in grid for t in grid)
    step = 0.05
    while step > 1e-6:
        new = min((deviance(w, p, t), p, t) for dp in (-2, -1, 0, 1, 2) for dt_ in (-2, -1, 0, 1, 2)
                  for p, t in [(min(0.99, max(-0.99, at[1] + dp * step)), min(0.99, max(-0.99, at[2] + dt_ * step)))])
        at, step = (new, step) if new[0] < at[0] - 1e-13 else (at, step / 2)
    return at


def series_of(spark, ys):
    rows = [(k, dt.date(2020 + i // 12, i % 12 + 1, 1), float(v)) for k, y in ys.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, month_start date, y double")


def simulated(phi, theta, n, seed):
    r = np.random.default_rng(seed)
    e, w = r.normal(0, 10, n + 50), np.zeros(n + 50)
    for t in range(1, n + 50):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(w[50:]) + 500


def test_fit_is_the_exact_maximum(spark):
    ys = {f"{p}/{t}/{n}": simulated(p, t, n, seed) for seed, (p, t, n) in enumerate([(0.6, 0.3, 80), (-0.5, 0.2, 60), (0.2, -0.7, 40), (0.8, 0.0, 25), (0.0, 0.5, 12)])}
    got = {}
    for r in fc.fit_forecast(series_of(spark, ys), ["k"]).collect():
        got.setdefault(r.k, []).append(r)
    for k, y in ys.items():
        w = np.diff(y)
        value, phi, theta = best(w)
        r = sorted(got[k], key=lambda x: x.step)
        assert deviance(w, r[0].phi, r[0].theta) == pytest.approx(value, abs=1e-6)
        assert (r[0].phi, r[0].theta) == pytest.approx((phi, theta), abs=1e-4)
        # forecasts and their variances by conditioning the joint normal of past and future
        n, h = len(w), 6
        p, t = r[0].phi, r[0].theta
        lags = np.array([(1 + 2 * p * t + t**2)] + [(1 + p * t) * (p + t) * p ** (j - 1) for j in range(1, n + h)]) / (1 - p**2)
        cov = lags[np.abs(np.subtract.outer(np.arange(n + h), np.arange(n + h)))]
        s2 = w @ np.linalg.solve(cov[:n, :n], w) / n
        gain = np.linalg.solve(cov[:n, :n], cov[:n, n:]).T
        left = cov[n:, n:] - gain @ cov[:n, n:]
        for x in r:
            one = np.arange(h) < x.step
            mean, se = y[-1] + (gain @ w)[one].sum(), math.sqrt(s2 * left[np.ix_(one, one)].sum())
            assert (x.forecast, x.lower_95, x.upper_95) == pytest.approx((mean, mean - 1.959964 * se, mean + 1.959964 * se), abs=0.011)


def test_months_of_the_forecast(spark):
    rows = fc.fit_forecast(series_of(spark, {"k": simulated(0.5, 0.2, 30, 9)}), ["k"]).orderBy("step").collect()
    assert [r["month"] for r in rows] == ["2022-07", "2022-08", "2022-09", "2022-10", "2022-11", "2022-12"]
    flat = fc.fit_forecast(series_of(spark, {"k": [5.0] * 12}), ["k"]).collect()
    assert {(r.forecast, r.lower_95, r.upper_95) for r in flat} == {(5.0, 5.0, 5.0)}


def test_short_series_dropped(spark):
    series = spark.createDataFrame([("k", dt.date(2020, m, 1), 1.0) for m in range(1, 6)], "k string, month_start date, y double")
    assert fc.fit_forecast(series, ["k"]).count() == 0


def test_coverage_counts_dropped_keys(spark):
    rows = [("short", dt.date(2020, m, 1), 1.0) for m in range(1, 5)] + \
           [("long", dt.date(2020, m, 1), float(m)) for m in range(1, 10)]
    series = spark.createDataFrame(rows, "k string, month_start date, y double")
    r = fc.series_coverage(series, ["k"]).first()
    assert (r["keys_total"], r["keys_forecast"], r["keys_dropped"]) == (2, 1, 1)
    assert {x["k"] for x in fc.fit_forecast(series, ["k"]).collect()} == {"long"}
