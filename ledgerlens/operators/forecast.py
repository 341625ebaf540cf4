"""Many-series monthly revenue forecast: ARIMA(1,1,1) by exact maximum likelihood.

One model per key.  Each key's gap-filled monthly series (one value per
month, so its length is bounded by the time span, not by the data volume) is
gathered into an array; the fit folds each candidate's recursion with `aggregate`,
all inside one projection per key -- no Python, no join against a grid.  Keys are the
scale axis: they spread over tasks like any other rows.

Model on w_t = y_t - y_{t-1} (no constant): w_t = phi w_{t-1} + e_t + theta e_{t-1}.
The Kalman recursion of this model has one state to carry: the prediction p_t of w_t
and the ratio r_t of its error's variance to sigma^2,
    r_1 = (1 + 2 phi theta + theta^2) / (1 - phi^2),  p_1 = 0,
    p_{t+1} = phi w_t + (theta / r_t) (w_t - p_t),  r_{t+1} = 1 + theta^2 - theta^2 / r_t.
With S = sum (w_t - p_t)^2 / r_t the exact Gaussian likelihood is largest, over sigma^2
too, where S * (r_1 ... r_n)^(1/n) is smallest; sigma^2 = S / n.  The search begins with
the best of a coarse grid (-0.9..0.9 step 0.1) and goes on to the best of 25 points
around it, halving the step until it is 6e-6, inside +-0.99.
h-step mean: y_n + p_{n+1} (1 + phi + ... + phi^(h-1));
variance: sigma^2 (sum_{j<h} psi_j^2 + (r_{n+1} - 1) (1 + phi + ... + phi^(h-1))^2), with
psi_0 = 1, psi_j = 1 + (phi + theta)(1 - phi^j)/(1 - phi); 95 % band +- 1.959964 se.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.timeseries import fill_months, monthly_totals

Z95 = 1.959964
MIN_POINTS = 6


def monthly_series(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str]) -> DataFrame:
    """Gap-filled monthly totals per key: keys..., month_start, y (double)."""
    m = fill_months(monthly_totals(df, date_col, value_col, keys), keys)
    return m.select(*keys, "month_start", F.col("revenue_dec").cast("double").alias("y"))


HALVINGS = 14


def _filtered(phi: str, theta: str) -> str:
    """SQL: fold the Kalman recursion over w, returning p and r of the next month, the sum of squares and the product of the ratios."""
    return (f"aggregate(w, named_struct('p', 0D, 'r', (1D + 2D * {phi} * {theta} + {theta} * {theta}) / (1D - {phi} * {phi}), 'ss', 0D, 'pr', 1D), "
            f"(a, x) -> named_struct('p', {phi} * x + {theta} / a.r * (x - a.p), 'r', 1D + {theta} * {theta} - {theta} * {theta} / a.r, "
            f"'ss', a.ss + (x - a.p) * (x - a.p) / a.r, 'pr', a.pr * a.r))")


def _best(grid_sql: str) -> str:
    """SQL: the point (phi, theta) of a grid with the largest likelihood."""
    value = f"transform(array({_filtered('g.phi', 'g.theta')}), f -> f.ss * pow(f.pr, 1D / size(w)))[0]"
    return f"array_min(transform({grid_sql}, g -> named_struct('v', {value}, 'phi', g.phi, 'theta', g.theta)))"


COARSE = ("transform(sequence(0, 360), i -> named_struct("
          "'phi', round(-0.9D + CAST(i DIV 19 AS DOUBLE) * 0.1D, 2), "
          "'theta', round(-0.9D + CAST(i % 19 AS DOUBLE) * 0.1D, 2)))")
AROUND = ("transform(sequence(0, 24), i -> named_struct("
          "'phi', least(0.99D, greatest(-0.99D, b.phi + CAST(i DIV 5 - 2 AS DOUBLE) * s)), "
          "'theta', least(0.99D, greatest(-0.99D, b.theta + CAST(i % 5 - 2 AS DOUBLE) * s))))")
#: The steps of the search, exact in binary.
STEPS = "array(" + ", ".join(f"{2.0 ** -(k + 4)!r}D" for k in range(HALVINGS)) + ")"


def _let(value_sql: str, name: str, body_sql: str) -> str:
    """Bind ``value_sql`` to ``name`` once for ``body_sql``.

    Chained withColumn steps get collapsed by the optimizer, which then
    re-evaluates a costly array expression at every reference; a one-element
    `transform` evaluates it exactly once.
    """
    return f"transform(array({value_sql}), {name} -> {body_sql})[0]"


def fit_forecast(series: DataFrame, keys: Sequence[str], steps: int = 6, min_points: int = MIN_POINTS) -> DataFrame:
    """Per key, fit ARIMA(1,1,1) by exact likelihood and forecast ``steps`` months.

    Output: keys..., month ('yyyy-MM'), step, forecast, lower_95, upper_95,
    phi, theta.  Keys with fewer than ``min_points`` months are dropped.
    """
    ks = list(keys)
    arr = series.groupBy(*ks).agg(
        F.sort_array(F.collect_list(F.struct("month_start", "y"))).alias("s"))
    arr = arr.filter(F.size("s") >= min_points)
    # the sums of powers that mean and variance need
    powers = "aggregate(sequence(0, h - 1), 0D, (a, j) -> a + pow(b.phi, j))"
    psi = ("aggregate(sequence(0, h - 1), 0D, (a, j) -> a + pow(CASE WHEN j = 0 THEN 1D "
           "ELSE 1D + (b.phi + b.theta) * (1D - pow(b.phi, j)) / (1D - b.phi) END, 2))")
    horizon = f"""transform(sequence(1, {int(steps)}), h -> named_struct('step', h, 'phi', b.phi, 'theta', b.theta,
          'mean', y[size(y) - 1] + f.p * {powers},
          'var', f.ss / size(w) * ({psi} + (f.r - 1D) * pow({powers}, 2))))"""
    body = _let(_filtered("b.phi", "b.theta"), "f", horizon)
    body = _let(f"aggregate({STEPS}, {_best(COARSE)}, (b, s) -> {_best(AROUND)})", "b", body)
    body = _let("transform(sequence(1, size(y) - 1), i -> y[i] - y[i - 1])", "w", body)
    body = _let("transform(s, r -> r.y)", "y", body)
    out = arr.select(*ks, F.expr("s[size(s) - 1].month_start").alias("last_month"),
                     F.explode(F.expr(body)).alias("p"))
    se = F.sqrt(F.col("p.var"))
    return out.select(
        *ks, F.date_format(F.add_months("last_month", F.col("p.step")), "yyyy-MM").alias("month"),
        F.col("p.step").alias("step"), F.round(F.col("p.mean"), 2).alias("forecast"),
        F.round(F.col("p.mean") - Z95 * se, 2).alias("lower_95"),
        F.round(F.col("p.mean") + Z95 * se, 2).alias("upper_95"),
        F.col("p.phi").alias("phi"), F.col("p.theta").alias("theta"))


def forecast_revenue(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str] = (),
                     steps: int = 6) -> DataFrame:
    """T1 + T2 over raw rows: monthly series per key, then the forecast."""
    ks = list(keys)
    if not ks:
        df = df.withColumn("_series", F.lit("all"))
        ks = ["_series"]
    return fit_forecast(monthly_series(df, date_col, value_col, ks), ks, steps)


def series_coverage(series: DataFrame, keys: Sequence[str], min_points: int = MIN_POINTS) -> DataFrame:
    """T2 report: how many keys were forecast and how many were dropped for
    having fewer than ``min_points`` months (one row)."""
    per_key = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"))
    return per_key.agg(F.count(F.lit(1)).alias("keys_total"),
                       F.count_if(F.col("months") >= min_points).alias("keys_forecast"),
                       F.count_if(F.col("months") < min_points).alias("keys_dropped"))
