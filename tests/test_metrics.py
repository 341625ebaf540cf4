"""Aggregates and windows on tiny literal frames, with the edge cases of FIXTURES §5."""

import datetime as dt

import pytest

from ledgerlens.operators import distribution as dist
from ledgerlens.operators import metrics as met
from ledgerlens.operators import pareto as par
from ledgerlens.operators import timeseries as ts


def sales(spark, rows):
    return spark.createDataFrame([(dt.datetime.fromisoformat(d), c, v) for d, c, v in rows],
                                 "date timestamp_ntz, customer string, revenue double")


def test_skew_guards(spark):
    one = sales(spark, [("2024-01-01", "a", 5.0), ("2024-01-02", "b", 7.0)])
    assert dist.distribution(one).first()["skew"] is None          # n < 3
    flat = sales(spark, [("2024-01-01", "a", 5.0)] * 4)
    assert dist.distribution(flat).first()["skew"] == 0.0            # constant
    pd = pytest.importorskip("pandas")
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.5]
    df = sales(spark, [("2024-01-01", "a", v) for v in vals])
    r = dist.distribution(df).first()
    s = pd.Series(vals)
    assert r["skew"] == pytest.approx(round(s.skew(), 6))
    assert r["q1"] == pytest.approx(s.quantile(0.25)) and r["q3"] == pytest.approx(s.quantile(0.75))


def test_histogram_constant_and_closed_last_bin(spark):
    flat = sales(spark, [("2024-01-01", "a", 5.0)] * 3)
    h = dist.histogram(flat, "revenue", 30).orderBy("bin").collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 3
    assert h[0]["lo"] == 4.5 and h[-1]["hi"] == pytest.approx(5.5)
    df = sales(spark, [("2024-01-01", "a", float(v)) for v in (0, 1, 2, 3, 10)])
    h = dist.histogram(df, "revenue", 10).orderBy("bin").collect()
    assert h[-1]["count"] == 1 and h[0]["count"] == 1 and sum(r["count"] for r in h) == 5
    empty = sales(spark, [])
    assert dist.histogram(empty, "revenue", 30).count() == 0


def test_monthly_histogram_labels(spark):
    df = sales(spark, [("2024-01-05", "a", 1000.0), ("2024-02-05", "a", 11000.0)])
    rows = {r["bin"]: (r["label"], r["count"]) for r in dist.monthly_histogram(df, bins=10).collect()}
    assert rows[0] == ("1k-2k", 1) and rows[9] == ("10k-11k", 1)
    flat = sales(spark, [("2024-01-05", "a", 1499.5), ("2024-02-05", "a", 1499.5)])
    assert [tuple(r) for r in dist.monthly_histogram(flat).collect()] == [(0, "1500", 2)]


def test_percent_guards_and_ties(spark):
    zero = sales(spark, [("2024-01-01", "a", 0.0), ("2024-01-01", "b", 0.0)])
    assert {r["pct"] for r in par.top_n(zero, "customer", "revenue", 10).collect()} == {0.0}
    assert tuple(par.top_share(zero, "customer", "revenue").first()) == (0.0, 0.0)
    tied = sales(spark, [("2024-01-01", c, 5.0) for c in "dcba"])
    assert [r["customer"] for r in par.top_n(tied, "customer", "revenue", 2).collect()] == ["a", "b"]


def test_pareto_one_big_customer(spark):
    df = sales(spark, [("2024-01-01", "big", 900.0), ("2024-01-01", "s1", 50.0), ("2024-01-01", "s2", 50.0)])
    assert par.pareto_count(df, "customer", "revenue").first()[0] == 1
    curve = par.pareto_curve(df, "customer", "revenue").collect()
    assert [r["cum_pct"] for r in curve] == [90.0, 95.0, 100.0]


def test_pareto_hot_tie_group_is_split(spark):
    # a third of all customers share one total: they must spread over buckets
    rows = [("2024-01-01", f"t{i:04d}", 100.0) for i in range(300)] + \
           [("2024-01-01", f"u{i:04d}", float(i + 1)) for i in range(600)]
    df = sales(spark, rows)
    from ledgerlens.session import materialize
    from pyspark.sql import functions as F
    agg = par.value_by_key(df, "customer", "revenue")
    ranged = agg.repartitionByRange(8, *par._order("customer")).withColumn("b", F.spark_partition_id())
    per = {r["b"]: r["n"] for r in ranged.filter(F.col("value_dec") == 100).groupBy("b").agg(F.count("*").alias("n")).collect()}
    assert len(per) >= 2 and max(per.values()) < 300
    cs = {r["customer"]: r["cum_pct"] for r in par.cumulative_share(df, "customer", "revenue", buckets=8).collect()}
    total = sum(v for _, _, v in rows)
    run = 0.0
    for _, c, v in sorted(rows, key=lambda r: (-r[2], r[1])):
        run += v
        assert cs[c] == pytest.approx(round(run / total * 100, 6), abs=1e-6)
    assert len(cs) == 900 and cs["u0000"] == pytest.approx(100.0)


def test_pareto_buckets_match_global_window(spark):
    import random
    rnd = random.Random(7)
    rows = [("2024-01-01", f"c{i:04d}", float(rnd.choice([10, 20, 20, 35, 50, rnd.randint(1, 500)])))
            for i in range(600)]
    df = sales(spark, rows)
    got = {r["customer"]: r["cum_pct"] for r in par.cumulative_share(df, "customer", "revenue", buckets=7).collect()}
    agg = {}
    for _, c, v in rows:
        agg[c] = agg.get(c, 0) + v
    total = sum(agg.values())
    run = 0.0
    for c, v in sorted(agg.items(), key=lambda kv: (-kv[1], kv[0])):
        run += v
        assert got[c] == pytest.approx(round(run / total * 100, 6), abs=1e-6)


def test_gaps_growth_and_moving_average(spark):
    df = sales(spark, [("2023-01-10", "a", 10.0), ("2023-03-10", "a", 30.0), ("2024-02-01", "a", 0.0),
                       ("2025-01-01", "a", 5.0)])
    observed = ts.monthly_revenue(df).count()
    filled = ts.monthly_filled(df).orderBy("month").collect()
    assert observed == 4 and len(filled) == 25 and filled[1]["revenue"] == 0.0
    ma = {r["month"]: r["ma3"] for r in ts.moving_average(df).collect()}
    assert ma["2023-01"] == 10.0 and ma["2023-03"] == 20.0 and ma["2024-02"] == pytest.approx(40 / 3, abs=1e-6)
    g = {r["year"]: r["growth_pct"] for r in ts.yoy_growth(df).collect()}
    assert g == {2024: -100.0}          # 2025 skipped: previous year is 0
    seas = ts.seasonality(df).collect()
    assert len(seas) == 12 and {r["month_name"] for r in seas} >= {"January", "December"}
    peak = {r["kind"]: r["month"] for r in ts.peak_month(df).collect()}
    assert peak == {"peak": "2023-03", "weakest": "2024-02"}


def test_kpis_on_empty_and_tax_breakdown(spark):
    empty = spark.createDataFrame([], "_revenue double")
    items = spark.createDataFrame([], "total_value double")
    r = met.kpis(empty, items).first()
    assert tuple(r) == (0.0, 0, 0.0, 0.0)
    t = spark.createDataFrame([("1.5", 2.0, 0.0, 0.18)], "cgst string, sgst double, igst double, gst_rate double")
    assert {(x["name"], x["value"]) for x in met.tax_breakdown(t).collect()} == {("cgst", 1.5), ("sgst", 2.0)}


def test_unique_customers_case_sensitive(spark):
    df = spark.createDataFrame([("Acme",), (" acme ",), ("ACME",), ("",), (None,), ("  ",)], "c string")
    assert met.unique_customers(df, "c").first()[0] == 3


def test_calendar_pool_drops_days_past_month_end(spark):
    df = sales(spark, [("2024-01-10", "a", 1.0)])
    got = [r["date"].isoformat() for r in ts.calendar_pool(df, days=(5, 30)).orderBy("date").collect()]
    assert len(got) == 23 and "2024-02-05" in got and not any(g.startswith("2024-03-01") for g in got)


def test_exact_quantiles_match_pandas(spark):
    import random
    pd = pytest.importorskip("pandas")
    from ledgerlens.operators.quantiles import exact_quantiles
    rnd = random.Random(11)
    # a third of the rows share one value: it must not matter for the result
    vals = [5.0 if i % 3 == 0 else rnd.random() * 1000 for i in range(1000)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.75, 0.99], buckets=6)
    got = tuple(spark.range(1).select(q.alias("q")).first()["q"])
    s = pd.Series([v for v in vals if v is not None])
    assert got == pytest.approx(tuple(s.quantile(p) for p in (0.1, 0.25, 0.5, 0.75, 0.99)), rel=1e-12)
    empty = spark.createDataFrame([], "x double")
    assert spark.range(1).select(exact_quantiles(empty, "x", [0.5]).q0).first()[0] is None
