"""Sizes, precisions, empty inputs and file forms that the tables at hand don't reach."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.dates import date_form, parse_dayfirst
from ledgerlens.functions.numbers import strict_number
from ledgerlens.operators import catalog as ct
from ledgerlens.operators import clean as cl
from ledgerlens.operators import distribution as dist
from ledgerlens.operators import facets as fc
from ledgerlens.operators import metrics as met
from ledgerlens.operators import pareto as par
from ledgerlens.operators import report as rp
from ledgerlens.sources import export as ex
from ledgerlens.sources import items as itl
from tests.test_functions import col_values


def values(spark, vs):
    return spark.createDataFrame([(f"k{i}", float(v)) for i, v in enumerate(vs)], "k string, v double")


def total(spark, vs):
    return met.totals_by(values(spark, vs).selectExpr("'all' AS k", "v"), "k", "v", "k", "v").first()["v"]


def test_money_is_not_rounded_row_by_row(spark):
    assert total(spark, [0.004] * 1000) == 4.0
    assert total(spark, [2e16, 0.25]) == 2e16 + 0.25
    assert total(spark, [1.5, float("nan")]) == 1.5


def test_slices_take_lists_of_any_size_and_type(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 7), (2, dt.datetime(2024, 1, 1), 8)], "id int, d timestamp_ntz, c int")
    for customers in ([7, 9, 10], [7, *range(100, 1200)], ["7"]):
        assert [r.id for r in fc.multi_slice(df, "d", "c", [], customers).collect()] == [1]


def test_promotion_compares_exactly():
    assert not cl.reaches(3_999_999, 5_000_000) and cl.reaches(4_000_000, 5_000_000) and not cl.reaches(0, 0)


def test_empty_frames(spark):
    raw = spark.createDataFrame([], "_row_id long, Date string, `Customer Name` string, `Gross Total` string")
    with pytest.raises(ValueError):
        cl.clean_sales(raw)
    assert cl.clean_reference(raw)[1] == []
    assert {r.ratio for r in cl.numeric_ratios(raw).collect()} == {None}
    assert dist.high_value_share(values(spark, []), "v").first()[0] is None


def test_negative_total_turns_the_pareto_bound(spark):
    assert par.pareto_count(values(spark, [-10, -20, -70]), "k", "v").first()[0] == 2
    assert par.pareto_count(values(spark, [5, -5]), "k", "v").first()[0] == 2


def test_numbers_have_no_suffix(spark):
    got = col_values(spark, ["1d", "2.5f", " 3 ", "-4.5e2", ".5", "5.", "1,000", "", None, "0x1"], strict_number)
    assert got == [None, None, 3.0, -450.0, 0.5, 5.0, None, None, None, None]


def test_dates_in_all_forms(spark):
    forms = ["05/01/2024 00:00:00", "2024/01/05", "5 Jan 2024", "05.01.2024", "5/1/24", "2024-01-05T00:00:00", "2024-01-05 00:00",
             "5-January-2024", "05-Jan-2024 00:00", "5-sep-99", "5 Sept 1999", "5-Foo-2024", "2024-01/05", "31.04.2024", "1/2/3"]
    got = [g and g.strftime("%Y-%m-%d") for g in col_values(spark, forms, parse_dayfirst)]
    assert got == ["2024-01-05"] * 9 + ["1999-09-05"] * 2 + [None] * 4


def test_dates_with_zones_names_and_half_days(spark):
    forms = ["2024-01-05T10:00:00Z", "2024-01-05 10:00:00+05:30", "05/01/2024 10:00 AM", "20240105T10:00", "20240105100000", "May 5, 2024", "Fri, 5 Jan 2024",
             "5th Jan 2024", "Friday 5 January 2024 10:00", "2024-01", "Jan 2024", "Jan-24", "5-1-24 12:30 pm", "5/1/2024 12:05 am", "5/1/2024 13:00 PM",
             "1st of May", "20241301", "Foo 5, 2024", "2024-Jan-05", "3 may 2024 1:2:3.5 p.m."]
    got = [g and g.strftime("%Y-%m-%d %H:%M:%S") for g in col_values(spark, forms, parse_dayfirst)]
    at, day = "2024-01-05 10:00:00", "2024-01-05 00:00:00"
    assert got == [at] * 5 + ["2024-05-05 00:00:00", day, day, at, "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, "2024-01-05 12:30:00",
                              "2024-01-05 00:05:00", None, None, None, None, day, "2024-05-03 13:02:03"]
    named = [f for f in col_values(spark, forms, date_form)]
    assert named[:4] == ["y-m-d time", "y-m-d time", "d-m-y am/pm", "yyyymmdd time"] and named[15] is None
    narrow = col_values(spark, ["2024-01-05", "5/1/2024"], lambda c: parse_dayfirst(c, forms=["y-m-d"]))
    assert narrow[0] == dt.datetime(2024, 1, 5) and narrow[1] is None


def test_amounts_beyond_the_decimals_are_an_error(spark):
    from pyspark.errors import PySparkException
    from ledgerlens.functions.numbers import money_sum
    total = lambda xs: values(spark, xs).agg(money_sum("v")).first()[0]
    assert total([9e27, 1.0, float("nan")]) == 9e27
    for bad in (1e29, float("inf")):
        with pytest.raises(PySparkException, match="28 digits"):
            total([bad, 1.0])


def test_moments_don_t_depend_on_partitions(spark):
    import numpy as np
    from ledgerlens.operators import distribution as ds, metrics as mt
    r = np.random.default_rng(4)
    x = np.concatenate([r.lognormal(8, 2, 4000), -r.random(50) * 1e6, [0.0, -0.0]])
    seen = set()
    for n in (1, 3, 11):
        df = spark.createDataFrame([(float(v),) for v in r.permutation(x)], "v double").repartition(n)
        seen.add((tuple(mt.revenue_summary(df, "v").first()), tuple(ds.distribution(df, "v").first())))
    assert len(seen) == 1
    (total, mean, median, std), (q1, q3, skew) = seen.pop()
    n, d = len(x), x - x.mean()
    assert (total, mean, median, std) == pytest.approx((x.sum(), x.mean(), np.median(x), x.std(ddof=1)), rel=1e-9)
    assert (q1, q3) == pytest.approx(tuple(np.quantile(x, [0.25, 0.75])))
    assert skew == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-6)
    empty = values(spark, [])
    assert tuple(mt.revenue_summary(empty, "v").first()) == (None,) * 4 and tuple(ds.distribution(empty, "v").first()) == (None,) * 3


def test_wall_clock_times_don_t_move_with_the_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert col_values(spark, ["2024-03-10 02:30:00"], parse_dayfirst) == [dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty_catalog_falls_back_on_the_name(spark):
    txn = spark.createDataFrame([(1, "INV1", " Bolt ")], "_row_id long, invoice_no string, item_name string")
    none = spark.createDataFrame([], "_row_id long, name_of_item string, under string")
    assert [tuple(r)[-2:] for r in ct.enrich(txn, none).collect()] == [("Bolt", "Uncategorized")]


def test_payload_has_no_nan_and_its_lists_are_sorted(spark):
    one = spark.createDataFrame([(float("nan"), float("inf"), 1.0)], "x double, y double, z double")
    ranked = spark.createDataFrame([("b", 1.0), ("c", 3.0), ("a", 1.0)], "k string, revenue double")
    doc = json.loads(rp.payload(spark, {"p": one}, {"top": (ranked, ("-revenue", "k"))}, {"date": "d", "gstin": None}).first()[0])
    assert doc["p"] == {"x": None, "y": None, "z": 1.0} and doc["roles"] == {"date": "d", "gstin": None}
    assert [r["k"] for r in doc["top"]] == ["c", "a", "b"]


def written(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_exports_may_be_wide_late_and_quoted(spark, tmpdir_path):
    rows = [f"{i}/1/2024,Acme,{i}" for i in range(1, 29)] * 2
    text = 'Sales Register,,\nDate,"Party\nName",Gross Total\n' + "\n".join(rows)
    text += '\n5/2/2024,"Acme ""X"" Ltd, Pune",7,late,later\n6/2/2024,"two\nlines",8' + "," * 300 + "end\n"
    df = ex.read_report_csv(spark, written(tmpdir_path, "wide.csv", text))
    assert df.columns[:4] == ["_row_id", "date", "party_name", "gross_total"] and len(df.columns) == 1 + 303
    got = df.orderBy("_row_id").collect()
    assert len(got) == 58
    assert (got[-2].party_name, got[-2].gross_total, got[-2].unnamed_3, got[-2].unnamed_4) == ('Acme "X" Ltd, Pune', "7", "late", "later")
    assert (got[-1].party_name, got[-1][-1]) == ("two\nlines", "end")


def test_short_records_do_not_cost_the_widest(spark, tmpdir_path):
    """a record is taken apart into its own cells, whatever the file's widest record has."""
    text = 'Date,Customer,Total\n' + "".join(f'{i}/1/2024,"C, {i}",{i}\n' for i in range(1, 9)) + "9/1/2024,D,9" + "," * 300 + "end\n"
    df = ex.read_report_csv(spark, written(tmpdir_path, "one.csv", text))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("StructField(") <= 2      # the parser of odd cells, no cell of the width
    got = [(r.customer, r[-1]) for r in df.orderBy("_row_id").collect()]
    assert got == [(f"C, {i}", None) for i in range(1, 9)] + [("D", "end")]


def test_odd_cells_are_read_as_by_the_csv_parser(spark):
    import random
    r = random.Random(3)
    cells = ["", "a", ' "c"', '6" pipe', '""', '"q, c"', '"d ""x"""', '"two\nl"', '""""', '"a"b', '"e" ', '"z"""', '"""z"', '"\\"', '"t"\n', "\\", "é", '"open']
    texts = [",".join(r.choice(cells) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    records = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "_file int, _row_id long, _record string")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = records.select("_file", "_row_id", F.from_csv("_record", ", ".join(f"_c{i} string" for i in range(9)), options).alias("s")).select("_file", "_row_id", "s.*")
    assert ex._split(records, 9).orderBy("_row_id").collect() == parsed.orderBy("_row_id").collect()


def test_several_exports_each_with_its_header(spark, tmpdir_path):
    a = written(tmpdir_path, "a.csv", "Title,,\nDate,Customer,Gross Total\n1/1/2024,A,1\n")
    b = written(tmpdir_path, "b.csv", "Gross Total,Date,Voucher\n2,2/1/2024,V1\n")
    got = {(r.date, r.customer, r.gross_total, r.voucher, r._file) for r in ex.read_report_files(spark, [a, b]).collect()}
    assert got == {("1/1/2024", "A", "1", None, 0), ("2/1/2024", None, "2", "V1", 1)}


def small_splits(spark, size):
    """Files are read in splits of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, str(size))
    return old


def plain_records(text):
    """Cells of the records of a text, by Python's reader of quotes that open a cell."""
    import csv
    import io
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("size", [64, 1000])
def test_records_over_many_splits(spark, tmpdir_path, size):
    import random
    r = random.Random(size)
    cell = ['plain', '5 ft', '6" pipe', 'a "b" c', '""', '"quoted, cell"', '"with ""doubled"""', '"two\nlines"', '"a\n\nb,c\n"', '""""', '"x""\n""y"', '']
    text = "Date,Customer,Gross Total,Item\n" + "".join(",".join(r.choice(cell) for _ in range(4)) + f",{i}\n" for i in range(150))
    path = written(tmpdir_path, "many.csv", text)
    old = small_splits(spark, size)
    try:
        records = ex.read_records(spark, [path])
        got = [tuple(x) for x in ex.read_headless(spark, path).orderBy("_row_id").collect()]
        ids = [x["_row_id"] for x in records.select("_row_id").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(set(ids)) == len(ids)
    want = plain_records(text)
    assert [tuple(c or "" for c in row[1:])[:len(w)] for row, w in zip(got, want, strict=True)] == [tuple(w) for w in want]


def test_an_inch_mark_keeps_lines_apart(spark, tmpdir_path):
    path = written(tmpdir_path, "inch.csv", 'Date,Customer,Item,Gross Total\n1/1/2024,A,5" pipe,1\n2/1/2024,B,"6"" pipe",2\n3/1/2024,C,7" pipe,3\n')
    got = [tuple(r)[1:] for r in ex.read_report_csv(spark, path).orderBy("_row_id").collect()]
    assert got == [("1/1/2024", "A", '5" pipe', "1"), ("2/1/2024", "B", '6" pipe', "2"), ("3/1/2024", "C", '7" pipe', "3")]
    assert not ex.has_quoted_breaks(spark, path)


def test_an_unclosed_quote_is_an_error(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(ex, "LONGEST_RECORD", 50)
    path = written(tmpdir_path, "open.csv", "Date,Customer,Total\n1/1/2024,\"A,1\n" + "2/1/2024,B,2\n" * 60)
    with pytest.raises(ValueError, match="never closed"):
        ex.read_report_csv(spark, path)


def test_keep_first_over_several_files(spark, tmpdir_path):
    from ledgerlens.operators.integrate import dedupe_first
    text = "Date,Customer,Gross Total\n{0}/1/2024,A,{0}\n{0}/2/2024,B{0},{0}\n"
    paths = [written(tmpdir_path, f"{c}.csv", text.format(n)) for n, c in enumerate("zay", 1)]
    both = ex.read_report_files(spark, paths)
    assert both.select("_row_id").distinct().count() == both.count() == 6
    assert {(r.customer, r.gross_total) for r in dedupe_first(both, "customer").collect()} == {("A", "1"), ("B1", "1"), ("B2", "2"), ("B3", "3")}


def test_item_files_with_breaks_and_day_first_dates(spark, tmpdir_path):
    head = "Date,Customer,Item Name,Category,Quantity,Unit Price,Total Value\n"
    path = written(tmpdir_path, "items.csv", head + '2024-01-05,"Acme\nLtd",Bolt,Parts,1,2,2\n05/02/2024,Beta,Nut,Parts,1,1d,3\nsoon,C,D,E,1,1,1\n')
    raw = itl.read_items_csv(spark, path)
    got = {(r.customer, r.date.month, r.unit_price) for r in itl.load_items(raw).collect()}
    assert got == {("Acme\nLtd", 1, 2.0), ("Beta", 2, None)}
    assert tuple(itl.load_items_stats(raw).first()) == (3, 1, 0, 2)


def test_a_cluster_needs_a_named_checkpoint_folder():
    from ledgerlens import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session)
