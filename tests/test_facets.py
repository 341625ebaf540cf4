"""Slices and facets on tiny frames."""

import datetime as dt

from ledgerlens.operators import facets as fc
from ledgerlens.operators.clean import sales_base
from ledgerlens.sources.items import load_items_lenient


def frames(spark):
    s = spark.createDataFrame([
        (1, dt.datetime(2023, 1, 5), " Acme ", 10.0), (2, dt.datetime(2024, 2, 5), "beta", 20.0),
        (3, dt.datetime(2024, 3, 5), "Zed", 5.0), (4, None, "acme", 1.0)],
        "_row_id long, date timestamp_ntz, customer string, revenue double")
    i = spark.createDataFrame([
        (1, dt.datetime(2023, 1, 5), "acme", "Blue Bolt", "Parts", 1.0, 2.0, 2.0),
        (2, dt.datetime(2024, 2, 5), "Beta", "red widget", "Parts", 1.0, 3.0, 3.0)],
        "_row_id long, date timestamp_ntz, customer string, item_name string, category string, "
        "quantity double, unit_price double, total_value double")
    return sales_base(s, "date", "revenue", "customer"), load_items_lenient(i)


def test_slices_and_scope(spark):
    sb, ib = frames(spark)
    assert {r["_row_id"] for r in fc.slice_sales(sb, ib, 2024, None, None).collect()} == {2, 3}
    assert {r["_row_id"] for r in fc.slice_sales(sb, ib, None, "  ACME ", None).collect()} == {1}
    # product scope: customers who bought it (normalised); 'all' and blank mean no filter (D3)
    assert {r["_row_id"] for r in fc.slice_sales(sb, ib, None, None, " blue  BOLT").collect()} == {1}
    assert fc.slice_sales(sb, ib, None, None, "nothing").count() == 0
    assert fc.slice_sales(sb, ib, None, None, "all").count() == 3
    assert fc.slice_items(ib, None, None, "Red Widget").count() == 1


def test_facets_ignore_their_own_filter(spark):
    sb, ib = frames(spark)
    f = {(r["facet"], r["value"]) for r in fc.facets(sb, ib, 2024, None, None).collect()}
    assert ("year", "2023") in f and ("year", "2024") in f          # year list ignores the year filter
    assert {v for k, v in f if k == "customer"} == {"beta", "Zed"}  # customers obey the year filter
    assert {v for k, v in f if k == "product"} == {"red widget"}


def test_facet_display_order_and_report_options(spark):
    df = spark.createDataFrame([("year", "2024"), ("year", "2023"), ("customer", "beta"), ("customer", "Acme"),
                                ("customer", "zed")], "facet string, value string")
    got = [tuple(r) for r in fc.sort_facets(df).collect()]
    assert got == [("customer", "Acme"), ("customer", "beta"), ("customer", "zed"), ("year", "2023"), ("year", "2024")]
    raw = spark.createDataFrame([(dt.datetime(2024, 1, 1), " a "), (dt.datetime(2024, 1, 2), "  "), (None, "b")],
                                "d timestamp_ntz, c string")
    opts = {(r["facet"], r["value"]) for r in fc.report_options(raw, "d", "c").collect()}
    assert opts == {("year", "2024"), ("customer", " a ")}         # raw text kept, blanks and dateless rows out
