"""Cleaning composites and integration on tiny frames."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean as cl
from ledgerlens.operators import integrate as ig


def raw_sales(spark):
    rows = [(1, "05/01/2024", " Acme ", "INV1", "1,000.00", "900"),
            (2, "2024-02-10", None, "INV2", "2000", None),
            (3, "junk", "Beta", "INV3", "300", "250"),
            (4, "7-Mar-2024", "Beta", "INV4", "-", "100"),
            (5, "8/3/2024", "acme", "INV5", "500 Dr", "400")]
    return spark.createDataFrame(rows, "_row_id long, `Invoice Date` string, `Party Name` string, "
                                       "`Voucher No` string, `Gross Total` string, Sales string")


def test_clean_sales(spark):
    cs = cl.clean_sales(raw_sales(spark))
    assert (cs.date_column, cs.revenue_column, cs.customer_column) == ("invoice_date", "gross_total", "party_name")
    assert set(cs.promoted) >= {"voucher_no", "gross_total", "sales"}
    st = cs.stats.first()
    assert (st[0], st[1], st[2]) == (2, 1, 3)
    rows = {r["_row_id"]: r for r in cs.dataframe.collect()}
    assert set(rows) == {1, 2, 5}
    assert rows[2]["party_name"] == "Unknown Customer"
    assert rows[2]["sales"] == 650.0                     # median of 900 and 400
    assert rows[1]["year_month"] == "2024-01" and rows[5]["gross_total"] == 500.0


def test_clean_sales_errors(spark):
    df = spark.createDataFrame([(1, "x", "y")], "_row_id long, name string, city string")
    with pytest.raises(ValueError):
        cl.clean_sales(df)


def test_integration_keep_first_and_status(spark):
    cs = cl.clean_sales(raw_sales(spark))
    master = spark.createDataFrame([(1, "ACME", "gold"), (2, "acme ", "silver"), (3, None, "x"), (4, "Zed", "y")],
                                   "_row_id long, `Customer Name` string, Tier string")
    m, _ = cl.clean_reference(master)
    merged, summary = ig.integrate_sales_and_master(cs, m)
    tiers = {r["_row_id"]: (r["tier"], r["_merge_status"]) for r in merged.collect()}
    assert tiers[1] == ("gold", "matched") and tiers[5] == ("gold", "matched")
    assert tiers[2] == (None, "missing_in_master")
    s = summary.first()
    assert (s["total_rows"], s["matched_rows"], s["master_duplicate_rows_removed"]) == (3, 2, 2)
    assert s["match_rate_pct"] == pytest.approx(66.666667)


def test_integration_skipped_without_keys(spark):
    cs = cl.clean_sales(raw_sales(spark))
    cat = spark.createDataFrame([(1, "Bolt", 5.0)], "_row_id long, item string, rate double")
    merged, summary = ig.integrate_sales_and_master(cs, cat)
    assert summary.first()["integration_status"] == "skipped" and merged.count() == 3
    with pytest.raises(ValueError):
        ig.integrate_sales_and_master(cs, cat, on_missing="error")


def test_dedupe_first_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "_row_id long, k string, v long")
    out = {r["k"]: r["v"] for r in ig.dedupe_first(df, "k").collect()}
    assert out["hot"] == 1 and len(out) == 101


def test_join_key_choice_prefers_tax_id():
    assert ig.choose_join_keys(["gstin", "party_name"], ["gstin_no", "customer_name"]) == ("gstin", "gstin_no", "gstin")
    assert ig.choose_join_keys(["party_name"], ["customer_name", "gstin"]) == ("party_name", "customer_name", "customer")
    assert ig.choose_join_keys(["amount"], ["rate"]) is None


def test_compatible_variant_keeps_key(spark):
    cs = cl.clean_sales(raw_sales(spark))
    master = spark.createDataFrame([(1, "ACME", "gold")], "_row_id long, `Customer Name` string, Tier string")
    m, _ = cl.clean_reference(master)
    merged, _ = ig.integrate_sales_and_master(cs, m, on_missing="error", keep_key=True)
    keys = {r["_row_id"]: r["join_key"] for r in merged.collect()}
    assert keys[1] == "acme" and keys[2] == "unknown customer"


def test_validation_guards(spark):
    from ledgerlens.sources import items as itl
    empty = spark.createDataFrame([(None, "a", "b", "c", "1", "2", "3")],
                                  "Date string, Customer string, `Item Name` string, Category string, "
                                  "Quantity string, `Unit Price` string, `Total Value` string")
    with pytest.raises(ValueError):
        itl.load_items(empty, check_empty=True)
    no_rev = spark.createDataFrame([(1, "2024-01-01", "abc")], "_row_id long, date string, gross_total string")
    with pytest.raises(ValueError):
        cl.clean_sales(no_rev)
