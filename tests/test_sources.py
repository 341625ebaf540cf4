"""Sources and sinks: CSV round trip, header recovery from a real file, placeholders."""

import datetime as dt
import os

import pytest

from ledgerlens.sources import export as ex
from ledgerlens.sources import items as itl
from ledgerlens.sources.sinks import write_csv_sorted


def test_placeholder_headers():
    assert ex.needs_header_recovery(["Acme Traders", "Unnamed: 1", "Unnamed: 2"])
    assert ex.needs_header_recovery(["_c0", "_c1", "Sales"])
    assert ex.needs_header_recovery([])
    assert not ex.needs_header_recovery(["Date", "Customer", "Unnamed: 2"])


def test_items_csv_round_trip(spark, tmpdir_path):
    rows = [(dt.datetime(2024, 1, 5), "INV001", 'Acme, "Ltd"', "Cooling Coil", "Components", 2, 7200.0, 14400.0),
            (dt.datetime(2023, 12, 25), "INV002", " Beta ", "Control Panel", None, 1, 9800.0, 9800.0),
            (None, "INV003", "Gamma", "Refrigerant Gas", "Consumables", 3, 2800.0, 8400.0)]
    df = spark.createDataFrame(rows, "Date timestamp_ntz, `Invoice No` string, Customer string, `Item Name` string, "
                                     "Category string, Quantity int, `Unit Price` double, `Total Value` double")
    out = os.path.join(tmpdir_path, "items_csv")
    write_csv_sorted(df.withColumn("Date", df["Date"].cast("date")), out, date_col="Date", single_file=True)
    back = itl.read_items_csv(spark, out)
    assert back.columns[:2] == ["Date", "Invoice No"]
    loaded = itl.load_items(back).orderBy("date").collect()
    assert len(loaded) == 2                                   # the dateless row is dropped
    assert loaded[0]["customer"] == "Beta" and loaded[0]["category"] == "Uncategorized"
    assert loaded[1]["customer"] == 'Acme, "Ltd"' and loaded[1]["total_value"] == 14400.0
    lenient = itl.load_items_lenient(back.drop("Total Value", "Category")).orderBy("date").collect()
    assert [r["total_value"] for r in lenient] == [9800.0, 14400.0]
    assert lenient[0]["_customer_norm"] == "beta" and lenient[1]["_product_norm"] == "cooling coil"
    with pytest.raises(ValueError):
        itl.load_items(back.drop("Category"))


def test_report_csv_header_recovery(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "daybook.csv")
    lines = ["Acme Traders Pvt Ltd,,,,", "Sales Register,,,,", "", "Date,Particulars,Voucher No,Gross Total,Sales",
             "5/1/2024,Foo Ltd,INV1,\"1,200.00\",1000", "6/1/2024,Bar,INV2,300,250"]
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")
    df = ex.read_report_csv(spark, path)
    assert df.columns == ["_row_id", "date", "particulars", "voucher_no", "gross_total", "sales"]
    got = [tuple(r)[1:] for r in df.orderBy("_row_id").collect()]
    assert got == [("5/1/2024", "Foo Ltd", "INV1", "1,200.00", "1000"), ("6/1/2024", "Bar", "INV2", "300", "250")]
    plain = os.path.join(tmpdir_path, "plain.csv")
    with open(plain, "w") as fh:
        fh.write("Date,Customer,Amount\n2024-01-01,A,5\n")
    p = ex.read_report_csv(spark, plain)
    assert p.columns == ["_row_id", "date", "customer", "amount"] and p.count() == 1


def test_header_scores_tie_keeps_first(spark):
    rows = [(0, "Date", "Customer", "Total"), (1, "Date", "Customer", "Total"), (2, "x", "y", "z")]
    df = spark.createDataFrame(rows, "_row_id long, _c0 string, _c1 string, _c2 string")
    assert ex.detect_header_row(df) == 0
    low = spark.createDataFrame([(0, "a", "b", "c")], "_row_id long, _c0 string, _c1 string, _c2 string")
    assert ex.detect_header_row(low) is None        # best score below 3.0


def test_payload_sink_writes_valid_json(spark, tmpdir_path):
    import glob
    import json
    from ledgerlens.operators import report as rp
    one = spark.createDataFrame([(1.5, None)], "total double, net double")
    top = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "customer string, revenue double")
    df = rp.payload(spark, {"revenue": one}, {"top": (top, ("-revenue",))})
    out = os.path.join(tmpdir_path, "payload")
    rp.write_payload(df, out)
    text = "".join(open(f).read() for f in glob.glob(os.path.join(out, "part-*")))
    doc = json.loads(text)
    assert doc["revenue"] == {"total": 1.5, "net": None}
    assert [r["customer"] for r in doc["top"]] == ["a", "b"]
