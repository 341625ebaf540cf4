"""Column expressions on tiny literal frames (FIXTURES §5 quirks)."""

from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_dayfirst
from ledgerlens.functions.numbers import lenient_number
from ledgerlens.functions.text import (canonical_name, canonical_names, literal_text_key, product_key,
                                       simple_name, text_key, trim_text)


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_lenient_number_quirks(spark):
    vals = ["(100)", "1e3", "INV007", "Rs. 45.00", "--4", ".", "1.2.3", "1,234.50", "5 Dr", "-", "", None, "-12.5"]
    got = col_values(spark, vals, lenient_number)
    assert got == [100.0, 13.0, 7.0, None, None, None, None, 1234.5, 5.0, None, None, None, -12.5]


def test_trim_keeps_empty_and_strips_unicode(spark):
    got = col_values(spark, ["  a b  ", " x ", "", None, "\t\ny\r\n"], trim_text)
    assert got == ["a b", "x", "", None, "y"]


def test_text_key(spark):
    got = col_values(spark, ["  Foo   BAR ", "nan", " None ", "", None, "a  b"], text_key)
    assert got == ["foo bar", None, None, None, None, "a b"]
    assert literal_text_key("  CUSTOMER#7   x ") == "customer#7 x"


def test_product_key(spark):
    got = col_values(spark, [" Blue--Bolt!! ", "###", None, "Air  Handler Unit"], product_key)
    assert got == ["blue bolt", None, None, "air handler unit"]


def test_dayfirst_parse(spark):
    got = col_values(spark, ["2024-01-05", "5/1/2024", "05-01-2024", "5-Jan-2024", "31/02/2024", "01/13/2024", "junk"],
                     parse_dayfirst)
    got = [None if g is None else g.strftime("%Y-%m-%d") for g in got]
    # ISO stays year-month-day; day-first elsewhere; impossible dates are null
    assert got == ["2024-01-05", "2024-01-05", "2024-01-05", "2024-01-05", None, None, None]


def test_canonical_names_and_duplicates():
    assert canonical_name(" Gross\tTotal ") == "gross_total"
    assert canonical_name("GSTIN/UIN") == "gstin_uin"
    assert canonical_name("***") == "unnamed_column"
    # a generated `amount_2` collides with a real `Amount_2`: the later one is bumped
    assert canonical_names(["Amount", "amount ", "Amount_2"]) == ["amount", "amount_2", "amount_2_2"]
    assert canonical_names(["A", "a", "A"]) == ["a", "a_2", "a_3"]
    assert simple_name(" Item Name ") == "item_name"
