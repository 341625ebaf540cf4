"""Plan shape: no Python UDFs anywhere, pushed filters, no single-partition window on fact rows."""

import pytest

import contextlib
import io
import re

from ledgerlens.plans.queries import QUERIES
from tests.conftest import SMALL

def formatted(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")     # lists PushedFilters and ReadSchema in full
    return buf.getvalue()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slice_filter_reaches_scan(spark):
    from pyspark.sql import functions as F
    from ledgerlens.sources import fixtures as fx
    df = fx.sales(spark, SMALL).filter(F.col("revenue") > 1000)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)" in plan(df)


def test_pareto_window_is_partitioned_by_bucket(spark):
    p = plan(QUERIES["pareto_count"](spark, SMALL))
    assert "hashpartitioning(bucket" in p


def test_monthly_scan_prunes_columns(spark):
    (columns,) = re.findall(r"ReadSchema: struct<([^>]*)>", formatted(QUERIES["monthly_revenue"](spark, SMALL)))
    assert {c.split(":")[0] for c in columns.split(",")} == {"o_orderdate", "o_totalprice"}


ONE_SCAN = ["tax_component", "tax_breakdown", "item_totals", "item_monthly", "monthly_revenue", "monthly_filled", "moving_avg_3m",
            "revenue_by_year", "yoy_growth", "seasonality", "peak_month", "calendar_pool", "high_value"]
TWO_SCANS = ["gross_net_year", "category_sales", "top_products", "forecast"]


@pytest.mark.parametrize("name,scans", [(n, 1) for n in ONE_SCAN] + [(n, 2) for n in TWO_SCANS])
def test_only_the_needed_tables_are_read(spark, name, scans):
    assert plan(QUERIES[name](spark, SMALL)).count("FileScan parquet") == scans


def test_facets_read_the_items_once(spark, monkeypatch):
    """The lists come from two written frames; the plans that write them read each table once."""
    from ledgerlens.operators import facets
    seen = []

    def write(df):
        seen.append(plan(df))
        return df.checkpoint()

    monkeypatch.setattr(facets, "materialize", write)
    assert plan(QUERIES["facets"](spark, SMALL)).count("FileScan parquet") == 0
    assert [p.count("FileScan parquet") for p in seen] == [4, 2]


def test_enrichment_joins_the_catalog_by_its_key(spark):
    p = plan(QUERIES["enrich"](spark, SMALL))
    assert "Scan ExistingRDD" not in p      # no copy of the facts


def test_product_keys_are_computed_once_a_value(spark):
    """no generator, join condition or trim repeats the normalisation of a value."""
    from ledgerlens.functions.text import product_key
    from ledgerlens.operators import catalog, roles
    txn = spark.createDataFrame([(1, " Blue  Bolt!", "\u00a0x")], "_row_id long, item string, other string")
    parts = spark.createDataFrame([(1, "blue bolt", "P"), (2, "BLUE-BOLT", "Q")], "_row_id long, name_of_item string, under string")
    keys = parts.select(product_key("name_of_item").alias("key"))
    for df in (roles.catalog_overlap(txn, keys), catalog.enrich(txn, parts)):
        own = [line for line in plan(df).splitlines() if "Generate" in line or "Join" in line]
        assert own and not any("regexp_replace" in line for line in own)
    assert "btrim" not in plan(txn.select(product_key("item")))
    assert [tuple(r) for r in catalog.enrich(txn, parts).collect()] == [(1, " Blue  Bolt!", "\u00a0x", "blue bolt", "P")]


def test_keep_first_is_a_hash_aggregate(spark):
    from ledgerlens.operators.integrate import dedupe_first
    df = spark.createDataFrame([(1, "a", "x")], "_row_id long, k string, v string")
    assert "SortAggregate" not in plan(dedupe_first(df, "k"))


REDUCERS = ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject", "GlobalLimit",
            "LocalLimit", "CollectLimit", "LocalTableScan", "Range", "Scan ExistingRDD", "Scan OneRowRelation")
PASS_THROUGH = ("Project", "Filter", "Sort", "Window", "Generate", "Expand", "Coalesce", "ColumnarToRow",
                "InputAdapter", "WholeStageCodegen", "AQEShuffleRead", "BroadcastHashJoin", "Union", "Exchange",
                "SortMergeJoin", "BroadcastNestedLoopJoin", "ShuffledHashJoin", "Subquery", "AdaptiveSparkPlan")


def _lines(plan_text):
    out = []
    for raw in plan_text.splitlines():
        i = next((k for k, ch in enumerate(raw) if ch.isalpha()), None)
        if i is not None:
            out.append((i, raw[i:]))
    return out


def _first_child(lines, idx):
    d = lines[idx][0]
    for j in range(idx + 1, len(lines)):
        if lines[j][0] > d:
            return j
        break
    return None


def single_partition_inputs(plan_text):
    """For each `Exchange SinglePartition`, the first non-pass-through node beneath it."""
    lines = _lines(plan_text)
    found = []
    for i, (_, text) in enumerate(lines):
        if text.startswith("Exchange SinglePartition"):
            j = _first_child(lines, i)
            while j is not None and lines[j][1].startswith(PASS_THROUGH) and not lines[j][1].startswith(REDUCERS):
                j = _first_child(lines, j)
            found.append(lines[j][1] if j is not None else "<none>")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_single_partitions_only_on_reduced_data(spark, name):
    """No Python node anywhere, and no fact rows funnelled into one task: every
    single-partition exchange moves the output of an aggregate, a limit or a
    small generated relation."""
    text = plan(QUERIES[name](spark, SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in text, f"{name} uses {node}"
    for node in single_partition_inputs(text):
        assert node.startswith(REDUCERS), f"{name}: single-partition exchange over {node[:80]}"


def test_year_slice_reaches_scan_as_date_range(spark):
    p = formatted(QUERIES["sales_slice"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in p and "LessThan(o_orderdate,1998-01-01T00:00)" in p
    p = formatted(QUERIES["item_slice"](spark, SMALL))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in p
