"""Sinks: sorted CSV export (S7) and the JSON payload file (S6, see operators.report)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv_sorted(df: DataFrame, path: str, date_col: str = "date", order_col: str = "_row_id",
                     single_file: bool = False) -> None:
    """Write with a header, rows ordered by date (then the row order).

    The global sort is a range-partitioned sort, so part files are
    themselves in date order; ``single_file`` funnels the sorted output
    through one task and is meant for small extracts only.
    """
    keys = [F.col(date_col).asc_nulls_last()] + ([F.col(order_col)] if order_col in df.columns else [])
    out = df.orderBy(*keys)
    if single_file:
        out = out.coalesce(1)
    # RFC 4180 quoting (quotes doubled), as spreadsheet exports and the item reader expect
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
