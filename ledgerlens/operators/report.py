"""Result payload and key-insight row.

Each part is a small (one-row or top-N) DataFrame; they are combined with
scalar subqueries, so nothing is cross-joined and no data passes through the
driver until the caller writes or collects the single payload row.
"""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def one_row_struct(df: DataFrame):
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("v")).scalar()


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, which JSON can hold."""
    def own(field):
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, (DoubleType, FloatType)):
            return c
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(field.name)

    return df.select(*[own(f) for f in df.schema.fields])


def rows_array(df: DataFrame, order: Sequence = ()):
    """A small bounded frame (a top-N) as an array-of-structs scalar subquery.

    ``order`` names the columns to sort by, `-name` for descending; the sort key
    is put in front of each row, sorted inside the aggregate and dropped.
    """
    keys = [(F.negative(F.col(o[1:])) if o.startswith("-") else F.col(o)).alias(f"k{i}") for i, o in enumerate(order)]
    packed = F.struct(*keys, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.agg(F.transform(F.sort_array(F.collect_list(packed)), lambda x: x["row"]).alias("v")).scalar()


def payload(spark: SparkSession, parts: Mapping[str, DataFrame], lists: Mapping[str, tuple] = (),
            names: Mapping[str, Optional[str]] = ()) -> DataFrame:
    """One row holding every part as JSON (`NaN` becomes null, keys text).

    ``parts`` are one-row frames, ``lists`` pairs of a bounded frame (top-N and
    the like) and its order, ``names`` plain texts such as detected roles.
    """
    fields = [one_row_struct(finite(df)).alias(k) for k, df in parts.items()]
    fields += [rows_array(finite(df), order).alias(k) for k, (df, order) in dict(lists).items()]
    fields += [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in dict(names).items()]).alias("roles")] if names else []
    doc = F.struct(*fields)
    return spark.range(1).select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))


def payload_rows(document: DataFrame) -> DataFrame:
    """The payload read back from its JSON: section, i (place in a list, else 0), field, and its value as number or else text."""
    text = F.col("text")
    sections = document.select(F.explode(F.from_json("payload", "map<string,string>")).alias("section", "json"))
    each = sections.select("section", F.posexplode(F.when(F.col("json").startswith("["), F.from_json("json", "array<map<string,string>>"))
                                                   .otherwise(F.array(F.from_json("json", "map<string,string>")))).alias("i", "row"))
    number = text.try_cast("double")
    return each.select("section", "i", F.explode("row").alias("field", "text")).select(
        "section", "i", "field", number.alias("number"), F.when(number.isNull(), text).alias("text"))


def write_payload(df: DataFrame, path: str) -> None:
    """S6 sink: the payload row as a JSON text file (one line)."""
    df.coalesce(1).write.mode("overwrite").text(path)


def insights(spark: SparkSession, top_customers: DataFrame, category_mix: DataFrame,
             forecast: DataFrame, peak: DataFrame) -> DataFrame:
    """First row of each ranked result as one row of columns."""
    tc = top_customers.orderBy(F.col("revenue").desc(), F.col("customer").asc()).limit(1)
    cm = category_mix.orderBy(F.col("revenue").desc(), F.col("category").asc()).limit(1)
    fc = forecast.orderBy(F.col("step").asc(), F.col("month").asc()).limit(1)
    pk = peak.filter(F.col("kind") == "peak")
    t, c, f, p = one_row_struct(tc), one_row_struct(cm), one_row_struct(fc), one_row_struct(pk)
    return spark.range(1).select(
        t.customer.alias("top_customer"), t.revenue.alias("top_customer_revenue"), t.pct.alias("top_customer_pct"),
        c.category.alias("lead_category"), c.pct.alias("lead_category_pct"),
        f.month.alias("next_forecast_month"), f.forecast.alias("next_forecast"),
        p.month.alias("peak_month"), p.revenue.alias("peak_revenue"))
