"""Report-export reading with header-row recovery.

ERP exports put title lines above the real header.  Files are read as lines, in
splits, and put together to records (quoted cells may hold separators, doubled
quotes and line breaks); one pass finds the widest record, the header row is scored
among the first 40 rows of each file, and the rows after it are split into cells and
named by the header's.  A record's number orders it over all files.
"""

from __future__ import annotations

import re
import uuid
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import canonical_names, trim_text
from ledgerlens.session import scratch_path

ORDER = "_row_id"
MAX_SCAN_ROWS = 40
MIN_HEADER_SCORE = 3.0

# Words a sales-report header row tends to contain.
HEADER_TOKENS = ["date", "particular", "customer", "party", "gross", "total", "gst", "amount",
                 "voucher", "invoice", "sales", "product", "item"]


def placeholders(names) -> list[str]:
    """The names that stand for no name: blank, nan or none, `unnamed...` (pandas), `_cN` (Spark)."""
    return [n for n in map(str, names) if re.fullmatch(r"(?is)\s*(nan|none|unnamed.*|_c\d+)?\s*", n)]


def is_placeholder(name) -> bool:
    return bool(placeholders([name]))


def needs_header_recovery(names) -> bool:
    """No columns at all, or at least half of them placeholders."""
    own = [n for n in names if n != ORDER]
    return 2 * len(placeholders(own)) >= len(own)


def _cells(cols: list[str]):
    arr = F.array(*[F.lower(trim_text(c)) for c in cols])
    return F.filter(arr, lambda c: c.isNotNull() & (c != ""))


def header_scores(df: DataFrame, order_col: str = ORDER, max_rows: int = MAX_SCAN_ROWS, keep_cells: bool = False) -> DataFrame:
    """Score each of the first ``max_rows`` rows that has >= 3 non-empty cells.

    score = 2 * (header tokens found in any cell) + 0.1 * min(cells, 20)
            + distinct cells / cells
    All array work is higher-order functions, no Python.
    """
    return _scored(df.orderBy(order_col).limit(max_rows), order_col, ["raw"] if keep_cells else [])


def _scored(first: DataFrame, order_col: str, keep: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in first.columns if c not in (order_col, "_file")]
    cells = first.select("*", F.col(order_col).alias("row"), _cells(cols).alias("cells"), F.array(*cols).alias("raw"))
    tokens = F.array(*[F.lit(t) for t in HEADER_TOKENS])
    n = F.size("cells")
    hits = F.size(F.filter(tokens, lambda t: F.exists("cells", lambda c: c.contains(t))))
    score = (hits.cast("double") * 2.0 + F.least(n, F.lit(20)).cast("double") * 0.1
             + F.size(F.array_distinct("cells")).cast("double") / n)
    return cells.filter(n >= 3).select("row", score.alias("score"), *keep)


def detect_header(df: DataFrame, order_col: str = ORDER):
    """The header row's order value (`row`) and cells (`raw`), or None below 3.0; the first on ties (one job)."""
    best = (header_scores(df, order_col, keep_cells=True).where(F.col("score") >= MIN_HEADER_SCORE)
            .select("row", "raw", "score").orderBy(F.col("score").desc(), F.col("row").asc()).limit(1).collect())
    return best[0] if best else None


def detect_header_row(df: DataFrame, order_col: str = ORDER) -> Optional[int]:
    """Order value of the best-scoring row (first on ties), None below 3.0 (one job)."""
    best = detect_header(df, order_col)
    return None if best is None else best["row"]


def recover_header(df: DataFrame, order_col: str = ORDER, canonical: bool = True) -> DataFrame:
    """S3: rename by the detected header row and keep the rows after it.

    Returns the frame unchanged when no header row is found confidently.
    One job fetches the header row (its cells become column names); the data
    rows never leave the executors.
    """
    best = detect_header(df, order_col)
    if best is None:
        return df
    cols = [c for c in df.columns if c != order_col]
    raw = [v if v is not None and str(v).strip() else f"Unnamed: {i}" for i, v in enumerate(best["raw"])]
    names = canonical_names(raw) if canonical else raw
    body = df.filter(F.col(order_col) > best["row"])
    return body.select(F.col(order_col), *[F.col(c).alias(n) for c, n in zip(cols, names)])


# A closed quoted cell, and any cell; every repetition is possessive, so a match is one pass.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_CELL = rf'(?:{_QUOTED}[^,]*+|[^",][^,]*+|)'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+$'
#: A line that begins outside a quoted cell and ends inside one; one that begins inside and never leaves, or leaves and ends inside another.
ENDS_INSIDE = rf"^(?:{_CELL},)*+{_OPEN}"
STAYS_INSIDE = rf'^[^"]*+(?:""[^"]*+)*+(?:$|"[^,]*+(?:,{_CELL}(?=,))*+,{_OPEN})'
#: A cell with the separator that ends it (an empty one more may follow a record's last); a quoted cell whose text is between its outer quotes.
_ENDED = rf'(?:{_QUOTED}[^,]*+|"[\s\S]*+|[^,]*+)(?:,|\z)'
_PLAIN = r'^"[^"]++(?:""[^"]*+)*+",?\z'
#: Lines of one record; more are taken for a quote that is never closed.
LONGEST_RECORD = 10_000
SPLIT = ["_file", "part", "block"]


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell goes on in the next line (the first such line begins outside a quoted cell)."""
    return not spark.read.text(path).where(F.col("value").contains('"') & F.col("value").rlike(ENDS_INSIDE)).isEmpty()


def _before(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Whether each row begins inside a quoted cell: `turns` (0/1), to be added to the first row's own state where `open` is true.

    A row takes the state outside to `out` and inside to `into` (1: inside).  Rows
    where both are the same fix the state; a row that swaps them turns it.
    """
    upto = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = rows.withColumn("swaps", F.sum(F.when(F.col("out") > F.col("into"), 1).otherwise(0)).over(upto))
    n = n.withColumn("fixed", F.last(F.when(F.col("out") == F.col("into"), F.struct("out", "swaps")), ignorenulls=True).over(upto))
    after = (F.coalesce("fixed.out", F.lit(0)) + F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))) % 2
    w = Window.partitionBy(*within).orderBy(*order)
    return n.withColumn("after", after).select(
        *rows.columns, F.lag(F.col("fixed").isNull(), 1, True).over(w).alias("open"), F.lag("after", 1, 0).over(w).alias("turns"))


def _with_offsets(splits: DataFrame, count: str) -> DataFrame:
    """The number of records before each split, over all files as listed (a row per split of a file, whatever its size)."""
    order = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("offset", F.coalesce(F.sum(count).over(order), F.lit(0)))


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The records of delimited exports: `_file` (place in ``paths``), `_row_id` (their order over all files) and `_record` (raw text).

    Lines are read in any number of splits and written once with their place.  A
    split's number of records and how its lines leave the state of quotes (outside
    or inside a quoted cell) are combined over the splits of a file, so a record may
    begin in one split and end in another.  A quote counts only where a cell begins
    with it; an inch mark inside a cell does not.  Blank lines are no records.
    """
    lines = None
    for i, path in enumerate(paths):
        one = spark.read.text(path).select(F.lit(i).alias("_file"), F.col("_metadata.file_path").alias("part"),
                                           F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
        lines = one if lines is None else lines.unionByName(one)
    quoted, inside = F.col("value").contains('"'), lambda pattern: F.col("value").rlike(pattern).cast("int")
    lines = _stored(lines.select("*", F.when(quoted, inside(ENDS_INSIDE)).otherwise(0).alias("out"),
                                 F.when(quoted, inside(STAYS_INSIDE)).otherwise(1).alias("into")), "lines")
    if lines.where("out = 1").isEmpty():
        # every line is a record; a split's lines are numbered in a row
        splits = _with_offsets(lines.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "n")
        # broadcast bound: a row for each split
        records = lines.join(F.broadcast(splits), SPLIT).select("_file", (F.col("offset") + F.col("at") - F.col("first")).alias("_row_id"),
                                                                F.col("value").alias("_record"))
        return _filled(records)
    placed = _before(lines, SPLIT, ["at"])
    # what a split does to the state, and with it the state in which each split of a file begins
    last = F.max_by(F.struct("open", "turns", "out", "into"), "at")
    splits = placed.groupBy(*SPLIT).agg(last.alias("l"))
    end = lambda start: F.when(F.when(F.col("l.open"), (F.col("l.turns") + start) % 2).otherwise(F.col("l.turns")) == 1, F.col("l.into")).otherwise(F.col("l.out"))
    begins = _before(splits.select(*SPLIT, end(0).alias("out"), end(1).alias("into")), SPLIT[:2], ["block"]).select(*SPLIT, F.col("turns").alias("start"))
    begin = F.when(F.col("open"), (F.col("turns") + F.col("start")) % 2).otherwise(F.col("turns"))
    # broadcast bound: a row for each split
    known = placed.join(F.broadcast(begins), SPLIT).withColumn("begin", begin).withColumn(
        "end", F.when(F.col("begin") == 1, F.col("into")).otherwise(F.col("out")))
    known = _stored(known.select(*SPLIT, "at", "value", "begin", "end", F.sum(1 - F.col("begin")).over(
        Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("nth")), "known")
    offsets = _with_offsets(known.groupBy(*SPLIT).agg(F.max("nth").alias("n")), "n").select(*SPLIT, "offset")
    numbered = known.join(F.broadcast(offsets), SPLIT).withColumn("_row_id", F.col("offset") + F.col("nth") - 1)
    alone = (F.col("begin") == 0) & (F.col("end") == 0)
    several = numbered.where(~alone).groupBy("_file", "_row_id")
    long = several.count().where(F.col("count") > LONGEST_RECORD).orderBy("_row_id").first()
    if long:
        raise ValueError(f"Record {long['_row_id']} of {paths[long['_file']]} has {long['count']} lines: a quote that is never closed?")
    joined = several.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "at", "value"))), lambda x: x["value"]), "\n").alias("_record"))
    return _filled(_stored(numbered.where(alone).select("_file", "_row_id", F.col("value").alias("_record")).unionByName(joined), "records"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder, a folder per `_file`, and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy("_file").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filled(records: DataFrame) -> DataFrame:
    text = F.ltrim(F.col("_record"), F.lit("﻿"))       # a byte order mark
    return records.select("_file", "_row_id", text.alias("_record")).where(F.col("_record").rlike(r"\S"))


def _split(records: DataFrame, width: int) -> DataFrame:
    """`_file`, `_row_id` and the first ``width`` cells of each record as `_c0`.., null where empty.

    A record is taken apart once, into as many cells as it has itself, so it does not
    cost what the widest record does; `explode` of one array keeps them together.  Quoted
    cells of odd form (they begin with a doubled quote, have text behind the last quote,
    or are never closed) are left to the CSV parser, each with the separator that ends it.
    """
    def text(c):
        inner = F.substr(c, F.lit(2), F.length(c) - F.when(c.endswith('",'), 3).otherwise(2))
        odd = F.from_csv(c, "c string, rest string", {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})["c"]
        return (F.when(~c.startswith('"'), F.rtrim(c, F.lit(",")))
                .when(c.rlike(_PLAIN), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(odd))

    quoted = F.transform(F.regexp_extract_all("_record", F.lit(_ENDED), F.lit(0)), text)
    parts = F.when(F.col("_record").contains('"'), quoted).otherwise(F.split("_record", ","))
    cells = records.select("_file", ORDER, F.explode(F.array(parts)).alias("cells"))
    return cells.selectExpr("_file", ORDER, *[f"nullif(get(cells, {i}), '') AS _c{i}" for i in range(width)])


def widths(records: DataFrame) -> dict[int, int]:
    """The cells of the widest record of each file (a row per file)."""
    bare = F.regexp_replace("_record", rf"(^|,){_QUOTED}", "$1")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return {r["_file"]: r["width"] for r in records.groupBy("_file").agg(F.max(cells).alias("width")).collect()}


def read_headless(spark: SparkSession, path: str) -> DataFrame:
    """Read delimited text with no header as `_c0.._c{N-1}` strings plus a file-order `_row_id`; N is the widest record's.

    Fully blank lines are skipped.
    """
    records = read_records(spark, [path])
    return _split(records, widths(records).get(0, 1)).drop("_file")


def read_report_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """S3 for several exports, each with its own title lines and header: their rows by column name.

    A column that a file lacks is null; `_file` numbers the files as listed, and
    `_row_id` orders the rows over all of them.  Each file's first line is its
    header unless it is mostly placeholders; then the header row is recovered.  All
    files are read, measured and searched for headers together.
    """
    records = read_records(spark, paths)
    width = widths(records)
    if not width:
        raise ValueError(f"No rows in {', '.join(paths)}.")
    nth = F.row_number().over(Window.partitionBy("_file").orderBy(ORDER))
    first = records.withColumn("nth", nth).where(F.col("nth") <= MAX_SCAN_ROWS).drop("nth").collect()      # MAX_SCAN_ROWS rows of each file
    head = _split(spark.createDataFrame(first, records.schema), max(width.values()))
    lines = {r["_file"]: r for r in head.orderBy(F.desc(ORDER)).collect()}      # the first of each file stays
    headers: dict[int, tuple] = {}
    for r in _scored(head, ORDER, ["_file", "raw"]).where(F.col("score") >= MIN_HEADER_SCORE).orderBy("score", F.desc("row")).collect():
        headers[r["_file"]] = (r["row"], r["raw"])      # the best, of these the first, stays
    out = None
    for i, n in sorted(width.items()):
        row, cells = lines[i][ORDER], [lines[i][f"_c{c}"] or "" for c in range(n)]
        body = _split(records.where(F.col("_file") == i), n).drop("_file")
        if needs_header_recovery(cells):
            row, cells = headers.get(i, (None, []))
        if row is not None:
            names = canonical_names([v if v and v.strip() else f"Unnamed: {c}" for c, v in enumerate(cells[:n])])
            body = body.where(F.col(ORDER) > row).toDF(ORDER, *names)
        body = body.withColumn("_file", F.lit(i))
        out = body if out is None else out.unionByName(body, allowMissingColumns=True)
    return out


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3 for one delimited export: use the first line as header unless it is
    mostly placeholders, otherwise recover the header row; error if no rows."""
    return read_report_files(spark, [path]).drop("_file")
