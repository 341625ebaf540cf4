"""URL filter: rules first, then a tree of path templates for each host.

Path segments form a tree below their host.  Going down level by level, a branch
point with many different children (by number and by share of its urls) is
variable.  A child whose share of labelled bad pages does not differ significantly
from its siblings' (two proportions, normal test) is merged into the wildcard, and
a child that does keeps its own branch.  Below a variable point, where most children
have few labels, the test is corrected for continuity, lest each rare label pass
it.  What all paths of a branch have in common is one edge, however many segments
long, so there are as many rounds as branch points on a path; they run until every
path has ended.  A template (leaf) is rejected when its share of bad labels,
smoothed towards its host's and that towards all hosts', exceeds a threshold.

Everything is grouping and joining on distinct (host, segments), which partial
aggregation shrinks first; nothing is gathered.

Defined results: a null url or one without `://` has an empty host and path (one
template of its own); an unlabelled template falls back on its host and then on
all hosts, and is allowed where there are no labels at all; repeated rows are
judged alike (and count each time); conflicting labels of one page count as bad;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, shared_folder, written

#: (verdict, rule), a rule being host/path-prefix; fixed values of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MANY_CHILDREN = 8
CHILDREN_SHARE = 0.2    # children for each url of the branch point
SIGNIFICANT_Z = 1.96
SMOOTHING = 5.0
REJECT = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(pages: DataFrame) -> DataFrame:
    """Adds host and path of `url`."""
    at = F.coalesce(F.locate("://", F.col("url")), F.lit(0))
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise(F.lit(""))
    return (pages.withColumn("rest", rest)
            .withColumn("host", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _LOWER))
            .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)).drop("rest"))


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, as (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, prefix = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + prefix))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments() -> Column:
    """The path's segments, digits runs as one shape."""
    return F.filter(F.split(F.regexp_replace("path", "[0-9]+", "0"), "/"), lambda s: s != F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, parts, template) for every distinct path of (host, parts, bad), bad being 1, 0 or null."""
    tree = (pages.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.sum("bad").alias("bad"))
            .withColumn("bad", F.coalesce("bad", F.lit(0))).withColumn("template", F.array().cast("array<string>")).withColumn("rest", F.col("parts")))
    spark, folder, level = pages.sparkSession, shared_folder(pages.sparkSession, "templates"), 0
    tree.write.parquet(f"{folder}/0")
    schema = tree.schema
    counts = [F.sum(c).alias(c) for c in ("n", "known", "bad")]
    known, bad = F.nullif(F.col("known"), F.lit(0)), F.col("bad")
    other_known, other_bad = F.nullif(F.col("all_known") - F.col("known"), F.lit(0)), F.col("all_bad") - F.col("bad")
    pooled, each = F.col("all_bad") / F.nullif(F.col("all_known"), F.lit(0)), 1 / known + 1 / other_known
    variable = (F.col("children") >= MANY_CHILDREN) & (F.col("children") >= CHILDREN_SHARE * F.col("all_n"))
    apart = F.abs(bad / known - other_bad / other_known)
    z = F.when(variable, apart - each / 2).otherwise(apart) / F.sqrt(F.nullif(pooled * (1 - pooled) * each, F.lit(0.0)))
    name = F.when((F.col("children") == 1) | F.coalesce(z >= SIGNIFICANT_Z, F.lit(False)), F.col("child")).otherwise(F.lit("*"))
    while not (going := spark.read.schema(schema).parquet(f"{folder}/{level}").where(F.size("rest") > 0)).isEmpty():
        # what all paths of a branch begin with is one edge: that of the least and the greatest of them
        ends = going.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        same = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
        ends = ends.select("host", "template", F.when(same > 0, same - 1).otherwise(F.size("low")).alias("shared"))
        gone = (going.join(ends, ["host", "template"]).withColumn("head", F.slice("rest", 1, F.col("shared")))
                .select("host", "parts", "n", "known", "bad", F.concat("template", "head").alias("template"),
                        F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("rest")))
        branch = gone.withColumn("child", F.get("rest", F.lit(0)))
        child = branch.where(F.size("rest") > 0).groupBy("host", "template", "child").agg(*counts)
        point = child.groupBy("host", "template").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad")))
        named = child.join(point, ["host", "template"]).select("host", "template", "child", F.array(name).alias("name"))
        level += 1
        # a path that ends here has no child and keeps its template
        tree = branch.join(named, ["host", "template", "child"], "left").select(
            "host", "parts", "n", "known", "bad", F.concat("template", F.coalesce("name", F.array().cast("array<string>"))).alias("template"),
            F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"))
        tree.write.parquet(f"{folder}/{level}")
    return (spark.read.schema(schema).parquet(*(f"{folder}/{k}" for k in range(level + 1))).where(F.size("rest") == 0)
            .select("host", "parts", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "known", "bad"))


def purity(tree: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(host, template, bad_share): the share of bad labels, smoothed by the host's and that by all hosts'."""
    leaf = tree.groupBy("host", "template").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
    host = leaf.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad"))
    everything = host.agg(F.coalesce(F.sum("host_bad") / F.nullif(F.sum("host_known"), F.lit(0)), F.lit(0.0)).alias("overall"))  # one row
    host = host.join(F.broadcast(everything)).select(
        "host", ((F.col("host_bad") + smoothing * F.col("overall")) / (F.col("host_known") + smoothing)).alias("host_share"))
    return leaf.join(host, "host").select("host", "template", ((F.col("bad") + smoothing * F.col("host_share")) /
                                                               (F.col("known") + smoothing)).alias("bad_share"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """Verdict on every (page_id, url); labels are (page_id, bad) with bad 1 or 0."""
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    cut = parse(pages.select("page_id", "url")).withColumn("parts", segments()).drop("url")
    tree = templates(cut.join(known, "page_id", "left").select("host", "parts", "bad"))
    leaf = tree.select("host", "parts", "template").join(purity(tree), ["host", "template"])
    judged = cut.withColumn("rule", rule_of(rules)).join(leaf, ["host", "parts"])
    own = F.when(F.col("bad_share") > reject, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("rule.rule").alias("rule"),
                         F.coalesce("rule.verdict", own).alias("verdict"), "template", "bad_share")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = corpus_table(spark, sf_dir, "labels", "doc_id", "quality").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return filter_urls(corpus_table(spark, sf_dir, "pages", "page_id", "url"), labels)
