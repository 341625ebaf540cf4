"""Quality by weak supervision: rules vote or abstain, and their accuracies are learned without labels.

Each rule votes good (1), bad (-1) or abstains (0) on measures of the whole text.
The votes are modelled as independent given the unknown quality; expectation-
maximisation over the counts of vote patterns (at most 3 to the power of the
rules, whatever the corpus) estimates how each rule votes on good and on bad
texts, with a prior that rules are right more often than not.  The posterior
probability of good then decides, instead of every rule having to pass.

All work on texts is done by SQL functions; only the pattern counts reach the driver.

Defined results: null and empty texts have no words, fail the base test and are
not kept; repeated rows are judged alike; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, written

WINDOW = 8
THRESHOLD = 0.5
ROUNDS = 100
SPACE = r"[\x20\x09-\x0D]+"
#: Function words of English, German, French and Spanish.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "that", "it", "is", "was", "for", "on", "with", "be", "as", "at",
                  "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "im", "auf", "für", "nicht", "ein", "eine",
                  "le", "la", "les", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par",
                  "el", "los", "las", "de", "y", "a", "se", "con", "por", "una", "su", "para", "es", "lo", "del")


def _duplicated_windows(words: Column, n: Column, window: int) -> Column:
    """Hashes of all windows of the words, by their first word."""
    return F.when(n >= window, F.transform(F.sequence(F.lit(1), n.cast("int") - window + 1),
                                           lambda i: F.xxhash64(F.slice(words, i, window)))
                  ).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column, window: int) -> Column:
    """Words covered by windows that begin at the given places, in order."""
    begin = F.struct(F.lit(-window).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(window), x - acc["last"])).cast("bigint").alias("n"))
    return F.aggregate(starts, begin, step, lambda acc: acc["n"])


def measures(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of each (doc_id, text): words, their characters, symbols, repeated lines and windows, and more for the rules."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != F.lit("")))
    counted = split.withColumn("n_words", F.size("words").cast("long")).select(
        "doc_id", "words", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[0-9]", ""))).cast("long").alias("n_digits"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.regexp_count("text", F.lit(r"[.!?]")).cast("long").alias("n_stops"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    hashed = counted.withColumn("hashes", _duplicated_windows(F.col("words"), F.col("n_words"), window)).select(
        "*", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function")).drop("words", "lines")
    # only texts with some repeated window sort their windows
    repeats = hashed.withColumn("sorted", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>"))).drop("hashes")
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("sorted"), j)["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    return repeats.withColumn("starts", starts).withColumn("n_repeat_words", _covered(F.col("starts"), window)).drop("sorted", "starts")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Each rule's vote; ratios are taken by multiplication, so no text divides by zero."""
    n, c = F.col("n_words"), F.col
    never = F.lit(False)
    return {
        "enough_words": _vote(n < 20, never),
        "word_length": _vote((c("word_chars") < 3 * n) | (c("word_chars") > 10 * n), never),
        "symbols": _vote(10 * c("n_symbols") > n, never),
        "symbol_runs": _vote(10 * c("n_symbol_runs") > n, never),
        "symbol_share": _vote(50 * c("n_symbols") > c("word_chars"), never),
        "repeated_lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), never),
        "repeated_windows": _vote(5 * c("n_repeat_words") > n, never),
        "function_words": _vote((c("n_function") < 2) & (n >= 50), c("n_function") >= 4),
        "sentences": _vote((100 * c("n_stops") < n) & (n >= 50), (50 * c("n_stops") >= n) & (3 * c("n_stops") <= n)),
        "digits": _vote(5 * c("n_digits") > c("word_chars"), never),
        "variety": _vote((5 * c("n_distinct") < n) & (n >= 50), never),
    }


def learn(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """(log-odds of good, per rule the log-odds that each vote adds), by expectation-maximisation over vote patterns."""
    if not patterns:
        return 0.0, []
    n_rules = len(patterns[0][0])
    # 22 pseudo-texts of either quality: 10 right votes, 10 abstentions, 2 wrong votes
    prior = {1: {1: 10.0, 0: 10.0, -1: 2.0}, -1: {-1: 10.0, 0: 10.0, 1: 2.0}}
    # begin where one bad vote condemns: rules that fire on texts good by all others lose their weight
    good = [0.1 if -1 in votes else 0.9 for votes, _ in patterns]
    odds, weights = 0.0, []
    for _ in range(ROUNDS):
        total = sum(count for _, count in patterns)
        mass = sum(g * count for g, (_, count) in zip(good, patterns))
        odds = math.log((mass + 1) / (total - mass + 1))
        weights = []
        for j in range(n_rules):
            table = {y: dict(prior[y]) for y in (1, -1)}
            for g, (votes, count) in zip(good, patterns):
                table[1][votes[j]] += g * count
                table[-1][votes[j]] += (1 - g) * count
            share = {y: {v: table[y][v] / sum(table[y].values()) for v in (-1, 0, 1)} for y in (1, -1)}
            weights.append({v: math.log(share[1][v] / share[-1][v]) for v in (-1, 0, 1)})
        before, good = good, [1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(w[v] for w, v in zip(weights, votes))))))
                              for votes, _ in patterns]
        if max(abs(a - b) for a, b in zip(before, good)) < 1e-9:
            break
    return odds, weights


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document of (doc_id, text): its counts, base_failed, the probability of good quality, and kept."""
    votes = rules()
    voted = measures(docs).select("*", *(v.alias(f"vote_{name}") for name, v in votes.items()))
    table = written(voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 *(f"vote_{name}" for name in votes)), "votes")
    columns = [f"vote_{name}" for name in votes]
    counted = table.groupBy(*columns).count().collect()
    odds, weights = learn(sorted((tuple(r[c] for c in columns), r["count"]) for r in counted))
    score = F.lit(odds)
    for column, w in zip(columns, weights):
        score = score + F.when(F.col(column) == 1, w[1]).when(F.col(column) == -1, w[-1]).otherwise(w[0])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (1 / (1 + F.exp(-score))).alias("good")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("good") >= threshold))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(corpus_table(spark, sf_dir, "documents", "doc_id", "text"))
