"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles (64-bit hashes).  The sketch has
`BANDS * ROWS` coordinates: in round i every element is thrown into one
coordinate, and an empty coordinate keeps the smallest value of the first round
that reaches it; after as many rounds as coordinates, round t + i fills
coordinate i from the whole set.  So every coordinate fills, even from one
element, and agreeing coordinates estimate the Jaccard similarity with
concentration bounds.

Equal sets are one class, known by a number of its own (`rep`), whatever ids its
documents have.  Classes that share a band are candidates.  Instead of all pairs of a band, its members are first
checked against the central one (which shares most bands with others).  Members
that this leaves apart are joined with all members of the bands of the same
central one, over an inverted index of the full sets in blocks of bounded size;
only links leave such a task.  Every link rests on an exact comparison of the full
sets.

With 40 bands of 6 rows a pair at similarity 0.8 is missed with probability
5e-6, less above.

Defined results: null and empty texts and texts without words have an empty set
and are linked with nothing; with fewer words than a shingle the whole sequence
is the one shingle; very long texts are taken whole.  A document is a row: several
texts under one id are linked each by its own text.  Repeated rows fall into one
class.  Documents with a null id are linked, but never give a component its id; a
component without any id has a null one, and its text with the smallest SHA-256 is
kept (in every row that repeats it).  Empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlens.llm.graph import components
from ledgerlens.llm.tables import corpus_table, matched, text_key, written
from ledgerlens.llm.words import chain, hashed_words, mix, text_chunks

SHINGLE = 5
SIMILARITY = 80   # per cent
BANDS, ROWS = 40, 6
#: Shingles of a block of documents that are joined in one task.
BLOCK_SHINGLES = 200_000


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): the sorted distinct shingles of each text."""
    words, first = hashed_words(column, "space")
    count = np.diff(first)
    runs = chain(words, n)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[:-1], size)
    whole = count[owner] < n
    elements = np.zeros(len(owner), np.uint64)
    elements[~whole] = runs[place[~whole]]
    for d in np.flatnonzero((count > 0) & (count < n)):
        elements[np.searchsorted(owner, d)] = chain(words[first[d]:first[d + 1]], count[d])[0] ^ np.uint64(count[d])
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
    return elements[fresh], np.searchsorted(owner[fresh], np.arange(len(count) + 1))


def sketches(elements: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of every set (a row of zeros for an empty one)."""
    sets, empty = len(first) - 1, np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((sets, t), empty, np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(first))
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(owner):
            break
        value = mix(elements + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if i < t:
            cell = owner * t + ((value >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            cell = owner * t + (i - t)
        free = flat[cell] == empty
        np.minimum.at(flat, cell[free], np.minimum(value[free], empty - np.uint64(1)))
        undone = (out == empty).any(axis=1)[owner]
        elements, owner = elements[undone], owner[undone]
    out[np.diff(first) == 0] = 0
    return out


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        for chunk in text_chunks(batches, "text"):
            elements, first = shingle_sets(chunk.column("text"), n)
            sketch = sketches(elements, first, bands * rows)
            band = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(sketch), axis=0)
            for r in range(rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r::rows])
            keys = [hashlib.blake2b(elements[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
            offsets = pa.array(np.arange(len(sketch) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), chunk.column("text_key"), pa.array(np.diff(first)), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(offsets, pa.array(band.reshape(-1).view(np.int64)))],
                names=["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return run


def _verified(n: int, similarity: int):
    def run(batches):
        for batch in batches:
            for chunk in text_chunks([batch], "text_u"):
                a, fa = shingle_sets(chunk.column("text_u"), n)
                b, fb = shingle_sets(chunk.column("text_v"), n)
                keep = []
                for i in range(chunk.num_rows):
                    x, y = a[fa[i]:fa[i + 1]], b[fb[i]:fb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= similarity * (len(x) + len(y) - both))
                kept = chunk.filter(pa.array(keep, pa.bool_()))
                yield kept.select(["u", "v"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """The (u, v) whose full sets have at least the similarity."""
    left = pairs.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(_verified(n, similarity), "u long, v long")


def _central(member: DataFrame) -> DataFrame:
    """The member of each band that shares most bands with others."""
    weight = member.groupBy("rep").agg(F.sum("size").alias("weight"))
    order = Window.partitionBy("band").orderBy(F.desc("weight"), "rep")
    return (member.join(weight, "rep").withColumn("rank", F.row_number().over(order)).where("rank = 1")
            .select("band", F.col("rep").alias("center"), F.col("n").alias("center_n")))


def _between_blocks(n: int, similarity: int):
    """Links of one block of single members against one block of all: an exact join over an inverted index."""
    def run(table: pa.Table) -> pa.Table:
        single = np.asarray(table.column("single"))
        sets = []
        for own in (table.filter(pa.array(single)), table.filter(pa.array(~single))):
            elements, first = shingle_sets(own.column("text"), n)
            sets.append((elements, first, np.asarray(own.column("rep"), np.int64), np.asarray(own.column("component"), np.int64)))
        (x, fx, ids, parts), (y, fy, others, other_parts) = sets
        order = np.argsort(y, kind="stable")
        terms, owner, size = y[order], np.repeat(np.arange(len(others)), np.diff(fy))[order], np.diff(fy)
        u, v = [], []
        for i in range(len(ids)):
            own = x[fx[i]:fx[i + 1]]
            low, high = np.searchsorted(terms, own), np.searchsorted(terms, own, side="right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(others))
            linked = (both > 0) & (100 * both >= similarity * (len(own) + size - both)) & (other_parts != parts[i])
            # one link to each other component is enough
            _, one = np.unique(other_parts[linked], return_index=True)
            found = others[linked][one]
            u += [ids[i]] * len(found)
            v += found.tolist()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _remaining_links(member: DataFrame, central: DataFrame, linked: DataFrame, texts: DataFrame, n: int, similarity: int) -> DataFrame:
    """Links between members of one band that the comparison with its central member left in different components.

    All bands with the same central member make one cluster.  Its single members
    (not linked to the central one) meet all members, in blocks of bounded size.
    """
    placed = member.join(linked.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    heads = central.join(mixed, "band", "left_semi").select("band", "center")
    main = linked.select(F.col("id").alias("center"), F.col("component").alias("main"))
    cluster = (placed.join(heads, "band").select("center", "rep", "n", "component").distinct()
               .join(main, "center", "left").withColumn("single", F.col("component") != F.coalesce("main", "center")).drop("main"))
    cluster = written(cluster, "clusters")
    blocks = cluster.groupBy("center").agg(
        F.ceil(F.sum(F.when(F.col("single"), F.col("n"))) / BLOCK_SHINGLES).cast("int").alias("singles"),
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("all"))
    own = cluster.join(blocks, "center").withColumn("hash", F.xxhash64("rep"))
    one = own.where("single").withColumn("a", F.expr("int(pmod(hash, singles))")).withColumn("b", F.explode(F.expr("sequence(0, all - 1)")))
    two = (own.where("singles > 0").withColumn("b", F.expr("int(pmod(hash, all))"))
           .withColumn("a", F.explode(F.expr("sequence(0, singles - 1)"))).withColumn("single", F.lit(False)))
    columns = ["center", "a", "b", "single", "rep", "component"]
    both = one.select(columns).unionByName(two.select(columns))
    return (both.join(texts, "rep").groupBy("center", "a", "b")
            .applyInArrow(_between_blocks(n, similarity), "u long, v long"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles and `first`, the (no_id, doc_id, text_key) of the first document of its group (null: an empty set).

    The first is that with the smallest id, null ones last, and of these with the smallest text_key.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    signed = written(docs.mapInArrow(_signatures(shingle, bands, rows),
                                     "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>"), "signatures")
    # equal sets have equal bands, so any row's will do; the first document lends its text to the class
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = written(signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(document).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    member = written(banded.join(shared, "band").distinct(), "members")
    central = written(_central(member), "central")
    needed = classes.join(member.select("rep").distinct(), "rep", "left_semi").select("rep", "first")
    texts = written(docs.join(needed, (docs["text_key"] == needed["first.text_key"]) & docs["doc_id"].eqNullSafe(needed["first.doc_id"]))
                    .select("rep", "text").dropDuplicates(["rep"]), "texts")

    stars = (member.join(central, "band").where("rep <> center")
             .where(f"100 * least(n, center_n) >= {similarity} * greatest(n, center_n)")
             .select(F.greatest("rep", "center").alias("u"), F.least("rep", "center").alias("v")).distinct())
    links = written(verify(stars, texts, shingle, similarity), "links")
    rest = _remaining_links(member, central, written(components(links), "linked"), texts, shingle, similarity)
    linked = components(links.unionByName(rest)).withColumnRenamed("id", "rep")

    placed = written(classes.select("set_key", "rep", "first").join(linked, "rep", "left")
                     .withColumn("component", F.coalesce("component", "rep")), "placed")
    heads = placed.groupBy("component").agg(F.min("first").alias("first"))
    groups = placed.select("set_key", "component").join(heads, "component").select("set_key", "first")
    own = F.when(F.col("n_shingles") > 0, F.col("set_key"))     # documents without a set share no key
    return signed.select("doc_id", "text_key", "n_shingles", own.alias("set_key")).join(groups, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document of (doc_id, text): n_shingles, component_id, kept."""
    linked = F.col("first").isNotNull()
    component = F.when(linked, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    # a group without any id keeps its first text
    kept = F.when(linked & F.col("first.no_id"), F.col("text_key") == F.col("first.text_key")).otherwise(F.col("doc_id").eqNullSafe(component))
    return near_groups(docs, shingle, similarity, bands, rows).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The documents, all columns, of which each group keeps its first one, in one row; those with an empty set all stay."""
    each = (near_groups(docs, shingle, similarity).where("n_shingles > 0").groupBy("doc_id", "text_key")
            .agg(F.count("*").alias("n"), F.min("first").alias("first")))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    marked = written(each.select("doc_id", "text_key", (~is_first).alias("goes"), "n").where("goes or n > 1"), "marked")
    # the same join at every size: texts are dealt by hash once and not sorted, and each task holds only its marks
    left = matched(docs, marked.where("goes").hint("shuffle_hash"), "left_anti")
    repeated = marked.where("not goes")
    if repeated.isEmpty():
        return left
    return matched(left, repeated, "left_anti").unionByName(matched(left, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(corpus_table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)
