"""How far the sources of a language diverge, by exact integer shares of their terms.

Identical texts of a language are collapsed first: one text with its number of
documents in each source.  Each distinct text is tokenised once, and its terms are
counted with these multiplicities, so a text copied a million times costs one.

A kept term occurs in `LEAST_DOCUMENTS` documents of the language at least.  Its
share in a group is p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence of
shares p from q is floor((p - q)^2 / q).  Summed over all kept terms for every pair
of sources it would need V values a pair, most of them for terms that neither
source has.  The pairs are sparse sums instead: an absent term's share p0 is the
same for all terms of a source, so

    sum over terms = sum over both present of f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0)
                   + sum over those of the one source of f(p,q0)
                   + sum over those of the other of f(p0,q)
                   + (V - terms of the one - terms of the other) f(p0,q0)

and only terms that both sources have are met pair by pair, in blocks of bounded
size.  All arithmetic is on 64-bit integers and exact up to 9 * 10^15 tokens a group.

Defined results: null text, lang and source count as ''; a group without terms has
N = 0; a language without kept terms has pairs of value 0 and no terms; repeated
rows count as documents each; very long texts are taken whole; empty tables give
empty results; doc_id and other columns are not read.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.words import lower_ascii, text_buffer, text_chunks, word_spans

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Distinct texts that one task remembers while it collapses copies, and bytes tokenised together.
REMEMBERED = 1 << 16
CHUNK = 12 << 20
#: (term, source) entries of a block of terms that one task evaluates.
BLOCK_ENTRIES = 200_000

#: A text travels to its task compressed, with its bytes before; rows of multiplicities have none.
COLLAPSED = "lang string, text_key binary, text binary, bytes long, source string, n long"
CODEC = "zstd"


def letters_table() -> np.ndarray:
    """Bytes that separate terms: all ASCII but letters."""
    table = np.zeros(256, dtype=bool)
    table[:0x80] = True
    table[0x41:0x5B] = table[0x61:0x7B] = False
    return table


def _collapse(batches):
    """Copies inside a task: the text once, then a row without it for each (text, source) and its number of documents."""
    seen: dict[tuple, int] = {}
    codec, names = pa.Codec(CODEC), ["lang", "text_key", "text", "bytes", "source", "n"]

    def flush():
        rows = [(*key, n) for key, n in seen.items()]
        seen.clear()
        lang, key, source, n = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(key, pa.binary()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64()),
                                           pa.array(source), pa.array(n)], names=names)

    told: set[tuple] = set()
    for chunk in text_chunks(batches, "text"):
        data, offsets = text_buffer(chunk.column("text"))
        langs, sources = chunk.column("lang").to_pylist(), chunk.column("source").to_pylist()
        fresh = []
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            text = data[a:b].tobytes()
            key = hashlib.blake2b(text, digest_size=16).digest()
            seen[langs[i], key, sources[i]] = seen.get((langs[i], key, sources[i]), 0) + 1
            if (langs[i], key) not in told:
                told.add((langs[i], key))
                fresh.append((langs[i], key, codec.compress(text, asbytes=True), len(text)))
        if fresh:
            lang, key, packed, size = zip(*fresh)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(key, pa.binary()), pa.array(packed, pa.binary()), pa.array(size, pa.int64()),
                                              pa.nulls(len(fresh), pa.string()), pa.nulls(len(fresh), pa.int64())], names=names)
        if len(seen) >= REMEMBERED:
            yield flush()
        if len(told) >= REMEMBERED:
            told.clear()    # a later copy sends its text again, which the next step drops
    if seen:
        yield flush()


def _term_counts(texts: pa.Array, langs: list[str], weights: list[dict[str, int]]):
    """Occurrences and documents of each (lang, source, term) in distinct texts with their documents per source."""
    data, offsets = text_buffer(texts)
    data = lower_ascii(data)
    separators = letters_table()
    starts, ends, first = word_spans(data, offsets, separators)
    if not len(starts):
        return None
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[~separators[data]]))
    coded = tokens.dictionary_encode()
    terms, ids = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    del data, starts, ends, bounds, tokens, coded      # the rest needs the memory
    # each text's distinct terms, then a row of them for each source that has the text
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    own, count = np.unique(owner * len(terms) + ids, return_counts=True)
    owner, ids = own // len(terms), own % len(terms)
    begin = np.searchsorted(owner, np.arange(len(first)))
    groups: dict[tuple[str, str], int] = {}
    pieces = []
    for d, (lang, sources) in enumerate(zip(langs, weights)):
        a, b = begin[d], begin[d + 1]
        for source, n in sources.items():
            group = groups.setdefault((lang, source), len(groups))
            pieces.append((group, a, b, n))
    group, a, b, n = (np.array(x, np.int64) for x in zip(*pieces))
    size = b - a
    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    key, weight = np.repeat(group, size) * len(terms) + ids[at], np.repeat(n, size)
    order = np.argsort(key, kind="stable")
    key, weight, occurrences = key[order], weight[order], (count[at] * np.repeat(n, size))[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(edge):
        return None
    names = list(groups)
    where = pa.array(key[edge] // len(terms))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in names]).take(where), pa.array([x[1] for x in names]).take(where),
         terms.cast(pa.string()).take(pa.array(key[edge] % len(terms))),
         pa.array(np.add.reduceat(occurrences, edge)), pa.array(np.add.reduceat(weight, edge))],
        names=["lang", "source", "term", "n", "documents"])


def _counted(batches):
    """Rows sorted by text: the first text of a key is tokenised, with the documents per source of all its rows."""
    langs, texts, weights, held = [], [], [], 0
    last, codec = None, pa.Codec(CODEC)

    def counted():
        return _term_counts(pa.array(texts, pa.large_binary()).cast(pa.large_string()), langs, weights)

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "text_key", "text", "bytes", "source", "n")]
        for lang, key, text, size, source, n in zip(*columns):
            if (lang, key) != last:
                if held >= CHUNK:
                    if (out := counted()) is not None:
                        yield out
                    langs, texts, weights, held = [], [], [], 0
                last = (lang, key)
                langs.append(lang)
                texts.append(codec.decompress(text, size, asbytes=True))     # rows with the text come first
                weights.append({})
                held += size
            if source is not None:
                weights[-1][source] = weights[-1].get(source, 0) + n
    if texts and (out := counted()) is not None:
        yield out


def _plain(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def term_counts(docs: DataFrame) -> DataFrame:
    """n occurrences in `documents` documents of each lang, source and term; each distinct text of a language is tokenised once."""
    rows = _plain(docs, "lang", "source", "text").mapInArrow(_collapse, COLLAPSED)
    counted = (rows.repartition("lang", "text_key").sortWithinPartitions("lang", "text_key", F.col("text").isNull())
               .mapInArrow(_counted, "lang string, source string, term string, n long, documents long"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per lang and term in `least` documents: its occurrences, and those of every source that has it (as many as sources at most)."""
    return (counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"),
                                               F.collect_list(F.struct("source", "n")).alias("sources"))
            .where(F.col("documents") >= least).select("lang", "term", "n", "sources"))


def shares(count, total):
    """1 + floor(10^9 (count + 1) / total), exactly: long division by thousands, for 0 <= count < total < 9 * 10^15."""
    rest, share = np.asarray(count, np.int64) + 1, 0
    for _ in range(3):
        rest = rest * 1000
        share, rest = share * 1000 + rest // total, rest % total
    return 1 + share


def divergence(p, q):
    return (p - q) * (p - q) // q


def _share(count: str, total: str) -> str:
    """`shares` as SQL."""
    rest, share = f"({count} + 1)", "0L"
    for _ in range(3):
        share, rest = f"({share} * 1000 + {rest} * 1000 div {total})", f"({rest} * 1000 % {total})"
    return f"(1 + {share})"


def _pair_sums(terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of the divergences of every two sources over one block of terms."""
    sources = sources.sort_by("place")
    total = np.asarray(sources.column("total"))
    n, absent = len(total), shares(np.zeros(len(total), np.int64), total)
    lists = terms.column("sources").combine_chunks()
    offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0] if len(lists) else np.zeros(1, np.int64)
    entries, size = lists.flatten(), np.diff(offsets)
    source = np.asarray(pc.index_in(entries.field("source"), value_set=sources.column("source").combine_chunks()), np.int64)
    share = shares(np.asarray(entries.field("n")), total[source])
    term = np.repeat(np.arange(len(size)), size)
    order = np.argsort(source, kind="stable")
    begin = np.searchsorted(source[order], np.arange(n + 1))
    have = np.diff(begin)
    value = (len(size) - have[:, None] - have[None, :]) * divergence(absent[:, None], absent[None, :])
    for s in range(n):
        own = order[begin[s]:begin[s + 1]]
        if not len(own):
            continue
        distinct, times = np.unique(share[own], return_counts=True)
        value[s] += (times[:, None] * divergence(distinct[:, None], absent[None, :])).sum(axis=0)
        value[:, s] += (times[:, None] * divergence(absent[None, :], distinct[:, None])).sum(axis=0)
        both = size[term[own]]
        at = np.repeat(offsets[term[own]] - (np.cumsum(both) - both), both) + np.arange(both.sum())
        p, q, other = np.repeat(share[own], both), share[at], source[at]
        np.add.at(value[s], other, divergence(p, q) - divergence(p, absent[other]) - divergence(absent[s], q) + divergence(absent[s], absent[other]))
    names = sources.column("source").combine_chunks()
    one, other = np.divmod(np.flatnonzero(~np.eye(n, dtype=bool)), n)
    return pa.table([pa.repeat(terms.column("lang")[0], len(one)), names.take(pa.array(one)), names.take(pa.array(other)), pa.array(value[one, other])],
                    names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Per (lang, source): its divergence from every other source of the lang (part `pair`) and its `top` own terms (part `term`), ranked."""
    groups = _plain(docs, "lang", "source").distinct()
    kept = written(kept_terms(term_counts(docs), least), "terms")
    own = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"), F.sum(F.size("sources")).alias("entries"))
    sized = written(groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("source_total")), ["lang", "source"], "left")
                    .join(langs, "lang", "left")
                    .select("lang", "source", (F.coalesce("source_total", F.lit(0)) + F.col("v")).alias("total"),
                            (F.col("lang_total") + F.col("v")).alias("lang_total"),
                            F.ceil(F.col("entries") / BLOCK_ENTRIES).cast("int").alias("blocks"),
                            F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("place")), "groups")

    # a lang without kept terms has no blocks
    blocks = sized.select("lang", "blocks").distinct().where("blocks > 0")
    dealt = kept.join(blocks, "lang").select("lang", F.expr("int(pmod(xxhash64(term), blocks))").alias("block"), "sources")
    beside = sized.where("blocks > 0").select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "source", "place", "total")
    sums = (dealt.groupBy("lang", "block").cogroup(beside.groupBy("lang", "block"))
            .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = (sized.select("lang", "source").join(sized.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
             .join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")))

    p, q = _share("n", "total"), _share("lang_n", "lang_total")
    terms = (own.join(sized.drop("blocks", "place"), ["lang", "source"]).selectExpr("lang", "source", "term AS item", f"{p} AS p", f"{q} AS q").where("p > q")
             .selectExpr("lang", "source", "'term' AS part", "item", "(p - q) * (p - q) div q AS value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (pairs.withColumn("rank", F.row_number().over(order))
            .unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))     # the limit goes before the shuffle


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(corpus_table(spark, sf_dir, "documents", "text", "lang", "source"))
