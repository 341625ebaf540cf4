"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents longer than a sequence are cut into whole sequences from their end, so
only the first piece may be shorter; nothing else is cut.  Pieces are packed by
bounded-space online best-fit: `open_bins` bins are open at a time, kept in a
bitset keyed by their free space, so the tightest bin that takes a piece is one
shift and one lowest-bit away; when another bin must be opened, the fullest one
closes first.  Pieces arrive in runs of `RUN`, the longest of a run first: with
bins for more than one run open, that leaves 0.3 % of the places empty where an
unsorted stream leaves 2.5 %.

Pieces are dealt to packers by a hash of their document and each packer sorts its
share by that hash, so a rerun task packs alike; a packer holds `open_bins` bins
whatever its share.  Only piece descriptions (no ids, no texts) are shuffled.

Defined results: a null text is an empty one (its end id alone); repeated rows
are packed as rows of their own; a null doc_id is kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.bpe import RANKS, VOCABULARY, Encoder
from ledgerlens.llm.tables import corpus_table

LENGTH = 1024
END_ID = 2
OPEN_BINS = 8192
RUN = 4096
#: Documents for each packer; a packer's memory does not depend on it.
DOCUMENTS_PER_PACKER = 100_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def _cut(length: int, end_id: int, vocabulary: str, ranks: str):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = Encoder(vocabulary, ranks)
        for batch in batches:
            doc, piece, start, size, crc = [], [], [], [], []
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("text"))
            for d, text in zip(ids, texts):
                tokens = encoder.encode(text.as_py() or "") + end
                n = len(tokens) // 4
                at, k = 0, 0
                while at < n:
                    take = (n - at) % length or length
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    size.append(take)
                    crc.append(zlib.crc32(tokens[4 * at:4 * (at + take)]))
                    at, k = at + take, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenBins:
    """At most `limit` open bins; bit f of `free` is set while a bin has f places left."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.count = length, limit, 0
        self.free, self.bins = 0, [[] for _ in range(length + 1)]
        self.opened = 0

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece: the tightest open bin that takes it, else a new one."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.opened
            self.opened += 1
        rest = space - size
        if rest:
            if self.count == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)   # the fullest closes
            self.bins[rest].append(number)
            self.free |= 1 << rest
            self.count += 1
        return number, self.length - space


def _pack(length: int, open_bins: int):
    def run(batches):
        from pyspark import TaskContext
        packer = TaskContext.get().partitionId() << 40
        bins = OpenBins(length, open_bins)
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index("length")).to_numpy()
            places = [(0, 0)] * len(sizes)
            for at in range(0, len(sizes), RUN):
                for i in at + np.argsort(-sizes[at:at + RUN], kind="stable"):
                    places[i] = bins.place(int(sizes[i]))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([packer + p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS,
         vocabulary: str = VOCABULARY, ranks: str = RANKS, documents_per_packer: int = DOCUMENTS_PER_PACKER) -> DataFrame:
    """Per piece of (doc_id, text): piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _cut(length, end_id, vocabulary, ranks), PIECE_SCHEMA)
    packers = max(1, math.ceil(docs.count() / documents_per_packer))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("deal", key).repartition(packers, "deal").sortWithinPartitions("deal", "doc_id", "piece", "start")
    return dealt.drop("deal").mapInArrow(_pack(length, open_bins), PACKED_SCHEMA)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(corpus_table(spark, sf_dir, "documents", "doc_id", "text"))
