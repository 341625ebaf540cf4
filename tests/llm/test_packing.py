import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm.bpe import Encoder
from ledgerlens.llm.packing import OpenBins, op1_pack, pack
from tests.llm.helpers import EDGE_TEXTS, SMALL, docs_of, edge_docs, empty_docs, table

REFERENCE = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(rows, docs):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in docs:
        ids, at = ids_of(text), 0
        own = sorted(by[doc], key=lambda r: r.piece)
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and 1 <= r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == 1024
            at += r.length
        assert at == len(ids) and (len(own) == 1 or len(ids) > 1024)


def check_sequences(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_small_table(spark):
    rows = op1_pack(spark, SMALL).collect()
    check_pieces(rows, docs_of(table(spark, "documents")))
    sequences = check_sequences(rows)
    assert sequences <= 1.03 * sum(r.length for r in rows) / 1024 + 1


def test_edges(spark):
    docs = edge_docs(spark).dropDuplicates(["doc_id"])
    rows = pack(docs).collect()
    check_pieces(rows, docs_of(docs))
    check_sequences(rows)
    twice = pack(edge_docs(spark)).where("doc_id = 5").collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert pack(empty_docs(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_library(text):
    assert list(np.frombuffer(ENCODER.encode(text), "<u4")) == ids_of(text)[:-1]


ENCODER = Encoder(cached=50)


def test_encoder_on_edge_texts():
    for text in EDGE_TEXTS:
        assert list(np.frombuffer(ENCODER.encode(text or ""), "<u4")) == ids_of(text)[:-1]


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_bins_hold_their_bounds(sizes, limit):
    bins, used = OpenBins(64, limit), {}
    for n in sizes:
        number, offset = bins.place(n)
        assert used.get(number, 0) == offset and offset + n <= 64
        used[number] = offset + n
        assert bins.count <= limit and bins.count == sum(map(len, bins.bins))
