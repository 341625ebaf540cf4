"""Words of a text column as numpy arrays, straight from Arrow's UTF-8 buffers.

Separators are ASCII, so words can be cut on bytes; A-Z are lower-cased on bytes.
A null text counts as an empty one.  Word hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20


def separator_table(kind: str) -> np.ndarray:
    """Which bytes separate words: `space` (0x20, 0x09-0x0D) or `alnum` (all ASCII but letters and digits)."""
    table = np.zeros(256, dtype=bool)
    if kind == "space":
        table[0x20] = True
        table[0x09:0x0E] = True
    elif kind == "alnum":
        table[:0x80] = True
        for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            table[lo:hi + 1] = False
    else:
        raise ValueError(f"unknown kind of words: {kind}")
    return table


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 bytes of all texts end to end, and where each begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Cut record batches into pieces of about `limit` text bytes (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """(starts, ends, first): byte spans of the words; words first[d]:first[d+1] are document d's."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time for all words together."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    length = ends - starts
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    h = mix(length.astype(np.uint64) ^ (lanes[starts] & masks[np.minimum(length, 8)]))
    at, rest = starts + 8, length - 8
    todo = np.flatnonzero(rest > 0)
    while len(todo):
        lane = lanes[at[todo]] & masks[np.minimum(rest[todo], 8)]
        h[todo] = mix(h[todo] * np.uint64(0x9E3779B97F4A7C15) + lane)
        at[todo] += 8
        rest[todo] -= 8
        todo = todo[rest[todo] > 0]
    return h


def hashed_words(column, kind: str):
    """(hashes, first) of all lower-cased words of a text column."""
    data, offsets = text_buffer(column)
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, offsets, separator_table(kind))
    return word_hashes(data, starts, ends), first


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items (len - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    h = hashes[:len(hashes) - n + 1]
    for k in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - n + 1 + k])
    return h if n > 1 else h.copy()
