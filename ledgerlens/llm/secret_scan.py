"""Secrets in texts: known forms, and strings that pass a battery of randomness tests.

Runs of 16 or more characters that encodings use are candidates.  A run that mixes
the separators of two encodings is cut instead, at `/` and `+`, at `-` and `_`, and
at all four; its parts with a digit are candidates.  Each candidate gets the
smallest encoding that has all its characters, and three tests against uniform
draws from that alphabet: chi-squared of the character counts, the number of runs
above and below the middle of the alphabet, and the serial correlation of
neighbours.  Their p-values combine to one statistic (Fisher); a random string's
is small.  How small an ordinary string's gets is read off the corpus itself: runs
without a digit are the null, by length.  Among runs with digits and letters the
Benjamini-Hochberg rule then sets one limit for each length class, with a null
that also holds all shorter ordinary runs, which look more random.

Statistics are counted over all documents; the driver gets histograms of fixed size.

Defined results: null and empty texts have no spans; repeated rows give rows
each; empty tables give empty results; other columns are not read (and kept as
they are by `without_secrets`).
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table, written
from ledgerlens.llm.words import text_buffer, text_chunks, word_spans

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api", b"akia")
HEX_LEAST = 24
NOT_HEX = np.array([chr(b) not in "0123456789abcdef" for b in range(256)])
MASK = "[SECRET]"

SHORTEST = 16
#: Parts of a run that mixes separators of two encodings.
PARTS = [re.compile(rb"[^%s]{%d,}" % (cut, SHORTEST)) for cut in (rb"/+", rb"_-", rb"/+_-")]
LENGTHS = (16, 20, 24, 32, 48, 64)      # length classes begin here
BINS, BIN_WIDTH = 400, 0.5
FALSE_SHARE = 0.01
#: Above this, a statistic of three tests is less likely than one in 1,000 for a random string.
RANDOM_AT_MOST = 22.46

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _DIGITS + _UPPER, _DIGITS + _LOWER,
             _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_")

SCAN_SCHEMA = "doc_id long, base array<string>, candidates array<struct<start:long,end:long,size:int,bin:int,ordinary:boolean>>"
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("bin", pa.int32()), ("ordinary", pa.bool_())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost without overlaps for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def _places() -> np.ndarray:
    """Index of each byte in each encoding's alphabet, -1 where it has none."""
    table = np.full((len(ENCODINGS), 256), -1, np.int64)
    for e, alphabet in enumerate(ENCODINGS):
        table[e, [ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return table


def _upper_chi2(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (Wilson-Hilferty)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(symbols: np.ndarray, size: int) -> float:
    """Fisher's statistic of the three tests for indices 0..size-1: about 6 for random ones, large for others."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=size)
    p_alphabet = _upper_chi2(float((counts * counts).sum()) * size / n - n, size - 1)
    high = symbols * 2 >= size
    above = int(high.sum())
    share = (size - (size + 1) // 2) / size
    expected = 1 + 2 * (n - 1) * share * (1 - share)
    spread = math.sqrt(2 * (n - 1) * share * (1 - share)) * 0.71
    runs = 1 + int((high[1:] != high[:-1]).sum())
    p_runs = _two_sided((runs - expected) / spread) if 0 < above < n else 2.0 ** (1 - n)
    middle = (size - 1) / 2
    p_serial = _two_sided(float(((symbols[1:] - middle) * (symbols[:-1] - middle)).sum()) * 12 / (size * size - 1) / math.sqrt(n - 1))
    return -2 * sum(math.log(max(p, 1e-40)) for p in (p_alphabet, p_runs, p_serial))


def candidates(data: np.ndarray, offsets: np.ndarray):
    """(document, begin, end, ordinary) of the runs of encoding characters (or their parts), by bytes of the chunk."""
    used = np.zeros(256, bool)
    used[[ord(c) for c in _UPPER + _LOWER + _DIGITS + "+/-_"]] = True
    if not len(data):
        return []
    inside, cut = used[data], np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    first, second = (np.concatenate([[0], np.cumsum((data == ord(x)) | (data == ord(y)))]) for x, y in ("/+", "-_"))
    mixed = (first[ends] > first[starts]) & (second[ends] > second[starts])
    whole = int((~mixed).sum())
    if mixed.any():
        cuts = np.array(sorted({(a + m.start(), a + m.end()) for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist())
                                for part in PARTS for m in part.finditer(data[a:b].tobytes())}), np.int64).reshape(-1, 2)
        starts, ends = np.concatenate([starts[~mixed], cuts[:, 0]]), np.concatenate([ends[~mixed], cuts[:, 1]])
    digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    letters = np.concatenate([[0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))])
    n_digits, n_letters = digits[ends] - digits[starts], letters[ends] - letters[starts]
    document = np.searchsorted(offsets, starts, side="right") - 1
    keep = n_letters > 0          # numbers alone are no secrets
    keep[whole:] &= n_digits[whole:] > 0    # a part is no ordinary run of its own
    return list(zip(document[keep], starts[keep], ends[keep], n_digits[keep] == 0))


def length_class(size: int) -> int:
    return sum(size >= low for low in LENGTHS) - 1


def _scanned(chunk, places):
    """Per document: (base spans, candidates) as (start, end, size, bin, ordinary)."""
    data, offsets = text_buffer(chunk.column("text"))
    found: list[list] = [[] for _ in range(chunk.num_rows)]
    flagged = np.zeros(chunk.num_rows, bool)
    for d, a, b, ordinary in candidates(data, offsets):
        symbols = data[a:b]
        e = next(e for e in range(len(ENCODINGS)) if (places[e][symbols] >= 0).all())
        t = randomness(places[e][symbols], len(ENCODINGS[e]))
        found[d].append((a - offsets[d], b - offsets[d], int(b - a), min(int(t / BIN_WIDTH), BINS - 1), bool(ordinary)))
    starts, ends, _ = word_spans(data, offsets, NOT_HEX)
    flagged[np.searchsorted(offsets, starts[ends - starts >= HEX_LEAST], side="right") - 1] = True
    low = data.tobytes().lower()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, side="right")) - 1
            flagged[d] = True
            at = low.find(word, int(offsets[d + 1]))
    for d in range(chunk.num_rows):
        if not flagged[d] and not found[d]:
            yield [], []
            continue
        text = low_text = data[offsets[d]:offsets[d + 1]]
        spans = base_spans(text.tobytes().decode("utf-8", "surrogatepass")) if flagged[d] else []
        if found[d] and len(low_text):
            place = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            own = [(int(place[a]), int(place[b]), n, t, o) for a, b, n, t, o in found[d]]
            own = [c for c in own if c[4] or not any(s < c[1] and c[0] < e for s, _, e in spans)]
        else:
            own = []
        yield spans, own


def scan(docs: DataFrame) -> DataFrame:
    """Per document of (doc_id, text): base spans and the candidates' statistics."""
    def run(batches):
        places = _places()
        for chunk in text_chunks(batches, "text"):
            rows = list(_scanned(chunk, places))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"),
                 pa.array([[f"{KINDS[k]}:{a}:{b}" for a, k, b in spans] for spans, _ in rows], pa.list_(pa.string())),
                 pa.array([[dict(zip(("start", "end", "size", "bin", "ordinary"), c)) for c in own] for _, own in rows],
                          pa.list_(_CANDIDATE))],
                names=["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN_SCHEMA)


def limits(scanned: DataFrame, false_share: float = FALSE_SHARE) -> list[int]:
    """For each length class the last bin of the statistic that counts as random (-1: none)."""
    size = F.col("c.size")
    level = sum(((size >= low).cast("int") for low in LENGTHS[1:]), F.lit(0))
    counted = (scanned.select(F.explode("candidates").alias("c")).groupBy(level.alias("level"), "c.bin", "c.ordinary")
               .count().collect())     # at most classes x bins x 2 rows
    null, seen = np.zeros((len(LENGTHS), BINS)), np.zeros((len(LENGTHS), BINS))
    for r in counted:
        (null if r["ordinary"] else seen)[r["level"], r["bin"]] = r["count"]
    null = np.cumsum(np.cumsum(null, axis=0), axis=1)       # this and all shorter classes; up to each bin
    seen = np.cumsum(seen, axis=1)
    out = []
    for k in range(len(LENGTHS)):
        p = (1 + null[k]) / (1 + null[k, -1])
        passed = np.flatnonzero((seen[k] > 0) & (p * seen[k, -1] <= false_share * seen[k]))
        last = int(passed.max()) if len(passed) else -1
        out.append(min(last, int(RANDOM_AT_MOST / BIN_WIDTH)))
    return out


def _all_spans(spans, own, limit):
    """The base spans and the random ones, overlapping parts of one run together."""
    random: list[tuple[int, int, int]] = []
    for a, b in sorted((a, b) for a, b, n, t, ordinary in own if not ordinary and t <= limit[length_class(n)]):
        if random and a < random[-1][2]:
            random[-1] = (random[-1][0], 3, max(b, random[-1][2]))
        else:
            random.append((a, 3, b))
    return sorted([*spans, *random])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, code points)."""
    scanned = written(scan(docs), "secrets")
    limit = limits(scanned)

    def run(batches):
        kind = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans = [(int(a), kind[k], int(b)) for k, a, b in (s.split(":") for s in row["base"])]
                own = [tuple(c[x] for x in ("start", "end", "size", "bin", "ordinary")) for c in row["candidates"]]
                every = _all_spans(spans, own, limit)
                n = [sum(s[1] == k for s in spans) for k in range(3)]
                out.append((row["doc_id"], *n, hashlib.sha256(",".join(row["base"]).encode()).hexdigest(),
                            ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in every)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by the mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every secret masked in `text` (and n_chars counted anew where it is a column)."""
    limit = limits(written(scan(docs), "secrets"))

    def run(batches):
        places = _places()
        for chunk in text_chunks(batches, "text"):
            texts = chunk.column("text").to_pylist()
            for d, (spans, own) in enumerate(_scanned(chunk, places)):
                every = _all_spans(spans, own, limit)
                if every:
                    texts[d] = masked(texts[d], every)
            yield chunk.set_column(chunk.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(corpus_table(spark, sf_dir, "documents", "doc_id", "text"))
