"""Personal data: fixed forms, and a skip-chain conditional random field over each document.

Tokens that hold a digit or an `@` are the field's nodes.  A node's own potentials
come from its shape and its neighbours' shapes, neighbours in the text share
transition potentials, and tokens that repeat or resemble an earlier one (same
digits, or same letters and digits) share a skip potential with it, however far
apart.  Loopy sum-product message passing gives each node's label probabilities,
so a number recognised in one place is recognised in its other writings.  What
the fixed forms left out and the field is sure of is added.

The field learns from the fixed forms' labels in all documents.  A token that no form
recognised is no personal data, but for one that repeats or resembles a recognised one
of its document: its label is hidden, and neither it nor its links are counted, so the
repeats that the forms miss do not teach the field that repeats are nothing.  Repeats
are linked each to the one before and to the first recognised one, so links grow with
the tokens; messages are passed until they settle.

Defined results: null and empty texts have no spans; repeated rows give rows each;
with nothing to learn from no span is added; very long texts are taken whole; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.tables import corpus_table
from ledgerlens.llm.words import text_buffer, text_chunks

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

SURE = 0.95
#: Messages have settled when none moves by more; a field that still swings after so many sweeps is taken as it is.
SETTLED = 1e-8
SWEEPS = 1_000
#: The strongest pull of one link, in natural logarithms: a neighbour says less than a repeat.
PULL = {"near": 1.0, "skip": 6.0}
LABELS = len(KINDS) + 1       # the last is: no personal data
OTHER = LABELS - 1

SPAN_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, leftmost without overlaps for each kind."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# ---- the field's nodes ----

N_SHAPES, N_DIGIT_LEVELS = 8, 8
N_FEATURES = N_SHAPES * N_DIGIT_LEVELS + 2 * N_SHAPES + 6


def shape(token: str) -> int:
    """A coarse form: what else than digits the token holds."""
    if "@" in token:
        return 0
    core = token.strip(".,;:!?\"'")
    if not any(c.isdigit() for c in core):
        return 7
    if core.startswith("+"):
        return 1
    if core.startswith("(") and core.endswith(")"):
        return 2
    if core.count(".") == 3 and core.replace(".", "").isdigit():
        return 3
    if core.isdigit():
        return 4
    if core.replace("-", "").isdigit():
        return 5
    return 6


def node_features(tokens: list[str], i: int) -> list[int]:
    token = tokens[i]
    digits = sum(c.isdigit() for c in token)
    level = min(digits, 4) if digits < 5 else 4 + (digits >= 5) + (digits >= 9) + (digits >= 13)
    own = shape(token)
    before = shape(tokens[i - 1]) if i else 7
    after = shape(tokens[i + 1]) if i + 1 < len(tokens) else 7
    at = N_SHAPES * N_DIGIT_LEVELS
    return [own * N_DIGIT_LEVELS + min(level, 7), at + before, at + N_SHAPES + after,
            at + 2 * N_SHAPES + (0 if any(c.isalpha() for c in token) else 1),
            at + 2 * N_SHAPES + 2 + min(3, sum(c in "().-+" for c in token))]


def likeness(token: str) -> str:
    """Tokens with the same key resemble each other: the digits where there are four or more, else letters and digits."""
    digits = "".join(c for c in token if c.isdigit())
    if len(digits) >= 4 and "@" not in token:
        return digits
    return "".join(c for c in token.lower() if c.isalnum())


def keys_of(tokens: list[str], nodes: list[int]) -> list[str]:
    """Each node's likeness; a short one in the form of a dialling code takes the next token's along if that is a node."""
    own = [likeness(tokens[i]) for i in nodes]
    return [key if len(key) >= 4 or shape(tokens[nodes[k]]) not in (1, 2) or k + 1 == len(nodes) or nodes[k + 1] != nodes[k] + 1
            else likeness(tokens[nodes[k]] + tokens[nodes[k + 1]]) for k, key in enumerate(own)]


def nodes_of(text: str):
    """(tokens with places, indices of the nodes)."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    tokens = [text[a:b] for a, b in spans]
    return spans, tokens, [i for i, t in enumerate(tokens) if "@" in t or any("0" <= c <= "9" for c in t)]


def links_of(tokens: list[str], nodes: list[int], labels: list[int] | None = None):
    """(neighbour links, skip links) between positions in `nodes`; with labels, skip links also lead to the first recognised one of each key."""
    near = [(k - 1, k) for k in range(1, len(nodes)) if nodes[k] == nodes[k - 1] + 1]
    skip, last, first = [], {}, {}
    keys = keys_of(tokens, nodes)
    for k, key in enumerate(keys if labels else ()):
        if labels[k] < OTHER:
            first.setdefault(key, k)
    for k, key in enumerate(keys):
        if len(key) >= 4:
            if key in last:
                skip.append((last[key], k))
            if key in first and first[key] not in (k, last.get(key)):
                skip.append((first[key], k))
            last[key] = k
    return near, skip


def hidden_of(tokens: list[str], nodes: list[int], labels: list[int]) -> list[bool]:
    """Which nodes' labels are not known: those that no form recognised but that are like a recognised one."""
    keys = keys_of(tokens, nodes)
    seen = {key for key, label in zip(keys, labels) if label < OTHER and len(key) >= 4}
    return [label == OTHER and key in seen for key, label in zip(keys, labels)]


def labels_of(spans, nodes, found) -> list[int]:
    """Each node's label by the fixed forms that overlap it (the first kind as listed)."""
    out, begins = [OTHER] * len(nodes), [spans[i][0] for i in nodes]
    for kind, start, end in found:
        k = max(0, bisect.bisect_right(begins, start) - 1)
        while k < len(nodes) and begins[k] < end:
            if start < spans[nodes[k]][1] and out[k] == OTHER:
                out[k] = kind
            k += 1
    return out


def marginals(own: np.ndarray, links: list[tuple[int, int, np.ndarray]], sweeps: int = SWEEPS, settled: float = SETTLED) -> np.ndarray:
    """Label probabilities by loopy sum-product; own: log potentials (nodes x labels), links: (i, j, log potentials)."""
    if not links:
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    i, j = (np.array([link[k] for link in links]) for k in (0, 1))
    potential = np.exp(np.stack([link[2] for link in links]))
    source, target = np.concatenate([i, j]), np.concatenate([j, i])
    towards = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    messages = np.zeros((len(source), LABELS))        # logarithms
    for _ in range(sweeps):
        belief = own.copy()
        np.add.at(belief, target, messages)
        out = belief[source] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("es,est->et", out, towards))
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if moved < settled:
            break
    belief = own.copy()
    np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


# ---- learning ----

LEARN_SCHEMA = "features array<int>, label int, near int, skip int"


def _learning_rows(batches):
    """A row per node with a known label: its features and label, and those of its linked neighbours before it (null: none, or hidden)."""
    for chunk in text_chunks(batches, "text"):
        rows = []
        for text in chunk.column("text").to_pylist():
            if text is None or not any(c in text for c in "0123456789@"):
                continue
            spans, tokens, nodes = nodes_of(text)
            labels = labels_of(spans, nodes, base_spans(text))
            near, skip = links_of(tokens, nodes)
            hidden = hidden_of(tokens, nodes, labels)
            before, earlier = ({b: labels[a] for a, b in links if not hidden[a]} for links in (near, skip))
            rows += [(node_features(tokens, i), labels[k], before.get(k), earlier.get(k)) for k, i in enumerate(nodes) if not hidden[k]]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32()))],
                names=["features", "label", "near", "skip"])


def fit(docs: DataFrame) -> dict:
    """Node weights by multinomial logistic regression; link potentials by smoothed log-odds of label pairs."""
    nodes = docs.select("text").mapInArrow(_learning_rows, LEARN_SCHEMA)
    # distinct rows are bounded by the features' combinations
    rows = nodes.groupBy("features", "label", "near", "skip").agg(F.count("*").alias("n")).toPandas()
    weights, n = np.zeros((N_FEATURES, LABELS)), rows["n"].to_numpy(float)
    label = rows["label"].to_numpy(int)
    if len(rows):
        x = np.zeros((len(rows), N_FEATURES))
        x[np.repeat(np.arange(len(rows)), [len(f) for f in rows["features"]]), np.concatenate(rows["features"].to_numpy())] = 1
        y = np.eye(LABELS)[label] * n[:, None]
        for _ in range(300):
            p = np.exp(x @ weights - (x @ weights).max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights += 2.0 * (x.T @ (y - p * n[:, None]) / n.sum() - 1e-4 * weights)
    pairs = {}
    share = (np.bincount(label, weights=n, minlength=LABELS) + 1.0) / (n.sum() + LABELS)
    for kind in ("near", "skip"):
        known = rows[kind].notna().to_numpy()
        # for each label ten pseudo-pairs: half of them agree, half are drawn from all labels
        together = np.zeros((LABELS, LABELS))
        np.add.at(together, (rows[kind][known].to_numpy(float).astype(int), label[known]), n[known])
        together = together + together.T
        given = together + 5.0 * share[None, :] + 5.0 * np.eye(LABELS)
        odds = np.log(given / given.sum(axis=1, keepdims=True)) - np.log(share)[None, :]
        pairs[kind] = np.clip((odds + odds.T) / 2, -PULL[kind], PULL[kind])
    return {"weights": weights, "learned": int(n.sum()), **pairs}


def added_spans(text: str, found, model: dict) -> list[tuple[int, int, int]]:
    """Spans that the field is sure of and that touch none of the fixed forms."""
    spans, tokens, nodes = nodes_of(text)
    labels = labels_of(spans, nodes, found)
    if not nodes or all(label != OTHER for label in labels):
        return []
    near, skip = links_of(tokens, nodes, labels)
    own = np.array([model["weights"][node_features(tokens, i)].sum(axis=0) for i in nodes])
    for k, label in enumerate(labels):
        if label != OTHER:          # recognised by its form: observed
            own[k] = np.where(np.arange(LABELS) == label, 0.0, -30.0)
    p = marginals(own, [(a, b, model["near"]) for a, b in near] + [(a, b, model["skip"]) for a, b in skip])
    out: list[tuple[int, int, int]] = []
    before = None
    for k, i in enumerate(nodes):
        best = int(p[k].argmax())
        if labels[k] != OTHER or best == OTHER or p[k, best] < SURE:
            before = None
            continue
        a, b = spans[i]
        token = text[a:b]
        a, b = a + len(token) - len(token.lstrip(".,;:!?\"'")), b - len(token) + len(token.rstrip(".,;:!?\"'"))
        if out and before == (i - 1, best):
            out[-1] = (best, out[-1][1], b)
        elif a < b:
            out.append((best, a, b))
        before = (i, best)
    return out


def find_personal_data(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per document of (doc_id, text): counts and digest of the fixed forms, and all spans (kind:start:end, code points)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs) if model is None else model
    signs = np.zeros(256, bool)
    signs[[*range(0x30, 0x3A), ord("@")]] = True

    def run(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for chunk in text_chunks(batches, "text"):
            data, offsets = text_buffer(chunk.column("text"))
            marks = np.concatenate([[0], np.cumsum(signs[data])])
            out = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                if marks[a] == marks[b]:
                    out.append((0, 0, 0, 0, nothing, ""))
                    continue
                text = data[a:b].tobytes().decode("utf-8", "surrogatepass")
                found = base_spans(text)
                more = added_spans(text, found, model) if model["learned"] else []
                write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
                out.append((*(sum(f[0] == k for f in found) for k in range(4)),
                            hashlib.sha256(write(found).encode()).hexdigest(), write(sorted([*found, *more]))))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.mapInArrow(run, SPAN_SCHEMA)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(corpus_table(spark, sf_dir, "documents", "doc_id", "text"))
