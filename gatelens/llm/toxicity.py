"""Toxicity by a classifier chain over categories.

Each category has a logistic model on marker features; a later model also gets
the earlier categories' probabilities. While a later model is trained these are
out-of-fold predictions, so it learns from probabilities as it will see them.
The labels say toxic or not; the categories before ``toxic`` are found in the
labelled rows: ``overt`` are toxic documents with one of the strongest markers,
``veiled`` the toxic ones without.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered_rows, scored_rows
from .subwords import SAMPLE_BYTES, collected, labelled_sample
from .textkit import LOWER, as_binary, finish, prefix_sums, runs, span_hash

BITS = 18
PREFIXES = (4, 5, 6, 7)
STRONGEST = 32
LEAST_Z = 3.0
FOLDS = 3
#: The most labelled rows that training takes, those of the least hashes of the id.
SAMPLE = 12_000
CATEGORIES = ("overt", "veiled", "toxic")
THRESHOLD = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def markers_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hashed feature of every lower-cased run of letters and digits, and of its first bytes."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[buf]
    m = _LETTER[low]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    o = offs[:-1][offs[:-1] < len(buf)]
    first[o] = m[o]
    o = offs[1:] - 1
    o = o[o >= 0]
    last[o] = m[o]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc, pre = np.searchsorted(offs, start, side="right") - 1, prefix_sums(low)
    docs, rows = [doc], [span_hash(pre, start, end)]
    for n in PREFIXES:
        long = end - start > n
        docs.append(doc[long])
        rows.append(finish(span_hash(pre, start[long], start[long] + n) + np.uint64(n)))
    return np.concatenate(docs), (np.concatenate(rows) >> np.uint64(64 - BITS)).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, parts in runs(as_binary(batch.column(2))):
            key = np.zeros(0, np.int64)
            for buf, offs, _ in parts:
                doc, row = markers_of(buf, offs)
                key = np.unique(np.concatenate([key, (doc << BITS) + row]))
            cut = np.searchsorted(key, np.arange(b - a + 1) << BITS)
            ids = (key & ((1 << BITS) - 1)).astype("<u4")
            blobs = [ids[s:t].tobytes() for s, t in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(blobs, pa.binary())], ["doc_id", "label", "rows"])


class Rows:
    """A sparse matrix of ones: each row's columns, and dense columns after those; the last one is the bias."""

    def __init__(self, row: np.ndarray, column: np.ndarray, width: int, dense: np.ndarray):
        self.row, self.column, self.width = row, column, width
        self.dense = np.concatenate([dense, np.ones((len(dense), 1))], axis=1)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.dense)) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed matrix times r."""
        return np.concatenate([np.bincount(self.column, r[self.row], self.width), r @ self.dense])

    def where(self, keep: np.ndarray) -> Rows:
        at, of = np.cumsum(keep) - 1, keep[self.row]
        return Rows(at[self.row[of]], self.column[of], self.width, self.dense[keep, :-1])


def logistic(x: Rows, y: np.ndarray, ridge: float = 0.1, steps: int = 200) -> np.ndarray:
    """Weights and, last, the bias, by accelerated gradient steps on the ridge-penalised mean loss."""
    w = np.zeros(x.width + x.dense.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    if not y.any():  # nothing of the kind is known
        w[-1] = -np.log(len(y) + 2)
        return w
    pen = np.full(len(w), ridge / max(len(y), 1))
    pen[-1] = 0
    top = x.back(x.times(np.ones(len(w))))  # bounds each weight's curvature; rare markers take larger steps
    rate = 1 / (np.maximum(top, 1.0) / (4 * len(y)) + pen)
    seen = w.copy()
    for k in range(steps):
        p = sigmoid(x.times(seen))
        new = seen - rate * (x.back(p - y) / len(y) + pen * seen)
        seen = new + k / (k + 3) * (new - w)
        w = new
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Markers:
    """Every hashed feature over the z bar as a column, chosen from the labelled rows that learn names, and the categories' labels after them."""

    def __init__(self, y: np.ndarray, sets: list[np.ndarray], learn: np.ndarray):
        size = 1 << BITS
        with_, without = (_counted([sets[k] for k in np.flatnonzero(learn & (y == label))]) for label in (1, 0))
        n1, n0 = max(y[learn].sum(), 1), max((1 - y[learn]).sum(), 1)
        p = (with_ + without) / (n1 + n0)
        z = (with_ / n1 - without / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        order = np.argsort(-np.abs(z), kind="stable")
        order = order[(np.abs(z[order]) >= LEAST_Z) & ((with_ + without)[order] >= 3)]
        self.column, self.width = np.full(size, -1, np.int32), len(order)
        self.column[order] = np.arange(len(order))
        strongest = np.zeros(len(order), bool)
        strongest[np.flatnonzero(z[order] > 0)[:STRONGEST]] = True
        found = [c[c >= 0] for c in (self.column[x] for x in sets)]
        self.row, self.at = np.repeat(np.arange(len(sets)), [len(c) for c in found]), np.concatenate([np.zeros(0, np.int32), *found])
        overt = (np.bincount(self.row, strongest[self.at], len(y)) > 0).astype(np.float32)
        self.labels = {"overt": y * overt, "veiled": y * (1 - overt), "toxic": y}

    def inputs(self, earlier: np.ndarray) -> Rows:
        return Rows(self.row, self.at, self.width, earlier)


def _counted(sets: list[np.ndarray], part: int = 1000) -> np.ndarray:
    """In how many of the sets each hashed feature is."""
    total = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(sets), part):
        total += np.bincount(np.concatenate(sets[a : a + part]), minlength=1 << BITS)
    return total


def hits(column: np.ndarray, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Each document's markers once, a number for document and marker."""
    c = column[row]
    hit = c >= 0
    return np.unique((doc[hit] << 32) | c[hit])


class Chain:
    """From (label, hashed features, each once) of each document: a marker's column by its hash, and one weight vector a category over markers, earlier categories and the bias.

    Out-of-fold probabilities come from markers, category labels and weights that the fold's own rows had no part in.
    """

    def __init__(self, sets: list[tuple[int, np.ndarray]], folds: int = FOLDS):
        y = np.array([label for label, _ in sets], np.float32)
        rows = [np.asarray(r) for _, r in sets]
        fold = np.arange(len(sets)) % folds
        every = Markers(y, rows, np.ones(len(sets), bool))
        parts = [(fold == f, Markers(y, rows, fold != f)) for f in range(folds) if (fold != f).any()]
        self.column, self.weights, earlier = every.column, [], np.zeros((len(sets), 0))
        for category in CATEGORIES:
            self.weights.append(logistic(every.inputs(earlier), every.labels[category]))
            outside = np.zeros(len(sets))
            for held, markers in parts:
                inputs = markers.inputs(earlier)
                w = logistic(inputs.where(~held), markers.labels[category][~held])
                outside[held] = sigmoid(inputs.where(held).times(w))
            earlier = np.concatenate([earlier, outside[:, None]], axis=1)
        self.outside = earlier

    def hits(self, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
        return hits(self.column, doc, row)

    def probabilities(self, key: np.ndarray, n: int) -> np.ndarray:
        """From hits: one row a document, one column a category."""
        doc, c = key >> 32, key & 0xFFFFFFFF
        out = np.zeros((n, len(CATEGORIES)))
        for k, w in enumerate(self.weights):
            z = np.bincount(doc, w[c], n) + w[-1]
            out[:, k] = sigmoid(z + out[:, :k] @ w[len(w) - 1 - k : -1])
        return out


def fit(docs: DataFrame, labels: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE, most: int = SAMPLE_BYTES) -> Chain:
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, may, rows)
    sets = sample.mapInArrow(_sets, "doc_id long, label int, rows binary").groupBy("doc_id").agg(F.min(F.struct("label", "rows")).alias("s")).select("doc_id", "s.*")  # ids that repeat count once
    got = collected(sets, F.length("rows"), most)
    return Chain([(int(y > 0), np.frombuffer(r.as_buffer(), "<u4")) for y, r in zip(got.column("label").to_pylist(), got.column("rows"), strict=True)])


def scorer(docs: DataFrame, chain: Chain):
    """The function from a batch's text column to the categories' probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # one number a hash, one weight a marker and category

    def run(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        chain = shared.value
        for a, b, parts in runs(as_binary(texts)):
            key = np.unique(np.concatenate([chain.hits(*markers_of(buf, offs)) for buf, offs, _ in parts]))
            p = chain.probabilities(key, b - a)
            yield a, b, [pa.array(p[:, k]) for k in range(p.shape[1])]

    return run


def toxicity(
    docs: DataFrame, labels: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: int = SAMPLE, most: int = SAMPLE_BYTES
) -> DataFrame:
    """(doc_id, overt, veiled, score, predicted) of every row of docs; score is the chain's last category, toxic.

    may, a condition on doc_id, says which labelled rows are learned from: those
    of the least hashes of the id, at most so many rows, and most bytes of
    features. Null, empty and blank texts have no markers and get the biases'
    probabilities. Without toxic labels nothing is predicted toxic. Rows are
    scored one by one; ids may be null or repeat, other columns play no part. No
    rows in, no rows out.
    """
    run = scorer(docs, fit(docs, labels, may, id_col, text_col, rows=rows, most=most))
    scored = scored_rows(docs, run, [*CATEGORIES[:-1], "score"], id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(
    docs: DataFrame, labels: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: int = SAMPLE, most: int = SAMPLE_BYTES
) -> DataFrame:
    """The rows of docs that toxicity doesn't predict toxic, with docs' columns as they are.

    Nulls, empties, repeats and an empty table fare as there; no column's name or value but the text's plays a part.
    """
    run = scorer(docs, fit(docs, labels, may, id_col, text_col, rows=rows, most=most))
    return filtered_rows(docs, run, lambda p: p[-1].to_numpy() < threshold, text_col)
