"""Supervised subword embeddings: a document is the mean of learned word and character n-gram vectors.

Words, pairs of adjacent words and n-grams of characters within words (with
their bounds) are hashed to rows of one table of vectors. Their mean goes through a
linear layer and softmax over two labels; table and layer are trained by
stochastic gradient descent in numpy, document by document. As all is linear up
to the softmax, scoring needs one number a row: its vector's part of the margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered_rows, materialize, scored_rows
from .textkit import SPACE, Part, as_binary, finish, prefix_sums, runs, span_hash, words

BITS = 16
ROWS = 3 << BITS
GRAMS = (3, 4)
DIM = 8
EPOCHS = 12
RATE = 1.0
#: The most labelled rows that training takes, those of the least hashes of the id.
SAMPLE = 4_000
SAMPLE_BYTES = 128 << 20
THRESHOLD = 0.3

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[SPACE] = 0x20


def rows_of(buf: np.ndarray, offs: np.ndarray, before: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray, np.uint64 | None]:
    """Document number and table row of every word, word pair and character n-gram of the documents, and the last word's hash.

    Of a text that comes in parts, before is the hash of the last word ahead;
    the part then follows a blank. Features are the same however it is cut.
    """
    if before is not None:
        buf, offs = np.concatenate(([0x20], buf)).astype(np.uint8), np.append(0, offs[1:] + 1)
    start, end, doc = words(buf, offs)
    shift = np.uint64(64 - BITS)
    pre = prefix_sums(_FOLDED[buf])
    h = span_hash(pre, start, end)
    out_doc, out_row = [doc], [(h >> shift).astype(np.int64)]
    if before is not None and before != 0:
        h, doc = np.append(before, h).astype(np.uint64), np.append(0, doc)
    pair = doc[1:] == doc[:-1]
    both = h[1:] * np.uint64(3) + h[:-1]
    both[h[1:] == h[:-1]] = 0  # a word said twice is one feature, whatever the word
    out_doc.append(doc[1:][pair])
    out_row.append((finish(both[pair]) >> shift).astype(np.int64) + (1 << BITS))
    at = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # where characters begin
    m = len(at) - 1
    blank = np.concatenate(([0], np.cumsum(SPACE[buf[at[:m]]])))
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(at[:m], offs)))
    for n in GRAMS:
        if m < n:
            continue
        # blanks only at the n-gram's ends, and all of it in one document
        ok = np.flatnonzero((blank[n - 1 : m] == blank[1 : m - n + 2]) & (owner[: m - n + 1] == owner[n - 1 :]))
        code = span_hash(pre, at[ok], at[ok + n]) + np.uint64(n)
        out_doc.append(owner[ok])
        out_row.append((finish(code) >> shift).astype(np.int64) + (2 << BITS))
    return np.concatenate(out_doc), np.concatenate(out_row), h[-1] if len(h) else before


def features(parts: Iterator[Part]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """rows_of each part; a text's later parts know the word before them."""
    before = None
    for buf, offs, ended in parts:
        doc, row, last = rows_of(buf, offs, before)
        before = None if ended else (np.uint64(0) if last is None else last)  # zero: no word yet
        yield doc, row


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) -> (doc_id, label, rows, weights): each document's distinct rows and their shares."""
    for batch in batches:
        for a, b, parts in runs(as_binary(batch.column(2)), 1 << 18):
            key, n = np.zeros(0, np.int64), np.zeros(0)
            for doc, row in features(parts):
                new, times = np.unique(doc * ROWS + row, return_counts=True)
                key, at = np.unique(np.concatenate([key, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times]), len(key))
            cut = np.searchsorted(key, np.arange(b - a + 1) * ROWS)
            ids = (key % ROWS).astype("<u4")
            share = n / np.maximum(np.bincount(key // ROWS, n, b - a), 1)[key // ROWS]
            share = share.astype("<f4")
            blobs = [[x[s:t].tobytes() for s, t in zip(cut, cut[1:], strict=False)] for x in (ids, share)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *(pa.array(x, pa.binary()) for x in blobs)], ["doc_id", "label", "rows", "shares"])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, may: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most so many labelled ids, those of the least hashes, whose rows may be learned from.

    may is a condition on doc_id. An id with several labels counts by the least.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(may)
    # of many labels only those of low hashes go on, twice as many as are taken, so that no task sorts what all others found
    bound = min(2**63 - 1, 2 * rows * 2**63 // max(labels.count(), 1))
    known = known.withColumn("__h", F.xxhash64("doc_id").bitwiseAND(2**63 - 1)).where(F.col("__h") <= bound)
    known = known.groupBy("doc_id", "__h").agg(F.min("label").alias("label")).orderBy("__h", "doc_id").limit(rows).select("doc_id", "label")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")  # at most rows ids


def collected(bags: DataFrame, size: Column, most: int) -> pa.Table:
    """The rows of bags (doc_id, ...), by doc_id: those of the least hashes of the id, as many as fit into so many bytes.

    The rows' sizes are looked at first, so that long documents can't fill the driver.
    """
    bags = materialize(bags, "bags")
    total, ids = 0, []
    for r in bags.select("doc_id", F.xxhash64("doc_id").bitwiseAND(2**63 - 1).alias("h"), size.alias("size")).orderBy("h", "doc_id").collect():
        total += r["size"]
        if total > most and ids:
            break
        ids.append((r["doc_id"],))
    few = bags.sparkSession.createDataFrame(ids, "doc_id long")
    return bags.join(F.broadcast(few), "doc_id").toArrow().sort_by("doc_id")


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(label, rows, shares) of each document -> each row's margin for label 1, and the bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (ROWS, dim)).astype(np.float32)
    layer = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    one = sum(y for y, *_ in bags)
    if not 0 < one < len(bags):  # nothing to tell apart: everything gets the labels' share
        return np.zeros(ROWS, np.float32), float(np.log((one + 1) / (len(bags) - one + 1)))
    steps, at = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            y, rows, share = bags[k]
            pace = rate * (1 - at / steps)
            at += 1
            v = table[rows]
            h = share @ v
            z = layer @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ layer
            layer -= pace * 0.1 * np.outer(p, h)
            bias -= pace * 0.1 * p
            table[rows] = v - np.outer(share * (pace * 10), back)
    return (table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Trains on at most rows labelled documents of those that may be learned from, and on at most so many bytes of their features."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, may, rows)
    bags = sample.mapInArrow(_bags, "doc_id long, label int, rows binary, shares binary")
    one = bags.groupBy("doc_id").agg(F.min(F.struct("label", "rows", "shares")).alias("bag")).select("doc_id", "bag.*")  # ids that repeat count once
    got = collected(one, 2 * F.length("rows"), most)
    view = lambda name, kind: (np.frombuffer(x.as_buffer(), kind) for x in got.column(name))
    return train([(int(y > 0), rows, shares) for y, rows, shares in zip(got.column("label").to_pylist(), view("rows", "<u4"), view("shares", "<f4"), strict=True)])


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """The function from a batch's text column to scores, softmax's probabilities of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS numbers

    def run(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        margin, bias = shared.value
        for a, b, parts in runs(as_binary(texts), 1 << 18):
            n, z = np.zeros(b - a), np.zeros(b - a)
            for doc, row in features(parts):
                n += np.bincount(doc, minlength=b - a)
                z += np.bincount(doc, margin[row], b - a)
            yield a, b, [pa.array(1 / (1 + np.exp(-z / np.maximum(n, 1) - bias)))]

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: int = SAMPLE, most: int = SAMPLE_BYTES
) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs.

    may, a condition on doc_id, says which labelled rows are learned from: those
    of the least hashes of the id, at most so many rows, and most bytes of
    features. Null, empty and blank texts get the score of the bias alone; long
    texts are read in parts, which changes nothing. Without labels
    of both kinds every row gets their smoothed share. Rows are scored one by
    one: equal texts get equal scores, ids may be null or repeat. No rows in,
    no rows out.
    """
    scored = scored_rows(docs, scorer(docs, fit(docs, labels, may, id_col, text_col, rows=rows, most=most)), ["score"], id_col, text_col)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rows: int = SAMPLE, most: int = SAMPLE_BYTES
) -> DataFrame:
    """The rows of docs that quality_scores predicts 1 for, with docs' columns as they are.

    Nulls, empties, repeats and an empty table fare as there; no column's name or value but the text's plays a part.
    """
    run = scorer(docs, fit(docs, labels, may, id_col, text_col, rows=rows, most=most))
    return filtered_rows(docs, run, lambda p: p[-1].to_numpy() >= threshold, text_col)
