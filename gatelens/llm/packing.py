"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Large pieces, above a third of the capacity, fit at most two to a sequence and
are matched greedily, each with the largest partner that still fits. Smaller
pieces then go, longest first, into the tightest gap that holds them. Lengths
are whole numbers up to the capacity, so the plan is made on the histogram of
lengths; pieces find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textkit import as_binary, slices
from .wordids import word_encoder

CAPACITY = 2048
END = 0


def place(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset) for every run of equal pieces.

    The piece of rank r goes to sequence first + (r - first rank) // pieces, at
    offset + ((r - first rank) % pieces) * length.
    """
    left, used, plan, total = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def take(length: int, n: int, first: int, per: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + n, first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for a in large:
        partners = iter([b for b in large if b <= a and a + b <= capacity])
        while left[a] > 0:
            b = next((x for x in partners if left[x] > (x == a)), None)
            if b is None:
                n = left[a]
                take(a, n, total, 1, 0)
                gaps[capacity - a].append((total, n))
            elif b == a:
                n = left[a] // 2
                take(a, 2 * n, total, 2, 0)
                gaps[capacity - 2 * a].append((total, n))
            else:
                n = min(left[a], left[b])
                take(a, n, total, 1, 0)
                take(b, n, total, 1, a)
                gaps[capacity - a - b].append((total, n))
            total += n
    for a in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        gap = a
        while left[a] > 0:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                gap = capacity
                fresh = -(-left[a] // (capacity // a))
                gaps[capacity].append((total, fresh))
                total += fresh
            first, n = gaps[gap].pop()
            per, offset = gap // a, capacity - gap
            full = min(n, left[a] // per)
            if full:
                take(a, full * per, first, per, offset)
                gaps[gap - per * a].append((first, full))
            if full < n and (rest := left[a]):  # fewer than one sequence takes
                take(a, rest, first + full, rest, offset)
                gaps[gap - rest * a].append((first + full, 1))
                full += 1
            if full < n:
                gaps[gap].append((first + full, n - full))
    return plan


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]) of every document's tokens; nth: how many of that length its task gave before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, count = word_encoder(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, column = batch.column(0).cast(pa.int64()), as_binary(batch.column(1))
            for a, b, *_ in slices(column):
                owner, piece, start, length, crc, blobs = [], [], [], [], [], []
                for row, tokens in enumerate(coder.encode(column[a:b].to_pylist(), end), a):
                    for k, s in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[s : s + capacity].astype("<u4").tobytes()
                        owner.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            blobs.append(part)
                sizes = np.array(length, np.int64)
                order = np.argsort(sizes, kind="stable")
                first = np.searchsorted(sizes[order], sizes[order])
                nth = np.empty(len(sizes), np.int64)
                nth[order] = np.arange(len(sizes)) - first + count[sizes[order]]
                count += np.bincount(sizes, minlength=capacity + 1)
                cols = [ids.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), task, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * with_ids, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A document is its whole text's ids and the end id; a null text counts as
    empty and gives a piece of one token. Documents longer than the capacity
    are cut into pieces of it, the last one shorter. Sequences are filled from
    offset 0 without gaps. Equal documents and rows that repeat a doc_id are
    packed once each; a null doc_id stays null. Other columns play no part. No
    rows in, no rows out. The driver holds one count a length and a plan of a
    few rows a length, both bounded by the capacity. Which of the equally long
    pieces goes where follows the tasks that read them; how many sequences there
    are doesn't.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, id_col, text_col, capacity, end, with_ids), "pieces")
    # a piece's rank among those of its length: of earlier tasks, then of its own; no task's pieces of one length are many
    counted = materialize(made.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    plan = spark.createDataFrame(place(counts, capacity), "length long, rank_from long, rank_to long, first long, per long, base long")
    ranked = made.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    hit = (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    at = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(plan), hit).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("first") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + (at % F.col("per")) * ranked["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
