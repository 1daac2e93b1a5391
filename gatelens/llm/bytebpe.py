"""Byte-level BPE in chunks that overlap.

Every text is cut into chunks that share some text with the next one. Each
chunk is split into pre-tokens on its own; where two chunks put a boundary at
the same place of their common part, their splits agree from there on, because
a pre-token depends on nothing before it, and they are stitched there. Chunks
that agree nowhere are split once more as one. Then every pre-token is encoded
by itself; the library merges its bytes by rank, and frequent ones are kept.
Chunks of very long documents are dealt to several tasks, others are gone
through in their task.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RANKS = "byte_bpe_50k.tiktoken"
CHUNK = 1 << 12
OVERLAP = 1 << 7
SPREAD = 1 << 20
#: Encoded pre-tokens that a process keeps, and the longest of them in characters.
KEPT = 300_000
LONGEST = 32


class Splitter:
    """Splits by the pattern as the library does, whose tables of letters and digits may be of another Unicode version.

    A character that the two engines put into different classes is replaced, for
    the split alone, by one of the library's class for it.
    """

    STAND_INS = {(True, False): "z", (False, True): "0", (False, False): "!"}

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        bare = {bytes([i]): i for i in range(256)}
        self.theirs = [tiktoken.Encoding(c, pat_str=c, mergeable_ranks=bare, special_tokens={}).encode_ordinary for c in (r"\p{L}", r"\p{N}")]
        self.ours = [regex.compile(c).match for c in (r"\p{L}", r"\p{N}")]
        # the library's white space is Unicode's; the pattern module's has four control characters more
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.known, self.other = set(map(chr, range(0x80))), {}

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        if not self.known.issuperset(text):
            for c in set(text) - self.known:
                kind = tuple(bool(f(c)) for f in self.theirs)
                if kind != tuple(bool(f(c)) for f in self.ours):
                    self.other[ord(c)] = self.STAND_INS[kind]
                self.known.add(c)
        if not self.other:
            return self.find(text)
        ends = list(accumulate(map(len, self.find(text.translate(self.other))), initial=0))
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Coder(dict):
    """Pre-token -> its ids, with each id's decimal text and bytes."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = Splitter(public_tokenizers.PATTERN)
        self.decimal, self.bytes = {i: str(i).encode() for i in ranks.values()}, {i: b for b, i in ranks.items()}

    def __missing__(self, token: str) -> list[int]:
        ids = self.library._encode_single_piece(token.encode())
        if len(token) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[token] = ids
        return ids


@lru_cache(2)
def coder(path: str | None = None) -> Coder:
    return Coder(path)


def pre_tokens(text: str, split, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """The text's pre-tokens, a list a chunk; every chunk is split on its own and stitched to the one before."""
    n, begin, stop = len(text), 0, chunk + overlap
    held = split(text[:stop])
    at = list(accumulate(map(len, held), initial=0))
    for start in range(chunk, n, chunk):
        if stop >= n:
            break
        end = min(n, start + chunk + overlap)
        new = split(text[start:end])
        new_at = list(accumulate(map(len, new), initial=start))
        # amid the text a chunk's last pre-token may go on, so where it begins is no boundary to go by, nor is a chunk's own start
        ours = {p for p in at[:-2] if p >= begin}
        cut = next((p for p in (new_at[1:-2] if end < n else new_at[1:-1]) if p in ours), None)
        if cut is None:
            held = split(text[begin:end])
            at = list(accumulate(map(len, held), initial=begin))
        else:
            yield held[bisect_left(at, begin) : bisect_left(at, cut)]
            held, at, begin = new, new_at, cut
        stop = end
    yield held[bisect_left(at, begin) :]


def encode(text: str, chunk: int = CHUNK, overlap: int = OVERLAP, path: str | None = None) -> list[int]:
    c = coder(path)
    return [i for tokens in pre_tokens(text, c.split, chunk, overlap) for i in chain.from_iterable(map(c.__getitem__, tokens))]


def sound_starts(text: str, split) -> list[int]:
    """Where pre-tokens start after other than white space, but for the last start."""
    starts = list(accumulate(map(len, split(text)), initial=0))[:-2]
    return [s for s in starts if s == 0 or not text[s - 1].isspace()]


def decode(ids: list[int], path: str | None = None) -> bytes:
    """The ids' raw bytes, put together."""
    return b"".join(map(coder(path).bytes.__getitem__, ids))


def _digests(ids: list[int], path: str | None) -> tuple[int, str, str]:
    text = b" ".join(map(coder(path).decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every whole text.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    bytes that the ids decode to. A null text counts as empty: no tokens, the
    digests of nothing. All texts go through chunks of chunk characters; those
    over spread characters are dealt to several tasks, which changes no result.
    Rows that repeat a doc_id are returned each, a null doc_id stays null, other
    columns play no part. No rows in, no rows out.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def of(ids_column, rows: list[tuple]) -> pa.RecordBatch:
        cols = [ids_column, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(cols + [pa.array([r[3] for r in rows], pa.list_(pa.int32()))] * with_ids, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids_column, rows, long = part.column(0), [], []
                for at, t in enumerate(part.column(1)):
                    text = t.as_py() or ""
                    if len(text) > spread:
                        row += 1
                        long += [(ids_column[at].as_py(), row, k, text[s : s + spread + wide]) for k, s in enumerate(range(0, len(text), spread))]
                        rows.append(None)
                    else:
                        ids = encode(text, chunk, overlap, path)
                        rows.append((*_digests(ids, path), ids if with_ids else None))
                done = [r for r in rows if r is not None]
                made = of(ids_column.filter(pa.array([r is not None for r in rows], pa.bool_())), done)
                none = [pa.nulls(len(done), t) for t in (pa.int64(), pa.int64(), pa.string())]
                yield pa.RecordBatch.from_arrays([*made.columns, *none], [*names, "row", "k", "body"])
                for r in long:
                    none = [pa.nulls(1, f.type) for f in made.schema][1:]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), *none, *(pa.array([x]) for x in r[1:])], [*names, "row", "k", "body"])

    wide = max(overlap, 2)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(rows.mapInArrow(run, f"{schema}, row long, k long, body string"), "bpe")
    chunks = made.where("body is not null").select("doc_id", "row", "k", "body").repartition(F.col("row"), F.col("k"))
    return made.where("body is null").select(*names).unionByName(_stitched(chunks, spread, wide, overlap, chunk, path, of, schema))


def _stitched(chunks: DataFrame, spread: int, wide: int, overlap: int, chunk: int, path: str | None, of, schema: str) -> DataFrame:
    """(doc_id, row, k, body): chunks of spread characters and wide more, each in any task, to the rows of their documents."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = coder(path).split
        for batch in batches:
            out = []
            for r, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = sound_starts(t, split)
                out.append({"row": r, "k": n, "head": [s for s in starts if 0 < s < wide], "tail": [s - spread for s in starts if s > spread]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("k", pa.int64()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    found = chunks.select("row", "k", "body").mapInArrow(marks, "row long, k long, head array<int>, tail array<int>")
    w = Window.partitionBy("row").orderBy("k")
    # a chunk begins at the first boundary that it shares with the one before; without one it is joined to that
    begin = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.col("head"), F.lag("tail").over(w))))
    found = found.withColumn("begin", begin).withColumn("part", F.count("begin").over(w)).withColumn("next", F.lead("begin").over(w))
    found = found.select("row", "k", "begin", "part", "next")
    joined = chunks.join(found, ["row", "k"])
    # up to the next chunk's begin, or to the chunk's own end where the next one is joined on or there is none
    stop = F.lit(spread) + F.coalesce("next", F.lit(0))
    skip = F.coalesce("begin", F.lit(0))
    piece = F.substring(F.col("body"), skip + 1, F.greatest(stop - skip, F.lit(0)))
    parts = joined.select("doc_id", "row", "part", "k", piece.alias("text")).groupBy("doc_id", "row", "part").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("texts"))
    parts = parts.select("doc_id", "row", "part", F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(encode(t, chunk, overlap, path), "<i4").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())], ["doc_id", "row", "part", "ids"])

    coded = parts.mapInArrow(code, "doc_id long, row long, part long, ids binary")
    whole = coded.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    whole = whole.select("doc_id", F.transform("parts", lambda x: x["ids"]).alias("parts"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, blobs in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(b"".join(blobs.as_py()), "<i4").tolist()
                yield of(pa.array([doc_id.as_py()], pa.int64()), [(*_digests(ids, path), ids)])

    return whole.mapInArrow(total, schema)
