"""Length-delimited binary token records with a separate offset index.

A record file is a run of frames: the payload's length (u64), that length's
masked checksum (u32), the payload, its masked checksum (u32), all
little-endian. A payload is a flag byte (1: the id is null), the width of a
token id in bytes, the document's id (i64) and its token ids. The index beside
it has a 16-byte head (magic, record count) and per record the frame's offset
(u64) and token count (u64), so any record can be read without the ones before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, shuffle_width
from .textkit import as_binary, slices
from .wordids import word_encoder

END = 2
MAGIC = b"GLTOKIX1"
ROWS_PER_FILE = 50_000
#: Bytes of a frame besides its token ids.
FRAME = 26


def masked(data: bytes) -> int:
    """CRC-32 rotated by 15 bits plus a constant, so that checksums of stored checksums stay sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    payload = struct.pack("<BBq", doc_id is None, ids.dtype.itemsize, doc_id or 0) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(read, where: str = "") -> tuple[int | None, np.ndarray] | None:
    """The next record of a stream, by its read function; None at the end; ValueError if damaged."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"damaged record length {where}")
    n = struct.unpack("<Q", head[:8])[0]
    payload, check = read(n), read(4)
    if len(payload) < n or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
        raise ValueError(f"damaged record {where}")
    null, width, doc_id = struct.unpack("<BBq", payload[:10])
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10)


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path there; local, HDFS and object stores alike."""
    return pafs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> list[dict]:
    """Encodes every whole text and writes the records in ascending doc_id order; returns one entry a file.

    Files are numbered in doc_id order. A null text counts as empty, a null
    doc_id comes first; rows that repeat a doc_id are written each, ordered by
    a hash of the text. A task writes under a name of its own and renames at its
    end, so a repeated or lost task leaves no torn file behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, folder = at(path)
        name = f"{folder}/part-{context.partitionId():06d}"
        own = f"{folder}/.try-{context.partitionId():06d}-{context.taskAttemptId()}"
        coder, offset, tokens, index = word_encoder(), 0, 0, []
        with fs.open_output_stream(f"{own}.rec") as out:
            for batch in batches:
                ids, column = batch.column(0).to_pylist(), as_binary(batch.column(1))
                for a, b, *_ in slices(column):
                    for row, coded in enumerate(coder.encode(column[a:b].to_pylist(), end), a):
                        index.append((offset, len(coded)))
                        out.write(data := frame(ids[row], coded))
                        offset += len(data)
                        tokens += len(coded)
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(MAGIC + struct.pack("<Q", len(index)) + np.array(index, "<u8").tobytes())
        fs.move(f"{own}.rec", f"{name}.rec")
        fs.move(f"{own}.idx", f"{name}.idx")
        yield pa.RecordBatch.from_pylist([{"file": context.partitionId(), "records": len(index), "tokens": tokens, "bytes": offset}])

    spark = docs.sparkSession
    fs, folder = at(path)
    fs.create_dir(folder, recursive=True)
    width = shuffle_width(docs, docs.count(), ROWS_PER_FILE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(width, *order).sortWithinPartitions(*order)
    made = rows.select("doc_id", "text").mapInArrow(run, "file long, records long, tokens long, bytes long").collect()
    return sorted((r.asDict() for r in made), key=lambda r: r["file"])


def _index(fs: pafs.FileSystem, where: str) -> np.ndarray:
    """Offset and token count of each record of a file, from its index."""
    with fs.open_input_stream(where) as f:
        data = f.read()
    if data[:8] != MAGIC or len(data) != 16 + 16 * struct.unpack("<Q", data[8:16])[0]:
        raise ValueError(f"damaged index {where}")
    return np.frombuffer(data, "<u8", offset=16).reshape(-1, 2).astype(np.int64)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the record files and their indexes alone.

    One job reads the indexes, which say how many tokens lie ahead of each
    file; the driver holds one number a file. Another one reads the records, and
    a record that isn't as its index says is an error.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = at(path)
        for batch in batches:
            n = [int(_index(fs, f"{folder}/{name}.idx")[:, 1].sum()) for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["file", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = at(path)
        for batch in batches:
            for one in batch.to_pylist():
                got, where, done = [], f"{folder}/{one['file']}", 0
                index = _index(fs, f"{where}.idx")
                starts = one["start"] + np.cumsum(index[:, 1]) - index[:, 1]
                with fs.open_input_stream(f"{where}.rec", buffer_size=1 << 20) as f:
                    for (offset, n), start in zip(index.tolist(), starts.tolist(), strict=True):
                        record = unframe(f.read, f"{where}.rec")
                        if record is None or offset != done or len(record[1]) != n:
                            raise ValueError(f"records and index differ in {where}")
                        done += FRAME + record[1].nbytes
                        got.append((record[0], start, n, zlib.crc32(record[1].astype("<u4").tobytes())))
                        if len(got) == 10_000:
                            yield batch_of(got)
                            got = []
                    if f.read(1):
                        raise ValueError(f"records without index in {where}")
                yield batch_of(got)

    def batch_of(got: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*got, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    fs, folder = at(path)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    names = sorted(f.base_name[:-4] for f in found if f.base_name.endswith(".rec") and not f.base_name.startswith("."))
    each = lambda rows, schema: spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)
    counts = dict(sorted(map(tuple, each([(n,) for n in names], "file string").mapInArrow(tokens, "file string, tokens long").collect())))
    starts = accumulate(counts.values(), initial=0)
    listed = each(list(zip(counts, starts, strict=False)), "file string, start long")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def pick_record(path: str, file: int, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the offset index: the shuffled read."""
    fs, folder = at(path)
    with fs.open_input_file(f"{folder}/part-{file:06d}.idx") as f:
        head = f.read(16)
        if head[:8] != MAGIC or not 0 <= record < struct.unpack("<Q", head[8:])[0]:
            raise ValueError("no such record")
        f.seek(16 + 16 * record)
        offset = struct.unpack("<QQ", f.read(16))[0]
    with fs.open_input_file(f"{folder}/part-{file:06d}.rec") as f:
        f.seek(offset)
        return unframe(f.read)


def token_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes docs as token records into the shared folder and returns what the files say of each document.

    An empty document is its end id alone. No rows in, no rows out.
    """
    path = fresh_path(docs.sparkSession, "records")
    write_records(docs, path, id_col, text_col, end)
    return read_records(docs.sparkSession, path)
