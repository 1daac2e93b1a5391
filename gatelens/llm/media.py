"""Media columns: payloads cut by content, stored once a chunk, and rebuilt from ordered chunk lists.

A payload's cuts fall where a rolling gear hash of the last 32 bytes has given
bits zero, so equal passages are cut alike wherever they stand. Chunks are known
by their digests. Spark counts the digests; a Bloom filter over those
that occur more than once tells every task which of its chunks nobody
else can have. These are stored beside their document without a shuffle; all
others go through one by digest, and are stored once. A document is rebuilt
from its ordered chunk list, and its bytes are verified against the digest of
the whole.

A stored payload is 8-bit samples behind a 16-byte head: magic, sample width,
and the number of samples that belong to the text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, fresh_path, join_hot, materialize
from .textkit import as_binary

UNIT = 64
MAGIC = b"GL8S"
HEAD = 16
LEAST, MASK, MOST = 256, np.uint32((1 << 10) - 1), 8192
DIGEST = 16
#: Bits a digest, and the least and the most bits of the filter; beyond these it is fuller, and more chunks are shuffled.
BLOOM_EACH, BLOOM_LEAST, BLOOM_MOST = 12, 1 << 20, 1 << 29
BLOOM_HASHES = 3
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of the unit."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def stored_of(text: bytes) -> bytes:
    return MAGIC + struct.pack("<IQ", 8, len(text)) + payload_of(text)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: the sum of the last 32 bytes' gear values, each doubled once a byte since."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def marks_of(data: np.ndarray, part: int = 1 << 22) -> list[int]:
    """Where the rolling hash's low bits are zero, found part by part with the bytes that it reaches back to."""
    out = []
    for a in range(0, len(data), part):
        back = min(a, 31)
        out.append(np.flatnonzero((gear(data[a - back : a + part])[back:] & MASK) == 0) + a + 1)
    return np.concatenate(out).tolist()


def cut(data: bytes) -> list[bytes]:
    """Chunks of LEAST to MOST bytes, but for the last, that end where the rolling hash's low bits are zero."""
    if len(data) <= LEAST:
        return [data]
    ends, at = [], 0
    for m in [*marks_of(np.frombuffer(data, np.uint8)), len(data)]:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST and m < len(data):
            at = m
            ends.append(m)
    ends.append(len(data))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False) if b > a]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def bloom_bits(digests: np.ndarray, size: int) -> np.ndarray:
    """Which of the filter's size bits each digest has, a row each; digests are 16 bytes, two 64-bit numbers."""
    a, b = digests[:, 0], digests[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(BLOOM_HASHES)], axis=1).astype(np.int64)


def _numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def manifest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, whole binary, chunks array<binary>): the stored form's digest and its chunks' in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for t in as_binary(batch.column(1)):
                data = stored_of(text := t.as_py())
                out[0].append(len(text))
                out[1].append(hashlib.sha256(data).digest())
                out[2].append([digest(c) for c in cut(data)])
            types = (pa.int64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["doc_id", "n_bytes", "whole", "chunks"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, whole binary, chunks array<binary>")


def shared_filter(digests: DataFrame) -> np.ndarray:
    """A Bloom filter over (digest), in numbers of 64 bits; as large as the digests are many, up to BLOOM_MOST."""
    size = min(max(BLOOM_LEAST, 1 << (BLOOM_EACH * digests.count()).bit_length()), BLOOM_MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pos = np.unique(bloom_bits(_numbers(batch.column(0).to_pylist()), size))
                word, at = np.unique(pos >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (pos & 63).astype(np.uint64), at)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    words = digests.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def write_store(docs: DataFrame, shared: np.ndarray, path: str, id_col: str, text_col: str) -> None:
    """Parquet at path: kind=own has each document's chunks that the filter says nobody shares, kind=shared all others.

    own rows: the stored form's digest and its chunks in order, null where
    shared. shared rows: a chunk once a task and its digest.
    """
    bits = docs.sparkSession.sparkContext.broadcast(shared)  # at most BLOOM_MOST bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["kind", "whole", "chunks", "digest", "bytes"], (pa.string(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary())
        table, seen = bits.value, set()
        for batch in batches:
            column = as_binary(batch.column(0))
            at = 0
            while at < len(column):
                rows, size = [], 0
                while at < len(column) and size < 1 << 22:
                    data = stored_of(column[at].as_py())
                    at += 1
                    size += len(data)
                    chunks = cut(data)
                    digests = [digest(c) for c in chunks]
                    pos = bloom_bits(_numbers(digests), 64 * len(table))
                    hit = ((table[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1).tolist()
                    if not all(hit):
                        rows.append(("own", hashlib.sha256(data).digest(), [None if s else c for c, s in zip(chunks, hit, strict=True)], None, None))
                    for c, d, s in zip(chunks, digests, hit, strict=True):
                        if s and d not in seen:
                            if len(seen) >= 500_000:
                                seen.clear()
                            seen.add(d)
                            rows.append(("shared", None, None, d, zlib.compress(c, 6)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    made = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, whole binary, chunks array<binary>, digest binary, bytes binary")
    made.write.option("compression", "zstd").partitionBy("kind").parquet(path)


def _features(data: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of a stored form."""
    if data[:4] != MAGIC:
        raise ValueError("no stored payload")
    payload = data[HEAD:]
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    sum_, square = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    turns = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    feature = f"samples={len(samples)};sum={sum_};energy={square};crossings={turns};peak={int(samples.max())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(rows: DataFrame) -> DataFrame:
    """(whole, chunks array<binary>) -> (whole, features...): joins each chunk list, verifies it and computes features."""
    names = ["whole", *(x.split()[0] for x in FEATURES.split(", "))]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole, chunks in zip(batch.column(0), batch.column(1), strict=True):
                data = b"".join(chunks.as_py())
                if hashlib.sha256(data).digest() != (w := whole.as_py()):
                    raise ValueError("a rebuilt payload isn't the stored one")
                out.append((w, *_features(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.select("whole", "chunks").mapInArrow(run, f"whole binary, {FEATURES}")


def read_store(spark: SparkSession, listed: DataFrame, often: DataFrame, path: str) -> DataFrame:
    """(whole, features...) of every stored form in listed, read back from the store at path.

    often: the fewer than HOT digests that over a HOT-th of all list entries have.

    Documents that share no chunk are read as they lie. For the others their
    lists (whole, chunks) fetch the shared chunks by digest.
    """
    own_schema, shared_schema = "whole binary, chunks array<binary>", "digest binary, bytes binary"
    own = spark.read.schema(own_schema + ", kind string").parquet(path).where("kind = 'own'")
    some = F.exists("chunks", lambda c: c.isNull())
    alone = read_features(own.where(~some))
    level0 = spark.read.schema(shared_schema + ", kind string").parquet(path).where("kind = 'shared'")
    # one stored copy a digest
    store = materialize(level0.select("digest", "bytes").groupBy("digest").agg(F.min("bytes").alias("bytes")), "chunks")
    mixed = own.where(some).select("whole", F.posexplode("chunks").alias("at", "bytes")).where("bytes is not null")
    lists = listed.join(own.where(~some).select("whole"), "whole", "left_anti")
    wanted = lists.select("whole", F.posexplode("chunks").alias("at", "digest"))
    near = wanted.join(F.broadcast(store.join(F.broadcast(often), "digest", "left_semi")), "digest")
    far = wanted.join(F.broadcast(often), "digest", "left_anti").join(store, "digest")
    fetched = near.unionByName(far).select("whole", "at", F.col("bytes").alias("packed"), F.lit(None).cast("binary").alias("bytes"))
    parts = fetched.unionByName(mixed.select("whole", "at", F.lit(None).cast("binary").alias("packed"), "bytes"))
    whole = parts.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("at", "packed", "bytes"))).alias("parts"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                chunks = [[zlib.decompress(p["packed"]) if p["packed"] is not None else p["bytes"] for p in one] for one in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chunks, pa.list_(pa.binary()))], ["whole", "chunks"])

    return alone.unionByName(read_features(whole.mapInArrow(unpack, own_schema)))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row.

    A null text counts as empty: a payload of 64 zeros. Equal texts share all
    chunks and get equal values; rows that repeat a doc_id are returned each, a
    null doc_id stays null, other columns play no part. No rows in, no rows out.
    Everything but doc_id and n_bytes comes from the bytes read back.
    """
    spark = docs.sparkSession
    made = materialize(manifest(docs, id_col, text_col), "manifest")
    lists = materialize(made.groupBy("whole").agg(F.min("chunks").alias("chunks"), F.count("*").alias("times")), "lists")
    uses = lists.select("times", F.explode("chunks").alias("digest")).groupBy("digest").agg(F.sum("times").alias("times"), F.count("*").alias("uses"))
    shared = materialize(uses.where("times > 1"), "shared")
    entries = lists.agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0))).first()[0]
    often = shared.where(F.col("uses") * HOT > entries).select("digest")
    path = fresh_path(spark, "media")
    write_store(docs, shared_filter(shared.select("digest")), path, id_col, text_col)
    read = materialize(read_store(spark, lists.select("whole", "chunks"), often, path), "features")
    names = [x.split()[0] for x in FEATURES.split(", ")]
    read = read.join(lists.select("whole", "times"), "whole")
    return join_hot(made.select("doc_id", "n_bytes", "whole"), read, ["whole"], "times", made.count()).select("doc_id", "n_bytes", *names)


#: The same in DuckDB's SQL: padding, stored form and features from the bytes' hexadecimal digits, CRC-32 byte by byte.
SQL = """
with recursive t as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
p as (select r, doc_id, octet_length(b) as n, b || unhex(repeat('00', (case when octet_length(b) = 0 then 64 else (64 - octet_length(b) % 64) % 64 end)::int)) as pay from t),
m as (select *, unhex('474C3853' || '08000000' || list_aggregate(list_transform(range(0, 8), lambda i: lpad(format('{:X}', (n >> (8 * i)) & 255), 2, '0')), 'string_agg', '')) || pay as media from p),
e as (select range as c, 0 as k, range as x from range(0, 256) union all select c, k + 1, xor(x >> 1, 3988292384 * (x & 1)) from e where k < 8),
tab as (select list(x order by c) as tab from e where k = 8),
v as (select *, list_transform(regexp_extract_all(hex(pay), '..'), lambda y: 16 * (instr('0123456789ABCDEF', y[1]) - 1) + instr('0123456789ABCDEF', y[2]) - 1) as v from m),
z as (select v.*, xor(list_reduce(list_concat([4294967295], list_transform(v[len(v) - 63:], lambda y: y::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) as crc from v, tab)
select doc_id, n as n_bytes, octet_length(pay) as payload_bytes, sha256(pay) as payload_sha256, crc as tail_crc32, octet_length(media) as media_bytes, sha256(media) as media_sha256,
 'samples=' || len(v) || ';sum=' || list_sum(v)::bigint || ';energy=' || list_sum(list_transform(v, lambda y: y::bigint * y))::bigint
 || ';crossings=' || len(list_filter(range(1, len(v)), lambda i: (v[i] >= 128) <> (v[i + 1] >= 128))) || ';peak=' || list_max(v) as feature
from z
"""
