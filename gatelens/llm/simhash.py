"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are made once a document. Distinct fingerprints are joined in
binary tries: pairs of nodes are followed together from the root, differing
bits are added up, and a pair is dropped once they exceed the budget. The
tries are dealt out by pigeonhole: of five blocks of the 64 bits, at most four
differing bits leave one block equal, so each block in turn leads the bit order
and only pairs below one shared node of that depth can hold a link. A node
with very many fingerprints is cut once more by the same argument on the
remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, join_hot, materialize, shuffle_width
from .graph import connected_components
from .textkit import as_binary, parts_of

SHINGLE = 4
SEED = 42
BITS = 4
BLOCKS = 5
MAX_GROUP = 200_000
LIMIT = 1 << 18


def shingle_hashes(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of size words, joined by a space; fewer words make one shingle."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, seed)] if words else []
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(x + 1 for x in ends)]
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is set if over half of the lower-cased text's shingle hashes have it; without words zero.

    A long text is read in parts, each with the last words of the one before.
    """
    total, n, held = np.zeros(64, np.int64), 0, []
    for part in parts_of(text):
        held += part.lower().split()  # bytes: only A-Z, and only 0x20 and 0x09-0x0D
        if len(held) >= size:
            hashes = shingle_hashes(held, size)
            total += _bit_counts(hashes)
            n += len(hashes)
            held = held[len(held) - size + 1 :]
    if not n and held:
        total, n = _bit_counts(shingle_hashes(held, size)), 1
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big") if n else 0


def _bit_counts(hashes: list[int]) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[a : a + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, h long, size int): the fingerprint of every whole text, and the text's hash and length; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_binary(batch.column(1))
            fps = [fingerprint(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column(2), batch.column(3)], ["doc_id", "fp", "h", "size"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    return docs.select(*columns).select("*", *_text_key("text")).mapInArrow(run, "doc_id long, fp long, h long, size int")


def _text_key(text_col: str) -> list[Column]:
    """Hash and length of a text, null as empty; among rows that repeat a doc_id they tell the texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.length(text).alias("size")]


def cuts(width: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Offset and width of each of the blocks that width bits are cut into."""
    ends = [width * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def rotated(keys: np.ndarray, fixed: int, offset: int) -> np.ndarray:
    """Keys whose bits after the first fixed ones are rotated left by offset."""
    n = np.uint64(64 - fixed)
    o = np.uint64(offset)
    if offset == 0:
        return keys
    mask = np.uint64((1 << int(n)) - 1)
    low = keys & mask
    return (keys & ~mask) | (((low << o) | (low >> (n - o))) & mask)


def deal(df: DataFrame) -> DataFrame:
    """(fp, key, depth, blk) -> the same, each row once a block that then leads after the bits fixed so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, depth, blk = (batch.column(i).to_numpy() for i in range(4))
            for was in np.unique(blk):
                rows = np.flatnonzero(blk == was)
                d = int(depth[rows[0]])  # the same for all rows of a block
                for k, (offset, width) in enumerate(cuts(64 - d)):
                    turned = rotated(key[rows].view(np.uint64), d, offset)
                    new = {"fp": fp[rows], "key": turned.view(np.int64), "depth": np.full(len(rows), d + width, np.int32), "blk": np.full(len(rows), was * (BLOCKS + 1) + k + 1, np.int64)}
                    yield pa.RecordBatch.from_pydict(new)

    return df.select("fp", "key", "depth", "blk").mapInArrow(run, "fp long, key long, depth int, blk long")


class Forest:
    """Union-find over positions with numpy; every parent is a root after each call."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def trie_join(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int, found: Forest) -> None:
    """Unites the positions of sorted distinct keys that differ in at most budget bits.

    lo and hi bound the nodes of that depth whose keys are to be joined with
    themselves. A trie node is a range of sorted keys; a pair of nodes goes to
    at most four pairs of children, one more differing bit for unlike children.
    """
    zero = np.zeros(len(lo), np.int64)
    stack = [(depth, lo, hi, lo, hi, zero)]
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > LIMIT:
            for s in range(0, len(a0), LIMIT):
                stack.append((d, *(x[s : s + LIMIT] for x in (a0, a1, b0, b1, err))))
            continue
        same = a0 == b0
        size = (a1 - a0) * (b1 - b0)
        small = size <= 16 if d < 64 else np.ones(len(a0), bool)
        if small.any():
            s0, s1, t1, t0 = a0[small], (a1 - a0)[small], (b1 - b0)[small], b0[small]
            n = s1 * t1
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = s0[which] + at // t1[which], t0[which] + at % t1[which]
            near = (i < j) & (found.root[i] != found.root[j])
            i, j = i[near], j[near]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            found.union(i[near], j[near])
        keep = ~small
        if not keep.any():
            continue
        a0, a1, b0, b1, err, same = (x[keep] for x in (a0, a1, b0, b1, err, same))
        bit = np.uint64(1) << np.uint64(63 - d)
        mask = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        am = np.searchsorted(keys, (keys[a0] & mask) | bit)
        bm = np.searchsorted(keys, (keys[b0] & mask) | bit)
        more = err < budget
        mixed = more & ~same
        parts = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            tuple(x[more] for x in (a0, am, bm, b1, err + 1)),
            tuple(x[mixed] for x in (am, a1, b0, bm, err + 1)),
        ]
        c0, c1, e0, e1, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        full = (c1 > c0) & (e1 > e0) & ~((c0 == e0) & (c1 - c0 == 1))
        if full.any():
            stack.append((d + 1, *(x[full] for x in (c0, c1, e0, e1, err))))


def join_partition(batches: Iterator[pa.RecordBatch], budget: int = BITS) -> Iterator[pa.RecordBatch]:
    """Edges of spanning forests of the links below the partition's shared nodes."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    got = pa.Table.from_batches(batches)
    fp, key, depth, blk = (got.column(n).to_numpy() for n in ("fp", "key", "depth", "blk"))
    key = key.view(np.uint64)
    for k in np.unique(blk):
        rows = np.flatnonzero(blk == k)
        rows = rows[np.argsort(key[rows])]
        d, keys = int(depth[rows[0]]), key[rows]
        lo = np.flatnonzero(np.append(True, np.diff(keys >> np.uint64(64 - d)) > 0))
        hi = np.append(lo[1:], len(keys))
        found = Forest(len(keys))
        trie_join(keys, lo[hi - lo > 1], hi[hi - lo > 1], d, budget, found)
        child = np.flatnonzero(found.root != np.arange(len(keys)))
        if len(child):
            yield pa.RecordBatch.from_pydict({"a": fp[rows][child], "b": fp[rows][found.root[child]]})


def links(distinct: DataFrame, budget: int = BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long) that connect all that differ in at most budget bits."""
    if not 0 <= budget < BLOCKS:
        raise ValueError(f"{BLOCKS} blocks find links of at most {BLOCKS - 1} bits")
    lead = F.expr("shiftrightunsigned(key, 64 - depth)")
    todo = distinct.select("fp", F.col("fp").alias("key"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("blk"))
    out = None
    while todo is not None:
        dealt = materialize(deal(todo).withColumn("lead", lead), "dealt")
        n = dealt.count()
        large = dealt.groupBy("blk", "lead").count().where(F.col("count") > max_group).select("blk", "lead")
        todo = None
        if n > max_group and not large.isEmpty():
            # below a node that very many share, four bits must still spare one of five blocks of the rest
            todo = dealt.where("depth < 56").join(large, ["blk", "lead"], "left_semi")
            whole = large.join(dealt.where("depth >= 56").select("blk", "lead").distinct(), ["blk", "lead"], "left_semi")
            dealt = dealt.join(large, ["blk", "lead"], "left_anti").unionByName(dealt.join(whole, ["blk", "lead"], "left_semi"))
        width = shuffle_width(dealt, n, 2_000_000)
        edges = dealt.repartition(width, "blk", "lead").select("fp", "key", "depth", "blk").mapInArrow(lambda x: join_partition(x, budget), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Two texts are linked if their fingerprints differ in at most budget bits;
    component_id is the smallest doc_id that links reach, the row's own
    included. Null and empty texts, and texts of white space, have fingerprint
    zero and are linked like any other. Rows that repeat a doc_id are each
    returned. A null doc_id stays null and is not counted for the smallest; a
    component without any doc_id has a null component_id. Other columns of docs
    play no part. No rows in, no rows out.
    """
    made = _components(docs, id_col, text_col, budget)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _components(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """(fp, doc_id, h, size, root, least) of every row: its component's least fingerprint and smallest doc_id.

    A component or a fingerprint may have most of the rows; join_hot leaves those where they are.
    """
    made = materialize(fingerprints(docs, id_col, text_col), "fp")
    classes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "classes")
    roots = connected_components(links(classes.select("fp"), budget), "simhash")
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    members = materialize(linked.join(classes, linked.node == classes.fp).select("fp", "root", "least"), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    component = join_hot(members.select("fp", "root"), least, ["root"], "n", members.count())
    classes = classes.join(component, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("least"), "rows")
    return join_hot(made, materialize(classes, "classes"), ["fp"], "rows", made.count())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BITS) -> DataFrame:
    """docs with one row of each near-duplicate component: that of the smallest doc_id, then of the least hash of the text.

    A row is known by its doc_id and text, so rows that repeat a doc_id with
    unlike texts each count for their own component; rows equal in both are one,
    whichever of them stays. Null ids come after all others; null texts are
    empty. Columns stay as they are. No rows in, no rows out.
    """
    key = ["none", "id", "h", "size"]
    known = lambda doc_id: [doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id")]
    parts = materialize(_components(docs, id_col, text_col, budget).select("root", *known(F.col("doc_id")), "h", "size"), "parts")
    stay = materialize(parts.groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*"), "stay")
    # fewer than HOT rows can be repeated in over a HOT-th of all rows; those need no shuffle of their texts
    hot = materialize(parts.groupBy(*key).count().where(F.col("count") * HOT > parts.count()).where("count > 1").select(*key), "hot")
    own = dict(zip(key, ("__none", "__id", "__h", "__size"), strict=True))
    rows = docs.select("*", *(c.alias(n) for c, n in zip([*known(F.col(id_col).cast("long")), *_text_key(text_col)], own.values(), strict=True)))
    same = lambda other: reduce(Column.__and__, (F.col(own[n]) == other[n] for n in key))
    often = stay.join(F.broadcast(hot), key, "left_semi")
    near = rows.join(F.broadcast(often), same(often), "left_semi")
    far = rows.join(F.broadcast(hot), same(hot), "left_anti").join(stay, same(stay), "left_semi")
    return near.dropDuplicates(list(own.values())).unionByName(far.dropDuplicates(list(own.values()))).select(*docs.columns)


def sql(size: int = SHINGLE, seed: int = SEED, budget: int = BITS) -> str:
    """simhash_components(documents) in DuckDB's SQL, for small tables: XXH64 a lane a step for all shingles together, then every pair of fingerprints."""
    p1, p2, p3, p4, p5 = (f"{x}::uhugeint" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole = "18446744073709551616::uhugeint"
    times = lambda a, b: f"(({a}) * {b} % {whole})"
    plus = lambda *a: f"(({' + '.join(a)}) % {whole})"
    turned = lambda x, r: f"list_transform([{x}], lambda x_: x_ * {1 << r}::uhugeint % {whole} + x_ // {1 << (64 - r)}::uhugeint)[1]"
    lane = lambda pos, n: "(" + " + ".join(f"v[{pos} + {k + 1}]::uhugeint * {1 << (8 * k)}::uhugeint" for k in range(n)) + ")"
    mixed = lambda acc, x: times(turned(plus(acc, times(x, p2)), 31), p1)
    zero = "0::uhugeint"
    starts = [f"({seed}::uhugeint + {p1} + {p2}) % {whole}", f"{seed}::uhugeint + {p2}", f"{seed}::uhugeint", f"({seed}::uhugeint + {whole} - {p1}) % {whole}"]
    merged = lambda h, acc: plus(times(f"xor({h}, {mixed(zero, acc)})", p1), p4)
    after = lambda c, x: f"{c} as (select * replace ({x} as h) from {{0}})"
    bits = ", ".join(f"(2 * sum((h // {1 << b}::uhugeint % 2)::int) > count(*))::int as b{b}" for b in range(64))
    of = lambda low: " + ".join(f"b{low + k} * {1 << k}::bigint" for k in range(32))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    chain, source = [], "l0"
    for k in range(1, 5):
        chain.append(after(f"l{k}", merged("h", f"s{k}")).format(source))
        source = f"l{k}"
    ctes = [
        f"t as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') as w from documents)",
        f"g as (select r, unnest(list_transform(range(0, greatest(len(w) - {size}, 0) + 1), lambda i: list_aggregate(w[i + 1:i + {size}], 'string_agg', ' '))) as g from t where len(w) > 0)",
        "d as materialized (select g, row_number() over () as id, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda y: 16 * (instr('0123456789ABCDEF', y[1]) - 1) + instr('0123456789ABCDEF', y[2]) - 1) as v from (select distinct g from g))",
        # stripes of 32 bytes, four lanes at once
        "st as (select id, v, 0 as pos, " + ", ".join(f"{x} as s{k + 1}" for k, x in enumerate(starts)) + " from d where len(v) >= 32 union all select id, v, pos + 32, "
        + ", ".join(mixed(f"s{k + 1}", lane(f"pos + {8 * k}", 8)) for k in range(4)) + " from st where pos + 32 <= len(v))",
        "l0 as (select id, v, pos, s1, s2, s3, s4, " + plus(*(turned(f"s{k}", r) for k, r in ((1, 1), (2, 7), (3, 12), (4, 18)))) + " as h from st where pos + 32 > len(v))",
        *chain,
        # what is left, by eights, one four and ones
        f"rest as (select id, v, pos, {plus('h', 'len(v)::uhugeint')} as h from l4 union all select id, v, 0, {plus(f'{seed}::uhugeint', p5, 'len(v)::uhugeint')} from d where len(v) < 32 union all "
        f"select id, v, case when pos + 8 <= len(v) then pos + 8 when pos + 4 <= len(v) then pos + 4 else pos + 1 end, case when pos + 8 <= len(v) then {plus(times(turned(f'xor(h, {mixed(zero, lane('pos', 8))})', 27), p1), p4)} "
        f"when pos + 4 <= len(v) then {plus(times(turned(f'xor(h, {times(lane('pos', 4), p1)})', 23), p2), p3)} else {times(turned(f'xor(h, {times(lane('pos', 1), p5)})', 11), p1)} end from rest where pos < len(v))",
        f"a1 as (select id, {times(f'xor(h, h // {1 << 33}::uhugeint)', p2)} as h from rest where pos >= len(v))",
        f"a2 as (select id, {times(f'xor(h, h // {1 << 29}::uhugeint)', p3)} as h from a1)",
        f"hashed as materialized (select d.g, xor(h, h // {1 << 32}::uhugeint) as h from a2 join d using (id))",
        f"bits as (select r, {bits} from g join hashed using (g) group by r)",
        f"fp as materialized (select t.r, doc_id, coalesce({of(32)}, 0) as hi, coalesce({of(0)}, 0) as lo from t left join bits using (r))",
        "f as materialized (select hi, lo, min(doc_id) as least from fp group by all)",
        f"e as materialized (select a.hi as h1, a.lo as l1, b.hi as h2, b.lo as l2, b.least from f a join f b on bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {budget})",
        "c as (select h1, l1, h2, l2, least from e union select c.h1, c.l1, e.h2, e.l2, e.least from c join e on c.h2 = e.h1 and c.l2 = e.l1)",
        "m as (select h1 as hi, l1 as lo, min(least) as component_id from c group by all)",
    ]
    return f"with recursive {', '.join(ctes)} select doc_id, format('{{:08x}}', hi) || format('{{:08x}}', lo) as fingerprint, component_id from fp join m using (hi, lo)"
