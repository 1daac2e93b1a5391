"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). Classes are a
few of the most frequent words, each its own, and for all others the words'
endings, hashed. The classes' softmax has hashed features of the context: the
word before (n-gram), the two words before together (n-gram) and the word before
the last one (skip). It is trained in rounds over all training documents: tasks
compute gradient updates from the round's shared weights, and the updates are
averaged by how often each feature occurred.

Within a class there is a softmax over its words, from their smoothed shares of
the class. It has pairs of a word and the one before as features, hashed to 32
bits below their context and class, as many as the corpus has; and hashed skip
and two-word features, whose weights go by the word's group, a few bits of its
hash. A normaliser so needs a sum a group: of those words that were seen in the
context, with their weights, and of the others' shares.

Tokens of a context and class meet in one task. The skips' weights are trained
there in rounds of gradient updates, which are averaged as those of the classes
are. A pair's weight starts from log(1 + n / (mu * share)), where n is the
pair's training count and mu grows with the context's: the best one without
skips, for mu more tokens dealt by share. Gradient steps bring it to what is best
with skips. No table of pairs is sent anywhere; the task counts them, takes the
steps, scores its tokens and sends each document's sum back. Very frequent
contexts are dealt by pair; their counts by class and group are taken while the
classes' softmax is trained, their pairs' gradients are summed in the rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, materialize, shuffle_width, trim
from .textkit import LOWER, Part, as_binary, finish, prefix_sums, runs, span_hash, words

OWN = 8
#: A power of two.
ENDINGS = 8
#: Sixteen, as a class is the lowest four bits of a group's hash.
CLASSES = OWN + ENDINGS
BUCKETS = 1 << 13
ROUNDS = 1
RATE = 0.3
BATCH = 1 << 14
#: Words with at least the count that this many words reach are looked up from a broadcast table.
FREQUENT = 1 << 18
END = np.uint64(0x5BD1E995C6A4A793)
START = np.uint64(0x2545F4914F6CDD1D)
FLUSH = 300_000
#: Of a context that occurred N times, mu is MU * N ** POWER.
MU, POWER = 2.0, 0.9
#: Within a class, words are told apart by the leading bits of their hashes where a feature's weights are hashed.
GROUP_BITS = 4
GROUPS = 1 << GROUP_BITS
#: Hashed rows a class of either feature that goes by the word before the last one; rounds over them, and steps of the pairs' weights a pass.
SKIPS = 1 << 11
WITHIN = 1
STEPS = 1
#: Tokens whose weights are looked up at once, and shards that a task learns from.
CHUNK, SHARDS = 1 << 14, 8
#: Tokens and documents of a block, whose tokens go out and whose sums come back together, and tokens a task that answers.
BLOCK, BLOCK_DOCS, ANSWERED = 1 << 20, 1 << 15, 1_000_000


def tokens(buf: np.ndarray, offs: np.ndarray, ended: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, hash and ending class of every lower-cased word, each document's end among them if it is there."""
    low = LOWER[buf]
    start, end, doc = words(low, offs)
    h = span_hash(prefix_sums(low), start, end)
    code = np.zeros(len(start), np.uint64)
    for k in (1, 2, 3):
        code <<= np.uint64(8)
        if len(low):
            code |= np.where(end - k >= start, low.take(np.maximum(end - k, 0)), np.uint8(0))
    kind = OWN + (finish(code + np.uint64(1)) & np.uint64(ENDINGS - 1)).astype(np.int64)
    if not ended:
        return doc, h, kind
    n = len(offs) - 1
    at = np.searchsorted(doc, np.arange(n), side="right")
    return np.insert(doc, at, np.arange(n)), np.insert(h, at, END), np.insert(kind, at, OWN)


def stable_order(x: np.ndarray) -> np.ndarray:
    """What np.argsort(x, kind="stable") gives of unsigned 64-bit numbers: the numbers are sorted with their places in the lowest bits, which is faster than sorting places.

    Of large numbers the bits just above the lowest four then give way to the
    places'. Where that brings any out of order, the places are sorted after all.
    """
    bits = max(len(x) - 1, 1).bit_length()
    put, off = np.uint64(bits), np.uint64(bits + 4)
    if int(x.max(initial=0)) >> (64 - bits):
        key = x >> off
        key <<= off
        few = x & np.uint64(15)
        few <<= put
        key |= few
        del few
    else:
        key = x << put
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    key &= np.uint64((1 << bits) - 1)
    order = key.view(np.int64)
    y = x.take(order)
    return order if (y[1:] >= y[:-1]).all() else np.argsort(x, kind="stable")


def alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of unsigned 64-bit numbers, the distinct ones, and where each one's begin in that order."""
    order = stable_order(x)
    y = x.take(order)
    cuts = np.flatnonzero(np.append(True, y[1:] != y[:-1])[: len(y)])
    return order, y.take(cuts), cuts


def spread(order: np.ndarray, cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each distinct number's value to all that are equal to it, in their own places."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(cuts, append=len(order)))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(learn, text) -> (word, kind, n, m): counts in the documents that are learned from, and in all, by task, given out whenever many words have gathered."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged() -> tuple[np.ndarray, ...]:
        order, word, cuts = alike(np.concatenate([x[0] for x in held]))
        kind = np.concatenate([x[1] for x in held])[order[cuts]]
        return word, kind, *(np.add.reduceat(np.concatenate([x[k] for x in held])[order], cuts) for k in (2, 3))

    def out(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), *map(pa.array, x[1:])], ["word", "kind", "n", "m"])

    for batch in batches:
        learn = batch.column(0)
        for flag, rows in ((1, learn), (0, pc.invert(learn))):
            for part in (p for *_, parts in runs(as_binary(batch.column(1).filter(rows))) for p in parts):
                _, h, kind = tokens(*part)
                order, word, cuts = alike(h)
                n = np.diff(cuts, append=len(h))
                held.append((word, kind[order[cuts]].astype(np.int32), n * flag, n))
                size += len(word)
                if size > 2 * FLUSH:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield out(held[0])
                        held, size = [], 0
    if held:
        yield out(merged())
        held.clear()
    trim()


def group_of(h: np.ndarray) -> np.ndarray:
    """The group that each word is of within its class."""
    return (h >> np.uint64(64 - GROUP_BITS)).astype(np.int64)


@dataclass
class Vocabulary:
    """The corpus' totals, classes, frequent words and frequent contexts."""

    total: int
    distinct: int
    all_tokens: int
    own: np.ndarray  # words of classes of their own, sorted
    own_class: np.ndarray
    class_total: np.ndarray
    class_size: np.ndarray  # of each class the sum of its words' counts, each more by one, and one for unknown words
    class_rest: np.ndarray  # the mean of that over words that aren't frequent, unknown ones among them
    group_share: np.ndarray  # of each class the shares of its words by group; unknown ones are dealt evenly
    frequent: Places
    level: np.ndarray  # of each frequent word its number in levels
    levels: np.ndarray  # counts, each more by one
    hot: Places  # contexts

    def classes(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return kind
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        return np.where(self.own[at] == h, self.own_class[at], kind)

    def level_of(self, h: np.ndarray) -> np.ndarray:
        """Each word's number in levels, -1 if it isn't frequent."""
        at = self.frequent.of(h)
        return np.where(at >= 0, self.level[at], -1) if len(self.level) else at

    def shares(self, y: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Each word's share of its class y, by its number in levels, -1 if it isn't frequent; a class' words and one unknown word sum to one."""
        known = self.levels[level] if len(self.levels) else np.zeros(len(level))
        return np.where(level < 0, self.class_rest[y], known) / self.class_size[y]


class Places:
    """Where 64-bit hashes stand in a sorted table of them, by their leading bits."""

    def __init__(self, table: np.ndarray):
        bits = max(1, (2 * len(table)).bit_length())
        self.ended, self.shift = np.append(table, np.uint64(2**64 - 1)), np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    @property
    def table(self) -> np.ndarray:
        return self.ended[:-1]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Each value's place, -1 if it isn't there."""
        last = len(self.ended) - 1  # of the greatest value of all, which ends every search
        at = self.first.take((x >> self.shift).view(np.int64)).astype(np.int64)
        there = self.ended.take(at)
        out = np.where((there == x) & (at < last), at, -1)
        todo = np.flatnonzero(there < x)
        at = at.take(todo) + 1
        while len(todo):
            want, there = x.take(todo), self.ended.take(at)
            hit = (there == want) & (at < last)
            out[todo[hit]] = at[hit]
            on = there < want
            at, todo = at[on] + 1, todo[on]
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (word, kind, n, m), a row a word. What comes to the driver is bounded by OWN, CLASSES, FREQUENT and HOT."""
    none = F.lit(0)
    total = counts.agg(*(F.coalesce(x, none).alias(k) for k, x in (("n", F.sum("n")), ("v", F.count_if(F.col("n") > 0)), ("m", F.sum("m"))))).first()
    top = counts.where("n > 0").orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = {r["word"] & (2**64 - 1): k for k, r in enumerate(top)}
    known = sorted(own)
    kind = F.col("kind")
    for k, r in enumerate(top):
        kind = F.when(F.col("word") == r["word"], k).otherwise(kind)
    # the least count that no more than FREQUENT words reach, from a histogram of the counts' logarithms
    steps = counts.groupBy(F.floor(F.log2("m") * 16).alias("b")).agg(F.count("*").alias("v"), F.min("m").alias("m")).orderBy(F.desc("b")).collect()
    least, seen = 2**62, 0
    for r in steps:
        seen += r["v"]
        if seen > FREQUENT:
            break
        least = r["m"]
    learned, rare = F.col("n") > 0, F.col("m") < least
    sums = (("n", F.sum("n")), ("size", F.sum(F.when(learned, F.col("n") + 1))), ("rest", F.sum(F.when(learned & rare, F.col("n") + 1))), ("words", F.count_if(learned & rare)))
    by_group = counts.groupBy(kind.alias("k"), F.shiftrightunsigned("word", 64 - GROUP_BITS).alias("g")).agg(*(F.coalesce(x, none).alias(k) for k, x in sums)).collect()
    n, size, rest, words_of = np.zeros((4, CLASSES, GROUPS))
    for r in by_group:
        n[r["k"], r["g"]], size[r["k"], r["g"]], rest[r["k"], r["g"]], words_of[r["k"], r["g"]] = r["n"], r["size"], r["rest"], r["words"]
    class_total, class_size, class_rest = n.sum(axis=1), size.sum(axis=1) + 1, (rest.sum(axis=1) + 1) / (words_of.sum(axis=1) + 1)
    group_share = (size - rest + (words_of + 1 / GROUPS) * class_rest[:, None]) / class_size[:, None]
    got = counts.where(F.col("m") >= least).select("word", "n").toArrow()
    word, n = got.column("word").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(word)
    levels, level = np.unique(n[order] + 1, return_inverse=True)
    hot = counts.where(F.col("m") * HOT > total["m"]).select("word").toArrow().column("word").to_numpy().view(np.uint64)  # fewer than HOT
    hot = np.unique(np.append(hot, START))
    return Vocabulary(total["n"], total["v"], total["m"], np.array(known, np.uint64), np.array([own[w] for w in known], np.int64), class_total, class_size, class_rest, group_share, Places(word[order]), level, levels.astype(float), Places(hot))


def contexts(doc: np.ndarray, h: np.ndarray, before: tuple[np.uint64, np.uint64] = (START, START)) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The word before each token, and table rows of its n-gram and skip features; before: the two tokens ahead of the first one's, the nearer last."""
    one, two = np.empty_like(h), np.empty_like(h)
    one[:1], two[:1], two[1:2] = before[1], before[0], before[1]
    if len(h) > 1 and doc[1] != doc[0]:
        two[1] = START
    one[1:] = np.where(doc[1:] == doc[:-1], h[:-1], START)
    two[2:] = np.where(doc[2:] == doc[:-2], h[:-2], START)
    b = np.uint64(BUCKETS - 1)
    return one, tuple((x & b).astype(np.int64) + 1 + k * BUCKETS for k, x in enumerate((finish(one), finish(two + np.uint64(7)), finish(one * np.uint64(5) + two))))


def _read(parts: Iterator[Part]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """Tokens, words before and features of each part; a text's later parts know the words before them."""
    before = (START, START)
    for part in parts:
        doc, h, kind = tokens(*part)
        yield doc, h, kind, *contexts(doc, h, before)
        if not part[2]:
            before = tuple([*before, *h[-2:]][-2:])


ROWS = 1 + 3 * BUCKETS


#: Sums beyond +-60, where single precision ends, are cut off.
MOST = 60


def _sums(table: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
    z = table.take(rows[0], axis=0, mode="clip")
    t = np.empty_like(z)
    for r in rows[1:]:
        table.take(r, axis=0, out=t, mode="clip")
        z += t
    z += table[0]
    return np.clip(z, -MOST, MOST, out=z)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def log_softmax(table: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
    z = _sums(table, rows)
    z -= np.log(_row_sums(np.exp(z)))[:, None]
    return z


def softmax(table: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
    z = _sums(table, rows)
    np.exp(z, out=z)
    z /= _row_sums(z)[:, None]
    return z


class Settled:
    """log P(class | context) by weights that don't change any more: their exponentials are taken once, and multiplied for each token."""

    def __init__(self, table: np.ndarray):
        ends = (0, 1, *range(1 + BUCKETS, ROWS + 1, BUCKETS))
        most = sum(float(np.abs(table[a:b]).max()) for a, b in zip(ends, ends[1:], strict=False))
        self.table, self.grown = table, np.exp(table) if most <= MOST else None  # else sums may have to be cut off

    def of(self, rows: tuple[np.ndarray, ...], y: np.ndarray) -> np.ndarray:
        """Of each token's class y."""
        if self.grown is None:
            return log_softmax(self.table, rows)[np.arange(len(y)), y]
        m = self.grown.take(rows[0], axis=0, mode="clip")
        t, flat, z = np.empty_like(m), self.table.ravel(), self.table[0].take(y)
        for k, r in enumerate(rows):
            if k:
                self.grown.take(r, axis=0, out=t, mode="clip")
                m *= t
            z += flat.take(r * CLASSES + y)
        return z - np.log(m @ self.grown[0])


def initial(v: Vocabulary) -> np.ndarray:
    """Every class at its share of the training tokens, whatever the context."""
    table = np.zeros((ROWS, CLASSES), np.float32)
    table[0] = np.log((v.class_total + 1) / (v.class_total.sum() + CLASSES))
    return table


def _train(batches: Iterator[pa.RecordBatch], table: np.ndarray, v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """One record: the task's change of the weights times each row's tokens, these tokens, and how often each hot context has each class and group."""
    first, table = table, table.copy()
    power, seen, hot = np.full(table.shape, 1.0, np.float32), np.zeros(ROWS), np.zeros(len(v.hot.table) * CLASSES * GROUPS)
    for batch in batches:
        for _, h, kind, one, features in (x for *_, parts in runs(as_binary(batch.column(0))) for x in _read(parts)):
            y, at = v.classes(h, kind), v.hot.of(one)
            often = np.flatnonzero(at >= 0)
            hot += np.bincount((at[often] * CLASSES + y[often]) * GROUPS + group_of(h[often]), minlength=len(hot))
            for a in range(0, len(y), BATCH):
                rows = tuple(f[a : a + BATCH] for f in features)
                g = softmax(table, rows)
                g[np.arange(len(g)), y[a : a + BATCH]] -= 1
                g = by_column(g)
                seen[0] += g.shape[1]
                _step(table, power, slice(0, 1), g.sum(axis=1)[None].astype(np.float32))
                for k, r in enumerate(rows):
                    _descend(table, power, seen, r, slice(1 + k * BUCKETS, 1 + (k + 1) * BUCKETS), g)
    change = (table - first) * seen[:, None]
    yield pa.RecordBatch.from_pydict({"change": [change.astype(np.float32).tobytes()], "seen": [seen.tobytes()], "hot": [hot.tobytes()]})
    del change, table, power
    trim()


def by_column(g: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(g.T, dtype=np.float64)


def _descend(table: np.ndarray, power: np.ndarray, seen: np.ndarray, rows: np.ndarray, part: slice, g: np.ndarray) -> None:
    """A step along the tokens' gradients g, a token a column, summed by row; rows: all within part."""
    low, width = rows - part.start, part.stop - part.start
    seen[part] += np.bincount(low, minlength=width)
    sums = np.empty((width, len(g)), np.float32)
    for k, x in enumerate(g):
        sums[:, k] = np.bincount(low, x, width)
    _step(table, power, part, sums)


def _step(table: np.ndarray, power: np.ndarray, part: slice, g: np.ndarray) -> None:
    """Rows without a gradient stay as they are."""
    power, table = power[part], table[part]
    power += g * g
    g *= np.float32(RATE)
    g /= np.sqrt(power)
    table -= g


def _add(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def train(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """texts: (text), all of which each round goes over. The weights, and for each hot context and class a row with each group's count.

    Updates meet in a tree of sums, one table comes to the driver.
    """
    sc, table, hot = texts.sparkSession.sparkContext, initial(v), np.zeros((len(v.hot.table) * CLASSES, GROUPS))
    if not v.total:
        return table, hot
    for _ in range(rounds):
        shared = sc.broadcast((table, v))
        made = texts.mapInArrow(lambda x, s=shared: _train(x, *s.value), "change binary, seen binary, hot binary")
        triples = made.rdd.map(lambda r: (np.frombuffer(r[0], np.float32).reshape(ROWS, CLASSES), np.frombuffer(r[1]), np.frombuffer(r[2])))
        change, seen, hot = triples.treeReduce(_add, depth=depth(triples))
        table = table + (change / np.maximum(seen, 1)[:, None]).astype(np.float32)
    return table, hot.reshape(-1, GROUPS)


def depth(tables: RDD) -> int:
    """Each level of a tree of sums brings at most about eight tables together."""
    return max(2, math.ceil(math.log(max(tables.getNumPartitions(), 2), 8)))


# -- scoring: blocks of documents send their tokens out by context, and get their sums back ------------

#: What a message holds: documents with what is known at once, tokens by context, rare words; and the answers to the two latter.
DOCS, PAIRS, WORDS, PAIR_SUMS, WORD_SUMS = range(5)
NAMES, MESSAGE = ["shard", "block", "kind", "data"], "shard long, block long, kind int, data binary"
LEARN = np.uint16(1 << 15)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, their bytes of equal place together, compressed; the first one is sorted and kept as steps."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in (first, *columns[1:])]
    data = b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    n, at, out = size // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        wide = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(t).ravel())
        at += n * wide
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


PAIR_TYPES, WORD_TYPES, SUM_TYPES, COUNT_TYPES = ("<u8", "<u4", "<u4", "<u2", "<u2"), ("<u8", "<u2"), ("<u2", "<f4"), ("<u2", "<u4", "<f8")
DOC_TYPES = ("<i8", "<i8", "<i8", "<i8", "<f8", "<f8")

Message = tuple[int, int, int, bytes]


class Block:
    """A run of documents whose sums come back together, and their tokens by context and by word that are still to be sent."""

    def __init__(self, name: int, shards: int, hot: Places):
        self.name, self.shards, self.hot = name, shards, hot
        self.docs, self.pairs, self.words, self.size, self.held, self.n = [], [], [], 0, 0, 0

    def add(self, doc: np.ndarray, one: np.ndarray, skip: np.ndarray, y: np.ndarray, h: np.ndarray, level: np.ndarray) -> None:
        """doc: the documents' places in the block, marked where they are learned from; skip: the hashed words before the last ones, needed in classes of endings."""
        group = (finish(one) & ~np.uint64(15)) | y.astype(np.uint64)
        word = (finish(h + np.uint64(11)) >> np.uint64(32) << np.uint64(GROUP_BITS)).astype(np.uint32) | group_of(h).astype(np.uint32)
        self.pairs.append((group, word, (level + 1).astype(np.uint32), np.where(y < OWN, 0, skip & (SKIPS - 1)).astype(np.uint16), doc, self.hot.of(one) >= 0))
        rare = level < 0
        self.words.append((h[rare], doc[rare]))
        self.size += len(h)
        self.held += len(h)

    def send(self) -> Iterator[Message]:
        """What is held: a message a shard for tokens by context, and one for rare words."""
        if self.held:
            group, word, level, skip, doc, often = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            mixed = np.where(often, finish(group ^ (word.astype(np.uint64) << np.uint64(20))), finish(group))
            yield from self._dealt(PAIRS, mixed, group, word, level, skip, doc)
            h, doc = (np.concatenate(x) for x in zip(*self.words, strict=True))
            yield from self._dealt(WORDS, finish(h), h, doc)
        self.pairs, self.words, self.held = [], [], 0

    def end(self) -> Iterator[Message]:
        yield from self.send()
        if self.docs:
            at = int(self._shard(finish(np.array([self.name], np.uint64)))[0])
            yield at, self.name, DOCS, packed(*(np.concatenate(x) for x in zip(*self.docs, strict=True)))

    def _shard(self, mixed: np.ndarray) -> np.ndarray:
        return ((mixed >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def _dealt(self, kind: int, mixed: np.ndarray, key: np.ndarray, *rest: np.ndarray) -> Iterator[Message]:
        shard = self._shard(mixed).astype(np.uint16 if self.shards <= 1 << 16 else np.uint32)
        order = stable_order(key)
        order = order.take(np.argsort(shard.take(order), kind="stable"))
        shard, columns = shard.take(order), [x.take(order) for x in (key, *rest)]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))[: len(shard)].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=False):
            yield int(shard[a]), self.name, kind, packed(*(c[a:b] for c in columns))


def _batches(messages: Iterator[Message], most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for m in messages:
        held.append(m)
        size += len(m[3])
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(messages: list[Message]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*messages, strict=True), types, strict=True)], NAMES)


def _ask(batches: Iterator[pa.RecordBatch], table: np.ndarray, v: Vocabulary, shards: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, learn, text) -> messages: of each block its tokens by context and class, its rare words, and its documents."""
    name, log_level, classes = TaskContext.get().partitionId() << 32, np.log10(v.levels), Settled(table)

    def messages() -> Iterator[Message]:
        block = Block(name, shards, v.hot)
        for batch in batches:
            ids, learn = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, parts in runs(as_binary(batch.column(2)), most=BLOCK_DOCS - 1):
                if block.n + b - a >= BLOCK_DOCS or block.size >= BLOCK:
                    yield from block.end()
                    block = Block(block.name + 1, shards, v.hot)
                size, known, total, rest = (np.zeros(b - a) for _ in range(4))
                for doc, h, kind, one, features in _read(parts):
                    y = v.classes(h, kind)
                    for s in range(0, len(y), BATCH):
                        part = slice(s, s + BATCH)
                        rest += np.bincount(doc[part], classes.of(tuple(f[part] for f in features), y[part]), b - a)
                    level = v.level_of(h)
                    often = level >= 0
                    size += np.bincount(doc, minlength=b - a)
                    known += np.bincount(doc[often], v.levels[level[often]] > 1, b - a)
                    total += np.bincount(doc[often], log_level[level[often]], b - a)
                    block.add((doc + block.n).astype(np.uint16) | np.where(learn[a + doc], LEARN, np.uint16(0)), one, features[1] - 1 - BUCKETS, y, h, level)
                    if block.held >= BLOCK:  # amid a long text too
                        yield from block.send()
                none = ids[a:b].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                block.docs.append((np.arange(block.n, block.n + b - a), ids[a:b].fill_null(0).to_numpy(), none, size.astype(np.int64) << 32 | known.astype(np.int64), total, rest / np.log(10)))
                block.n += b - a
        yield from block.end()

    yield from _batches(messages())
    trim()


@dataclass
class Tally:
    """Tokens by context and class, and what is counted of them; all of a context's and class' tokens are here, or, of hot contexts, all of a pair's."""

    group: np.ndarray  # of the distinct contexts and classes
    at: np.ndarray  # each token's among them
    order: np.ndarray  # of the tokens by context and class
    place: np.ndarray  # the row of each hot one among the hot ones, else -1
    mu: np.ndarray
    times: np.ndarray
    n: np.ndarray  # of each token its pair's training count
    share: np.ndarray
    learn: np.ndarray


def tally(group: np.ndarray, word: np.ndarray, level: np.ndarray, learn: np.ndarray, v: Vocabulary, hot: np.ndarray) -> Tally:
    order, distinct, cuts = alike(group)
    at = spread(order, cuts, np.arange(len(cuts)))
    times = np.bincount(at, learn, len(distinct))
    keys = ((finish(v.hot.table) & ~np.uint64(15))[:, None] | np.arange(CLASSES, dtype=np.uint64)).ravel()
    by_key = np.argsort(keys)
    known = Places(keys[by_key]).of(distinct)
    place = np.where(known >= 0, by_key[known], -1)
    times[known >= 0] = hot.sum(axis=1)[place[known >= 0]]
    pair = word.astype(np.uint64)
    pair *= np.uint64(0x100000001)
    pair ^= group
    by_pair, _, cuts = alike(finish(pair))
    n = spread(by_pair, cuts, np.add.reduceat(learn.take(by_pair), cuts, dtype=float))
    del pair, by_pair
    share = v.shares((group & np.uint64(15)).astype(np.int64), level)
    return Tally(distinct, at, order, place, MU * np.maximum(times, 1) ** POWER, times, n, share, learn)


@dataclass
class Within:
    """What is trained within classes: rows of weights by group for the skip and the two words before, and the pairs' weights of hot contexts."""

    table: np.ndarray
    seen: np.ndarray  # of each hot context and class, by group, the share of words that were seen there
    scale: np.ndarray  # and what was added to these words' weights


def unlearned(v: Vocabulary) -> Within:
    hot = np.zeros((len(v.hot.table) * CLASSES, GROUPS))
    return Within(np.zeros((2 * ENDINGS * SKIPS, GROUPS), np.float32), hot, hot)


def masses(n: np.ndarray, seen: np.ndarray, scale: np.ndarray, share: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """A context's sums, by group, of exp(weights) times share and mu: seen words with theirs, all others with none."""
    return np.exp(scale) * (n + mu[:, None] * seen) + mu[:, None] * np.maximum(share - seen, 0)


def stepped(scale: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A gradient step of the pairs' weights; expected: by group, a seen word's expected count over its own, before its weight's change.

    A pair's gradient is its count, with mu's part, less its expected count. Each
    step is divided by that count, so a context's seen words of a group move alike
    and one number holds for them.
    """
    return scale + np.clip(1 - np.exp(scale) * expected, -1, 1)


#: Sums of the hashed features' weights beyond +-30 are cut off.
FAR = 30


class Chunk:
    """Tokens of some contexts and classes, in their order, and the sums that normalise them."""

    def __init__(self, t: Tally, tokens: np.ndarray, word: np.ndarray, skip: np.ndarray, v: Vocabulary, hot: np.ndarray, w: Within):
        self.tokens, self.learn = tokens, t.learn[tokens]
        ids = t.at[tokens]
        new = np.diff(ids, prepend=-1) != 0
        ids, self.at = ids[new], np.cumsum(new) - 1
        self.place, self.mu = t.place[ids], t.mu[ids]
        y = (t.group[ids] & np.uint64(15)).astype(np.int64)
        self.group = (word[tokens] & np.uint32(GROUPS - 1)).astype(np.int64)
        cell, shape = self.at * GROUPS + self.group, (len(ids), GROUPS)
        n, share = t.n[tokens], t.share[tokens]
        n_of = np.bincount(cell, self.learn, len(ids) * GROUPS).reshape(shape)
        self.here = np.bincount(cell, np.where(self.learn, share / np.maximum(n, 1), 0), len(ids) * GROUPS).reshape(shape)
        seen, self.scale, self.hot = self.here.copy(), np.zeros(shape, np.float32), self.place >= 0
        for x, known in ((n_of, hot), (seen, w.seen), (self.scale, w.scale)):
            x[self.hot] = known[self.place[self.hot]]
        zero, share = np.zeros((1, 1)), v.group_share[y]
        self.rest = masses(zero, seen, zero - np.inf, share, self.mu).astype(np.float32)
        self.own = masses(n_of, seen, zero, seen, self.mu).astype(np.float32)
        # rows of the word before the last one, and of that and the last one together
        base, far = (y - OWN)[self.at] * SKIPS, skip[tokens].astype(np.int64)
        both = finish(t.group[ids][self.at] ^ (far.astype(np.uint64) << np.uint64(20)))
        self.rows = base + far, base + (both & np.uint64(SKIPS - 1)).astype(np.int64) + ENDINGS * SKIPS
        self.pieces = [slice(a, a + CHUNK) for a in range(0, len(tokens), CHUNK)]

    def factors(self, table: np.ndarray, part: slice, grown: np.ndarray | None = None) -> np.ndarray:
        """exp of the hashed features' weights, a token a row and a group a column; grown: the exponentials of the table."""
        one, both = (x[part] for x in self.rows)
        if grown is not None:
            z = grown.take(one, axis=0)
            z *= grown.take(both, axis=0)
            return z
        z = table.take(one, axis=0)
        z += table.take(both, axis=0)
        return np.exp(np.clip(z, -FAR, FAR, out=z), out=z)

    def mass(self) -> np.ndarray:
        """Of each context its groups' sums of exp(weights) times share and mu, by the pairs' weights alone."""
        return np.exp(self.scale) * self.own + self.rest

    def by_context(self, part: slice, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of tokens' rows by context, and which contexts these are."""
        cut = np.flatnonzero(np.diff(self.at[part], prepend=-1))
        return self.at[part][cut], np.add.reduceat(x.view(np.complex64), cut, axis=0).view(np.float32)  # two columns at once

    def settle(self, table: np.ndarray, grown: np.ndarray | None = None) -> np.ndarray:
        """Gradient steps of the pairs' weights from where they are the best without skips; those of hot contexts are trained in rounds. The first piece's factors."""
        first = self.factors(table, self.pieces[0], grown)
        for _ in range(0 if self.hot.all() else STEPS):
            mass = self.mass()
            expected = np.repeat((self.mu / mass.sum(axis=1)).astype(np.float32)[:, None], GROUPS, axis=1)
            for k, part in enumerate(self.pieces):
                f = self.factors(table, part, grown) if k else first
                share = (self.learn[part] / np.einsum("ij,ij->i", f, mass.take(self.at[part], axis=0))).astype(np.float32)
                which, sums = self.by_context(part, f * share[:, None])
                expected[which] += sums
            self.scale[~self.hot] = stepped(self.scale, expected)[~self.hot]
        return first


def _chunks(t: Tally, word: np.ndarray, skip: np.ndarray, v: Vocabulary, hot: np.ndarray, w: Within) -> Iterator[Chunk]:
    """All tokens but those of classes of a single word, whole contexts at once, hot ones last."""
    order = t.order[((t.group & np.uint64(15)) >= OWN)[t.at[t.order]]]
    often = (t.place >= 0)[t.at[order]]
    order = np.concatenate([order[~often], order[often]])
    cuts = np.append(np.flatnonzero(np.diff(t.at[order], prepend=-1)), len(order))
    a = 0
    while a < len(order):
        b = int(cuts[max(np.searchsorted(cuts, a + CHUNK, side="right") - 1, np.searchsorted(cuts, a, side="right"))])
        yield Chunk(t, order[a:b], word, skip, v, hot, w)
        a = b


def _learn(messages: Iterator[Message], w: Within, v: Vocabulary, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """One record: the task's change of the table times each row's tokens, these tokens, and of hot contexts what was seen and expected here."""
    table, power, count = w.table.copy(), np.full(w.table.shape, 1.0, np.float32), np.zeros(len(w.table))
    seen, expected = np.zeros((2, *w.seen.shape), np.float32)
    for _, of in groupby(messages, key=lambda m: m[0]):
        blobs = [unpacked(m[3], *PAIR_TYPES) for m in of if m[2] == PAIRS]
        if not blobs:
            continue
        group, word, level, skip, doc = (np.concatenate(x) for x in zip(*blobs, strict=True))
        del blobs
        keep = (doc & LEARN) > 0
        group, word, level, skip = group[keep], word[keep], level[keep], skip[keep]
        t = tally(group, word, level.astype(np.int64) - 1, np.ones(len(group), bool), v, hot)
        for c in _chunks(t, word, skip, v, hot, w):
            seen[c.place[c.hot]] += c.here[c.hot]
            first = c.settle(table)
            mass = c.mass()
            for k, part in enumerate(c.pieces):
                f = c.factors(table, part) if k else first
                g = f * mass.take(c.at[part], axis=0)
                z = _row_sums(g)[:, None]
                if c.hot.any():
                    which, sums = c.by_context(part, f / z)
                    expected[c.place[which[c.hot[which]]]] += sums[c.hot[which]]
                g /= z
                g[np.arange(len(g)), c.group[part]] -= 1
                g = by_column(g)
                for a, rows in zip((0, ENDINGS * SKIPS), c.rows, strict=True):
                    _descend(table, power, count, rows[part], slice(a, a + ENDINGS * SKIPS), g)
    yield ((table - w.table) * count[:, None]).astype(np.float32), count, seen, expected
    trim()


def train_within(asked: RDD, v: Vocabulary, hot: np.ndarray, rounds: int) -> Within:
    """Rounds of distributed updates of the weights within classes, each over all training tokens; asked: messages, a shard a partition."""
    sc, w = asked.context, unlearned(v)
    tasks = max(sc.defaultParallelism, asked.getNumPartitions() // SHARDS)
    for _ in range(rounds if v.total else 0):
        shared = sc.broadcast((w, v, hot))
        made = asked.coalesce(tasks).mapPartitions(lambda x, s=shared: _learn(x, *s.value))
        change, count, seen, expected = made.treeReduce(_add, depth=depth(made))
        n, y = hot.sum(axis=1), np.tile(np.arange(CLASSES), len(v.hot.table))
        mu = MU * np.maximum(n, 1) ** POWER
        none = mu / masses(hot, seen, w.scale, v.group_share[y], mu).sum(axis=1)
        w = Within(w.table + (change / np.maximum(count, 1)[:, None]).astype(np.float32), seen, np.where((y >= OWN)[:, None], stepped(w.scale, expected + none[:, None]), 0))
    return w


def pair_scores(group: np.ndarray, word: np.ndarray, level: np.ndarray, skip: np.ndarray, learn: np.ndarray, v: Vocabulary, hot: np.ndarray, w: Within | None) -> np.ndarray:
    """log10 P(word | class, words before) of tokens; without trained weights, by the pairs' alone."""
    t = tally(group, word, level, learn, v, hot)
    out = np.empty(len(group))
    plain = np.arange(len(group)) if w is None else np.flatnonzero((group & np.uint64(15)) < OWN)  # by the pairs' weights alone
    at = t.at[plain]
    out[plain] = np.log10((t.n[plain] + t.mu[at] * t.share[plain]) / (t.times + t.mu)[at])
    if w is None:
        return out
    far = sum(float(np.abs(x).max()) for x in np.split(w.table, 2))
    grown = np.exp(w.table) if far <= FAR else None  # else sums may have to be cut off
    for c in _chunks(t, word, skip, v, hot, w):
        first = c.settle(w.table, grown)
        mass, up = c.mass(), np.exp(c.scale)
        for j, part in enumerate(c.pieces):
            k, at, g = c.tokens[part], c.at[part], c.group[part]
            f = c.factors(w.table, part, grown) if j else first
            n = t.n[k]
            own = (n + c.mu[at] * t.share[k]) * np.where(n > 0, up[at, g], 1) * f[np.arange(len(f)), g]
            out[k] = np.log10(own / np.einsum("ij,ij->i", f, mass.take(at, axis=0)))
    return out


def _by_blob(blob: np.ndarray, doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sums of values by blob and document; where each blob's begin."""
    order, key, cuts = alike((blob.astype(np.int64) << 16 | doc).view(np.uint64))
    key = key.view(np.int64)
    return (key & 0xFFFF).astype(np.uint16), np.searchsorted(key >> 16, np.arange(int(blob.max(initial=-1)) + 2)), [np.add.reduceat(x.take(order), cuts, dtype=float) for x in values]


def _answer(messages: Iterator[Message], v: Vocabulary, hot: np.ndarray, w: Within | None) -> Iterator[tuple[int, int, bytes]]:
    """Messages -> (block, kind, data): the documents' as they are, and of each block the sums of its tokens' scores and rare words' counts."""
    held: dict[int, list[tuple[int, list[np.ndarray]]]] = {PAIRS: [], WORDS: []}
    for _, block, kind, data in messages:
        if kind == DOCS:
            yield block, kind, data
        else:
            held[kind].append((block, unpacked(data, *(PAIR_TYPES if kind == PAIRS else WORD_TYPES))))
    for kind in (PAIRS, WORDS):
        blobs, held[kind] = held[kind], []
        if not blobs:
            continue
        names, columns = [b for b, _ in blobs], [np.concatenate(x) for x in zip(*(c for _, c in blobs), strict=True)]
        blob = np.repeat(np.arange(len(blobs)), [len(c[0]) for _, c in blobs])
        del blobs
        learn, doc = (columns[-1] & LEARN) > 0, columns[-1] & ~LEARN
        if kind == PAIRS:
            values = [pair_scores(columns[0], columns[1], columns[2].astype(np.int64) - 1, columns[3], learn, v, hot, w)]
        else:
            order, _, cuts = alike(columns[0])
            n = spread(order, cuts, np.add.reduceat(learn.take(order), cuts, dtype=float))
            values = [n > 0, np.log10(n + 1)]
        del columns, learn
        doc, cuts, sums = _by_blob(blob, doc, *values)
        del blob, values
        types = SUM_TYPES if kind == PAIRS else COUNT_TYPES
        for name, a, b in zip(names, cuts, cuts[1:], strict=False):
            yield name, PAIR_SUMS if kind == PAIRS else WORD_SUMS, packed(doc[a:b], *(x[a:b].astype(t) for x, t in zip(sums, types[1:], strict=True)))
    trim()


SCORED = "doc_id long, n_tokens long, n_known long, base double, score double"


def _merge(batches: Iterator[pa.RecordBatch], norm: float) -> Iterator[pa.RecordBatch]:
    """A block's messages after each other, its documents first -> a row a document."""
    names, block, docs, sums = [x.split()[0] for x in SCORED.split(", ")], None, None, []

    def out() -> pa.RecordBatch:
        _, ids, none, sizes, total, rest = docs
        known, more, model = sums
        size = sizes >> 32
        arrays = [pa.array(ids, mask=none > 0), pa.array(size), pa.array((sizes & 0xFFFFFFFF) + known.astype(np.int64)), pa.array(total + more - size * norm), pa.array(rest + model)]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for name, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != block:
                if docs is not None:
                    yield out()
                block, docs = name, unpacked(data, *DOC_TYPES)
                sums = [np.zeros(len(docs[0])) for _ in range(3)]
            elif kind == PAIR_SUMS:
                doc, value = unpacked(data, *SUM_TYPES)
                sums[2][doc] += value
            else:
                doc, known, value = unpacked(data, *COUNT_TYPES)
                sums[0][doc] += known
                sums[1][doc] += value
    if docs is not None:
        yield out()


def lm_scores(docs: DataFrame, may: Column, id_col: str = "doc_id", text_col: str = "text", within: int = 0) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    may, a condition on doc_id, says which documents are learned from; all of
    those are counted and trained on. Words are compared by 64-bit hashes. A
    null, empty or blank text is the end token alone. Without training documents
    the base gives probability one and the model equal classes. Rows that repeat
    a doc_id are scored each; a null doc_id stays null; other columns play no
    part. within: rounds of training within classes; without any, the pairs'
    weights stay where they start and skips have none. A long text is read in parts, its tokens are sent a block at a time.
    docs must give its rows in the same order if read again, as tables do. No
    rows in, no rows out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce(may, F.lit(False)).alias("learn"), "text")
    counts = rows.select("learn", "text").mapInArrow(_count, "word long, kind int, n long, m long")
    counts = materialize(counts.groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    v = vocabulary(counts)
    table, hot = train(rows.where("learn").select("text"), v)
    width = shuffle_width(docs, v.all_tokens, ANSWERED)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((table, v))
    norm = float(np.log10(v.total + v.distinct + 1))
    # an RDD, as its shuffle is then read by every round and by the answers, and written once
    asked = rows.mapInArrow(lambda x: _ask(x, *shared.value, width), MESSAGE).repartitionById(width, F.col("shard").cast("int")).rdd.map(tuple)
    trained = spark.sparkContext.broadcast((v, hot, train_within(asked, v, hot, within) if within else None))
    answered = spark.createDataFrame(asked.mapPartitions(lambda x: _answer(x, *trained.value)), "block long, kind int, data binary", verifySchema=False)
    scored = answered.repartition(width, "block").sortWithinPartitions("block", "kind").mapInArrow(lambda x: _merge(x, norm), SCORED)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
