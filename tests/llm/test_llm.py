"""The text operators against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import os
import random
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from gatelens.llm import bytebpe, graph, maxent, media, packing, records, rules, simhash, subwords, textkit, toxicity, urls, wordids
from gatelens.llm import queries as llm_queries
from gatelens.llm.common import fresh_path, id_fold
from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the dark green forest tonight."),
    (2, "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest tonight."),
    (3, "Something else entirely: numbers 12 345, symbols #$%, and a few more words to be read here."),
    (4, ""), (5, None), (6, "  \n\t "), (7, "one"), (8, "two words"), (9, "é ß 中文 Ünïcödé Α\u0301 naïve <|endoftext|> don't, can't."),
    (10, "repeat " * 400), (3, "Something else entirely: numbers 12 345, symbols #$%, and a few more words to be read here."),
    (None, "no id at all, but a text with some words in it"), (11, "x" * 5000), (12, "a line\na line\n\nb line\na line\n"),
]


@pytest.fixture
def docs(spark):
    """With columns whose names clash with those that the operators make."""
    rows = [(i, t, "s", 1, "x", 0.5, "g", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score int, fp string, label double, rows string, word int").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i > 5)) for i in range(1, 12)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")


def small_corpus(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(80)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(n)]


# -- text kit and graph ------------------------------------------------------------


def test_words_and_hashes_are_those_of_plain_splitting():
    texts = [(t or "").encode() for _, t in TEXTS]
    column = pa.array(texts, pa.large_binary())
    got, hashes = [], {}
    for a, _, buf, offs in textkit.slices(column, 64):
        start, end, doc = textkit.words(buf, offs)
        h = textkit.span_hash(textkit.prefix_sums(buf), start, end)
        for s, e, k, x in zip(start, end, doc, h, strict=True):
            got.append((a + int(k), buf[s:e].tobytes()))
            assert hashes.setdefault(got[-1][1], x) == x
    assert got == [(k, w) for k, t in enumerate(texts) for w in t.split()]
    assert len(set(hashes.values())) == len(hashes)


def test_components(spark):
    edges = [(1, 2), (3, 2), (5, 6), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (2, 1)]
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(2, 1), (3, 1), (6, 5), (9, 8), (10, 8), (11, 8), (12, 8)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {(r.node, r.root) for r in graph.connected_components(chain).collect()} == {(i, 0) for i in range(1, 101)}


def test_components_have_one_root_a_node(spark):
    """After one round of this chain no parent is a child, yet node 3 has two parents."""
    chain = spark.createDataFrame([(2, 5), (5, 4), (4, 3), (3, 1)], "a long, b long")
    assert sorted((r.node, r.root) for r in graph.connected_components(chain).collect()) == [(i, 1) for i in (2, 3, 4, 5)]


# -- 1 near-duplicates -------------------------------------------------------------


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= budget:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return Counter((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp, strict=True))


def test_simhash_equals_brute_force(docs):
    got = simhash.simhash_components(docs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == brute_components(TEXTS, 4)


def test_simhash_of_nothing(empty):
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def near_fingerprints(n=400, seed=3):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    while len(out) < n:
        x = r.choice(base)
        for _ in range(r.randint(1, 7)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("max_group", "budget"), [(10**6, 4), (4, 4), (4, 2)])
def test_trie_join_loses_no_link(spark, max_group, budget):
    """With a small max_group nodes are cut once more, or several times."""
    fps = near_fingerprints()
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.links(df, budget, max_group).collect()
    forest = simhash.Forest(len(fps))
    at = {x - (1 << 64) if x >> 63 else x: k for k, x in enumerate(fps)}
    forest.union(np.array([at[e.a] for e in edges], int), np.array([at[e.b] for e in edges], int))
    want = simhash.Forest(len(fps))
    a = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= budget)
    want.union(i, j)
    assert (forest.root == want.root).all()
    assert all((fps[at[e.a]] ^ fps[at[e.b]]).bit_count() >= 1 for e in edges)


def test_one_of_each_component_stays(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 7, 8, 9, 10, 11, 12)] + [(True, None)]


def test_rows_that_repeat_an_id_are_told_apart_by_their_texts(spark, monkeypatch):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, b), (7, b), (7, a), (7, a), (None, c), (None, c), (None, a), (None, "d")]
    for hot in (1024, 2):  # also where equal rows count as hot
        monkeypatch.setattr(simhash, "HOT", hot)
        for seed in range(3):
            random.Random(seed).shuffle(rows)
            kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
            assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(3, b), (7, a), (0, c), (0, "d")])


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    """Whole results don't depend on where long texts are cut."""
    r = random.Random(8)
    texts = ["".join(r.choice(["Ab", "c", "déf", ".", " ", " ", "\n", "x" * 70]) for _ in range(n)) for n in (0, 5, 400, 3000)]
    whole = pa.array([t.encode() for t in texts], pa.large_binary())
    for limit in (16, 50, 300):
        parts = [[p for p in textkit.parts_of(t.encode(), limit)] for t in texts]
        assert [b"".join(p) for p in parts] == [t.encode() for t in texts]
        assert [[w for p in ps for w in p.split()] for ps in parts] == [t.encode().split() for t in texts]
        monkeypatch.setattr(simhash, "parts_of", lambda t, n=limit: textkit.parts_of(t, n))
        assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]
        monkeypatch.setattr(wordids, "PART", limit)
        coder = wordids.WordEncoder()
        assert [x.tolist() for x in coder.encode([t.encode() for t in texts], 7)] == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
        for read in (subwords.features, lambda parts: (toxicity.markers_of(b, o) for b, o, _ in parts)):
            for a, b, parts in textkit.runs(whole, limit):
                got = Counter(x for doc, row in read(parts) for x in zip(doc.tolist(), row.tolist(), strict=True))
                doc, row = next(iter(read(iter([(*next(textkit.slices(whole[a:b], 1 << 30))[2:], True)]))))
                assert got == Counter(zip(doc.tolist(), row.tolist(), strict=True))
        data = np.frombuffer(b"".join(t.encode() for t in texts), np.uint8)
        assert media.marks_of(data, limit) == media.marks_of(data)
        for a, b, parts in textkit.runs(whole, limit):
            got = list(maxent._read(parts))
            want = list(maxent._read(iter([(*next(textkit.slices(whole[a:b], 1 << 30))[2:], True)])))[0]
            assert all((np.concatenate([g[k] for g in got]) == want[k]).all() for k in range(4))
            assert all((np.concatenate([g[4][k] for g in got]) == want[4][k]).all() for k in range(3))


# -- 2 media -----------------------------------------------------------------------


def test_media_round_trip(spark, docs, empty):
    shared = "".join(random.Random(5).choice("abc defg\n") for _ in range(9000))
    rows = TEXTS + [(20, shared), (21, shared), (22, "prefix " + shared), (23, shared + " suffix")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = media.media(df).collect()
    want = []
    for i, t in rows:
        text = (t or "").encode()
        payload = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        want.append((i, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + media.HEAD))
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in got) == Counter(want)
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.media(empty).count() == 0


def test_chunks_cut_by_content():
    data = random.Random(1).randbytes(200_000)
    assert b"".join(media.cut(data)) == data
    assert all(media.LEAST <= len(c) <= media.MOST for c in media.cut(data)[:-1])
    shifted = set(map(media.digest, media.cut(b"some bytes before" + data)))
    common = [c for c in media.cut(data) if media.digest(c) in shifted]
    assert sum(map(len, common)) > 0.95 * len(data)
    h = media.gear(np.frombuffer(data, np.uint8))
    assert int(h[100]) == sum(int(media.GEAR[data[100 - k]]) << k for k in range(32)) % (1 << 32)


def test_a_changed_chunk_is_noticed(spark):
    rows = spark.createDataFrame([(bytearray(hashlib.sha256(b"other").digest()), [bytearray(media.stored_of(b"text"))])], "whole binary, chunks array<binary>")
    with pytest.raises(Exception, match="isn't the stored one"):
        media.read_features(rows).collect()


# -- 3 urls ------------------------------------------------------------------------


def test_url_rules_and_sql(spark, oracle, rows, tmp_path):
    shutil.copytree(SMALL, tmp_path / "t", copy_function=shutil.copyfile)
    odd = [
        (1, "http://a.example.net/en/1", "blo"), (2, "https://Example.NET/en/x?y#z", None), (3, "http://net", None), (4, "http://net/", None),
        (5, "//no.scheme/x", None), (6, None, None), (7, "", None), (8, "http://x.example.com/de/1?q=/fr/", None), (9, "http://xexample.com/de/1", None),
        (10, "http://a.org/fr/1/2/3/4/5", None), (11, "http://a.org/FR/1", None), (12, "a://b://c.net/d", None), (4, "http://net/", None), (None, "http://b.com/p/1", None),
        *((100 + i, f"http://h{i % 2}.com/{'shop' if i % 3 else 'blog'}/{i}/item{i}.html", None) for i in range(40)), *((200 + i, f"http://h0.com/de/{i}", None) for i in range(9)),
        *((300 + i, f"http://k.example.com/{'de' if i % 2 else 'en'}/{i}", None) for i in range(30)),
    ]
    df = spark.createDataFrame(odd, "page_id long, url string, host string")
    df.drop("host").toPandas().astype({"page_id": "Int64"}).to_parquet(tmp_path / "t" / "pages.parquet")
    got = urls.url_filter(df)
    assert rows(got) == oracle(urls.sql(), str(tmp_path / "t"))
    by = {r.page_id: r for r in got.collect()}
    assert [(by[k].host, by[k].path, by[k].rule, by[k].verdict) for k in (1, 2, 4, 8, 10, 12)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/en/x", "example.net/en/", "allow"), ("net", "/", "net/", "block"),
        ("x.example.com", "/de/1", "example.com/de/", "block"), ("a.org", "/fr/1/2/3/4/5", "org/fr/", "allow"), ("b:", "//c.net/d", None, by[12].verdict),
    ]
    assert (by[3].host, by[3].path, by[3].rule) == ("net", "", None) and (by[6].host, by[6].path) == ("", "") and by[9].rule is None and by[11].rule is None
    assert urls.url_filter(df.limit(0)).count() == 0


def test_templates_learn_from_given_labels(spark):
    rows = [(i, f"http://h.com/{'spam' if i % 2 else 'ham'}/{i}", i % 2 if i < 60 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = urls.url_filter(df, rules=(), bad=F.col("bad")).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") and r.rule is None for r in got)


def test_templates_see_every_segment(spark):
    rows = [(i, f"http://h.com/2024/05/12/{'casino' if i % 2 else 'news'}/{i}", i % 2 if i < 60 else None) for i in range(100)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules=(), bad=F.col("bad")).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)
    assert {r.template for r in got} == {"/*/*/*/casino/*", "/*/*/*/news/*"}


# -- 4, 7 classifiers --------------------------------------------------------------


def labelled(spark, n=400, seed=2):
    r = random.Random(seed)
    good = ["river", "stone", "walking", "gentle", "morning", "reading"]
    rows, marks = [], []
    for i in range(n):
        bad, toxic = r.random() < 0.4, r.random() < 0.3
        w = [r.choice(good) + str(r.randint(0, 9)) for _ in range(r.randint(5, 40))]
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["Wretchling", "bogfiend,", "slimeoaf"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_quality_on_held_out_rows(spark):
    docs, labels, marks = labelled(spark)
    may = id_fold(F.col("doc_id"), 5) != 0
    got = {r.doc_id: r for r in subwords.quality_scores(docs, labels, may).collect()}
    held = [(i, q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.97
    # held-out labels are no input: other ones give the same scores
    flipped = labels.withColumn("quality", F.when(may, F.col("quality")).otherwise(1 - F.col("quality")))
    again = {r.doc_id: r.score for r in subwords.quality_scores(docs, flipped, may).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = subwords.keep_good(docs, labels, may)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, marks = labelled(spark)
    may = id_fold(F.col("doc_id"), 5) != 0
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, may).collect()}
    held = [(i, t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == t for i, t in held]) > 0.97
    kept = toxicity.keep_clean(docs, labels, may)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs, labels, _ = labelled(spark)
    may = F.lit(True)
    assert subwords.labelled_sample(docs, labels, "doc_id", "text", "quality", may, 50).count() <= 50
    assert subwords.labelled_sample(docs, labels, "doc_id", "text", "quality", may, 10**6).count() == 400
    bags = subwords.labelled_sample(docs, labels, "doc_id", "text", "quality", may, 400).withColumn("rows", F.col("text"))
    got = subwords.collected(bags, F.length("rows"), 5000)
    assert 0 < sum(len(t) for t in got.column("rows").to_pylist()) <= 5000
    assert subwords.collected(bags, F.length("rows"), 10**9).num_rows == 400


def test_chain_feeds_earlier_categories_to_later_ones():
    chain = toxicity.Chain([(k % 2, np.array([7, 9 + k % 2])) for k in range(40)])
    assert [len(w) for w in chain.weights] == [len(chain.weights[0]) + k for k in range(3)]


def test_every_marker_over_the_bar_is_kept():
    """900 features are in ten toxic documents each, and in no other one."""
    sets = [(1, np.arange(k // 10 * 100, k // 10 * 100 + 100, dtype="<u4")) for k in range(90)] + [(0, np.array([5000 + k], "<u4")) for k in range(90)]
    chain = toxicity.Chain(sets)
    assert (chain.column[:900] >= 0).all() and (chain.column[900:] < 0).all()
    key = chain.hits(np.zeros(100, np.int64), np.arange(800, 900))
    assert chain.probabilities(key, 1)[0, -1] > 0.5


def test_classifiers_on_odd_rows(docs, labels, empty, spark):
    may = F.col("doc_id") > 0
    for run in (lambda d, m: subwords.quality_scores(d, m, may), lambda d, m: toxicity.toxicity(d, m, may)):
        got = run(docs, labels).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1  # nothing to go by
        assert len({r.score for r in got if r.doc_id == 3}) == 1
        assert run(empty, labels).count() == 0
        assert len({round(r.score, 9) for r in run(docs, labels.limit(0)).collect()}) == 1
    assert subwords.keep_good(docs, labels, may).columns == docs.columns
    assert toxicity.keep_clean(docs, labels, may).schema == docs.schema


# -- 5 packing ---------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice((10, 30, 64, 2048))
    counts = Counter(r.randint(1, capacity) for _ in range(r.randint(0, 80)))
    bins, seen = {}, Counter()
    for length, a, b, first, per, base in packing.place(dict(counts), capacity):
        assert a == seen[length]
        seen[length] = b
        for k in range(b - a):
            bins.setdefault(first + k // per, []).append((base + k % per * length, length))
    assert +seen == +counts and sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in held) <= 2
    if bins:  # first-fit decreasing is no better
        free = []
        for x in sorted(counts.elements(), reverse=True):
            k = next((k for k, f in enumerate(free) if f >= x), None)
            if k is None:
                free.append(capacity - x)
            else:
                free[k] -= x
        assert len(bins) <= len(free) + 1


def test_packing_rows(docs, empty):
    tokenizer = wordids.word_encoder().tokenizer
    got = packing.pack(docs, capacity=64, with_ids=True).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[s : s + 64], "<u4").tobytes()
            want[(i, k, s, len(part) // 4, zlib.crc32(part), part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty).count() == 0


def test_word_cache_gives_the_tokenizers_ids():
    coder = wordids.WordEncoder()
    r = random.Random(1)
    parts = ["a", "B", "é", "ß", "e\u0301", "\u0301", "'s", "'", "’", ",", ".", ",,", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "1", "23", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u3000", "中", "İ", "ΑΣ", "ﬁ", "\x00", "-", "ing", "the", "%%%", "word!!"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    got = [x.tolist() for x in coder.encode([t.encode() for t in texts])]
    assert got == [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]


# -- 6 records ---------------------------------------------------------------------


def test_records(spark, docs, empty):
    tokenizer = wordids.word_encoder().tokenizer
    path = fresh_path(spark, "test")
    files = records.write_records(docs, path)
    got = records.read_records(spark, path).collect()
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    one = records.pick_record(path, next(f["file"] for f in files if f["records"]), 0)
    assert one[0] is None and len(one[1]) == want[0][2]
    with pytest.raises(ValueError, match="no such"):
        records.pick_record(path, files[0]["file"], 10**6)
    assert records.token_records(empty).count() == 0


def test_damage_is_noticed():
    import io

    data = records.frame(7, np.arange(5, dtype="<u2"))
    back = records.unframe(io.BytesIO(data).read)
    assert back[0] == 7 and back[1].tolist() == [0, 1, 2, 3, 4]
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.unframe(io.BytesIO(bytes(bad)).read)


# -- 8 language model --------------------------------------------------------------


def test_lm_base_is_exact_and_the_model_is_a_distribution(spark, docs, empty):
    import math

    for rows, may in ((small_corpus(), id_fold(F.col("doc_id"), 7) != 2), (TEXTS, F.coalesce(F.col("doc_id"), F.lit(0)) != 2)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        learned = [r for r in rows if (zlib.crc32(str(r[0]).encode()) % 7 != 2 if rows is not TEXTS else r[0] != 2)]
        tok = lambda t: [*(t or "").encode().lower().split(), None]
        c = Counter(w for _, t in learned for w in tok(t))
        total, distinct = sum(c.values()), len(c)
        want = Counter((i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tok(t)), 6)) for i, t in rows)
        got = maxent.lm_scores(df, may).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert maxent.lm_scores(empty, F.lit(True)).count() == 0
    assert len(maxent.lm_scores(docs, F.lit(False)).collect()) == len(TEXTS)


def lm_rows(df, may):
    return sorted(map(tuple, maxent.lm_scores(df, may).collect()))


def assert_lm_rows(got, want, columns=6):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4:columns] for r in got] == [pytest.approx(r[4:columns], abs=1e-3) for r in want]


def test_lm_score_by_brute_force(spark, monkeypatch):
    """Base and model by dictionaries, word by word, whatever the sizes of blocks, hot contexts and messages."""
    rows = [*small_corpus(4), (900, "zz yy"), (901, ""), (901, ""), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    may = id_fold(F.col("doc_id"), 7) != 2
    kept = {}
    train, vocabulary = maxent.train, maxent.vocabulary
    monkeypatch.setattr(maxent, "train", lambda *a: kept.setdefault("t", train(*a)))
    monkeypatch.setattr(maxent, "vocabulary", lambda c: kept.setdefault("v", vocabulary(c)))
    got = maxent.lm_scores(df, may).collect()
    (table, _), v = kept["t"], kept["v"]

    def read(t):  # words, classes, words before and the classes' log probabilities, of one text
        (_, _, parts), = textkit.runs(pa.array([(t or "").encode()], pa.large_binary()))
        (_, h, kind, one, features), = maxent._read(parts)
        return h.tolist(), v.classes(h, kind).tolist(), one.tolist(), maxent.log_softmax(table, features)

    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    word, kind, pair, group = Counter(), {}, Counter(), Counter()
    for t in learned:
        for h, y, one, _ in zip(*read(t), strict=True):
            word[h] += 1
            kind[h] = y
            pair[one, h] += 1
            group[one, y] += 1
    size = Counter()
    for h, n in word.items():
        size[kind[h]] += n + 1
    want = []
    for i, t in rows:
        score = 0.0
        for h, y, one, z in zip(*read(t), strict=True):
            n = group[one, y]
            mu = maxent.MU * max(n, 1) ** maxent.POWER
            score += z[y] / np.log(10) + np.log10((pair[one, h] + mu * (word[h] + 1) / (size[y] + 1)) / (n + mu))
        want.append((i, float(score)))
    assert sorted(i for i, _ in want) == sorted(r.doc_id for r in got)
    assert [x for _, x in sorted(want)] == pytest.approx([r.score for r in sorted(got, key=lambda r: (r.doc_id, r.score))], abs=2e-4)
    # a context's words, one unknown one among them, sum to one over all classes
    _, _, ones, z = read(learned[0])
    for one, logs in list(zip(ones, z, strict=True))[:9]:
        total = 0.0
        for y in range(maxent.CLASSES):
            n = group[one, y]
            mu = maxent.MU * max(n, 1) ** maxent.POWER
            of = [h for h in word if kind[h] == y]
            total += np.exp(logs[y]) * (sum(pair[one, h] + mu * (word[h] + 1) / (size[y] + 1) for h in of) + mu / (size[y] + 1)) / (n + mu)
        assert abs(total - 1) < 1e-4
    monkeypatch.setattr(maxent, "vocabulary", vocabulary)
    monkeypatch.setattr(maxent, "train", train)
    want = lm_rows(df, may)
    for name, value in (("HOT", 10), ("HOT", 10**6), ("BLOCK", 50), ("BLOCK_DOCS", 5), ("ANSWERED", 40)):
        monkeypatch.setattr(maxent, name, value)
        assert_lm_rows(lm_rows(df, may), want)
    monkeypatch.setattr(maxent, "FREQUENT", 3)  # shares of rare words become their mean, the base stays
    assert_lm_rows(lm_rows(df, may), want, 5)


def kept_lm(monkeypatch, df, may, within):
    """Rows, and the vocabulary, counts of hot contexts and weights that they come from."""
    kept = {}
    with monkeypatch.context() as m:
        for name in ("vocabulary", "train", "train_within"):
            m.setattr(maxent, name, lambda *a, k=name, f=getattr(maxent, name): kept.setdefault(k, f(*a)))
        got = maxent.lm_scores(df, may, within=within).collect()
    return got, kept["vocabulary"], *kept["train"], kept["train_within"]


def lm_tokens(t, v):
    """Word, class, word before, rows within the class and classes' log probabilities of each of a text's tokens."""
    (_, _, parts), = textkit.runs(pa.array([(t or "").encode()], pa.large_binary()))
    (_, h, kind, one, features), = maxent._read(parts)
    y = v.classes(h, kind)
    skip = (features[1] - 1 - maxent.BUCKETS) % maxent.SKIPS
    group = (textkit.finish(one) & ~np.uint64(15)) | y.astype(np.uint64)
    both = (textkit.finish(group ^ (skip.astype(np.uint64) << np.uint64(20))) % np.uint64(maxent.SKIPS)).astype(int)
    return h, y, one, skip, both, features


@pytest.mark.parametrize("hot", [1, 1024])
def test_lm_trained_within_classes_by_brute_force(spark, monkeypatch, hot):
    """Scores word by word from the trained weights; a context's words, an unknown one of each group among them, sum to one."""
    rows = [*small_corpus(4), (900, "zz yy"), (901, ""), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(maxent, "HOT", hot)
    got, v, table, counts, w = kept_lm(monkeypatch, df, id_fold(F.col("doc_id"), 7) != 2, 3)
    assert np.abs(w.table).max() > 0.1 and np.abs(w.scale).max() > 0.01 and (len(v.hot.table) == 1 if hot == 1 else len(v.hot.table) >= v.distinct)
    of = {i: lm_tokens(t, v) for i, t in rows}
    learned = [of[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    word, kind, pair = Counter(), {}, Counter()
    tokens_of = {}
    for h, y, one, skip, both, _ in learned:
        for x in zip(h.tolist(), y.tolist(), one.tolist(), skip.tolist(), both.tolist()):
            word[x[0]] += 1
            kind[x[0]] = x[1]
            pair[x[2], x[0]] += 1
            tokens_of.setdefault((x[2], x[1]), []).append(x)
    size = Counter()
    for h, n in word.items():
        size[kind[h]] += n + 1
    share = lambda h, y: (word[h] + 1) / (size[y] + 1)
    g_of = lambda h: h >> (64 - maxent.GROUP_BITS)

    def factors(y, skip, both):
        base = (y - maxent.OWN) * maxent.SKIPS
        return np.exp((w.table[base + skip] + w.table[maxent.ENDINGS * maxent.SKIPS + base + both]).astype(float))

    held = {}

    def context(one, y):  # the words' masses, those of unknown words a group, and the scale of seen ones
        if (one, y) in held:
            return held[one, y]
        n = len(tokens_of.get((one, y), ()))
        mu = maxent.MU * max(n, 1) ** maxent.POWER
        words_of = [h for h in word if kind[h] == y]
        unknown = mu / (size[y] + 1) / maxent.GROUPS
        at = np.flatnonzero(v.hot.table == np.uint64(one))

        def masses(scale):
            return {h: (pair[one, h] + mu * share(h, y)) * (np.exp(scale[g_of(h)]) if pair[one, h] else 1) for h in words_of}

        def by_group(m):
            return np.bincount([g_of(h) for h in words_of], [m[h] for h in words_of], maxent.GROUPS) + unknown

        scale = np.zeros(maxent.GROUPS)
        if len(at):
            scale = w.scale[at[0] * maxent.CLASSES + y]
        elif y >= maxent.OWN:
            for _ in range(maxent.STEPS):
                m = by_group(masses(scale))
                expected = mu / m.sum() + sum((f / (f @ m) for f in (factors(y, *x[3:]) for x in tokens_of.get((one, y), ()))), np.zeros(maxent.GROUPS))
                scale = scale + np.clip(1 - np.exp(scale) * expected, -1, 1)
        held[one, y] = masses(scale), by_group(masses(scale)), mu
        return held[one, y]

    def inside(h, one, y, skip, both):
        m, total, mu = context(one, y)
        f = factors(y, skip, both) if y >= maxent.OWN else np.ones(maxent.GROUPS)
        return m.get(h, mu / (size[y] + 1)) * f[g_of(h)] / (f @ total)

    want = []
    for i, _ in rows:
        h, y, one, skip, both, features = of[i]
        z = maxent.log_softmax(table, features)
        want.append((i, sum(float(z[k][y[k]]) / np.log(10) + np.log10(inside(int(h[k]), int(one[k]), int(y[k]), skip[k], both[k])) for k in range(len(h)))))
    assert [x for _, x in sorted(want)] == pytest.approx([r.score for r in sorted(got, key=lambda r: r.doc_id)], abs=1e-3)
    h, _, one, skip, _, _ = learned[0]
    for k in range(9):
        for y in range(maxent.OWN, maxent.CLASSES):
            both = (textkit.finish(((textkit.finish(one[k : k + 1]) & ~np.uint64(15)) | np.uint64(y)) ^ (skip[k : k + 1].astype(np.uint64) << np.uint64(20))) % np.uint64(maxent.SKIPS)).astype(int)[0]
            m, total, mu = context(int(one[k]), y)
            f = factors(y, skip[k], both)
            unknown = mu / (size[y] + 1) / maxent.GROUPS * f.sum() / (f @ total)
            assert abs(sum(inside(x, int(one[k]), y, skip[k], both) for x in m) + unknown - 1) < 1e-6


def test_lm_steps_within_classes_follow_the_gradient(spark, monkeypatch):
    """One step from no weights, against differences of the training tokens' log-likelihood."""
    rows = small_corpus(7, 40)
    _, v, _, counts, _ = kept_lm(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), 1)
    assert len(v.hot.table) >= v.distinct  # all contexts, whose pairs' weights stay as they are within a round
    block = maxent.Block(0, 1, v.hot)
    for _, t in rows:
        h, y, one, skip, _, _ = lm_tokens(t, v)
        block.add(np.full(len(h), maxent.LEARN), one, skip, y, h, v.level_of(h))
    messages = [m for m in block.send() if m[2] == maxent.PAIRS]
    first = maxent.unlearned(v)
    (change, count, seen, expected), = maxent._learn(iter(messages), first, v, counts)
    group, word, level, skip, _ = maxent.unpacked(messages[0][3], *maxent.PAIR_TYPES)
    learn = np.ones(len(group), bool)

    def likelihood(w):
        return maxent.pair_scores(group, word, level.astype(int) - 1, skip, learn, v, counts, w).sum() * np.log(10)

    assert likelihood(first) == pytest.approx(likelihood(None), rel=1e-6)
    step = change / np.maximum(count, 1)[:, None]
    slope = step / np.sqrt(np.maximum(maxent.RATE**2 - step**2, 1e-12))
    for row in np.flatnonzero(count)[:: max(1, int((count > 0).sum()) // 12)]:
        for g in (0, 5, 11):
            up, down = (maxent.Within(first.table.copy(), first.seen, first.scale) for _ in range(2))
            up.table[row, g] += 0.05
            down.table[row, g] -= 0.05
            assert slope[row, g] == pytest.approx((likelihood(up) - likelihood(down)) / 0.1, abs=0.01)
    n = np.maximum(counts.sum(axis=1), 1)[:, None]  # without skips, pairs stand at their best: no step
    met = (counts.sum(axis=1) > 0) & (np.arange(len(counts)) % maxent.CLASSES >= maxent.OWN)
    none = maxent.MU * n**maxent.POWER / (n + maxent.MU * n**maxent.POWER)
    assert np.abs(maxent.stepped(np.zeros_like(expected), expected + none)[met]).max() < 1e-3


def test_lm_skips_tell_words_of_a_class_apart(spark):
    """Forty words of one ending after the same word: only the word before that one says which."""
    r = random.Random(3)
    name = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    rows = [(i, " ".join(f"{name[k]} mid {name[40 + (k + (i >= 1000)) % 40]}ing" for k in (r.randrange(40) for _ in range(20)))) for i in (*range(300), *range(1000, 1060))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    may = (F.col("doc_id") < 1000) & (F.col("doc_id") % 5 != 2)
    gain = {}
    for within in (0, 6):
        of = {q.doc_id: q.score / 20 for q in maxent.lm_scores(df, may, within=within).collect()}
        right, wrong = [x for i, x in of.items() if i < 1000 and i % 5 == 2], [x for i, x in of.items() if i >= 1000]
        gain[within] = np.mean(right), np.mean(right) - np.mean(wrong)
    assert gain[6][0] > gain[0][0] + 0.2 and gain[6][1] > gain[0][1] + 0.4


def test_lm_within_classes_without_rows_or_training(spark, docs, empty):
    assert maxent.lm_scores(empty, F.lit(True), within=1).count() == 0
    for may in (F.lit(False), F.col("doc_id") == 2, F.lit(True)):
        got = maxent.lm_scores(docs, may, within=1).collect()
        assert len(got) == len(TEXTS) and all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_op8_trains_within_classes(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(maxent, "train_within", lambda *a, f=maxent.train_within: rounds.append(a[3]) or f(*a))
    assert llm_queries.op8_lm(spark, SMALL).count() == len(spark.read.parquet(SMALL + "/documents.parquet").collect()) and rounds[0] > 0


def test_lm_places():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        table = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        x = np.concatenate([table, r.integers(0, 1 << 63, 100).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        where = {v: k for k, v in enumerate(table.tolist())}
        assert maxent.Places(table).of(x).tolist() == [where.get(v, -1) for v in x.tolist()]


def test_lm_orders_are_stable():
    r = np.random.default_rng(4)
    hashes = r.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2)
    for n in (0, 1, 2, 5000):
        near = (np.uint64(1 << 63) + r.integers(0, 300, n).astype(np.uint64) * np.uint64(16)) | r.integers(0, 16, n).astype(np.uint64)  # alike but for bits that places take
        for x in (hashes[r.integers(0, 40, n)] & ~np.uint64(15) | r.integers(0, 16, n).astype(np.uint64), r.integers(0, 99, n).astype(np.uint64), near, np.full(n, 2**64 - 1, np.uint64)):
            assert (maxent.stable_order(x) == np.argsort(x, kind="stable")).all()
            order, distinct, cuts = maxent.alike(x)
            values, at, counts = np.unique(x, return_inverse=True, return_counts=True)
            assert (distinct == values).all() and (np.diff(cuts, append=n) == counts).all()
            assert (maxent.spread(order, cuts, counts) == counts[at]).all()


@pytest.mark.parametrize("scale", [1, 30])
def test_lm_settled_classes(scale):
    """Products of exponentials, and sums that have to be cut off, give what the softmax gives."""
    r = np.random.default_rng(6)
    table = (r.normal(size=(maxent.ROWS, maxent.CLASSES)) * scale).astype(np.float32)
    rows, y = tuple(r.integers(1 + k * maxent.BUCKETS, 1 + (k + 1) * maxent.BUCKETS, 500) for k in range(3)), r.integers(0, maxent.CLASSES, 500)
    settled = maxent.Settled(table)
    assert (settled.grown is None) == (scale > 1)
    assert settled.of(rows, y) == pytest.approx(maxent.log_softmax(table, rows)[np.arange(500), y], abs=1e-4)
    assert maxent.softmax(table, rows) == pytest.approx(np.exp(maxent.log_softmax(table, rows)), abs=1e-5)


def test_lm_weights_are_looked_up_once_a_token(monkeypatch):
    """Steps of the pairs' weights and the scores after them share their look-ups; with weights so large that sums are cut off, too."""
    r = np.random.default_rng(8)
    n, none = 3000, np.zeros(maxent.CLASSES)
    v = maxent.Vocabulary(n, 50, n, np.zeros(0, np.uint64), np.zeros(0, np.int64), none, none + 100, none + 2, np.full((maxent.CLASSES, maxent.GROUPS), 1 / maxent.GROUPS), maxent.Places(np.zeros(0, np.uint64)), np.zeros(0, np.int64), np.zeros(0), maxent.Places(np.array([maxent.START])))
    group = np.sort(r.integers(0, 1 << 40, 60).astype(np.uint64)[r.integers(0, 60, n)] << np.uint64(4) | r.integers(maxent.OWN, maxent.CLASSES, n).astype(np.uint64))
    word, skip, level, learn = r.integers(0, 50, n).astype(np.uint32), r.integers(0, maxent.SKIPS, n).astype(np.uint16), np.full(n, -1), r.random(n) < 0.8
    monkeypatch.setattr(maxent, "CHUNK", 400)
    looked, factors = [], maxent.Chunk.factors
    monkeypatch.setattr(maxent.Chunk, "factors", lambda self, table, part, *a: looked.append(len(self.tokens[part])) or factors(self, table, part, *a))
    w = maxent.unlearned(v)
    hot = np.zeros((maxent.CLASSES, maxent.GROUPS))
    w.table[:] = r.normal(size=w.table.shape) / 4
    got = {}
    for far in (maxent.FAR, 0.0):
        monkeypatch.setattr(maxent, "FAR", far)
        got[far] = maxent.pair_scores(group, word, level, skip, learn, v, hot, w)
        assert sum(looked) == n
        looked.clear()
    w.table[:] = 0
    monkeypatch.setattr(maxent, "FAR", 30)
    assert got[0.0] == pytest.approx(maxent.pair_scores(group, word, level, skip, learn, v, hot, w), abs=1e-5)
    assert np.abs(got[30] - got[0.0]).max() > 0.01


def test_lm_messages_come_back_whole():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        columns = np.sort(r.integers(0, 1 << 63, n).astype(np.uint64)), *(r.integers(0, 1 << 16, n).astype(t) for t in maxent.PAIR_TYPES[1:])
        assert all((a == b).all() for a, b in zip(columns, maxent.unpacked(maxent.packed(*columns), *maxent.PAIR_TYPES), strict=True))


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows = tuple(rng.integers(1 + k * maxent.BUCKETS, 1 + (k + 1) * maxent.BUCKETS, 50) for k in range(3))
    assert np.allclose(np.exp(maxent.log_softmax(table, rows)).sum(axis=1), 1, atol=1e-4)


def test_lm_gains_a_tenth_over_its_base_on_held_out_texts(spark):
    got = llm_queries.op8_lm(spark, SMALL.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[2] > 40_000 and got[0] > 0.9 * got[1]


def test_lm_learns_context(spark):
    rows = [(i, " ".join(["alpha beta gamma delta"] * 20)) for i in range(40)]
    got = maxent.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), id_fold(F.col("doc_id"), 7) != 2).collect()
    assert all(r.score > r.base_score / 2 for r in got)


# -- 9 rules -----------------------------------------------------------------------


def brute_rules(text):
    w = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_rules_equal_brute_force(spark, docs, empty):
    r = random.Random(6)
    rows = list(TEXTS)
    for i in range(60):
        w = [r.choice("abcd") for _ in range(r.randint(0, 120))]
        rows.append((100 + i, "".join(x + r.choice([" ", " ", " ", "\n", "\t ", "\r\n", "\x1c", "\u3000"]) for x in w)))
    rows += [(200, " ".join(str(k) for k in range(8))), (201, " ".join(["p q r s t u v w"] * 2)), (202, "w " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rules.quality_rules(df).collect()
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == Counter((i, *brute_rules(t)) for i, t in rows)
    assert not any(x.kept and x.base_failed for x in got)
    assert len(rules.quality_rules(docs).collect()) == len(TEXTS)
    assert rules.quality_rules(empty).count() == 0


def test_the_cascade_goes_by_rejections_per_cost_and_keeps_the_verdict(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (i % 50) + "$" * (i % 7)) for i in range(200)], "doc_id long, text string")
    f = rules.features(df, "text")
    # what is measured: rejections are exact, and a rule that searches long texts forty times costs more than one that compares a number
    searches = " + ".join(f"regexp_count(text, '(w|o|r|d|{k})+x')" for k in range(40))
    some = (rules.Rule("slow", f"{searches} > -1 and n_words < 40"), rules.Rule("fast", "n_words < 20"), rules.Rule("never", "n_words < 0"), rules.Rule("more", "n_words < 30"))
    long = rules.features(df.selectExpr("doc_id", "repeat(text, 20) as text"), "text")
    measured = rules.costs(long, some)
    assert measured["slow"][0] > 2 * measured["fast"][0] and measured["never"][1] == 0
    n = [i % 50 + (i % 7 > 0) for i in range(200)]
    share = lambda least: sum(x < least for x in n) / 200
    assert {k: v[1] for k, v in rules.costs(f, some, 1).items()} == {"slow": share(40), "fast": share(20), "never": 0.0, "more": share(30)}
    # what is made of it
    monkeypatch.setattr(rules, "costs", lambda *_: {"slow": (1e-4, 0.8), "fast": (1e-6, 0.4), "never": (1e-6, 0.0), "more": (1e-6, 0.6)})
    assert [x.name for x in rules.order_rules(f, some)] == ["more", "fast", "slow", "never"]
    monkeypatch.undo()
    order = rules.order_rules(f, rules.BASE + rules.RULES)
    assert {x.name for x in order} == {x.name for x in rules.BASE + rules.RULES}
    a, b = (f.select(rules.cascade(list(o)).alias("k")).where("k").count() for o in (order, order[::-1]))
    assert a == b


# -- 10 byte-level BPE -------------------------------------------------------------


def test_byte_bpe(spark, docs, empty):
    one = bytebpe.coder().library.encode_ordinary
    for options in ({}, {"chunk": 40, "overlap": 8, "spread": 100}):
        got = bytebpe.byte_bpe(docs, with_ids=True, **options).collect()
        want = Counter()
        for i, t in TEXTS:
            ids = one(t or "")
            want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert bytebpe.byte_bpe(empty).count() == 0


def test_chunks_are_stitched_where_they_agree():
    one = bytebpe.coder().library.encode_ordinary
    r = random.Random(1)
    parts = ["\x1c", "\x1f", "\u0558", "\u208f", "\U00011de0", "\u0b72", "a", "B", "é", "'s", "'", "re", "'r", "'ll", ",", "...", " ", "  ", "\n", "\n\n", "\t", " \n", "12", "中", "ing", " the", "\u0301", "  x"]
    for _ in range(600):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 300)))
        ids = bytebpe.encode(text, r.randint(3, 60), r.randint(2, 12))
        assert ids == one(text) and bytebpe.decode(ids) == text.encode()


# -- registered queries ------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query(spark, oracle, rows, name):
    assert rows(llm_queries.queries()[name](spark, SMALL)) == oracle(llm_queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def small(spark):
    return sorted(map(tuple, spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text").collect()))


def token_ids(t, end):
    return [*wordids.word_encoder().tokenizer.encode(t or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_on_a_whole_table(spark, small):
    got = llm_queries.op1_simhash(spark, SMALL).collect()
    components = brute_small(small)
    assert Counter(map(tuple, got)) == Counter((i, f"{brute_fingerprint(t):016x}", c) for (i, t), (_, _, c) in zip(small, components, strict=True))


def test_op2_on_a_whole_table(spark, small):
    want = Counter()
    for i, t in small:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = llm_queries.op2_media(spark, SMALL).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(r.media_bytes == r.payload_bytes + media.HEAD for r in got) and len({r.media_sha256 for r in got}) == len({t or "" for _, t in small})


def test_op5_on_a_whole_table(spark, small):
    want, lengths = Counter(), []
    for i, t in small:
        ids = token_ids(t, 0)
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])] += 1
            lengths.append(len(ids[a : a + 2048]))
    got = llm_queries.op5_packing(spark, SMALL).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048
    assert len(held) <= -(-sum(lengths) // 2048) + 2


def test_op6_on_a_whole_table(spark, small):
    want, start = [], 0
    for i, t in small:
        ids = token_ids(t, 2)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, llm_queries.op6_records(spark, SMALL).collect())) == want


def test_op10_on_a_whole_table(spark, small):
    one, want = bytebpe.coder().library.encode_ordinary, []
    for i, t in small:
        ids = one(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, llm_queries.op10_byte_bpe(spark, SMALL).collect())) == want


def test_op4_and_op7_tell_held_out_rows(spark):
    """At the size where every word has been seen: nearly all labels of rows that were never learned from."""
    folder = SMALL.replace("0.001", "0.1")
    labels = {r.doc_id: r for r in spark.read.parquet(folder + "/labels.parquet").collect()}
    for run, label, least in ((llm_queries.op4_toxicity, "toxic", 0.98), (llm_queries.op7_quality, "quality", 0.99)):
        got = [r for r in run(spark, folder).where("held_out").collect() if r.doc_id in labels]
        assert len(got) > 700 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in got]) >= least
        assert all(r.predicted == (r.score >= (0.3 if label == "quality" else 0.5)) for r in got)


def test_op8_base_on_a_whole_table(spark, small):
    import math

    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in small if zlib.crc32(str(i).encode()) % 7 != 2 for w in tok(t))
    total, distinct = sum(c.values()), len(c)
    want = [(i, zlib.crc32(str(i).encode()) % 7 == 2, len(tok(t)), sum(c[w] > 0 for w in tok(t)), total) for i, t in small]
    got = sorted(map(tuple, llm_queries.op8_lm(spark, SMALL).collect()))
    assert [r[:5] for r in got] == want
    assert [r[5] for r in got] == pytest.approx([sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tok(t)) for _, t in small], rel=1e-9)


# -- scores by plain loops ----------------------------------------------------------


def one_hash(word):
    buf = np.frombuffer(word, np.uint8)
    return textkit.span_hash(textkit.prefix_sums(buf), np.array([0]), np.array([len(buf)]))


def test_quality_score_by_plain_features():
    """Words, pairs and n-grams of characters one by one, each row's margin added up."""
    r = np.random.default_rng(5)
    margin, bias = r.normal(size=subwords.ROWS).astype(np.float32), 0.2
    shift = np.uint64(64 - subwords.BITS)
    for text in ("the the cat,\tsat\x0b on a måt 中文字 x", "", "  ", "a", "ab cd", "é\n\nü ü"):
        rows, words = [], text.encode().split()
        for w in words:
            rows.append(int(one_hash(w)[0] >> shift))
        for a, b in zip(words, words[1:], strict=False):
            both = np.zeros(1, np.uint64) if a == b else one_hash(b) * np.uint64(3) + one_hash(a)
            rows.append(int(textkit.finish(both)[0] >> shift) + (1 << subwords.BITS))
        blank = lambda c: c in " \t\n\x0b\x0c\r"
        for n in subwords.GRAMS:
            for k in range(len(text) - n + 1):
                gram = text[k : k + n]
                if not any(map(blank, gram[1:-1])):
                    h = one_hash("".join(" " if blank(c) else c for c in gram).encode()) + np.uint64(n)
                    rows.append(int(textkit.finish(h)[0] >> shift) + (2 << subwords.BITS))
        got = [x for *_, parts in textkit.runs(pa.array([text.encode()], pa.large_binary())) for _, x in subwords.features(parts)]
        assert Counter(np.concatenate(got).tolist()) == Counter(rows)
        want = 1 / (1 + np.exp(-(sum(float(margin[k]) for k in rows) / max(len(rows), 1)) - bias))

        class Session:
            sparkContext = type("C", (), {"broadcast": staticmethod(lambda x: type("B", (), {"value": x}))})

        run = subwords.scorer(type("D", (), {"sparkSession": Session}), (margin, bias))
        (_, _, [p]), = run(pa.array([text]))
        assert p[0].as_py() == pytest.approx(want, abs=1e-6)


def test_chain_probabilities_by_plain_loops():
    rng = random.Random(1)
    sets = [(int(k % 3 == 0), np.array(sorted(rng.sample(range(40), 8) + [50 + k % 3, 60 + (k % 3) * (k % 5)]), "<u4")) for k in range(120)]
    sets = [(y, np.unique(x)) for y, x in sets]
    chain = toxicity.Chain(sets)
    for _, x in sets[:20]:
        earlier = []
        for w in chain.weights:
            columns = [chain.column[v] for v in x if chain.column[v] >= 0]
            z = sum(w[c] for c in columns) + w[-1] + sum(a * b for a, b in zip(earlier, w[len(w) - 1 - len(earlier) : -1], strict=True))
            earlier.append(1 / (1 + np.exp(-z)))
        got = chain.probabilities(chain.hits(np.zeros(len(x), np.int64), x), 1)[0]
        assert got.tolist() == pytest.approx(earlier)


def test_out_of_fold_probabilities_know_nothing_of_their_fold():
    """Labels of one fold, all turned round, change that fold's own probabilities in no way."""
    rng = random.Random(2)
    sets = [(k % 2, np.unique(np.array(rng.sample(range(30), 6) + [40 + k % 2 * (k % 7 > 0)], "<u4"))) for k in range(150)]
    whole = toxicity.Chain(sets)
    turned = toxicity.Chain([(1 - y if k % toxicity.FOLDS == 0 else y, x) for k, (y, x) in enumerate(sets)])
    assert np.allclose(whole.outside[:: toxicity.FOLDS, 0], turned.outside[:: toxicity.FOLDS, 0])
    assert not np.allclose(whole.outside[1 :: toxicity.FOLDS, 0], turned.outside[1 :: toxicity.FOLDS, 0])


def test_paths_that_nothing_shares_end_at_once(spark, monkeypatch):
    """The same templates as by going through every level, by brute force over the shapes."""
    r = random.Random(9)
    rows = [(i, "http://" + r.choice(["a.com", "b.org"]) + "".join("/" + r.choice(["x", "y", "zz", str(r.randint(1, 3))]) for _ in range(r.randint(0, 5))), r.choice([0, 1, None])) for i in range(160)]
    got = {x.page_id: x.template for x in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, bad int"), rules=(), bad=F.col("bad")).collect()}
    shapes = {i: (u.split("/")[2], ["*" if x.isdigit() else x for x in u.split("/")[3:]]) for i, u, _ in rows}
    template = dict.fromkeys(shapes, "")
    for d in range(5):
        nodes = {}
        for i, (host, shape) in shapes.items():
            if len(shape) > d:
                nodes.setdefault((host, template[i]), {}).setdefault(shape[d], []).append(i)
        for (_, before), children in nodes.items():
            some = {}
            for seg, ids in children.items():
                labels = [b for i, _, b in rows if i in set(ids) and b is not None]
                if len(ids) < 2 or not labels:
                    for i in ids:
                        template[i] = before + "/" + (seg if len(ids) >= 2 else "*")
                else:
                    some.setdefault(sum(labels) / len(labels), []).append((seg, ids, sum(labels), len(labels)))
            branch, last = [], None
            for share in sorted(some):
                bad, n = sum(x[2] for x in some[share]), sum(x[3] for x in some[share])
                if last:
                    p, diff = (bad + last[0]) / (n + last[1]), bad / n - last[0] / last[1]
                    if diff * diff > 4 * p * (1 - p) * (1 / n + 1 / last[1]):
                        branch.append([])
                else:
                    branch.append([])
                branch[-1] += some[share]
                last = bad, n
            for group in branch:
                segs = sorted(x[0] for x in group)
                name = segs[0] if len(segs) == 1 else f"{segs[0]}..{segs[-1]}|{len(segs)}"
                for _, ids, _, _ in group:
                    for i in ids:
                        template[i] = before + "/" + name
    assert got == template


def test_very_long_urls_and_texts(spark):
    path = "/".join(f"seg{k}x" for k in range(300))
    rows = [(1, f"http://a.com/{path}?q"), (2, "http://a.com/" + "y" * 200_000), (3, "http://a.com/" + "y" * 200_000)]
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1].path == "/" + path and got[1].template == "/*" * 300 and got[2].template == got[3].template == "/" + "y" * 200_000
    r = random.Random(3)
    text = " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(60_000)) + "\n" + "z" * 300_000 + "\n" + "z" * 300_000
    (x,) = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_rules(text)


# -- the pipeline --------------------------------------------------------------------


def brute_pipeline(spark, docs, labels):
    """The stages on rows (doc_id, text, others): scores by the operators, everything else by plain Python."""
    import corpus_pipeline

    may = corpus_pipeline.learnable()
    scores = Counter(r.doc_id for r in subwords.quality_scores(docs, labels, may).collect() if r.predicted)
    assert Counter(r.doc_id for r in subwords.keep_good(docs, labels, may).collect()) == scores
    first = subwords.keep_good(docs, labels, may)
    left = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in toxicity.keep_clean(first, labels, may).collect())
    kept, want = {}, Counter()
    for ((none, i), t), (_, _, c) in zip(left, brute_small([(k, t) for k, (_, t) in enumerate(left)]), strict=True):
        kept.setdefault(c, []).append((none, i, t))
    for group in kept.values():
        least = min(group)[:2]
        same = {t for *key, t in group if tuple(key) == least}
        want[least, frozenset(same)] += 1
    return want


def piece_rows(i, t):
    n = len(token_ids(t, 0))
    return [(i, k, min(2048, n - s)) for k, s in enumerate(range(0, n, 2048))]


def run_pipeline(spark, folder):
    import corpus_pipeline

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    got = corpus_pipeline.run(spark, str(folder))
    left = {x for x in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before if "gatelens" in x}
    assert len(left) == 1 and "stage3" in left.pop()
    return Counter((r.doc_id, r.piece, r.length) for r in got.collect())


def assert_pipeline(spark, folder):
    from gatelens.llm.common import table

    want = brute_pipeline(spark, table(spark, str(folder), "documents"), table(spark, str(folder), "labels"))
    got = run_pipeline(spark, folder)
    for (none, i), texts in want.elements():
        # of rows that share the least id of a component, one stays; which one goes by a hash
        options = [Counter(piece_rows(None if none else i, t)) for t in texts]
        took = next((o for o in options if not o - got), None)
        assert took is not None
        got -= took
    assert not got


def test_pipeline_equals_its_stages_by_brute_force(spark):
    assert_pipeline(spark, SMALL)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated ids, equal rows, empty and long texts, and columns named as the stages' own."""
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["river", "stone", "walking", "gentle", "morning", "reading"]) + str(r.randint(0, 9)) for _ in range(40))
    rows, marks = [], []
    for i in range(120):
        t = good()
        bad, toxic = i % 4 == 1, i % 6 == 3
        t = t.upper() if bad else t
        t = t + " wretchling bogfiend" if toxic else t
        rows.append((i, t))
        marks.append((i, int(not bad), int(toxic)))
    odd = [(7, good()), (7, good()), (7, rows[8][1]), (8, rows[8][1]), (None, good()), (None, rows[10][1]), (None, None), (200, None), (201, ""), (202, " \n"), (203, " ".join(good() for _ in range(300))), (10, rows[10][1])]
    names = "lang string, source string, n_chars long, score double, label int, rows string, fp string, h string, size long, none string, id string, root string, least long, row long, learn boolean"
    extra = [("de", None, 1, 0.5, 1, "x", None, "h", 2, None, "i", "r", None, 3, True), (None,) * 15]
    both = [(i, t, *extra[k % 2]) for k, (i, t) in enumerate(rows + odd)]
    spark.createDataFrame(both, f"doc_id long, text string, {names}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    marks += [(None, 1, 0), (5, None, None), (6, 0, None), (999, 1, 1), (7, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert_pipeline(spark, tmp_path)
    for name in ("quality", "toxic", "near_duplicates"):
        import corpus_pipeline

        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert getattr(corpus_pipeline, name)(spark, docs, str(tmp_path)).schema == docs.schema


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert not run_pipeline(spark, tmp_path)


def brute_small(rows):
    fps = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    forest = simhash.Forest(len(rows))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    forest.union(i, j)
    return [(i, None, rows[k][0]) for (i, _), k in zip(rows, forest.root, strict=True)]
