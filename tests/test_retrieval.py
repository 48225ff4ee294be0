import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seekmill.operators import dedup, hot, index, lexicon, search, suggest
from seekmill.sources.shared import shared_folder

DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry durian apple"), (4, "fig")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def built(spark, docs):
    counts = index.term_counts(index.terms(frame(spark, docs)))
    return index.tfidf(counts, len(docs)), index.document_frequencies(counts)


def ask(spark, docs, query, **k):
    idx, freq = built(spark, docs)
    terms = index.terms(frame(spark, [(0, query)]))
    vector = search.query_vector(terms, freq, len(docs))
    return {r["doc_id"]: r["sparse_score"] for r in search.sparse_search(idx, vector, **k).collect()}


def test_weights_of_the_worked_example(spark):
    got = {(r["doc_id"], r["term"]): r["weight"] for r in built(spark, DOCS)[0].collect()}
    assert got == pytest.approx({(1, "apple"): 0.894427, (1, "banana"): 0.447214, (2, "banana"): 0.707107, (2, "cherry"): 0.707107, (3, "apple"): 0.357936, (3, "cherry"): 0.357936, (3, "durian"): 0.862418, (4, "fig"): 1.0}, abs=1e-6)


def test_sparse_scores(spark):
    assert ask(spark, DOCS, "apple banana") == pytest.approx({1: 0.948683}, abs=1e-6)
    assert ask(spark, DOCS, "Apple zzz") == pytest.approx({1: 0.181738, 3: 0.072729}, abs=1e-6)
    assert ask(spark, DOCS, "apple apple fig") == {}
    assert ask(spark, DOCS, "zzz") == {} and ask(spark, DOCS, "") == {}
    assert ask(spark, DOCS, "apple zzz", strict=True) == {}
    assert set(ask(spark, DOCS, "apple", k=1)) == {1} and ask(spark, DOCS, "apple", k=0) == {}


def test_zero_norms(spark):
    assert ask(spark, DOCS[:3], "apple") == {}
    idx, _ = built(spark, DOCS[:3])
    assert {r["weight"] for r in idx.where("doc_id = 2").collect()} == {0.0}
    assert ask(spark, [(1, "one")], "one") == {1: pytest.approx(1.0)}


def test_statistics(spark):
    counts = index.term_counts(index.terms(frame(spark, DOCS), spark.createDataFrame([("fig",)], "word string")))
    assert {(r["doc_id"], r["total"]) for r in index.document_lengths(counts).collect()} == {(1, 3), (2, 2), (3, 3)}
    assert {r["tf"] for r in index.term_frequencies(counts).where("doc_id = 1").collect()} == {2 / 3, 1 / 3}
    lists = {r["term"]: [p["doc_id"] for p in r["postings"]] for r in index.postings(index.tfidf(counts, 4)).collect()}
    assert lists == {"apple": [1, 3], "banana": [1, 2], "cherry": [2, 3], "durian": [3]}


def test_dense_ties_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    best = search.dense_search(v, [1.0, 0.0], 3)
    assert [(r["vec_id"], r["score"]) for r in best.collect()] == [(2, 1.0), (1, 1.0), (3, 0.0)]
    sparse = spark.createDataFrame([(1, 0.5), (9, 0.8)], "doc_id long, sparse_score double")
    got = [tuple(r) for r in search.fuse(sparse, best).collect()]
    assert got == [(1, 0.5, 1.0, 0.75), (2, 0.0, 1.0, 0.5), (9, 0.8, 0.0, 0.4), (3, 0.0, 0.5, 0.25)]
    assert [tuple(r) for r in search.fuse(sparse, None, 1).collect()] == [(9, 0.8, 0.0, 0.8)]
    docs = spark.createDataFrame([(9, "t")], "doc_id long, title string")
    assert {tuple(r) for r in search.with_documents(search.fuse(sparse, None), docs).select("doc_id", "title").collect()} == {(9, "t"), (1, "")}


def test_dictionaries(spark):
    texts = spark.createDataFrame([("The cat, the CAT dog",), ("增长 GDP增长 ，",), (None,)], "text string")
    en = lexicon.english_dictionary(texts, spark.createDataFrame([("dog",)], "word string"))
    assert [tuple(r) for r in lexicon.sorted_dictionary(en).collect()] == [("cat", 2), ("the", 2), ("gdp", 1)]
    cn = {r["word"]: r["freq"] for r in lexicon.chinese_dictionary(texts).collect()}
    assert cn["增"] == 2 and cn["GDP"] == 1 and "，" not in cn
    lists = {r["ch"]: r["words"] for r in lexicon.character_lists(en).collect()}
    assert lists["t"] == ["cat", "the"] and lists["g"] == ["gdp"]


WORDS = [("en", "cat", 5), ("en", "car", 5), ("en", "care", 9), ("en", "dog", 2), ("cn", "cat", 50), ("en", "ca", 1), ("en", "bat", 7)]


def test_suggestions(spark):
    d = spark.createDataFrame(WORDS, "lang string, word string, freq long")
    assert [tuple(r) for r in suggest.by_prefix(d, "ca", 3).collect()] == [("care", 9), ("car", 5), ("cat", 5)]
    assert suggest.by_prefix(d, "CA").collect() == []
    assert [tuple(r) for r in suggest.corrections(d, "cat", 4).collect()] == [("cat", 50, 0), ("cat", 5, 0), ("bat", 7, 1), ("car", 5, 1)]
    near = [(w, f, sum(a != b for a, b in zip(w, "cat"))) for w, f in (("cat", 5), ("cat", 50), ("bat", 7), ("car", 5))]
    far = [tuple(r) for r in suggest.corrections(d, "cat", 7, "reference").collect()]
    assert far == sorted(far, key=lambda x: (x[2], x[1], x[0]), reverse=True) and set(near) <= set(far)
    got = [(r["word"], r["type"]) for r in suggest.suggest(d, "cat", 3).collect()]
    assert got == [("cat", "prefix")]
    assert suggest.suggest(d, "", 3).collect() == []
    batch = suggest.batch_prefix(d.where("lang = 'en'").select("word", "freq"), spark.createDataFrame([("ca",), ("d",), ("zz",)], "query string"), 2)
    assert {(r["query"], r["word"], r["rank"]) for r in batch.collect()} == {("ca", "care", 1), ("ca", "car", 2), ("d", "dog", 1)}


def greedy(hashes, distance=3):
    kept = []
    for i, h in sorted(hashes):
        if all(bin((h ^ g) & (2**64 - 1)).count("1") > distance for _, g in kept):
            kept.append((i, h))
    return {i for i, _ in kept}


def random_hashes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        h = r.getrandbits(64) if not out or r.random() < 0.3 else r.choice(out)[1]
        for _ in range(r.randrange(3)):
            h ^= 1 << r.randrange(64)
        out.append((i, h & (2**64 - 1)))
    return [(i, h - 2**64 if h >> 63 else h) for i, h in out]


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_near_pairs_and_greedy(spark, blocks):
    hashes = random_hashes(blocks, 150)
    df = spark.createDataFrame(hashes, "doc_id long, h long")
    first = {}
    for i, h in hashes:
        first.setdefault(h, i)
    want = {(i, j) for h, i in first.items() for g, j in first.items() if i < j and bin((h ^ g) & (2**64 - 1)).count("1") <= 3}
    assert {(r["i"], r["j"]) for r in dedup.near_pairs(df, 3, blocks).collect()} == want
    assert {r["doc_id"] for r in dedup.keep_first(df, 3, blocks).collect()} == greedy(hashes)


def test_near_links_hold_every_document_and_pair(spark):
    hashes = random_hashes(7, 150) + [(200 + i, 0) for i in range(20)]
    rows = [tuple(r) for r in dedup.near_links(spark.createDataFrame([*hashes, hashes[-1], (None, 0)], "doc_id long, h long")).collect()]
    assert len(rows) == len(set(rows))
    by_id = dict(hashes)
    head = {i: i for i in by_id} | {j: i for i, j, d in rows if d == 0}
    near = {(i, j): d for i, j, d in rows if d}
    got = {}
    for j in by_id:
        for i in by_id:
            a, b = sorted((head[i], head[j]))
            if i < j and (a == b or (a, b) in near):
                got[i, j] = near.get((a, b), 0)
    far = {(i, j): bin((g ^ h) & (2**64 - 1)).count("1") for j, h in by_id.items() for i, g in by_id.items() if i < j}
    assert got == {p: d for p, d in far.items() if d <= 3}
    assert sum(d == 0 for _, _, d in rows) == len(hashes) - len(set(by_id.values()))


def test_greedy_chain(spark):
    a, b, c = 0, 0b111, 0b111111
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, 0b1111 << 20)], "doc_id long, h long")
    assert {r["doc_id"] for r in dedup.keep_first(df).collect()} == {1, 3, 4}
    assert dedup.keep_first(df.limit(0)).collect() == []


def test_simhash_and_numbers(spark):
    docs = frame(spark, [(5, "a b c d e f"), (7, "a b c d e f"), (9, "")])
    counts = index.term_counts(index.terms(docs))
    h = {r["doc_id"]: r["h"] for r in dedup.simhash(docs, counts).collect()}
    assert h[5] == h[7] != 0 and h[9] == 0
    wanted = docs.select(dedup.features_wanted(F.lit("x" * 1200)).alias("a"), dedup.features_wanted(F.lit("x")).alias("b")).first()
    assert tuple(wanted) == (10, 5)
    assert [(r["doc_id"], r["new_id"]) for r in dedup.renumbered(docs).orderBy("doc_id").collect()] == [(5, 1), (7, 2), (9, 3)]


def test_hot(spark):
    counts = hot.click_counts(spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (9,)], "doc_id long"))
    assert [tuple(r) for r in hot.hot(counts, 3).collect()] == [(1, 3, 2), (2, 2, 2), (3, 9, 1)]
    assert hot.hot(counts, 0).collect() == []
    assert tuple(hot.hot_stats(counts).first()) == (4, 6)
    assert tuple(hot.hot_stats(counts.limit(0)).first()) == (0, 0)


@pytest.mark.parametrize("local", [1 << 20, 490])
def test_a_long_chain_of_neighbours(spark, local):
    """Each of 500 documents is near the one before it and no other, so every second one stays."""
    r, chain = random.Random(3), [0]
    while len(chain) < 500:
        a, b = r.sample(range(64), 2)
        h = chain[-1] ^ (1 << a) ^ (1 << b)
        if all((h ^ x).bit_count() > 3 for x in chain[:-1]):
            chain.append(h)
    hashes = [(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate(chain)]
    df = spark.createDataFrame(hashes, "doc_id long, h long")
    tables = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file://")).glob("seekmill-*")}
    before = tables()
    assert {x["doc_id"] for x in dedup.keep_first(df, local=local).collect()} == set(range(0, 500, 2))
    assert len(tables() - before) == (0 if local > 500 else 3)  # a round's tables go once the next has its own


def test_blocks_follow_the_number_of_fingerprints():
    fits = lambda n, b: n <= 4 << 64 * (b - 3) // b
    for n in (0, 1000, 10**8, 10**9, 5 * 10**10, 10**13):
        b = dedup.blocks_for(n)
        assert fits(n, b) and (b == 5 or not fits(n, b - 1))


def test_integer_weights(spark):
    rows = [(1, "all", 3), (2, "all", 1), (3, "all", 2), (4, "all", 9), (1, "half", 2), (2, "half", 1), (3, "own", 7)]
    got = {(r["doc_id"], r["term"]): r["n"] for r in dedup.integer_weights(spark.createDataFrame(rows, "doc_id long, term string, n long"), 4).collect()}
    assert got == {(1, "all"): 1, (2, "all"): 1, (3, "all"): 1, (4, "all"): 1, (1, "half"): 2000, (2, "half"): 1000, (3, "own"): 14000}
