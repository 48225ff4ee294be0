import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seekmill.llm import bpe, packing, queries, token_files, tokens, topk
from seekmill.llm.storage import new_path

BYTES, WORDS, MULTI = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a \nb", "a\n b", "Don't DON'T we'LL \"'s it's'd", "<|endoftext|> x<|startoftext|>", "tab\tand\r\nend \t",
    "é café É İstanbul ΣΑΣ ſ", " no　break x", "日本語 テキスト 12345 ½ Ⅷ Ⓐ", "👩‍👩‍👧 emoji 🙂🙂", "a.b,c;d!!! ...", "x" * 300, "́ mark first ̸", "1 22 333,4444.5", "\x1c\x1d sep \x85 nel", "'", "''s",
]


def library(path, added=True):
    """The library as loaded; without ``added``, its added tokens are ordinary text."""
    t = Tokenizer.from_file(path)
    if not added:
        t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ADDED = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|startoftext|><|endoftext|>", " <|startoftext|> <|endoftext|>\n", "<|ENDOFTEXT|>", "<|endoftext|", "日<|endoftext|>🙂"]


@pytest.mark.parametrize("added", [True, False])
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoders_give_the_library_ids(path, added):
    r = random.Random(1)
    points = [chr(c) for c in [*range(1, 0x250), *range(0x250, 0x3000, 7), *range(0x3000, 0x20000, 97)] if not 0xD800 <= c < 0xE000]
    alphabets = [" \n\taeé'sST1.,-İ日́", "abc'sdtrellvm ,.1<|>", points, points[:0x24F]]
    texts = TEXTS + ADDED + ["".join(r.choice(a) for _ in range(r.randrange(40))) for a in alphabets for _ in range(1500)]
    encoder = tokens.encoder(path, added)
    assert type(encoder) is {BYTES: tokens.BytePairs, WORDS: tokens.WordPairs}[path]
    for t, want in zip(texts, library(path, added)(texts), strict=True):
        assert encoder.ids(t).tolist() == want, repr(t)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoders_on_long_runs(path):
    texts = [c * 300_000 for c in (" ", "\n", "x", "é", "日", ".", "1", "ab ", "🙂")]
    for t, want in zip(texts, library(path)(texts), strict=True):
        assert tokens.encoder(path).ids(t).tolist() == want, repr(t[:3])


@pytest.mark.parametrize("path,end", [(BYTES, ""), (WORDS, "</w>")])
def test_every_token_is_merged_from_its_own_pair(path, end):
    """What lets merges be ranked by what they make: each merged token's characters, merged alone, give it."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {p: i for i, p in enumerate(pairs)}
    for a, b in pairs:
        bare = (a + b).removesuffix(end) if end else a + b
        parts = [*bare[:-1], bare[-1] + end] if end and (a + b) != bare else list(bare)
        while len(parts) > 1:
            i = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            assert (parts[i], parts[i + 1]) in rank
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [a + b]


def test_other_vocabularies_go_to_the_library(tmp_path):
    with open(BYTES, encoding="utf-8") as f:
        file = json.load(f)
    file["model"]["vocab"]["!"], file["model"]["vocab"]["he"] = file["model"]["vocab"]["he"], file["model"]["vocab"]["!"]
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(file, f)
    encoder = tokens.encoder(path)
    assert type(encoder) is tokens.Library
    assert [encoder.ids(t).tolist() for t in TEXTS] == library(path)(TEXTS)


def test_assign_fills_and_balances():
    r = random.Random(2)
    for _ in range(50):
        lengths = [r.randrange(1, 64) for _ in range(r.randrange(0, 80))]
        out = packing.assign(lengths, 64)
        used = defaultdict(list)
        for n, places in zip(lengths, out, strict=True):
            assert sum(x[2] for x in places) == n
            for b, offset, k in places:
                used[b].append((offset, k))
        assert len(used) == -(-sum(lengths) // 64)
        for spots in used.values():
            at = 0
            for offset, k in sorted(spots):
                assert offset == at
                at += k
            assert at <= 64


def check_pieces(rows, texts, ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        want, at = [*ids[d], 1], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return len(by_seq)


def test_packing_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf, "documents").collect()}
    ids = dict(zip(docs, library(BYTES)(list(docs.values())), strict=True))
    used = check_pieces(queries.op6_packing(spark, sf).collect(), docs, ids)
    assert used <= sum(len(x) + 1 for x in ids.values()) / 2048 + 2


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "a", 2), (2, "", 3), (2, "b " * 5000, 4)], "doc_id long, text string, length long")
    rows = packing.pack(df, BYTES).collect()
    assert sum(r["length"] for r in rows) == 1 + 2 + 1 + len(library(BYTES)(["b " * 5000])[0]) + 1
    assert packing.pack(df.limit(0), BYTES).collect() == []


def test_token_files_over_the_table(spark, sf):
    docs = sorted((r["doc_id"], r["text"] or "") for r in queries.table(spark, sf, "documents").collect())
    want, start = [], 0
    for (d, _), ids in zip(docs, library(WORDS)([t for _, t in docs]), strict=True):
        ids = [*ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op7_token_files(spark, sf).collect())) == want


def test_token_files_odd_rows(spark):
    df = spark.createDataFrame([(5, None, "x"), (None, "a", "x"), (2, "", "x"), (2, "b b", "x"), (2, "b b", "x")], "doc_id long, text string, tokens string")
    path = new_path(spark)
    token_files.write_tokens(df, path, WORDS)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 2, 2, 2, 5]
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    assert all(len(r["tokens"]) == r["n_tokens"] for r in rows)
    found = spark.read.schema(token_files.FILE).orc(path).where("doc_id = 5")
    assert "EqualTo(doc_id,5)" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1
    path = new_path(spark)
    token_files.write_tokens(df.limit(0), path, WORDS)
    assert token_files.read_tokens(spark, path).collect() == []


def brute_top(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            v = tuple(float(np.floor(64 * float(x))) for x in v)
            good[i] = max(good.get(i, v), v)
    out = set()
    for q, v in good.items():
        if q % 20 == 0:
            scores = sorted((-int(np.dot(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [1 << 16, 100])
def test_top_k_against_brute_force(spark, shard_rows):
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.1 * r.normal(size=8)).tolist()) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(None, [1.0] * 8), (2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, []), (2020, [1.0, 2.0]), (2021, [3.0, 4.0]), (40, [9.0] * 8), (40, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<float>, score string")
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect()}
    assert got == brute_top(f32)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_scores_beyond_a_long_are_its_ends(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0]), (3, [0.0, 3.4e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 0), (3, 2, -(2**63))]


def test_large_scores_are_exact(spark):
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.integers(-(1 << 22), 1 << 22, 6)]) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in r.integers(-9, 9, 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: [int(64 * x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in good if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], w)), i) for i, w in good.items() if i != q)[:20]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert max(abs(s) for *_, s in want) > 1 << 54
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=50).collect()}
    assert got == want


def test_cells_bound_their_vectors_and_spare_queries(spark):
    r = np.random.default_rng(10)
    centres = 100 * r.normal(size=(6, 8))
    rows = [(i, np.floor(centres[i % 6 if i > 900 else 0] + r.normal(size=8)).tolist()) for i in range(2400)]
    df = spark.createDataFrame([*rows, (5000, [1.0]), (5000, [2.0]), (5001, [7.0, 7.0])], "vec_id long, v array<double>")
    near, cells = topk.cells_of(df, [1, 2, 8], 12)
    found = {x["vec_id"]: (x["shard"], x["v"]) for x in near.collect()}
    assert len(found) == 2402 and found[5000][1] == [2.0]
    of = {s: c for c, shards in enumerate(cells.shards) for s in shards}
    q = r.normal(size=(30, 8)) * 100
    bounds = cells.bounds(8, q)
    for i, v in rows:
        assert (q @ np.array(v) <= bounds[:, of[found[i][0]]]).all()
    for dim in (1, 2):
        assert np.isneginf(cells.bounds(dim, np.ones((1, dim)))[0][cells.dims != dim]).all()
    sizes = np.bincount([s for s, _ in found.values()])
    assert sizes.max() <= 2 * (2403 // 12) and len(sizes) <= 24 + 2
    shared = spark.sparkContext.broadcast(cells)
    kth = {i: sorted((float(np.dot(v, w)) for _, w in rows), reverse=True)[20] for i, v in rows[::20]}
    asked = spark.createDataFrame([(i, found[i][1], found[i][0], f) for i, f in kth.items()], "vec_id long, v array<double>, shard int, floor double")
    sent = asked.mapInArrow(topk._elsewhere(shared), "shard int, vec_id long, v array<double>, floor double").count()
    assert sent < 0.7 * len(kth) * (len(sizes) - 1)


def test_ball_tree_bounds_hold():
    r = np.random.default_rng(5)
    v = r.normal(size=(500, 6))
    tree = topk.BallTree.build(np.arange(500), v, leaf=16)
    q = r.normal(size=(20, 6))
    bounds = tree.bounds(q)
    for leaf, (lo, hi) in enumerate(tree.leaves):
        assert (q @ tree.vectors[lo:hi].T <= bounds[:, leaf][:, None]).all()
    assert sorted(tree.ids.tolist()) == list(range(500))


def reference_encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_spark_hash(spark):
    row = spark.sql("select xxhash64('über'), xxhash64(X'00ff10'), xxhash64(123456789012L)").first()
    assert tuple(row) == (bpe.spark_hash("über".encode()), bpe.spark_hash(b"\x00\xff\x10"), bpe.spark_hash((123456789012).to_bytes(8, "little")))


def test_pairs_have_slots_of_their_own():
    r = random.Random(2)
    pairs = sorted({(min(r.randrange(300), r.randrange(300)), r.randrange(300)) for _ in range(4000)})
    moves, slots = bpe.pair_slots(pairs, 300)
    assert len(set(slots.tolist())) == len(pairs)
    assert all(moves[a] + b == slot for (a, b), slot in zip(pairs, slots, strict=True))
    assert bpe.pair_slots([], 3)[0].tolist() == [0, 0, 0]


@pytest.mark.parametrize("dictionary", [0, 50])
def test_bpe_against_the_library(spark, dictionary):
    r = random.Random(1)
    texts = [*TEXTS, None, *["".join(r.choice(" \n\taeé'sST1.,-İ日́") for _ in range(r.randrange(60))) for _ in range(100)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the the", 1), (None, "the the", 1)], "doc_id long, text string, ids int")
    enc = reference_encoding()
    out = bpe.decode(bpe.encode(df, MULTI, P.PATTERN, dictionary=dictionary), MULTI).collect()
    for row in out:
        t = "the the" if row["doc_id"] is None else texts[row["doc_id"]] or ""
        assert row["ids"] == enc.encode_ordinary(t), repr(t)
        assert bytes(row["decoded"]) == t.encode()
    assert len(out) == len(texts) + 2
    assert bpe.encode(df.limit(0), MULTI, P.PATTERN).collect() == []


def test_bpe_of_long_words(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghij") for _ in range(8000)), "x" * 20000, "日" * 3000, " " * 5000 + "a", "ab" * bpe.SHORT]
    enc = reference_encoding()
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MULTI, P.PATTERN).collect()
    assert {x["doc_id"]: x["ids"] for x in out} == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_frequent_words_are_the_most_frequent(spark):
    df = spark.createDataFrame([(w,) for n, w in enumerate("abcdefgh") for _ in range(n)], "word string")
    assert sorted(r["word"] for r in bpe.frequent_words(df, 3, 64).collect()) == ["f", "g", "h"]
    assert bpe.frequent_words(df.limit(0), 3, 64).collect() == []


def test_bpe_over_the_table(spark, sf):
    enc = reference_encoding()
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op10_byte_bpe(spark, sf).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
