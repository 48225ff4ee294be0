import random
import re
import zlib
from collections import Counter

import pytest

from seekmill.llm import queries, spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_words(rows, every=199, least=6, times=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= times}


def brute(words, ratio=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and distance(w, v) == 1] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")


def test_two_words_at_distance_one_share_one_key():
    r = random.Random(1)
    for _ in range(20_000):
        a = "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
        i = r.randrange(len(a))
        b = r.choice([a[:i] + a[i + 1 :], a[:i] + r.choice("abc") + a[i:], a[:i] + r.choice("abc") + a[i + 1 :]])
        if a != b:
            assert len(set(spelling.keys_of(a)) & set(spelling.keys_of(b))) == 1


def test_hashed_keys_meet_like_texts(monkeypatch):
    r = random.Random(2)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(2, 7))) for _ in range(300)}
    plain = {(a, b): len(set(spelling.keys_of(a)) & set(spelling.keys_of(b))) for a in words for b in words if a < b}
    for short in (0, 3, 4):
        monkeypatch.setattr(spelling, "SHORT", short)
        assert plain == {(a, b): len(set(spelling.keys_of(a)) & set(spelling.keys_of(b))) for a in words for b in words if a < b}


def counted(spark, words):
    return spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, id string")


@pytest.mark.parametrize("short", [0, 64])
def test_variants_against_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(spelling, "SHORT", short)
    r = random.Random(3)
    words = {"".join(r.choice("abÿ") for _ in range(r.randrange(3, 7))): r.choice([5, 5, 25, 25, 125, 700, 4000]) for _ in range(250)}
    long = "xy" * 4000
    words |= {long: 500, long[:-1]: 90, long[:70] + "z" + long[70:]: 7, long[:100] + "q" + long[101:]: 100}
    got = {tuple(x) for x in spelling.spelling_variants(counted(spark, words)).collect()}
    short_words = {w: n for w, n in words.items() if len(w) < 100}
    assert {x for x in got if len(x[0]) < 100} == brute(short_words)
    assert {(len(w), n, near, root == long, form_n) for w, form, root, n, near, form_n in got if len(w) > 100} == {(8000, 500, 3, True, None), (7999, 90, 1, True, 500), (8001, 7, 1, True, 500), (8000, 100, 1, True, 500)}


def test_roots_follow_long_chains(spark):
    words = {"a" * 6 + "b" * k: 5 ** (k + 1) for k in range(12)}
    got = {tuple(x) for x in spelling.spelling_variants(counted(spark, words)).collect()}
    assert got == brute(words) and {x[2] for x in got} == {"a" * 6 + "b" * 11}


ODD = [(1, None), (2, ""), (None, "nullid nullid nullid nullid nullid"), (3, "Twelve TWELVE twelve ÉTÉÉTÉ ÉTÉÉTÉ"), (3, "Twelve TWELVE twelve ÉTÉÉTÉ ÉTÉÉTÉ"), (4, "wordĀword under_score x1letters twelvè " * 9), (5, "short " * 9), (6, "q" * 30_000 + " plain×÷ß " + "q" * 30_000)]


def test_counts_of_odd_rows(spark):
    for every in (199, 3, 1):
        got = {x["word"]: x["n"] for x in spelling.word_counts(frame(spark, ODD), min_count=1, change=spelling.respell(every)).collect()}
        assert got == brute_words(ODD, every, times=1)
    assert {x["word"]: x["n"] for x in spelling.word_counts(frame(spark, ODD)).collect()} == brute_words([(None, t) for _, t in ODD])
    out = spelling.spelling_variants(spelling.word_counts(frame(spark, [])))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_small_tasks_emit_partial_counts(spark, monkeypatch):
    rows = [(i, f"common {'abcdefgh'[i % 8] * 7} singles{'xyz'[i % 3]}") for i in range(200)]
    run = spelling._count(6, None)
    monkeypatch.setattr(spelling, "HELD", 2)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t.encode() for _, t in rows], pa.binary())], names=["doc_id", "text"])
    total = Counter()
    for out in run(iter([batch])):
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            total[w] += n
    assert total == brute_words([(None, t) for _, t in rows], times=1)


def test_query_over_the_table(spark, sf):
    rows = [(x["doc_id"], x["text"]) for x in queries.table(spark, sf, "documents").collect()]
    got = {tuple(x) for x in queries.op11_spelling_variants(spark, sf).collect()}
    words = brute_words(rows)
    assert {(x[0], x[3]) for x in got} == set(words.items())
    assert got == brute(words)
