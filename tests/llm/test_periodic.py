import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seekmill.llm import periodic, queries


def brute_runs(w, least=6, ratio=4):
    """Every stretch of every period, kept where no smaller period holds for it."""
    found = []
    for q in range(1, len(w) // ratio + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, ratio * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                found.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(found)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(words) if i not in gone))


def repetitive(r, most):
    words, letters = [], r.choice([1, 2, 3, 6])
    while len(words) < most:
        block = [r.randrange(letters) for _ in range(r.randrange(1, 25))]
        words += block * r.randrange(1, 7) + block[: r.randrange(len(block) + 1)] if r.random() < 0.6 else [r.randrange(20)]
    return words


@pytest.mark.parametrize("short", [0, 1, 16])
def test_runs_against_brute_force(monkeypatch, short):
    monkeypatch.setattr(periodic, "SHORT", short)
    r = random.Random(short)
    for _ in range(800):
        w = repetitive(r, r.randrange(1, 300))
        assert periodic.periodic_runs(np.array(w, np.int64)) == brute_runs(w)
    for least, ratio in ((2, 4), (20, 5)):
        w = repetitive(r, 200)
        assert periodic.periodic_runs(np.array(w, np.int64), least, ratio) == brute_runs(w, least, ratio)


def test_k_follows_from_the_least_run():
    assert periodic.min_overlap(6, 4) == 5 and periodic.min_overlap(20, 5) == 16 and periodic.min_overlap(2, 4) == 3
    x = np.array([*range(100), *[7, 8] * 5, *range(200, 300)])
    assert periodic.surviving(x, 5) == [(100, 110)]
    assert periodic.surviving(np.arange(50), 5) == []


def test_long_periods_and_long_texts():
    block = list(range(3000))
    x = np.array(block * 5 + [9, 9, 9] + [1] * 200_000 + [2] + [1] * 100_000)
    assert periodic.periodic_runs(x) == [(0, 15000, 3000), (15003, 200_000, 1), (215_004, 100_000, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, runs string, collapsed array<int>")


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a " * 20), (4, "a a a a a a"), (4, "a a a a a a"), (5, "a a a a a"), (6, "é b " * 9), (7, "x\x1fy " * 6), (8, "w " * 30_000), (9, "no run here at all")]


def test_odd_rows(spark):
    out = periodic.find_runs(frame(spark, ODD))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=repr)
    want = []
    for i, t in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words) if len(words) < 1000 else [(0, 30_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic.find_runs(frame(spark, [])).collect() == []


def test_planted_periods_and_the_query(spark, tmp_path):
    r = random.Random(4)
    rows = [*ODD[:7], *((i, " ".join(f"w{x}" for x in repetitive(r, r.randrange(1, 120)))) for i in range(10, 400))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((brute_row(*x) for x in rows), key=repr)


def test_query_over_the_table(spark, sf):
    rows = {x["doc_id"]: x["text"] for x in queries.table(spark, sf, "documents").collect()}
    out = queries.op13_periodic_runs(spark, sf)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {x["doc_id"]: tuple(x) for x in out.collect()}
    assert got.keys() == rows.keys()
    few = [i for i, t in rows.items() if len(t or "") < 6000]
    assert len(few) > 100 and all(got[i] == brute_row(i, rows[i]) for i in few)
