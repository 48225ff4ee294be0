import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekmill.operators import suggest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def most(q):
    return 1 if len(q) <= 2 else 2 if len(q) <= 5 else 3


def test_words_within_the_edits_share_a_deletion():
    r = random.Random(1)
    for _ in range(4000):
        a = [r.choice("abc") for _ in range(r.randrange(0, 16))]
        b = list(a)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = [r.choice("abc")] * r.randrange(2)
        n = distance(a, b)
        assert suggest.deletions("".join(a), n) & suggest.deletions("".join(b), n)


WORDS = 400


@pytest.fixture(scope="module")
def words(spark):
    r = random.Random(2)
    found = {"".join(r.choice("abcé増") for _ in range(r.randrange(0, 14))): r.randrange(1, 6) for _ in range(WORDS)} | {"x" * 300: 2}
    return found, spark.createDataFrame([(w, n, "x") for w, n in found.items()], "word string, freq int, query string").repartition(5).cache()


@pytest.mark.parametrize("order", ["intended", "reference"])
def test_corrections_of_many_queries(spark, words, order):
    known, df = words
    r = random.Random(3)
    queries = [*r.sample(sorted(known), 60), "", "a", "zz", "abca", "x" * 298 + "y", "é増é"]
    keys = {"intended": lambda w, d: (d, -known[w], w), "reference": lambda w, d: (-d, -known[w], tuple(-ord(c) for c in w + "\0"))}[order]
    want = set()
    for q in set(queries):
        near = [(w, distance(w, q)) for w in known if abs(len(w) - len(q)) <= 3]
        near = sorted(((w, d) for w, d in near if d <= most(q)), key=lambda x: keys(*x))
        want |= {(q, w, known[w], d, i) for i, (w, d) in enumerate(near[:5], 1)}
    asked = spark.createDataFrame([(q,) for q in [*queries, "a", None]], "query string")
    got = suggest.batch_corrections(df, asked, 5, order).select("query", "word", "freq", "dist", "rank").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    one = suggest.corrections(df, "abca", 5, order).collect()
    assert {(x["word"], x["dist"]) for x in one} == {(w, d) for q, w, _, d, _ in want if q == "abca"}


def test_prefixes_of_many_queries(spark, words):
    known, df = words
    queries = ["a", "b", "ab", "abc", "é", "zz", "x" * 299, "", None]
    want = set()
    for q in filter(None, queries):
        found = sorted((w for w in known if w.startswith(q)), key=lambda w: (-known[w], w))
        want |= {(q, w, known[w], i) for i, w in enumerate(found[:3], 1)}
    asked = spark.createDataFrame([(q,) for q in queries * 2], "query string")
    out = suggest.batch_prefix(df, asked, 3)
    assert {tuple(x) for x in out.select("query", "word", "freq", "rank").collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan  # before the rows meet, and after
    assert suggest.batch_prefix(df, asked.limit(0)).collect() == [] and suggest.batch_prefix(df.limit(0), asked).collect() == []
    assert suggest.batch_prefix(df, asked, 0).collect() == [] and suggest.batch_corrections(df.where(F.lit(False)), asked).collect() == []


def test_hashed_deletions_are_the_deletions():
    r = random.Random(4)
    words = ["", "a", "aa", "é増\U00020000", *("".join(r.choice("abcdé増") for _ in range(r.randrange(0, 14))) for _ in range(300))]
    allowed = np.array([r.randrange(4) for _ in words])
    row, key = suggest.hashed_deletions(pa.array(words), allowed)
    texts = [suggest.deletions(w, m) for w, m in zip(words, allowed.tolist(), strict=True)]
    assert np.bincount(row, minlength=len(words)).tolist() == [len(t) for t in texts]
    of_text = {t: suggest.hashed_deletions(pa.array([t]), np.array([0]))[1][0] for t in set().union(*texts)}
    assert len(set(of_text.values())) == len(of_text)
    assert {*zip(row.tolist(), key.tolist(), strict=True)} == {(i, int(of_text[t])) for i, found in enumerate(texts) for t in found}


def test_few_words_leave_their_task(spark):
    queries = spark.createDataFrame([("abcdefg", 3)], "query string, most int")
    keys = queries.mapInArrow(suggest._keys("query", ["query"]), "key long, query string")
    words = spark.createDataFrame([(f"{i:07d}", 3) for i in range(500)] + [("abcdxfg", 3)], "word string, most int")
    left = words.mapInArrow(suggest._keys("word", ["word"], suggest._wanted(keys)), "key long, word string")
    assert left.where("word = 'abcdxfg'").count() >= 1 and left.where("word <> 'abcdxfg'").count() < 500
