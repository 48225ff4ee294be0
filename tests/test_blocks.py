import random

import pytest
from pyspark.sql import functions as F

from seekmill.operators import blocks, search

VECTOR = "term string, df long, q_weight double"


def postings(spark, docs=6000, seed=1):
    r = random.Random(seed)
    rows = [("all", d, r.choice([0.1, 0.2]) + (0.7 if d in (4321, 17) else 0)) for d in range(docs)]
    rows += [("half", 3 * d, r.random()) for d in range(docs // 3)] + [("rare", d, -0.5) for d in (17, 40, 4321, 5998)] + [("one", 9, 1.0)]
    return spark.createDataFrame(rows, "term string, doc_id long, weight double").repartition(5)


@pytest.mark.parametrize("size", [1, 100])
def test_blocks_hold_the_postings(spark, size):
    index = postings(spark)
    made = blocks.posting_blocks(index, size).cache()
    assert sorted(map(tuple, blocks.expand(made).collect())) == sorted(map(tuple, index.collect()))
    rows = made.collect()
    assert all(r["n"] == len(r["distances"]) == len(r["weights"]) <= size for r in rows)
    assert all((r["least"], r["greatest"]) == (min(r["weights"]), max(r["weights"])) for r in rows)
    assert all(r["distances"][0] == 0 and r["first_doc"] + r["distances"][-1] == r["last_doc"] and r["distances"] == sorted(r["distances"]) for r in rows)
    assert blocks.posting_blocks(index.limit(0)).collect() == []
    made.unpersist()


def test_odd_postings(spark):
    index = spark.createDataFrame([(None, 1, 1.0), ("a", None, 1.0), ("a", 1, None), ("a", -(1 << 61), 1.0), ("a", 1 << 61, -1.0)], "term string, doc_id long, weight double")
    got = blocks.expand(blocks.posting_blocks(index)).collect()
    assert sorted(map(tuple, got)) == [("a", -(1 << 61), 1.0), ("a", 1 << 61, -1.0)]


QUERIES = [[("all", 0.8)], [("all", 0.6), ("half", 0.8)], [("half", -0.7), ("all", 0.3)], [("rare", 0.9), ("all", 0.1)], [("rare", -0.9), ("half", 0.2)], [("one", 1.0)], [("one", 0.5), ("rare", 0.5)]]


def test_search_equals_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PROBED", 8)
    index = postings(spark).cache()
    made = blocks.posting_blocks(index, 16).cache()
    for i, terms in enumerate(QUERIES):
        monkeypatch.setattr(blocks, "CELLS", [50, 4096, 1][i % 3])
        absent, k, strict = ([], 5, True) if i % 2 else ([("none", None, 0.4)], 40, False)
        vector = spark.createDataFrame([(t, 1, w) for t, w in terms] + absent, VECTOR)
        assert blocks.block_search(made, vector, k, strict).collect() == search.sparse_search(index, vector, k, strict).collect()
    none = spark.createDataFrame([("none", None, 1.0)], VECTOR)
    assert blocks.block_search(made, none).collect() == []
    assert blocks.block_search(made, spark.createDataFrame([("all", 1, 1.0), ("none", None, 1.0)], VECTOR), strict=True).collect() == []
    assert blocks.block_search(made, spark.createDataFrame([("all", 1, 1.0)], VECTOR), 0).collect() == []


def test_blocks_are_skipped(spark, tmp_path):
    blocks.posting_blocks(postings(spark), 16).write.parquet(str(tmp_path / "blocks"))
    made = spark.read.parquet(str(tmp_path / "blocks"))
    vector = spark.createDataFrame([("all", 1, 0.9)], VECTOR)
    ranges = blocks.needed_ranges(made.where("term = 'all'"), vector, 2)
    read = made.where((F.col("term") == "all") & blocks._overlaps(ranges))
    assert {d for a, b in ranges for d in (17, 4321) if a <= d <= b} == {17, 4321}
    assert 2 <= read.count() <= 10 < made.where("term = 'all'").count()
    plan = read._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(last_doc" in plan


def test_merged_ranges():
    assert blocks.merged([], 0, 5) == [] and blocks.merged([3], 10, 5) == [(25, 29)]
    assert blocks.merged([4, 1, 2, 9], 0, 10, 64) == [(10, 29), (40, 49), (90, 99)]
    assert blocks.merged([1, 3, 9, 20], 0, 1, 2) == [(1, 9), (20, 20)]
