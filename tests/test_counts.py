"""Term counts made where documents are read, against those of exploded tokens."""

from pyspark.sql import functions as F

from seekmill.functions.text import tokenize
from seekmill.operators import dedup, index
from seekmill.plans import catalogue
from seekmill.sources.shared import spread

ROWS = [(1, "Apple apple pie ÉCLAIR éclair. 中文中"), (2, None), (3, ""), (4, " \t\n"), (5, "the The a 3.5 3.5 \x0b b"), (6, "x " * 3000 + "y z Z")]


def both(df, stop=None, **k):
    want = sorted(map(tuple, index.term_counts(index.terms(df, stop, **k)).collect()), key=repr)
    return want, sorted(map(tuple, index.document_terms(df, stop, **k).collect()), key=repr)


def test_counts_are_those_of_tokens(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    stop = spark.createDataFrame([("the",), ("a",), (None,), ("the",)], "word string")
    odd = lambda c: F.concat(F.split(F.coalesce(c, F.lit("")), "[ap]"), F.array(F.lit(None).cast("string"), F.lit(" \t"), F.lit("B")))
    for tokens in (tokenize, lambda c: tokenize(c, "word"), odd):
        want, got = both(df, stop, tokens=tokens)
        # a token that is null is none
        assert got == [w for w in want if w[1] is not None] and got
    again = df.unionByName(df.where("doc_id in (1, 5)")).unionByName(spark.createDataFrame([(None, "q q"), (None, "q r")], df.schema))
    want, got = both(again, stop)
    assert want == got and (1, "apple", 4) in got and (None, "q", 3) in got
    monkeypatch.setattr(index, "CARRIED", 1)
    assert both(df, stop)[0] == both(df, stop)[1]
    assert index.document_terms(df.limit(0), stop).collect() == []


def test_the_most_frequent_terms(spark):
    df = spark.createDataFrame([(7, "b b a a c d d d"), (8, "z y"), (9, "é z z"), (10, "")], "doc_id long, text string")
    got = {tuple(r) for r in index.document_terms(df, most=F.when(F.col("doc_id") == 7, 2).otherwise(1)).collect()}
    assert got == {(7, "d", 3), (7, "a", 2), (8, "y", 1), (9, "z", 2)}
    texts = spark.createDataFrame([(i, " ".join(f"w{k % (i + 3)}" for k in range(90 * i))) for i in range(9)], "doc_id long, text string")
    few = index.document_terms(texts, most=dedup.features_wanted(F.col("text")))
    assert {tuple(r) for r in dedup.simhash(texts, few).collect()} == {tuple(r) for r in dedup.simhash(texts, index.term_counts(index.terms(texts))).collect()}


def test_counting_shuffles_nothing(spark, sf):
    for name in ("stopword_filter", "vocab", "df", "doc_len", "embed_docs"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert all("doc_id" not in line or "term" not in line.split("]")[0] for line in exchanges) and len(exchanges) <= 1, name


def test_only_texts_reach_python(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").unionByName(spark.sql("SELECT 7L AS doc_id, CAST(X'61FF20C3A9' AS STRING) AS text"))
    want, got = both(df)
    assert got == want and (7, "�", 1) in got
    plan = index.document_terms(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_rows_are_dealt_without_a_sort(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spread(spark.range(0, 4000, 1, 1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text")))
    assert df._jdf.queryExecution().executedPlan().toString().count("RoundRobinPartitioning") == 0
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == cores and max(sizes) < 2 * 4000 / cores


def test_terms_are_counted_once_a_query(spark, sf, monkeypatch):
    made = []
    counted = index.document_terms
    monkeypatch.setattr(index, "document_terms", lambda *a, **k: made.append(1) or counted(*a, **k))
    for name in ("hybrid_docs", "sparse_search_blocks", "and_candidates_strict", "hybrid_degraded"):
        made.clear()
        catalogue.QUERIES[name](spark, sf)
        assert len(made) == 1, name
