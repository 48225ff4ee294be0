"""Weights and posting lists of packed rows, against those of a row a document and term."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekmill.operators import index
from seekmill.plans import catalogue

ROWS = [(1, "Apple apple pie ÉCLAIR éclair. 中文中"), (2, None), (3, ""), (4, " \t\n"), (5, "the The a 3.5 3.5 \x0b b"), (6, "x " * 3000 + "y z Z"), (7, "a\x1cb\x85c\xa0d e\x00 apple\fpie\r\npie"), (8, "common"), (9, "pie-apple,x3.x3 3x")]
SCHEMA = "doc_id long, text string"


def both(docs, stop=None, **k):
    n = docs.count()
    want = {(r["doc_id"], r["term"]): r["weight"] for r in index.tfidf(index.term_counts(index.terms(docs, stop)), n).collect()}
    packed = index.packed_tfidf(docs, n, stop, **k)
    got = index.unpacked(packed).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["term"]): r["weight"] for r in got} == pytest.approx(want, abs=1e-12) and want
    lists = {r["term"]: [p["doc_id"] for p in r["postings"]] for r in index.packed_postings(packed).collect()}
    assert lists == {t: sorted(d for d, u in want if u == t) for t in {t for _, t in want}}
    return packed


def test_packed_weights_are_those_of_rows(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, SCHEMA).unionByName(spark.sql("SELECT 10L AS doc_id, CAST(X'61FF20C3A9' AS STRING) AS text"))
    stop = spark.createDataFrame([("the",), ("a",), (None,)], "word string")
    for size in (1, 60, index.PIECE):
        both(df.coalesce(1), stop, piece=size)
    assert both(df.coalesce(1)).where(F.size("docs") > 1).count() > 0
    assert both(df.where("doc_id < 2")).count() == 8 and index.packed_tfidf(df.limit(0), 0, stop).collect() == []
    both(df.unionByName(df.where("doc_id in (1, 5)")), stop)
    monkeypatch.setattr(index, "CARRIED", 1)
    both(df, stop)


def test_many_short_documents_in_a_piece(spark):
    n = 70_000  # words times documents are over 2^31
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("both w"), "id").alias("text"))
    lists = index.packed_postings(index.packed_tfidf(docs, n))
    found = lists.select(F.size("postings").alias("n"), (F.col("term") == F.concat(F.lit("w"), F.col("postings")[0]["doc_id"])).alias("right"))
    assert {(r["n"], r["right"], r["count"]) for r in found.groupBy("n", "right").count().collect()} == {(1, True, n), (n, False, 1)}


def test_a_term_goes_on_in_later_batches():
    def batch(*rows):
        terms, docs = zip(*rows, strict=True) if rows else ((), ())
        lists = pa.array(docs, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), lists, pa.array([[x / 2 for x in d] for d in docs], pa.list_(pa.float64()))], names=["term", "docs", "weights"])

    batches = [batch(("a", [3, 1])), batch(), batch(("a", [2])), batch(("a", [9]), ("b", [5]), ("c", [7])), batch(("c", [6, 4])), batch(("d", [1])), batch(("e", [2]))]
    got = [(r["term"], [(p["doc_id"], p["weight"]) for p in r["postings"]]) for b in index._joined(iter(batches)) for r in b.to_pylist()]
    assert got == [(t, [(d, d / 2) for d in docs]) for t, docs in (("a", [1, 2, 3, 9]), ("b", [5]), ("c", [4, 6, 7]), ("d", [1]), ("e", [2]))]


def test_postings_move_packed_rows(spark, sf):
    plan = catalogue.QUERIES["postings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "doc_id#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert catalogue._packed(spark, sf).count() < catalogue._counts(spark, sf).count() * 3 / 4
