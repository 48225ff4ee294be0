"""Sparse, dense and fused retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.operators.index import idf
from seekmill.sources.shared import written


def query_vector(query_terms: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """term, df, q_weight of a query's terms (repeats count), L2-normalised; no rows if the norm is zero.
    A term that no document has weighs ``log2 n`` and has a null df."""
    counted = query_terms.groupBy("term").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    # the query's few terms reach the frequencies as a semi-join filter first
    known = frequencies.join(F.broadcast(counted.select("term")), "term")
    raw = counted.join(known, "term", "left").crossJoin(F.broadcast(total))
    raw = raw.select("term", "df", (F.col("n") / F.col("total") * idf(n_docs, F.coalesce("df", F.lit(0)))).alias("w"))
    norm = raw.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.crossJoin(F.broadcast(norm)).where(F.col("norm") > 0).select("term", "df", (F.col("w") / F.col("norm")).alias("q_weight"))


def with_all_terms(counts: DataFrame, vector: DataFrame) -> DataFrame:
    """The rows of ``counts`` (doc_id, term once a document) of those documents that ``matches`` can find: of all
    documents only they need weights."""
    known = vector.where(F.col("df").isNotNull()).select("term")
    found = counts.join(F.broadcast(known), "term").groupBy("doc_id").agg(F.count("*").alias("found"))
    needed = F.broadcast(known.agg(F.count("*").alias("needed")))
    # as a table its size is known, so that counts aren't shuffled for few documents
    return counts.join(written(found.join(needed, F.col("found") == F.col("needed")).select("doc_id")), "doc_id", "left_semi")


def matches(index: DataFrame, vector: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, score (cosine) of the documents with all terms that any document has; under ``strict``
    a term that none has leaves no result."""
    needed = vector.agg(F.count(F.lit(1) if strict else F.col("df")).alias("needed"))
    hits = index.join(F.broadcast(vector.where(F.col("df").isNotNull()).select("term", "q_weight")), "term")
    found = hits.groupBy("doc_id").agg(F.count("*").alias("found"), F.sum(F.col("q_weight") * F.col("weight")).alias("score"))
    return found.join(F.broadcast(needed), F.col("found") == F.col("needed")).select("doc_id", "score")


def top(scored: DataFrame, k: int, score: str, *ties: Column) -> DataFrame:
    """The ``k`` best rows; each task keeps its own best, so only ``k`` rows a task move."""
    return scored.orderBy(F.desc(score), *ties).limit(max(k, 0))


def sparse_search(index: DataFrame, vector: DataFrame, k: int = 20, strict: bool = False) -> DataFrame:
    found = matches(index, vector, strict).select("doc_id", F.round("score", 9).alias("sparse_score"))
    return top(found, k, "sparse_score", F.col("doc_id"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_search(vectors: DataFrame, query: list[float], k: int = 60) -> DataFrame:
    """vec_id, score of the ``k`` best inner products; ties go to the larger id."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col("embedding").isNotNull()).select("vec_id", F.round(dot(F.col("embedding"), literal), 9).alias("score"))
    return top(scored, k, "score", F.desc("vec_id"))


def fuse(sparse: DataFrame, dense: DataFrame | None, k: int = 20, alpha: float = 0.5) -> DataFrame:
    """doc_id, sparse_score, dense_score, final_score: ``alpha`` of the cosine and the rest of the dense
    score moved from [-1, 1] to [0, 1]; a document that one side lacks has zero there. Without dense
    results the final score is the cosine."""
    found = sparse.select("doc_id", F.col("sparse_score"))
    if dense is None:
        out = found.select("doc_id", "sparse_score", F.lit(0.0).alias("dense_score"), F.col("sparse_score").alias("final_score"))
        return top(out, k, "final_score", F.col("doc_id"))
    moved = dense.select(F.col("vec_id").alias("doc_id"), ((F.col("score") + 1) / 2).alias("dense_score"))
    both = found.join(moved, "doc_id", "full").select("doc_id", F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"))
    final = F.round(alpha * F.col("sparse_score") + (1 - alpha) * F.col("dense_score"), 9)
    return top(both.withColumn("final_score", final), k, "final_score", F.col("doc_id"))


def with_documents(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Joins the few ranked rows with their documents; a missing document has empty fields. ``ranked``
    is a top-k result, so it is broadcast and the documents are filtered by it before they move."""
    found = docs.join(F.broadcast(ranked.select("doc_id")), "doc_id", "left_semi")
    out = ranked.join(found, "doc_id", "left")
    return out.fillna("", [c for c, kind in found.dtypes if kind == "string"])
