"""Exact dedup by a heavy-hitter split, with DataFrame functions only.

A Misra-Gries style sketch (``approx_top_k``) proposes frequent digests, an exact aggregate
verifies them, and the verified winners are broadcast: rows of frequent digests get their answer
map-side. The sketch keeps a map of ``s`` slots, the power of two from ``tracked / 0.75`` on, and its
estimates are too high by 3.5 / s of the rows at most and never too low. Digests of an estimate above that
share are proposed, so every digest of a larger share is, and they are fewer than ``s``. What is left
to shuffle holds no larger group; it is aggregated where it is read, and joined back by sort-merge, which
AQE can split. Sketches merge in two levels, so no task takes one of every other task.

Cases: a null text counts as empty; all other texts are compared unchanged. A null ``doc_id`` is
smaller than any other; a group of null ids only keeps its rows. Rows that repeat a ``doc_id`` and
text are one document and get equal answers; ``drop_copies`` leaves one of them. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekmill.llm.storage import materialize, unused

GROUPS = 64


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def least_share(tracked: int) -> float:
    """The share of all rows from which on a sketch of ``tracked`` items proposes every digest."""
    slots = 8
    while slots * 3 < tracked * 4:
        slots *= 2
    return 3.5 / slots


def frequent_digests(rows: DataFrame, tracked: int) -> DataFrame:
    """h: hashes of the digests that may be frequent, fewer than the sketch has slots."""
    part = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(digest), {tracked})").alias("s"), F.count("*").alias("n"))
    # by a key, so that an empty table has no sketch instead of a null one
    top = part.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
    found = top.select("n", F.inline(F.expr(f"approx_top_k_estimate(s, {tracked})")))
    return found.where((F.col("count") > 1) & (F.col("count") > F.col("n") * least_share(tracked))).select(F.col("item").alias("h"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (binary SHA-256).

    ``tracked`` is the sketch's counters and bounds the broadcasts: rows of 8 and of 56 bytes.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest")))
    group = (F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    heavy = frequent_digests(rows, tracked)
    winners = rows.join(F.broadcast(heavy), F.xxhash64("digest") == F.col("h"), "left_semi").groupBy("digest").agg(*group)
    winners = materialize(winners.withColumn("heavy", F.lit(True)))
    split = rows.join(F.broadcast(winners), "digest", "left")
    rest = split.where(F.col("heavy").isNull()).select("doc_id", "digest")
    rest = rest.join(rest.groupBy("digest").agg(*group).hint("merge"), "digest")
    out = split.where(F.col("heavy")).select("doc_id", "keep_id", "group_size", "digest").unionByName(rest.select("doc_id", "keep_id", "group_size", "digest"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts: one that ``exact_dedup`` keeps, and any one of
    those that repeat its doc_id too; columns as they were."""
    gone_id, gone_digest, kept, n = unused(docs, "gone_id", "gone_digest", "kept", "n")
    seen = exact_dedup(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    odd = materialize(seen.agg(F.max("kept").alias(kept), F.count("*").alias(n)).where(~F.col(kept) | (F.col(n) > 1)))
    # what goes grows with the documents, so it is never broadcast, however little it is here
    same = lambda other: docs[id_col].eqNullSafe(other[gone_id]) & (_digest(text_col) == other[gone_digest])
    left = docs.join(odd.hint("merge"), same(odd), "left_anti")
    repeated = odd.where(kept)
    if not repeated.limit(1).count():
        return left
    again = docs.join(repeated.hint("merge"), same(repeated))
    # the first rows are found before the shuffle too, so many repeats are no hot group
    return left.unionByName(again.dropDuplicates([gone_id, gone_digest]).select(*docs.columns))
