"""Posting lists as blocks of bounded size, and a top-k that leaves out blocks by their bounds.

A block is a row: a term, the ids of at most ``size`` of its documents as distances from the first, their
weights, and the least and greatest weight. A term of all documents is many rows, so no cell or
task grows with it, and a reader that needs a range of documents reads the blocks that meet it. Ids are to
span less than 2**63; rows with a null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.operators.search import matches, top

SIZE, CELLS, PROBED, RANGES = 1024, 4096, 32, 64
BLOCKS = "term string, first_doc long, last_doc long, n int, least double, greatest double, distances array<long>, weights array<double>"
Ranges = list[tuple[int, int]]


def _cut(size: int):
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, n = batch.column(0), batch.num_rows
            if not n:
                continue
            docs, weights = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            new = pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.flatnonzero(new) + 1])
            within = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            at = np.flatnonzero(within % size == 0)
            ends = np.append(at, n)
            first = docs[at]
            lists = pa.array(ends, pa.int32())
            distances = pa.ListArray.from_arrays(lists, pa.array(docs - np.repeat(first, np.diff(ends))))
            columns = [terms.take(pa.array(at)), pa.array(first), pa.array(docs[ends[1:] - 1]), pa.array(np.diff(ends), pa.int32())]
            columns += [pa.array(np.minimum.reduceat(weights, at)), pa.array(np.maximum.reduceat(weights, at)), distances, pa.ListArray.from_arrays(lists, pa.array(weights))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def posting_blocks(index: DataFrame, size: int = SIZE) -> DataFrame:
    """term, doc_id, weight rows -> blocks in the order of term and document. They are ranged by both, so a
    frequent term spans tasks, and each task cuts the stream of its range."""
    rows = index.select("term", F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("weight")).dropna()
    return rows.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").mapInArrow(_cut(size), BLOCKS)


def expand(blocks: DataFrame) -> DataFrame:
    """Blocks -> term, doc_id, weight."""
    rows = blocks.select("term", "first_doc", F.inline(F.arrays_zip("distances", "weights")))
    return rows.select("term", (F.col("first_doc") + F.col("distances")).alias("doc_id"), F.col("weights").alias("weight"))


def _overlaps(ranges: Ranges) -> Column:
    """Blocks that meet a range: reaches the statistics of row groups."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | ((F.col("last_doc") >= low) & (F.col("first_doc") <= high))
    return out


def _within(ranges: Ranges) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | F.col("doc_id").between(low, high)
    return out


def merged(cells: list[int], low: int, width: int, most: int = RANGES) -> Ranges:
    """Cells as ranges of ids, ``most`` at most: the narrowest gaps between them are closed."""
    cells = sorted(cells)
    gaps = sorted(range(1, len(cells)), key=lambda i: cells[i - 1] - cells[i])[: most - 1]
    cuts = sorted(i for i in gaps if cells[i] - cells[i - 1] > 1)
    parts = [cells[a:b] for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True)]
    return [(low + p[0] * width, low + (p[-1] + 1) * width - 1) for p in parts if p]


def _bounded_cells(blocks: DataFrame, vector: DataFrame, needed: int) -> tuple[list[tuple[int, float]], int, int]:
    """((cell, bound) for the cells that have all terms, least id, width of a cell): the ids are cut into ``CELLS`` cells of
    equal width, whose bounds come from the blocks' heads alone."""
    heads = blocks.select("term", "first_doc", "last_doc", "least", "greatest").join(F.broadcast(vector), "term")
    bound = F.greatest(F.col("q_weight") * F.col("greatest"), F.col("q_weight") * F.col("least"))
    heads = heads.select("term", "first_doc", "last_doc", bound.alias("bound"))
    ends = heads.agg(F.min("first_doc").alias("low"), F.max("last_doc").alias("high")).first()
    if ends["low"] is None:
        return [], 0, 1
    low, width = ends["low"], max(1, -((ends["low"] - ends["high"] - 1) // CELLS))
    cell = lambda c: F.floor((F.col(c) - low) / width).cast("long")
    met = heads.select("term", "bound", F.explode(F.sequence(cell("first_doc"), cell("last_doc"))).alias("cell"))
    best = met.groupBy("cell", "term").agg(F.max("bound").alias("bound"))
    best = best.groupBy("cell").agg(F.sum("bound").alias("bound"), F.count("*").alias("terms")).where(F.col("terms") == needed)
    return sorted(((r["cell"], r["bound"]) for r in best.collect()), key=lambda x: (-x[1], x[0])), low, width  # CELLS rows at most


def scores_within(blocks: DataFrame, vector: DataFrame, ranges: Ranges) -> DataFrame:
    """doc_id, sparse_score of the documents in ``ranges`` with all terms of ``vector``; other blocks aren't read."""
    found = matches(expand(blocks.where(_overlaps(ranges))).where(_within(ranges)), vector)
    return found.select("doc_id", F.round("score", 9).alias("sparse_score"))


def needed_ranges(blocks: DataFrame, vector: DataFrame, k: int) -> Ranges:
    """Ranges of ids that hold the ``k`` best documents. ``vector`` has terms that documents have.

    The cells of the highest bounds are scored first; their kth score rules out every cell whose bound is below it.
    """
    needed = vector.count()
    cells, low, width = _bounded_cells(blocks, vector, needed)
    if len(cells) > PROBED:
        first = top(scores_within(blocks, vector, merged([c for c, _ in cells[:PROBED]], low, width)), k, "sparse_score", F.col("doc_id")).collect()
        if len(first) == k:
            # sums may differ by rounding
            least = min(r["sparse_score"] for r in first) - 1e-8
            cells = [x for x in cells if x[1] >= least]
    return merged([c for c, _ in cells], low, width) if cells else []


def _asked(blocks: DataFrame, vector: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame] | None:
    """The blocks of the terms that documents have, and these terms; None where nothing can match."""
    terms = vector.collect()
    words = [r["term"] for r in terms if r["df"] is not None]
    if not words or (strict and len(words) < len(terms)):
        return None
    return blocks.where(F.col("term").isin(words)), vector.where(F.col("df").isNotNull())


def block_search(blocks: DataFrame, vector: DataFrame, k: int = 20, strict: bool = False) -> DataFrame:
    """What ``search.sparse_search`` gives for the same postings. The query's few terms reach the driver, and the bounds
    of ``CELLS`` cells at most."""
    asked = _asked(blocks, vector, strict)
    ranges = needed_ranges(*asked, k) if asked and k > 0 else []
    return top(scores_within(*(asked or (blocks, vector)), ranges), k, "sparse_score", F.col("doc_id"))


def scores_of(blocks: DataFrame, vector: DataFrame, doc_ids: list[int], strict: bool = False) -> DataFrame:
    """doc_id, sparse_score of those of a result page's documents that have all terms."""
    asked = _asked(blocks, vector, strict)
    ranges = merged(list(set(doc_ids)), 0, 1) if asked else []
    scored = scores_within(*(asked or (blocks, vector)), ranges)
    return scored.where(F.col("doc_id").isin(doc_ids))
