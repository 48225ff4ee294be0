"""Near-duplicate documents by SimHash, with the earliest document winning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekmill.functions.text import hamming
from seekmill.sources.shared import checkpointed, discard, written

BITS = 64


def feature_hash(term: Column) -> Column:
    """The first 64 bits of a term's MD5, as a signed number."""
    h = F.md5(term.cast("binary"))
    return F.conv(F.substring(h, 1, 16), 16, -10).cast("long")


def features_wanted(content: Column) -> Column:
    """How many features a content's size in bytes calls for."""
    return F.greatest(F.lit(5), F.least(F.lit(200), F.floor(F.octet_length(content) / 120)))


def integer_weights(counts: DataFrame, n_docs: int) -> DataFrame:
    """doc_id, term, n of term counts as features of a fingerprint, with the TF-IDF weight as a whole number of thousandths of
    count times ``log2(n_docs / df)``, one at least: sums of whole numbers are the same in any order. Terms of all documents,
    which tell none apart, have one."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.greatest(F.lit(1), F.floor(F.col("n") * F.floor(1000 * F.log2(F.lit(float(n_docs)) / F.col("df")) + 1e-6)))
    return counts.join(df, "term").select("doc_id", "term", weight.cast("long").alias("n"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' (hash, weight) lists, 200 or so each -> their fingerprints: a bit is set where its signed weights add up to more than zero."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            lists = part.column(1)
            features = lists.flatten()
            hashes, n = (features.field(c).to_numpy(zero_copy_only=False).astype("<i8") for c in (0, 1))
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            begins = np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()
            sums = np.add.reduceat(np.where(bits, n[:, None], -n[:, None]), begins, axis=0)
            h = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h, pa.int64())], names=["doc_id", "h"])


def simhash(docs: DataFrame, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, h: sign-weighted sums over the terms of greatest ``n`` of each document: its counts, or ``integer_weights``.
    Documents without terms have h = 0."""
    wanted = docs.select("doc_id", features_wanted(F.coalesce(F.col(text_col), F.lit(""))).alias("wanted"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    best = counts.withColumn("k", F.row_number().over(by)).where(F.col("k") <= 200).join(wanted, "doc_id").where(F.col("k") <= F.col("wanted"))
    best = best.select("doc_id", "n", feature_hash(F.col("term")).alias("fh"))
    kind = T.StructType([T.StructField("doc_id", counts.schema["doc_id"].dataType), T.StructField("h", T.LongType())])
    hashed = best.groupBy("doc_id").agg(F.collect_list(F.struct("fh", F.col("n").cast("long").alias("n"))).alias("features")).mapInArrow(_folded, kind)
    return docs.select("doc_id").join(hashed, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit(0)).alias("h"))


def blocks_for(n: int, distance: int = 3, room: int = 4, most: int = 10) -> int:
    """The fewest blocks whose keys are so long that ``n`` even fingerprints leave ``room`` a key at most."""
    fits = (b for b in range(distance + 2, most) if n <= room << BITS * (b - distance) // b)
    return next(fits, most)


def near_pairs(hashes: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs i < j with Hamming distance up to ``distance`` between the first documents of different
    fingerprints, and that distance.

    Of ``blocks`` blocks of bits, at least ``blocks - distance`` agree in such a pair, so an equi-join on
    every choice of that many blocks finds all. More blocks make longer keys, so smaller buckets, and
    more keys; for distance 3 five give ten keys of 25 bits, eight 56 of 40. The default follows the
    number of fingerprints.
    """
    first = hashes.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    if blocks is None:
        first = checkpointed(first)
        blocks = blocks_for(first.count(), distance)
    edges = [round(BITS * b / blocks) for b in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(k).alias("k"), F.col("h").bitwiseAND(F.lit(signed)).alias("v")))
    banded = first.select("doc_id", "h", F.explode(F.array(*keys)).alias("key")).select("doc_id", "h", "key.k", "key.v")
    left, right = banded.alias("l"), banded.alias("r")
    found = left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.doc_id") < F.col("r.doc_id")))
    far = hamming(F.col("l.h"), F.col("r.h"))
    return found.where(far <= distance).select(F.col("l.doc_id").alias("i"), F.col("r.doc_id").alias("j"), far.cast("int").alias("distance")).distinct()


def near_links(hashes: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """``near_pairs``, and for each further document of a fingerprint a row (the fingerprint's first document, it, 0).

    No document is missing and rows grow with documents: two documents are near if their first documents
    are the same or a pair here, whose distance is theirs. Null doc_ids are left out; rows that repeat a
    doc_id and fingerprint are one document.
    """
    held = checkpointed(hashes)
    shared = held.groupBy("h").agg(F.min("doc_id").alias("i"), F.count("*").alias("n")).where(F.col("n") > 1)
    # one row a fingerprint, which may have very many documents: a join by merging can split those
    members = held.join(shared.hint("merge"), "h").where(F.col("i") < F.col("doc_id")).select("i", F.col("doc_id").alias("j"), F.lit(0).alias("distance")).distinct()
    return near_pairs(held, distance, blocks).unionByName(members)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order of (j, i) -> the j that stay: those whose lower neighbours all went."""
    gone: set[int] = set()
    now, stays = None, True
    for batch in batches:
        kept = []
        for i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if j != now:
                if now is not None:
                    kept.append(now) if stays else gone.add(now)
                now, stays = j, True
            stays = stays and i in gone
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["doc_id"])
    if now is not None and stays:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], names=["doc_id"])


def keep_first(hashes: DataFrame, distance: int = 3, blocks: int | None = None, local: int = 1 << 20) -> DataFrame:
    """doc_id of the documents that stay: in id order, a document goes if one that stays is near.

    Documents of equal fingerprint stand or fall with the first of them, so only first ones are
    compared. A document is decided once all its lower neighbours are: each round keeps those whose
    lower neighbours all went, then drops their neighbours. Once ``local`` edges or fewer are open, one
    task walks them in order, so a long chain of neighbours takes no long row of rounds.
    """
    hashes = checkpointed(hashes)
    edges = checkpointed(near_pairs(hashes, distance, blocks).select("i", "j"))
    first = hashes.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kept = first.join(edges.select(F.col("j").alias("doc_id")).distinct(), "doc_id", "left_anti")
    newly, open_edges = kept, edges
    former: list[DataFrame] = []  # of the round before, whose tables no later one reads
    while open_edges.count() > local:
        gone = open_edges.join(newly.select(F.col("doc_id").alias("i")), "i", "left_semi").select("j").distinct()
        # edges from or to a dropped document decide nothing any more
        left = open_edges.join(gone, "j", "left_anti").join(gone.select(F.col("j").alias("i")), "i", "left_anti")
        waiting = open_edges.select("j").distinct().join(gone, "j", "left_anti")
        newly = written(waiting.join(left.select("j").distinct(), "j", "left_anti").select(F.col("j").alias("doc_id")))
        open_edges, kept = written(left), written(kept.unionByName(newly))
        discard(*former)
        former = [newly, open_edges, kept]
    last = open_edges.repartition(1).sortWithinPartitions("j", "i").mapInArrow(_walk, "doc_id long")
    return kept.unionByName(last)


def renumbered(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``docs`` with new_id 1..n in source order: ranges are sorted in parallel, and a range starts after
    the counts of those before it (one row a range is broadcast)."""
    ranged = checkpointed(docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_inside": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(base), "_part").withColumn("new_id", F.col("_base") + F.col("_inside") + 1).drop("_at", "_part", "_inside", "_base")
