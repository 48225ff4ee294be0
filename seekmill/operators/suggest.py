"""Query suggestions: words that begin with the query, then words within a few edits of it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.functions.text import max_distance
from seekmill.sources.shared import written


def by_prefix(dictionary: DataFrame, query: str, k: int = 5) -> DataFrame:
    """word, freq of the most frequent words that start with ``query``; a word of several lists has the
    English frequency. The predicate reaches a word-sorted Parquet file."""
    starting = dictionary.where(F.col("word").startswith(query))
    if "lang" in dictionary.columns:
        starting = starting.groupBy("word").agg(F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("freq"))), F.max("freq")).alias("freq"))
    return starting.select("word", "freq").orderBy(F.desc("freq"), "word").limit(max(k, 0))


def corrections(dictionary: DataFrame, query: str, k: int = 5, order: str = "intended") -> DataFrame:
    """word, freq, dist of words within the edits that the query's length allows. ``order``: ``intended``
    (nearest first, then frequent) or ``reference`` (farthest first, then frequent, then last word)."""
    most = 1 if len(query) <= 2 else 2 if len(query) <= 5 else 3
    near = dictionary.where(F.abs(F.length("word") - len(query)) <= most).withColumn("dist", F.levenshtein("word", F.lit(query), most)).where(F.col("dist") >= 0)
    keys = {"intended": ["dist", F.desc("freq"), "word"], "reference": [F.desc("dist"), F.desc("freq"), F.desc("word")]}[order]
    return near.select("word", "freq", "dist").orderBy(*keys).limit(max(k, 0))


def suggest(dictionary: DataFrame, query: str, k: int = 5, order: str = "intended") -> DataFrame:
    """word, freq, type (``prefix`` or ``correction``). Corrections fill what prefixes leave; those that
    are prefix results already drop out after the limit, so there can be fewer than ``k``."""
    first = by_prefix(dictionary, query, k)
    left = k - first.count() if query else 0
    out = first.where(F.lit(bool(query))).select("word", "freq", F.lit("prefix").alias("type"))
    if left <= 0:
        return out
    more = corrections(dictionary, query, left, order).join(F.broadcast(first.select("word")), "word", "left_anti")
    return out.unionByName(more.select("word", "freq", F.lit("correction").alias("type")))


def best(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """``hits`` with ``rank``, the ``k`` first of each query. Every task keeps its own ``k`` a query before they meet, so
    a query that most rows hit is no hot group."""
    by = Window.partitionBy("query").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(k, 0))


def batch_prefix(dictionary: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, word, freq, rank for many queries (column ``query``): the best words of every prefix, as far as the longest query
    goes, then an equi-join. Ranked first, a prefix that most words have brings ``k`` rows a task to it."""
    asked = queries.select("query").where(F.length("query") > 0).distinct()
    longest = asked.agg(F.max(F.length("query")).alias("longest"))  # one row
    words = dictionary.where(F.length("word") > 0).select("word", "freq").crossJoin(F.broadcast(longest)).where(F.col("longest").isNotNull())
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.col("longest"))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    ranked = best(words.select("word", "freq", F.explode(prefixes).alias("query")), k, F.desc("freq"), F.col("word"))
    return ranked.join(asked, "query").select("query", "word", "freq", "rank")


KEYED = 10  # characters of a word that its deletions are made of


def deletions(word: str, most: int) -> set[str]:
    """The texts that the first ``KEYED`` characters give without ``most`` of them or fewer.

    Two words within ``most`` edits share one: what an alignment of both leaves unmatched in two beginnings
    of equal length is no more than its edits on either side.
    """
    begin = word[:KEYED]
    n = len(begin)
    return {"".join(begin[i] for i in kept) for size in range(max(0, n - most), n + 1) for kept in combinations(range(n), size)}


SLOTS = 26  # leading bits of a key that name its bit in the table of the queries' keys
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def hashed_deletions(words: pa.Array, most: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the ``deletions`` of many words: a key is a text's hash, so texts that are equal have equal keys. With
    ``wanted``, a table of 2 ** ``SLOTS`` bits, only keys whose bit is set."""
    begins = pc.utf8_rpad(pc.utf8_slice_codeunits(words, 0, KEYED), KEYED, "\0")
    codes = np.frombuffer("".join(begins.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, KEYED).astype(np.uint64) + np.uint64(1)
    length = np.minimum(pc.utf8_length(words).to_numpy(zero_copy_only=False), KEYED)
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for n, m in {*zip(length.tolist(), most.tolist(), strict=True)}:
        at = np.flatnonzero((length == n) & (most == m))
        columns = codes[at].T
        # texts by how many characters are gone: a character is kept, or goes too
        texts = [(np.full(len(at), FACTOR), 0)]
        for i in range(n):
            texts = [((h ^ (h >> np.uint64(29))) * FACTOR + columns[i], gone) for h, gone in texts] + [(h, gone + 1) for h, gone in texts if gone < m]
        for h, _ in texts:
            if wanted is None:
                rows.append(at), keys.append(h)
            else:
                slot = h >> np.uint64(64 - SLOTS)
                hit = np.flatnonzero(wanted[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                rows.append(at[hit]), keys.append(h[hit])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
    return row[new], key[new]


def _keys(column: str, others: list[str], wanted: np.ndarray | None = None):
    """Rows with a column ``most`` -> a row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, key = hashed_deletions(part.column(column), part.column("most").to_numpy(zero_copy_only=False), wanted)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(part.column(c).take(pa.array(row)) for c in others)], names=["key", *others])

    return run


def _wanted(keys: DataFrame) -> np.ndarray:
    """The table of the bits that keys name: 8 MB, however many there are."""
    slot = F.shiftrightunsigned("key", 64 - SLOTS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - SLOTS}) & 63 AS int))")
    found = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (SLOTS - 6), np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def batch_corrections(dictionary: DataFrame, queries: DataFrame, k: int = 5, order: str = "intended") -> DataFrame:
    """query, word, freq, dist, rank for many queries: what ``corrections`` gives for each. Words and queries meet by an
    equi-join on texts with a few characters deleted, and distances are then computed in full. Of the words' texts only
    those leave their task that a query may have."""
    words = dictionary.where(F.col("word").isNotNull()).select("word", F.col("freq").cast("long").alias("freq"), F.when(F.length("word") <= 2, 2).otherwise(3).alias("most"))
    asked = queries.select("query").where(F.col("query").isNotNull()).distinct().withColumn("most", max_distance(F.col("query")))
    query_keys = written(asked.mapInArrow(_keys("query", ["query", "most"]), "key long, query string, most int"))
    word_keys = words.mapInArrow(_keys("word", ["word", "freq"], _wanted(query_keys)), "key long, word string, freq long")
    met = word_keys.join(query_keys, "key").where(F.abs(F.length("word") - F.length("query")) <= F.col("most"))
    # candidates are verified where they meet, so few of them move to be made distinct
    near = met.withColumn("dist", F.levenshtein("word", "query", 3)).where((F.col("dist") >= 0) & (F.col("dist") <= F.col("most")))
    keys = {"intended": [F.col("dist"), F.desc("freq"), F.col("word")], "reference": [F.desc("dist"), F.desc("freq"), F.desc("word")]}[order]
    return best(near.select("query", "word", "freq", "dist").distinct(), k, *keys)


def levenshtein_pairs(words: DataFrame, query: str) -> DataFrame:
    """word, dist, within: each word's edit distance to ``query`` and whether its length allows it."""
    dist = F.levenshtein("word", F.lit(query))
    return words.select("word", dist.alias("dist"), (dist <= max_distance(F.lit(query))).alias("within"))
