"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row numbers are dense and depend on the rows only: rows fall into ``buckets`` fixed hash buckets,
are numbered by (doc_id, size, crc) in each, and start where the counts of earlier buckets end.
The permutation maps row number ``x`` of ``n`` to ``y``; the shard is ``y % shards`` and the slot
``y // shards``, so counts differ by one at most, slots have no gaps, and ``locate`` computes both
for one row number without data.

Cases: a null text has size 1 and crc 0; null ids are numbered like any value; identical rows are
interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.llm.storage import materialize

PRIME = 2**31 - 1
WALK = 64


def round_keys(seed: int, rounds: int = 6) -> list[tuple[int, int, int]]:
    """Three constants a round from a linear congruential sequence that starts at ``seed``."""
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            row.append(x or 1)
        keys.append(tuple(row))
    return keys


def sides(n: int) -> tuple[int, int]:
    """Radices (a, b) of the Feistel halves: the smallest near-square domain of at least ``n``."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(x, a: int, b: int, keys, div) -> tuple:
    """One pass over the domain a*b, on ints or on columns; ``div`` is the integer division."""
    left, right = div(x, b), x % b
    for i, (k1, k2, k3) in enumerate(keys):
        v = left if i % 2 else right
        mixed = ((v + k1) % PRIME) * ((v * k2 + k3) % PRIME) % PRIME
        if i % 2:
            right = (right + mixed) % b
        else:
            left = (left + mixed) % a
    return left * b + right


def locate(x: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of row number ``x`` among ``n``."""
    a, b = sides(n)
    keys = round_keys(seed)
    y = permute(x, a, b, keys, lambda p, q: p // q)
    while y >= n:
        y = permute(y, a, b, keys, lambda p, q: p // q)
    return y % shards, y // shards


def _position(x: Column, n: int, seed: int) -> Column:
    """``permute`` with cycle walking as a column: the rounds fold over an array of their constants."""
    a, b = sides(n)
    rounds = F.array(*[
        F.struct(F.lit(bool(i % 2)).alias("odd"), *[F.lit(k).cast("long").alias(f"k{j}") for j, k in enumerate(ks, 1)])
        for i, ks in enumerate(round_keys(seed))
    ])

    def turn(s: Column, k: Column) -> Column:
        v = F.when(k["odd"], s["l"]).otherwise(s["r"])
        mixed = ((v + k["k1"]) % PRIME) * ((v * k["k2"] + k["k3"]) % PRIME) % PRIME
        return F.struct(
            F.when(k["odd"], s["l"]).otherwise((s["l"] + mixed) % a).alias("l"),
            F.when(k["odd"], (s["r"] + mixed) % b).otherwise(s["r"]).alias("r"),
        )

    def once(v: Column) -> Column:
        start = F.struct(F.floor((v - v % b) / b).cast("long").alias("l"), (v % b).alias("r"))
        return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20240229, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, row_number, shard, slot.

    Text is read once and never shuffled; what is shuffled has four integers a row. The table of
    bucket offsets that is broadcast has ``buckets`` rows at most.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    n = rows.count()
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32"))
    numbered = rows.withColumn("inside", inside).join(F.broadcast(starts), "bucket").withColumn("row_number", F.col("first") + F.col("inside") - 1)
    at = numbered.withColumn("y", _position(F.col("row_number"), max(n, 1), seed))
    return at.select("doc_id", "size", "text_crc32", "row_number", (F.col("y") % shards).cast("int").alias("shard"), F.floor((F.col("y") - F.col("y") % shards) / shards).cast("long").alias("slot"))
