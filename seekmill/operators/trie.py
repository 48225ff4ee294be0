"""The nodes of a dictionary's trie in preorder, from a sorted word list and without a tree.

A word adds the nodes of its prefixes beyond what it shares with the word before it, and one child to
the node where they part. That node belongs to the last word before it that added a node of that depth:
words are ranged, a task walks its range with a stack of (word, depths), and what it can't find there is
settled by the ends of the stacks of earlier ranges, a few rows a range (no more than a word is long).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekmill.sources.shared import checkpointed

ROOT = -1  # the range of the root, before all others
STEPS = "kind int, part int, seq long, word string, freq long, shared int, of_part int, of_seq long, low int, high int"
WORD, END = 0, 1


def common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def walk(part: int, before: str | None, words: Iterator[tuple[str, int]]) -> Iterator[tuple]:
    """Rows of ``STEPS``: a word's owner of the node it parts from (null if an earlier range has it), then the stack's end."""
    stack: list[list[int]] = []  # (word, least depth, greatest depth) of the nodes on the last word's path that were added here
    last = before or ""
    for seq, (word, freq) in enumerate(words):
        shared = common(last, word)
        while stack and stack[-1][1] > shared:
            stack.pop()
        if stack:
            stack[-1][2] = min(stack[-1][2], shared)
        owner = (ROOT, 0) if shared == 0 else (part, stack[-1][0]) if stack else (None, None)
        yield WORD, part, seq, word, freq, shared, *owner, None, None
        stack.append([seq, shared + 1, len(word)])
        last = word
    for seq, low, high in stack:
        yield END, part, seq, None, None, None, None, None, low, high


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in STEPS.split(", ")]
    at: dict[str, object] = {}

    def words() -> Iterator[tuple[str, int]]:
        for batch in batches:
            for part, before, word, freq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at.setdefault("part", part)
                at.setdefault("before", before)
                yield word, freq

    rows = words()
    first = next(rows, None)
    if first is None:
        return

    def every() -> Iterator[tuple[str, int]]:
        yield first
        yield from rows

    out: list[tuple] = []
    for step in walk(at["part"], at["before"], every()):
        out.append(step)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def node_bytes(word: str, freq: int, shared: int, children: dict[int, int]) -> bytes:
    """The nodes that a word adds: each after its character, with its word's frequency and number of children."""
    out = []
    for depth in range(shared + 1, len(word) + 1):
        key, ends = word[depth - 1].encode(), depth == len(word)
        out.append(struct.pack("<H", len(key)) + key + struct.pack("<BQI", ends, freq if ends else 0, (not ends) + children.get(depth, 0)))
    return b"".join(out)


def root_bytes(ends: bool, freq: int, children: int) -> bytes:
    return struct.pack("<BQI", ends, freq, children)


def preorder(words: dict[str, int]) -> bytes:
    """The nodes of a small dictionary, by one walk."""
    steps = list(walk(0, None, iter(sorted((w, f) for w, f in words.items() if w))))
    children: dict[tuple[int, int], dict[int, int]] = {}
    for _, _, _, word, _, shared, of_part, of_seq, _, _ in steps:
        if word is not None:
            own = children.setdefault((of_part, of_seq), {})
            own[shared] = own.get(shared, 0) + 1
    nodes = [node_bytes(s[3], s[4], s[5], children.get((0, s[2]), {})) for s in steps if s[3] is not None]
    return root_bytes("" in words, words.get("", 0), children.get((ROOT, 0), {}).get(0, 0)) + b"".join(nodes)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            entries, nodes = [], []
            for r in batch.slice(at, 1000).to_pylist():
                children = {c["depth"]: c["n"] for c in r["children"] or []}
                name = None if r["word"] is None else r["word"].encode()
                entries.append(None if name is None else struct.pack("<I", len(name)) + name + struct.pack("<Q", r["freq"]))
                if r["part"] == ROOT:
                    nodes.append(root_bytes(name is not None, r["freq"] or 0, children.get(0, 0)))
                else:
                    nodes.append(node_bytes(r["word"], r["freq"], r["shared"], children))
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.binary()), pa.array(nodes, pa.binary())], names=["entry", "nodes"])


def trie_rows(dictionary: DataFrame) -> DataFrame:
    """word, freq -> entry, nodes: a row for the root, then one a word in ascending order, with its place in the word list and
    the bytes of the nodes that it adds. A word of several lists counts once, as in suggestions."""
    freq = F.max("freq")
    if "lang" in dictionary.columns:
        freq = F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("freq"))), freq)
    once = dictionary.where(F.col("word").isNotNull()).groupBy("word").agg(F.coalesce(freq, F.lit(0)).alias("freq"))
    ranged = once.where(F.col("word") != "").repartitionByRange("word").sortWithinPartitions("word")
    ranged = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    lasts = ranged.groupBy("part").agg(F.max("word").alias("last"))
    lasts = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row a range
    steps = checkpointed(ranged.join(F.broadcast(lasts), "part").select("part", "before", "word", "freq").mapInArrow(_walk, STEPS))

    words, ends = steps.where(F.col("kind") == WORD), steps.where(F.col("kind") == END)
    # a node of this depth on the path to a range was added by the last range before that has one on its stack
    lost = words.where(F.col("of_part").isNull()).select(F.col("part").alias("lost_part"), F.col("shared").alias("depth")).distinct()
    spines = ends.select(F.col("part").alias("end_part"), F.col("seq").alias("end_seq"), "low", "high")
    met = lost.join(spines, (F.col("end_part") < F.col("lost_part")) & F.col("depth").between(F.col("low"), F.col("high")))
    owners = met.groupBy("lost_part", "depth").agg(F.max(F.struct("end_part", "end_seq")).alias("owner"))
    owned = words.join(owners, (F.col("part") == F.col("lost_part")) & (F.col("shared") == F.col("depth")) & F.col("of_part").isNull(), "left")
    owned = owned.select(F.coalesce("of_part", "owner.end_part").alias("part"), F.coalesce("of_seq", "owner.end_seq").alias("seq"), F.col("shared").alias("depth"))
    children = owned.groupBy("part", "seq", "depth").agg(F.count("*").alias("n")).groupBy("part", "seq").agg(F.collect_list(F.struct("depth", "n")).alias("children"))

    root = once.where(F.col("word") == "").agg(F.max("word").alias("word"), F.max("freq").alias("freq")).select(F.lit(ROOT).alias("part"), F.lit(0).cast("long").alias("seq"), "word", "freq", F.lit(0).alias("shared"))
    rows = root.unionByName(words.select("part", "seq", "word", "freq", "shared")).join(children, ["part", "seq"], "left")
    return rows.repartitionByRange("part", "seq").sortWithinPartitions("part", "seq").select("part", "word", "freq", "shared", "children").mapInArrow(_encode, "entry binary, nodes binary")
