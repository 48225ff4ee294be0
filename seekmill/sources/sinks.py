"""Writers: Parquet laid out for its readers, and result JSON."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.operators.trie import preorder, trie_rows
from seekmill.sources.binary import TRIE_MAGIC, TRIE_VERSION, VECTOR_MAGIC, register, vector_record
from seekmill.sources.shared import checkpointed
from seekmill.sources.store import write_index


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Range-partitioned and sorted by ``keys``, so filters on them skip row groups (dictionaries by word, postings by term)."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row, as the column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def json_array(df: DataFrame) -> str:
    """A result page (top-k rows) as a JSON array."""
    return "[" + ",".join(r["json"] for r in json_rows(df).collect()) + "]"


def vector_blocks(df: DataFrame) -> DataFrame:
    """Vectors in the binary file layout, one block (a whole file's bytes) a partition: column ``data``.
    Partitions are to be small enough for a cell, so repartition large sets first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim, body = 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n, dim = n + batch.num_rows, values.shape[1]
            records = np.zeros(batch.num_rows, vector_record(dim))
            records["id"], records["v"] = batch.column(0).to_numpy(), values
            body.append(records.tobytes())
        data = struct.pack("<Iii", VECTOR_MAGIC, n, dim) + b"".join(body)
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(pack, "data binary")


def six_digits(weight: Column) -> Column:
    """A weight as text files keep it: six significant digits."""
    return F.format_string("%.5e", weight).cast("double")


def trie_bytes(words: dict[str, int]) -> bytes:
    """The same as one string, of a dictionary that fits the driver; its word list is in the order of ``words``."""
    entries = [(w.encode(), f) for w, f in words.items()]
    head = TRIE_MAGIC + struct.pack("<IQ", TRIE_VERSION, len(entries)) + b"".join(struct.pack("<I", len(w)) + w + struct.pack("<Q", f) for w, f in entries)
    return head + preorder(words)


def write_trie(dictionary: DataFrame, path: str) -> None:
    """A dictionary (word, freq) as a trie snapshot, a set of files that end to end are one: header, word list, then
    the nodes of its trie in preorder, children by character."""
    register(dictionary.sparkSession)
    trie_rows(dictionary).write.format("seekmill_trie").mode("overwrite").save(path)


def page_blocks(df: DataFrame) -> DataFrame:
    """doc_id, block, size: documents in the page store layout with the block's size in bytes. Text is
    escaped, so every block is well-formed."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda tag, c: F.concat(F.lit(f"  <{tag}>"), c, F.lit(f"</{tag}>\n"))
    block = F.concat(F.lit("<doc>\n"), line("id", F.col("doc_id").cast("string")), line("link", safe("link")), line("title", safe("title")), line("content", safe("content")), F.lit("</doc>\n"))
    return df.select("doc_id", block.alias("block")).withColumn("size", F.octet_length("block").cast("long"))


def write_page_store(docs: DataFrame, path: str) -> None:
    """``path``/pages: blocks in doc_id order, whose files end to end are one store; ``path``/offsets: doc_id,
    offset in that store and size, tab-separated; ``path``/index: the same for ``read_documents``. Ranges are written in parallel; a range starts after the
    sizes of those before it, one row a range, which is what is broadcast."""
    ranged = page_blocks(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    blocks = checkpointed(ranged.select("doc_id", "block", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg(F.sum("size").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(whole), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.withColumn("inside", inside).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("offset"), "size")
    # the writer ends each value's line, so a block's own last line end goes
    blocks.sortWithinPartitions("at").select(F.regexp_replace("block", "\n$", "")).write.mode("overwrite").text(f"{path}/pages")
    offsets = checkpointed(offsets)
    write_tsv(offsets.sort("doc_id"), f"{path}/offsets")
    write_index(offsets, path)


def write_postings(index: DataFrame, path: str) -> None:
    """Lines of term, then doc_id and weight (six significant digits) of each document in ascending order, tab-separated."""
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", six_digits(F.col("weight")).alias("weight"))))
    fields = F.flatten(F.transform("postings", lambda p: F.array(p["doc_id"].cast("string"), p["weight"].cast("string"))))
    lines = index.groupBy("term").agg(pairs.alias("postings")).select("term", F.array_join(F.concat(F.array("term"), fields), "\t").alias("line"))
    lines.repartitionByRange("term").sortWithinPartitions("term").select("line").write.mode("overwrite").text(path)


def write_character_index(lists: DataFrame, path: str) -> None:
    """Lines of a character (``ch``), then its ``words``, tab-separated, in ascending order."""
    lines = lists.select("ch", F.array_join(F.concat(F.array("ch"), "words"), "\t").alias("line"))
    lines.repartitionByRange("ch").sortWithinPartitions("ch").select("line").write.mode("overwrite").text(path)
