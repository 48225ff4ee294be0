"""Token ids in ORC files, in ascending document order.

Each file has ``doc_id``, ``first`` (ids before the document in its file), ``n_tokens`` and
``tokens``: integer columns under run-length encoding, stripes that readers can split, row indexes,
and a Bloom filter on ``doc_id``, so a lookup of documents reads few stripes. The texts are
range-partitioned by (doc_id, text hash) before they are encoded, so the sampling of bounds encodes
nothing and a doc_id that many rows share spans files.

Cases: a null or empty text has its end id only; null doc_ids come first; repeated rows are all
written; an empty table writes no documents and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekmill.llm.tokens import encoder

FILE = "doc_id long, first long, n_tokens long, tokens array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
STRIPE = {"orc.stripe.size": str(32 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}


def _encode(path: str, added: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added).ids
        end = np.array([end_id], "<u4")
        before = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t.as_py() or "") for t in part.column(1)]
                n = np.array([len(x) + 1 for x in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = np.concatenate([x for each in ids for x in (each, end)]).view("<i4")
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends[:-1] + before), pa.array(n), tokens.cast(ARROW.field(3).type)], schema=ARROW)
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, added: bool = True, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the files to ``path``. ``added``: see ``tokens``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(_encode(tokenizer_path, added, end_id), FILE).write.options(**STRIPE).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens. A file's base comes from the
    totals of the files before it: one row a file, which is what is broadcast."""
    # files are numbered by their range partition, so in document order
    files = spark.read.schema(FILE).orc(path).withColumn("file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = files.join(F.broadcast(base), "file")
    return out.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "tokens")


@F.arrow_udf(T.LongType())
def tokens_crc32(tokens: pa.Array) -> pa.Array:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    data, ends = memoryview(np.ascontiguousarray(tokens.values, "<i4")).cast("B"), (4 * tokens.offsets.to_numpy()).tolist()
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())
