"""Data sources for the binary files of the older formats: vectors and trie snapshots.

Files are read in byte ranges, a task each, so a large file is many tasks and none is held whole. They are
written as sets: each task writes parts of its own, and the commit, which knows which attempts of
tasks count, writes the header with the total last. A folder without a header is no set, and the parts
of failed attempts are deleted. In name order the parts end to end are one file of the format.

Paths are URIs that Arrow's file systems know (local ones, hdfs, s3, gs). Files with another magic or
version, and those shorter than their header says, give no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: How the files begin.
VECTOR_MAGIC, TRIE_MAGIC, TRIE_VERSION = 0x44454D42, b"TRIE", 1
HEADER = "0-header"
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
VECTORS, WORDS = "vec_id long, embedding array<float>", "word string, freq long"


def vector_record(dim: int) -> np.dtype:
    return np.dtype([("id", "<i4"), ("v", "<f4", (dim,))])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[list[fs.FileInfo]]:
    """The files of ``path``, each alone or, of a set, its parts in order. Sets may lie in a folder of files."""
    store, root = store_of(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [[info]]
    found = sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name)
    plain = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    if any(f.base_name == HEADER for f in plain):
        return [plain]
    return [[f] for f in plain if not f.base_name.startswith(("1-", "2-"))] + [s for f in found if f.type == fs.FileType.Directory for s in files_of(_uri(path, f))]


def _uri(path: str, info: fs.FileInfo) -> str:
    return f"{path.rstrip('/')}/{info.base_name}"


@dataclass
class Range(InputPartition):
    """``count`` records from byte ``at`` on of a file; ``dim`` of vectors."""

    file: str
    at: int
    count: int
    dim: int = 0


def _head(store: fs.FileSystem, file: str, size: int) -> bytes:
    with store.open_input_file(file) as f:
        return f.read_at(size, 0)


class VectorReader(DataSourceReader):
    def __init__(self, path: str, ranges: int | None) -> None:
        self.path, self.ranges = path, ranges

    def partitions(self) -> list[Range]:
        store, _ = store_of(self.path)
        out: list[Range] = []
        for parts in files_of(self.path):
            head = _head(store, parts[0].path, 12)
            if len(head) < 12:
                continue
            magic, n, dim = struct.unpack("<Iii", head)
            if magic != VECTOR_MAGIC or n < 0 or dim < 0:
                continue
            size, begin, found = vector_record(dim).itemsize, 12, []
            for p in parts:
                found.append((p.path, begin, (p.size - begin) // size))
                begin = 0
            if sum(count for _, _, count in found) < n:
                continue
            left = n  # what follows the last record is ignored
            for file, at, count in found:
                count = min(count, left)
                left -= count
                step = max(1, -(-count // self.ranges) if self.ranges else RANGE_BYTES // size)
                out += [Range(file, at + k * size, min(step, count - k), dim) for k in range(0, count, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = store_of(self.path)
        record = vector_record(partition.dim)
        step = max(1, CHUNK_BYTES // record.itemsize)
        with store.open_input_file(partition.file) as f:
            for k in range(0, partition.count, step):
                n = min(step, partition.count - k)
                rows = np.frombuffer(f.read_at(n * record.itemsize, partition.at + k * record.itemsize), record)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * partition.dim)
                vectors = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows["v"]).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"].astype(np.int64)), vectors], names=["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    count: int
    meta: int | None


class SetWriter(DataSourceArrowWriter):
    """Parts of a set. ``pack`` turns a batch into (bytes of each section, records, meta); ``header`` gives the
    header of the total and the meta, which all tasks must agree on."""

    def __init__(self, path: str, overwrite: bool, sections: list[str], pack: Callable, header: Callable) -> None:
        self.path, self.sections, self.pack, self.header = path, sections, pack, header
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        if store.get_file_info(f"{root}/{HEADER}").type == fs.FileType.File:
            if not overwrite:
                raise FileExistsError(f"{path} is a set already")
            store.delete_file(f"{root}/{HEADER}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        context = TaskContext.get()
        name = f"{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}"
        files = {s: f"{s}-{name}" for s in self.sections}
        count, meta, out = 0, None, {}
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                data, n, of_batch = self.pack(batch)
                if meta is not None and of_batch != meta:
                    raise ValueError(f"vectors of {meta} and {of_batch} numbers")
                meta, count = of_batch, count + n
                for section, part in data.items():
                    if part:
                        if section not in out:
                            out[section] = store.open_output_stream(f"{root}/{files[section]}")
                        out[section].write(part)
        finally:
            for f in out.values():
                f.close()
        return Written([files[s] for s in out], count, meta)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        done = [m for m in messages if m is not None]
        metas = {m.meta for m in done if m.meta is not None}
        if len(metas) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of {sorted(metas)} numbers")
        kept = {f for m in done for f in m.files}
        for f in store.get_file_info(fs.FileSelector(root)):
            if f.type == fs.FileType.File and f.base_name not in kept:  # of failed attempts, or of the set before
                store.delete_file(f.path)
        with store.open_output_stream(f"{root}/{HEADER}") as f:
            f.write(self.header(sum(m.count for m in done), metas.pop() if metas else None))

    def abort(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.path)
        for m in messages:
            for f in m.files if m else []:
                if store.get_file_info(f"{root}/{f}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{f}")


def _pack_vectors(batch: pa.RecordBatch) -> tuple[dict[str, bytes], int, int]:
    ids, vectors = (batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "embedding"))
    if ids.null_count or vectors.null_count or vectors.flatten().null_count:
        raise ValueError("a vector file has no nulls")
    number, n = ids.to_numpy(), len(ids)
    if ((number < -(1 << 31)) | (number >= 1 << 31)).any():
        raise ValueError("ids of vector files have 32 bits")
    sizes = np.unique(vectors.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and {sizes[1]} numbers")
    records = np.zeros(n, vector_record(int(sizes[0])))
    records["id"], records["v"] = number, vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return {"1-body": records.tobytes()}, n, int(sizes[0])


def _vector_header(n: int, dim: int | None) -> bytes:
    return struct.pack("<Iii", VECTOR_MAGIC, n, dim or 0)


class VectorFiles(DataSource):
    """``seekmill_vectors``: magic, count and dimension, then an id and 32-bit floats a vector."""

    @classmethod
    def name(cls) -> str:
        return "seekmill_vectors"

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options["path"], int(self.options["ranges"]) if "ranges" in self.options else None)

    def writer(self, schema: StructType, overwrite: bool) -> SetWriter:
        return SetWriter(self.options["path"], overwrite, ["1-body"], _pack_vectors, _vector_header)


class TrieReader(DataSourceReader):
    """A word has no place of its own, so a file's word list is streamed by one task; a set's by one a part."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Range]:
        store, _ = store_of(self.path)
        out: list[Range] = []
        for parts in files_of(self.path):
            head = _head(store, parts[0].path, 16)
            if len(head) < 16 or head[:4] != TRIE_MAGIC or struct.unpack_from("<I", head, 4)[0] != TRIE_VERSION:
                continue
            n = struct.unpack_from("<Q", head, 8)[0]
            if len(parts) == 1:
                out.append(Range(parts[0].path, 16, n))
            out += [Range(p.path, 0, -1) for p in parts if p.base_name.startswith("1-")]  # all words of the part
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = store_of(self.path)

        def words() -> Iterator[tuple[str, int]]:
            with store.open_input_stream(partition.file) as f:
                f.read(partition.at)
                k = 0
                while k != partition.count:
                    head = f.read(4)
                    if not head and partition.count < 0:
                        return
                    size = struct.unpack("<I", head)[0]
                    word = f.read(size)
                    yield word.decode("utf-8", "replace"), struct.unpack("<Q", f.read(8))[0]
                    k += 1

        def batch(rows: list[tuple[str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "freq"])

        if partition.count > 0:  # a file that ends early gives no rows, so it is walked once first
            try:
                for _ in words():
                    pass
            except struct.error:
                return
        held: list[tuple[str, int]] = []
        for row in words():
            held.append(row)
            if len(held) == 10_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


def _pack_trie(batch: pa.RecordBatch) -> tuple[dict[str, bytes], int, None]:
    entries, nodes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("entry", "nodes"))
    return {"1-words": b"".join(e for e in entries if e), "2-nodes": b"".join(nodes)}, sum(e is not None for e in entries), None


def _trie_header(n: int, _: None) -> bytes:
    return TRIE_MAGIC + struct.pack("<IQ", TRIE_VERSION, n)


class TrieFiles(DataSource):
    """``seekmill_trie``: magic, version and number of words, the words with their frequencies, then the nodes. Reads
    words; writes the columns ``entry`` (a word of the list) and ``nodes`` in the order of their rows."""

    @classmethod
    def name(cls) -> str:
        return "seekmill_trie"

    def schema(self) -> str:
        return WORDS

    def reader(self, schema: StructType) -> TrieReader:
        return TrieReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SetWriter:
        return SetWriter(self.options["path"], overwrite, ["1-words", "2-nodes"], _pack_trie, _trie_header)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)
    spark.dataSource.register(TrieFiles)


def read_vectors(spark: SparkSession, path: str, ranges: int | None = None) -> DataFrame:
    """vec_id, embedding of a vector file, a set, or a folder of them. ``ranges``: tasks a file; else one for each 64 MB."""
    register(spark)
    reader = spark.read.format(VectorFiles.name())
    return (reader if ranges is None else reader.option("ranges", ranges)).load(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """vec_id, embedding as a set of vector files."""
    register(vectors.sparkSession)
    rows = vectors.selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(embedding AS ARRAY<FLOAT>) AS embedding")
    rows.write.format(VectorFiles.name()).mode("overwrite").save(path)


def read_trie(spark: SparkSession, path: str) -> DataFrame:
    """word, freq: the word lists of trie snapshots."""
    register(spark)
    return spark.read.format(TrieFiles.name()).load(path)
