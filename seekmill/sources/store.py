"""Documents of a page store by id, as a Spark data source.

The store's blocks lie end to end in files; its index has a record of fixed width a document, in the order
of ids, so a task finds an id by halving, without reading more of the index than a few records, and
reads that document's bytes alone. A result page is one plan: its ids are dealt to tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from seekmill.sources.binary import HEADER, SetWriter, store_of
from seekmill.sources.readers import document_of

#: How the index begins, and a record of it.
INDEX_MAGIC = b"OFFS"
RECORD = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("size", "<i8")])
IDS_A_TASK = 4
FOUND = "doc_id long, link string, title string, content string"

Files = list[tuple[str, int, int]]  # path, first byte or record, number of them


@dataclass
class Wanted(InputPartition):
    ids: list[int]
    index: Files
    pages: Files


def _end_to_end(infos: list[fs.FileInfo], width: int) -> Files:
    out, at = [], 0
    for f in sorted(infos, key=lambda f: f.base_name):
        out.append((f.path, at, f.size // width))
        at += f.size // width
    return out


class _Files:
    """Records or bytes of files end to end, each file opened once."""

    def __init__(self, store: fs.FileSystem, files: Files, width: int) -> None:
        self.store, self.files, self.width, self.opened = store, files, width, {}
        self.count = files[-1][1] + files[-1][2] if files else 0

    def read(self, at: int, n: int) -> bytes:
        out = b""
        for path, first, count in self.files:
            if first <= at < first + count:
                if path not in self.opened:
                    self.opened[path] = self.store.open_input_file(path)
                part = min(n, first + count - at)
                out += self.opened[path].read_at(part * self.width, (at - first) * self.width)
                at, n = at + part, n - part
                if not n:
                    break
        return out

    def close(self) -> None:
        for f in self.opened.values():
            f.close()


def find(index: _Files, doc_id: int) -> tuple[int, int] | None:
    """(offset, size) of a document; of equal ids the first record's."""
    low, high = 0, index.count
    while low < high:
        mid = (low + high) // 2
        if struct.unpack("<q", index.read(mid, 1)[:8])[0] < doc_id:
            low = mid + 1
        else:
            high = mid
    if low == index.count:
        return None
    found, offset, size = struct.unpack("<qqq", index.read(low, 1))
    return (offset, size) if found == doc_id else None


class StoreReader(DataSourceReader):
    def __init__(self, path: str, ids: list[int]) -> None:
        self.path, self.ids = path, sorted(set(ids))

    def partitions(self) -> list[Wanted]:
        store, root = store_of(self.path)
        listed = lambda name: [f for f in store.get_file_info(fs.FileSelector(f"{root}/{name}")) if f.type == fs.FileType.File]
        files = listed("index")
        head = next((f for f in files if f.base_name == HEADER), None)
        if head is None:
            raise FileNotFoundError(f"{self.path} has no index")
        index = _end_to_end([f for f in files if f.base_name.startswith("1-")], RECORD.itemsize)
        with store.open_input_file(head.path) as f:
            magic, count = struct.unpack("<4sQ", f.read(12))
        if magic != INDEX_MAGIC or count != sum(n for _, _, n in index):
            raise ValueError(f"the index of {self.path} is damaged")
        pages = _end_to_end([f for f in listed("pages") if f.base_name.startswith("part-")], 1)
        return [Wanted(self.ids[at : at + IDS_A_TASK], index, pages) for at in range(0, len(self.ids), IDS_A_TASK)] or [Wanted([], [], [])]

    def read(self, partition: Wanted) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        index, pages = _Files(store, partition.index, RECORD.itemsize), _Files(store, partition.pages, 1)
        rows = []
        for doc_id in partition.ids:
            at = find(index, doc_id)
            block = document_of(pages.read(*at).decode()) if at else None
            if block:
                rows.append([doc_id, block["link"], block["title"], block["content"]])
        index.close(), pages.close()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "link", "title", "content"])


def _pack(batch: pa.RecordBatch) -> tuple[dict[str, bytes], int, None]:
    records = np.zeros(batch.num_rows, RECORD)
    for c in RECORD.names:
        records[c] = batch.column(batch.schema.get_field_index(c)).to_numpy()
    return {"1-records": records.tobytes()}, batch.num_rows, None


class StoreFiles(DataSource):
    """``seekmill_store``: reads the documents of the option ``ids`` (separated by commas); writes the index, from rows of
    doc_id, offset, size in the order of ids."""

    @classmethod
    def name(cls) -> str:
        return "seekmill_store"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(self.options["path"], [int(x) for x in self.options.get("ids", "").split(",") if x])

    def writer(self, schema: StructType, overwrite: bool) -> SetWriter:
        return SetWriter(self.options["path"], overwrite, ["1-records"], _pack, lambda n, _: struct.pack("<4sQ", INDEX_MAGIC, n))


def read_documents(spark: SparkSession, store: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, link, title, content of a page's documents; those that the store lacks have no row."""
    spark.dataSource.register(StoreFiles)
    return spark.read.format(StoreFiles.name()).option("ids", ",".join(map(str, doc_ids))).load(store)


def write_index(offsets: DataFrame, store: str) -> None:
    """The index of a store from doc_id, offset, size; rows without an id have none."""
    offsets.sparkSession.dataSource.register(StoreFiles)
    rows = offsets.where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "offset", "size")
    rows.repartitionByRange("doc_id", "offset").sortWithinPartitions("doc_id", "offset").write.format(StoreFiles.name()).mode("overwrite").save(f"{store}/index")
