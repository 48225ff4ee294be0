"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``linear * n + quadratic * n * n`` (attention stays inside a piece).
A document gives full sequences first; what remains of it joins a window of remainders. Each window
opens just enough sequences for its tokens and assigns remainders, longest first, each to the
sequence of lowest cost with room for all of it; where none has room it is cut over the sequences
with most room. So a window pads less than one sequence in total.

Packing works on each input partition as it streams by: nothing is shuffled, no group of documents
meets in one task, and memory is bounded by ``window`` tokens plus one document. Sequence ids hold
the partition's number above ``2**33``, so a repeated task gives the same ids.

Cases: a null or empty text has its end id only; null and repeated doc_ids are documents like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekmill.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[list[tuple[int, int, int]]]:
    """Where each of ``lengths`` (all under ``capacity``) goes: a list of (bin, offset, length) for each.

    Opens ``ceil(sum / capacity)`` bins, so all of it fits. Ties go to the lower bin.
    """
    bins = -(-sum(lengths) // capacity)
    room, cost = np.full(bins, capacity), np.zeros(bins)
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        open_cost = np.where(room >= n, cost, np.inf)
        b = int(open_cost.argmin())
        while n:
            if room[b] < n:
                b = int(room.argmax())
            part = min(n, int(room[b]))
            out[i].append((b, capacity - int(room[b]), part))
            room[b] -= part
            cost[b] += linear * part + quadratic * part * part
            n -= part
    return out


def pack_stream(docs: Iterator[tuple[int | None, bytes]], first_id: int, capacity: int, window: int, linear: float, quadratic: float) -> Iterator[tuple]:
    """(doc_id, little-endian uint32 ids) -> rows of ``PIECES``, sequence ids counting from ``first_id``."""
    next_id = first_id
    held: list[tuple] = []  # doc_id, start, ids, doc_tokens
    tokens = 0

    def flush() -> Iterator[tuple]:
        nonlocal next_id
        lengths = [len(h[2]) // 4 for h in held]
        for (doc, start, ids, total), places in zip(held, assign(lengths, capacity, linear, quadratic), strict=True):
            at = 0
            for b, offset, n in places:
                yield doc, start + at, n, ids[4 * at : 4 * (at + n)], total, next_id + b, offset
                at += n
        next_id += -(-sum(lengths) // capacity)

    for doc, ids in docs:
        total = len(ids) // 4
        full = total // capacity
        for k in range(full):
            yield doc, k * capacity, capacity, ids[4 * k * capacity : 4 * (k + 1) * capacity], total, next_id, 0
            next_id += 1
        if total > full * capacity:
            held.append((doc, full * capacity, ids[4 * full * capacity :], total))
            tokens += total - full * capacity
            if tokens >= window:
                yield from flush()
                held.clear()
                tokens = 0
    yield from flush()


def _pack(path: str, added: bool, end_id: int, capacity: int, window: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, added).ids
        end = np.array([end_id], "<u4").tobytes()

        def docs() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc, ids(text.as_py() or "").tobytes() + end

        out: list[tuple] = []
        for row in pack_stream(docs(), TaskContext.get().partitionId() << 33, capacity, window, linear, quadratic):
            out.append(row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, window: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048, added: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``PIECES`` for all rows of ``docs``; ``ids`` are little-endian unsigned 32-bit. ``added``: see ``tokens``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(tokenizer_path, added, end_id, capacity, window, linear, quadratic), PIECES)
