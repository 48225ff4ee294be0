"""Exact top-k inner-product search by a ball tree per shard.

Vectors fall into cells by their nearest pivot, a bounded sample of the vectors, and a cell that is larger than the
average into hash shards; a task builds the ball tree of its shard and then streams queries in
batches. A node's inner products with ``q`` are at most ``q . centre + |q| * radius``, and a leaf's bound is
the least over its ancestors. Each query visits leaves from the highest bound down and stops at the
first that its kth score excludes.

The kth score is shared over shards in two rounds: every query first searches one shard only (its
home); then each cell's ball, one row a cell that all tasks get, gives a bound, and the query goes to the shards
of those cells only whose bound reaches the score of its kth hit at home, along with that score.
Queries are streamed in blocks and not broadcast, so memory is a shard and a batch, however many queries there are.

Components become ``floor(scale * x)``. Where norms allow sums of 2**53 or more, scores are summed as whole
numbers of any size; those beyond a long's range come back as its nearest end.

Cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no
part; rows that share an id count once, with the greatest vector; vectors meet only vectors of equal
length; ties go to the smaller id; queries with fewer than k candidates return all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekmill.llm.storage import materialize

HITS = "query_id long, vec_id long, score long"
LEAF = 128
BATCH = 512
MOST_CELLS = 1024
VECTOR, QUERY = 0, 1
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class BallTree:
    """Leaves as slices of the reordered vectors; every node's centre and radius, root first."""

    ids: np.ndarray
    vectors: np.ndarray
    leaves: list[tuple[int, int]]
    centres: np.ndarray
    radii: np.ndarray
    above: list[list[int]]  # per leaf, itself and its ancestors

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(ids))
        leaves, centres, radii, above = [], [], [], []
        stack = [(0, len(ids), [])]
        while stack:
            lo, hi, path = stack.pop()
            part = vectors[order[lo:hi]]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            node = len(centres)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max())))
            path = [*path, node]
            if hi - lo <= leaf or not away.max():
                leaves.append((lo, hi))
                above.append(path)
                continue
            # two far points; a half goes to each by the difference of its distances
            a = part[away.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(part @ (b - a), kind="stable")
            order[lo:hi] = order[lo:hi][side]
            mid = (lo + hi) // 2
            stack += [(lo, mid, path), (mid, hi, path)]
        return cls(ids[order], vectors[order], leaves, np.array(centres), np.array(radii), above)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with each leaf."""
        norms = np.sqrt((queries**2).sum(axis=1))
        nodes = queries @ self.centres.T + norms[:, None] * self.radii[None, :]
        nodes += 1e-9 * (1 + np.abs(nodes))  # for rounding
        return np.stack([nodes[:, path].min(axis=1) for path in self.above], axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of each query's best ``k`` here with scores of ``floor`` or more."""
        n = len(queries)
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = np.full((n, k), -np.inf)
        who = np.full((n, k), np.iinfo(np.int64).max)
        least = floor.astype(np.float64).copy()
        active = np.arange(n)
        for turn in range(len(self.leaves)):
            leaf = order[active, turn]
            go = bounds[active, leaf] >= least[active]
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by])) + 1
            for group in np.split(by, cuts):
                q = active[group]
                lo, hi = self.leaves[leaf[group[0]]]
                score = queries[q] @ self.vectors[lo:hi].T
                score[self.ids[None, lo:hi] == query_ids[q][:, None]] = -np.inf
                score[score < least[q][:, None]] = -np.inf
                some = np.flatnonzero((score > -np.inf).any(axis=1))
                if not len(some):
                    continue
                q, score = q[some], score[some]
                scores = np.concatenate([best[q], score], axis=1)
                names = np.concatenate([who[q], np.broadcast_to(self.ids[lo:hi], score.shape)], axis=1)
                top = np.lexsort((names, -scores), axis=1)[:, :k]
                best[q] = np.take_along_axis(scores, top, axis=1)
                who[q] = np.take_along_axis(names, top, axis=1)
                least[q] = np.maximum(least[q], best[q, -1])
        row, col = np.nonzero(best > -np.inf)
        return row, who[row, col], np.rint(best[row, col]).astype(np.int64)

    def inexact(self, queries: np.ndarray) -> np.ndarray:
        """Queries some of whose sums here may be 2**53 or more."""
        with np.errstate(over="ignore"):
            longest = np.sqrt((self.vectors**2).sum(axis=1)).max()
            return ~(np.sqrt((queries**2).sum(axis=1)) * longest < 2.0**52)

    def search_whole(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of one query's best ``k``, in whole numbers."""
        q = [int(x) for x in query.tolist()]
        scores = ((sum(a * int(b) for a, b in zip(q, v, strict=True)), i) for i, v in zip(self.ids.tolist(), map(np.ndarray.tolist, self.vectors), strict=True) if i != query_id)
        return [(i, score) for score, i in heapq.nsmallest(k, ((min(max(s, LOW), HIGH), i) for s, i in scores), key=lambda x: (-x[0], x[1]))]


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        trees: dict[int, BallTree] | None = None
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def grown() -> dict[int, BallTree]:
            found: dict[int, list] = {}
            for i, v in zip(ids, vectors, strict=True):
                found.setdefault(v.shape[1], []).append((i, v))
            out = {}
            for dim, parts in found.items():
                name, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                last = np.append(np.diff(name) != 0, True)  # sorted by id and vector
                out[dim] = BallTree.build(name[last], v[last])
            return out

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal trees
            if trees is None:
                trees = grown()
            for dim in {w[1].shape[1] for w in waiting}:
                if dim not in trees:
                    continue
                own = [w for w in waiting if w[1].shape[1] == dim]
                q, v, floor = (np.concatenate([w[i] for w in own]) for i in range(3))
                large = trees[dim].inexact(v)
                row, who, score = trees[dim].search(q[~large], v[~large], k, floor[~large])
                yield pa.RecordBatch.from_arrays([pa.array(q[~large][row]), pa.array(who), pa.array(score)], names=names)
                for at in np.flatnonzero(large).tolist():
                    hits = trees[dim].search_whole(int(q[at]), v[at], k)
                    yield pa.RecordBatch.from_arrays([pa.array([int(q[at])] * len(hits), pa.int64()), pa.array([i for i, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.int64())], names=names)
            waiting.clear()

        for batch in batches:
            shards, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            change = (np.diff(shards) != 0) | (np.diff(tags) != 0) | (np.diff(sizes) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    if waiting:
                        yield from answer()
                    shard, ids, vectors, trees = shards[lo], [], [], None
                part = batch.slice(lo, hi - lo)
                name = part.column(2).to_numpy()
                values = part.column(3).flatten().to_numpy().reshape(hi - lo, -1)
                if tags[lo] == VECTOR:
                    ids.append(name)
                    vectors.append(values)
                else:
                    floor = part.column(4).to_numpy(zero_copy_only=False)
                    for at in range(0, hi - lo, BATCH):
                        waiting.append((name[at : at + BATCH], values[at : at + BATCH], floor[at : at + BATCH]))
                        if sum(len(w[0]) for w in waiting) >= BATCH:
                            yield from answer()
        if waiting:
            yield from answer()

    return run


def _own_task(df: DataFrame, parts: int) -> Column:
    """A value for each shard whose hash deals it to a task of its own among ``parts``."""
    tries = df.sparkSession.range(32 * parts + 64).select(F.col("id").cast("int").alias("x"))
    taken = {r["task"]: r["x"] for r in tries.groupBy(F.pmod(F.hash("x"), F.lit(parts)).alias("task")).agg(F.min("x").alias("x")).collect()}
    return F.get(F.lit([taken.get(i, i) for i in range(parts)]), F.col("shard"))


def _round(vectors: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """Searches ``queries`` (shard, vec_id, v, floor) in their shards."""
    both = vectors.select("shard", F.lit(VECTOR).alias("tag"), "vec_id", "v", F.lit(0.0).alias("floor")).unionByName(queries.select("shard", F.lit(QUERY).alias("tag"), "vec_id", "v", "floor"))
    met = both.repartition(parts, _own_task(both, parts)).sortWithinPartitions("shard", "tag", "vec_id", "v")
    return met.mapInArrow(_search(k), HITS)


@dataclass
class Cells:
    """Pivots of each length of vectors, and of every cell its length, radius, and shards."""

    pivots: dict[int, tuple[int, np.ndarray]]  # length -> first cell, matrix
    dims: np.ndarray
    radii: np.ndarray
    shards: list[list[int]]

    def bounds(self, dim: int, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of each query's inner products with each cell; a cell of vectors of another length has none."""
        out = np.where(self.dims[None, :] == dim, np.inf, -np.inf).repeat(len(queries), axis=0)
        if dim in self.pivots:
            first, pivots = self.pivots[dim]
            at = slice(first, first + len(pivots))
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt((queries**2).sum(axis=1))
                found = queries @ pivots.T + norms[:, None] * self.radii[None, at]
                found += 1e-9 * (1 + np.abs(found))  # for rounding
            out[:, at] = np.where(np.isnan(found), np.inf, found)
        return out


def _nearest(pivots: dict[int, tuple[int, np.ndarray]], others: dict[int, int]):
    """(vec_id, v) -> with the cell of the nearest pivot and the distance from it; lengths without a pivot have a cell of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            cell, away = np.zeros(len(sizes), np.int32), np.full(len(sizes), np.inf)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                if dim not in pivots:
                    cell[at] = others[dim]
                    continue
                first, centres = pivots[dim]
                v = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                for lo in range(0, len(at), BATCH):
                    part = v[lo : lo + BATCH]
                    with np.errstate(over="ignore", invalid="ignore"):
                        squares = (centres**2).sum(axis=1)[None, :] - 2 * (part @ centres.T)
                        best = np.where(np.isnan(squares), np.inf, squares).argmin(axis=1)
                        cell[at[lo : lo + BATCH]] = first + best
                        away[at[lo : lo + BATCH]] = np.sqrt(((part - centres[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(cell), pa.array(away)], names=["vec_id", "v", "cell", "away"])

    return run


def cells_of(rows: DataFrame, lengths: list[int], wanted: int) -> tuple[DataFrame, Cells]:
    """(vec_id, v, shard) of all vectors, an id once, and the cells: ``wanted`` pivots at most, the vectors of lowest hash."""
    spark = rows.sparkSession
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect()
    by_dim: dict[int, list[list[float]]] = {}
    for r in sample:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    pivots, first = {}, 0
    for dim, vs in sorted(by_dim.items()):
        pivots[dim] = first, np.array(vs)
        first += len(vs)
    others = {dim: first + i for i, dim in enumerate(sorted(set(lengths) - set(pivots)))}
    near = materialize(rows.select("vec_id", "v").mapInArrow(_nearest(pivots, others), "vec_id long, v array<double>, cell int, away double"))
    if near.groupBy("vec_id").count().where("count > 1").limit(1).count():
        once = near.groupBy("vec_id").agg(F.max(F.struct("v", "cell", "away")).alias("most"))
        near = materialize(once.select("vec_id", "most.v", "most.cell", "most.away"))
    total = first + len(others)
    stats = {r["cell"]: r for r in near.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    average = -(-sum(r["n"] for r in stats.values()) // max(1, len(sample)))
    shards, at = [], 0
    for c in range(total):
        parts = -(-stats[c]["n"] // average) if c in stats else 0
        shards.append(list(range(at, at + parts)))
        at += parts
    dims = np.zeros(total, np.int64)
    for dim, (low, vs) in pivots.items():
        dims[low : low + len(vs)] = dim
    for dim, c in others.items():
        dims[c] = dim
    cells = Cells(pivots, dims, np.array([stats[c]["radius"] * (1 + 1e-9) if c in stats else 0.0 for c in range(total)]), shards)
    begin, count = (F.get(F.lit(x), F.col("cell")) for x in ([s[0] if s else 0 for s in shards], [max(1, len(s)) for s in shards]))
    return near.select("vec_id", "v", (begin + F.pmod(F.xxhash64("vec_id"), count)).cast("int").alias("shard")), cells


def _elsewhere(shared):
    """Queries (vec_id, v, shard, kth) -> a row for each further shard that may hold a hit of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        shards = [np.array(s, np.int32) for s in cells.shards]
        for batch in batches:
            lists = batch.column(1)
            sizes, home = np.diff(lists.offsets.to_numpy()), batch.column(2).to_numpy()
            floor = batch.column(3).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == dim)
                for lo in range(0, len(every), BATCH):
                    at = every[lo : lo + BATCH]
                    v = lists.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                    go = (cells.dims[None, :] == dim) & (cells.bounds(dim, v) >= floor[at][:, None])
                    rows, to = [], []
                    for i, own in enumerate(go):
                        found = np.concatenate([shards[c] for c in np.flatnonzero(own)] or [np.zeros(0, np.int32)])
                        found = found[found != home[at[i]]]
                        rows += [at[i]] * len(found)
                        to.append(found)
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), batch.column(0).take(take), lists.take(take), batch.column(3).take(take)], names=["shard", "vec_id", "v", "floor"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, shard_rows: int = 1 << 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows where ``is_query`` (a column of the integer ``vec_id``)."""
    spark = vectors.sparkSession
    # doubles of 2**53 or more are whole already, and may be too large for a long
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    v = F.transform(vector_col, lambda x: whole(F.lit(float(scale)) * x.cast("double")))
    raw = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & raw.isNotNull() & (F.size(raw) > 0)
    sound &= F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}
    n, cores = sum(lengths.values()), spark.sparkContext.defaultParallelism
    rows, cells = cells_of(rows, list(lengths), min(MOST_CELLS, max(1, -(-n // shard_rows), min(cores, -(-n // 2048)))))
    parts = max(1, sum(map(len, cells.shards)))
    asked = rows.where(is_query)

    first = materialize(_round(rows, asked.withColumn("floor", F.lit(float("-inf"))), parts, k))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    known = asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    known = known.select("vec_id", "v", "shard", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("floor"))
    rest = known.mapInArrow(_elsewhere(spark.sparkContext.broadcast(cells)), "shard int, vec_id long, v array<double>, floor double")
    hits = first.unionByName(_round(rows, rest, parts, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
