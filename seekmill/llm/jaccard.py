"""N-gram Jaccard join by MinHash banding, verified on full shingle sets.

1. A pass over the texts gives each document its shingle count, a 128-bit digest of its set and
   ``bands`` band hashes. ``bands_for`` picks rows and bands for a target recall at the threshold.
2. Documents with equal sets become one representative (the least doc_id) with a multiplicity.
3. A shuffle on band hashes finds buckets with several representatives, as one star of edges a
   bucket, and the components of these stars bound who can be linked with whom.
4. Only texts of representatives in such components are read again. Their sets meet by component;
   a component over ``block`` members or ``BLOCK_BYTES`` of sets is dealt by blocks, or by its buckets and
   their blocks where that ships less, so each task holds two blocks at most and every candidate pair meets.
5. A task compares all pairs of its blocks by inverted lists and matrix products and returns per
   document its number of links and one edge of a spanning forest: rows grow with documents, not pairs.

Cases: a null text or one without words has an empty set and links with nothing; null doc_ids are
left out; rows that share a doc_id and text are one; where a doc_id has several texts, all are compared,
the join gives the document the links of all of them, and ``drop_near_copies`` judges each text alone; equal
texts link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekmill.llm.components import connected_components
from seekmill.llm.shingles import SIZE, mix, shingle_set
from seekmill.llm.storage import materialize, unused

SIGNED = "doc_id long, n int, s1 long, s2 long, bands array<long>"
BROADCAST_ROWS, SALTS, BLOCK_BYTES = 1 << 16, 64, 4 << 20
VERIFIED = "rep long, links long, root long, unit long, giant boolean, other long"


def bands_for(threshold: float, recall: float = 0.999, most: int = 216) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, that find a pair at
    ``threshold`` with probability ``recall`` or more within ``most`` hash functions."""
    fits = []
    for rows in range(1, 65):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            fits.append((bands, rows))
    return fits[-1]


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base.astype(np.uint32)[:, None], ((base >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]


def signature(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of a set; the band's number is part of its hash."""
    salt, factor = _functions(bands * rows)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1 << 14):
        x = (h[None, at : at + (1 << 14)] ^ salt) * factor
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(axis=1), out=least)
    parts = least.reshape(bands, rows).astype(np.uint64)
    out = mix(np.arange(bands, dtype=np.uint64))
    for i in range(rows):
        out = mix(out * np.uint64(31) + parts[:, i])
    return out


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, sig = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    s1.append(mix(s).sum(dtype=np.uint64).astype(np.int64))
                    s2.append(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))
                sig.append(signature(s, bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "bands"],
            )

    return run


def _expand(size: int):
    """(doc_id, text, mult, bands, units) -> a row a unit with the document's whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                s = shingle_set(row["text"], size).tobytes()
                units = row["units"]
                k = len(units)
                step = max(1, min(64, (64 << 20) // max(1, len(s))))  # copies of a set in a batch
                for lo in range(0, k, step):
                    part = units[lo : lo + step]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([u["unit"] for u in part], pa.int64()), pa.array([u["bi"] for u in part], pa.int32()), pa.array([u["bj"] for u in part], pa.int32()),
                            pa.array([u["own"] for u in part], pa.int32()), pa.array([u["kind"] for u in part], pa.int32()),
                            pa.array([row["doc_id"]] * m, pa.int64()), pa.array([row["mult"]] * m, pa.int64()), pa.array([s] * m, pa.binary()),
                            pa.array([row["bands"] if u["kind"] == 2 else None for u in part], pa.list_(pa.int64())),
                        ],
                        names=["unit", "bi", "bj", "own", "kind", "rep", "mult", "shingles", "bands"],
                    )

    return run


EXPANDED = "unit long, bi int, bj int, own int, kind int, rep long, mult long, shingles binary, bands array<long>"


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float64)
    if not len(shared):
        return out.astype(np.int64)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return who[hit][order], at[hit][order]

    (wa, pa_), (wb, pb) = places(a, left), places(b, right)
    for lo in range(0, len(shared), columns):
        x, y = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        i, j = np.searchsorted(pa_, [lo, lo + columns])
        x[wa[i:j], pa_[i:j] - lo] = 1
        i, j = np.searchsorted(pb, [lo, lo + columns])
        y[wb[i:j], pb[i:j] - lo] = 1
        out += x @ y.T
    return out.astype(np.int64)


def verify(members: list[dict], threshold: float) -> Iterator[tuple]:
    """All pairs of a task's two blocks (or within its one) -> (rep, links, root of its tree here), and
    each pair with a member of multiplicity 0, which ``links`` leaves out, both ways as (rep, other)."""
    first = [m for m in members if m["own"] == members[0]["bi"]]
    within = members[0]["bi"] == members[0]["bj"]
    second = first if within else [m for m in members if m["own"] == members[0]["bj"]]
    if not first or not second:
        return
    sets = [np.frombuffer(m["shingles"], np.uint64) for m in first], [np.frombuffer(m["shingles"], np.uint64) for m in second]
    common = common_counts(*sets)
    sizes = np.array([len(x) for x in sets[0]])[:, None], np.array([len(x) for x in sets[1]])[None, :]
    linked = (common > 0) & (common >= threshold * (sizes[0] + sizes[1] - common) - 1e-9)
    if within:
        np.fill_diagonal(linked, False)
    if members[0]["kind"] == 2:  # a bucket: a pair counts where its first common band is
        bands = [np.array([m["bands"] for m in x], np.int64) for x in (first, second)]
        unit = members[0]["unit"]
        here = int(np.flatnonzero(bands[0][0] == unit)[0])
        for k in range(here):
            linked &= bands[0][:, k][:, None] != bands[1][:, k][None, :]
    everyone = first if within else first + second
    parent = list(range(len(everyone)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shift = 0 if within else len(first)
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked) if within else linked)), strict=True):
        x, y = find(i), find(j + shift)
        if x != y:
            low, high = sorted((x, y), key=lambda p: everyone[p]["rep"])
            parent[high] = low
    mult = np.array([m["mult"] for m in first]), np.array([m["mult"] for m in second])
    links = [(linked * mult[1][None, :]).sum(axis=1)] if within else [(linked * mult[1][None, :]).sum(axis=1), (linked * mult[0][:, None]).sum(axis=0)]
    met = [linked.any(axis=1)] if within else [linked.any(axis=1), linked.any(axis=0)]
    for i, (m, n, any_) in enumerate(zip(everyone, np.concatenate(links).tolist(), np.concatenate(met).tolist(), strict=True)):
        if any_:
            yield m["rep"], n, everyone[find(i)]["rep"], m["unit"], m["kind"] > 0, None
    apart = linked & ((mult[0] == 0)[:, None] | (mult[1] == 0)[None, :])
    for i, j in zip(*(x.tolist() for x in np.nonzero(apart)), strict=True):
        yield first[i]["rep"], 0, None, first[i]["unit"], False, second[j]["rep"]
        if not within:
            yield second[j]["rep"], 0, None, first[i]["unit"], False, first[i]["rep"]


def _verify(threshold: float):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    names = ["rep", "links", "root", "unit", "giant", "other"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield from batch.slice(at, 64).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[dict] = []
        key = None
        for row in rows(batches):
            now = row["kind"], row["unit"], row["bi"], row["bj"]
            if now != key:
                if group:
                    out += verify(group, threshold)
                group, key = [], now
            group.append(row)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if group:
            out += verify(group, threshold)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _deal(members: DataFrame, unit: str, blocks: str, kind: int) -> DataFrame:
    """A row for each block pair that a member's block is in."""
    own = F.pmod(F.xxhash64("rep", F.lit(kind)), F.col(blocks)).cast("int")
    dealt = members.select("rep", F.col(unit).alias("unit"), F.col(blocks).alias("blocks"), own.alias("own"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    return dealt.select("rep", "unit", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), "own", F.lit(kind).alias("kind"))


def _by_part(rows: DataFrame, giants: DataFrame, count: int, how: str = "inner") -> DataFrame:
    """``rows`` (rep, part) joined with a row a large component. Most rows may be of one component, so they are
    not dealt by it: ``giants`` is broadcast up to a checked number of rows, else each of its rows is sent to many tasks."""
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(giants), "part", how)
    spread = giants.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(spread, ["part", "_salt"], how).drop("_salt")


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _numbered(texts: DataFrame) -> DataFrame:
    """node, doc_id, digest, text, many (whether its doc_id has other texts): a row a distinct doc_id and text, nodes in doc_id order."""
    once = texts.groupBy("doc_id", _digest(F.col("text")).alias("digest")).agg(F.max("text").alias("text"))
    once = materialize(once.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").withColumn("node", F.monotonically_increasing_id()))
    many = once.groupBy("doc_id").agg((F.count("*") > 1).alias("many"))
    return materialize(once.join(many.hint("merge"), "doc_id"))


def _compared(docs: DataFrame, threshold: float, size: int, recall: float, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(doc_id, rep, class_id, n_links, n) of each document; where a doc_id repeats, of each distinct doc_id
    and text under a number as doc_id, with the numbers' names and the linked pairs (rep, other, weight) that
    have a text of a doc_id with several, which n_links leaves out."""
    bands, rows = bands_for(threshold, recall)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    every = materialize(texts.mapInArrow(_sign(bands, rows, size), SIGNED))
    repeated = every.groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > 1).limit(1).count()
    key, mult, names = ["s1", "s2", "n"], F.count("*"), None
    if repeated:
        named = _numbered(texts)
        names, texts = named.select("node", "doc_id", "digest", "many"), named.select(F.col("node").alias("doc_id"), "text")
        every = materialize(texts.mapInArrow(_sign(bands, rows, size), SIGNED))
        # a text of a doc_id with several stands alone, with multiplicity 0
        alone = names.select(F.col("node").alias("doc_id"), F.when(F.col("many"), F.col("node") + 1).otherwise(0).alias("alone"))
        every = materialize(every.join(alone, "doc_id"))
        key, mult = [*key, "alone"], F.sum(F.when(F.col("alone") == 0, 1).otherwise(0))

    sets = every.where(F.col("n") > 0)
    equal = sets.groupBy(*key).agg(F.min("doc_id").alias("rep"), mult.alias("mult"))
    reps = materialize(equal.join(sets.select(F.col("doc_id").alias("rep"), "bands"), "rep"))
    banded = reps.select("rep", "n", F.explode("bands").alias("band"))
    # blocks by members and by bytes of their sets
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") * 8 / BLOCK_BYTES))
    buckets = banded.groupBy("band").agg(F.count("*").alias("c"), F.min("rep").alias("head"), blocks.alias("bb")).where(F.col("c") > 1)
    inside = materialize(banded.join(buckets, "band"))
    parts = connected_components(inside.select(F.col("rep").alias("u"), F.col("head").alias("v")))
    sizes = inside.groupBy("rep").agg(F.max("n").alias("n"))
    parts = materialize(parts.select(F.col("node").alias("rep"), F.col("component").alias("part")).join(sizes, "rep"))
    per_part = parts.groupBy("part").agg(F.count("*").alias("m"), blocks.alias("pb"))
    giants = materialize(per_part.where(F.col("pb") > 1))

    large = giants.count()
    small = _by_part(parts, giants, large, "left_anti")
    units = small.select("rep", F.col("part").alias("unit"), F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("own"), F.lit(0).alias("kind"))
    if large:
        big = _by_part(parts.drop("n"), giants, large)
        by_bucket = inside.join(big, "rep")
        shipped = by_bucket.groupBy("part").agg(F.sum("bb").alias("by_bucket"), F.max("m").alias("m"), F.max("pb").alias("pb"))
        whole = materialize(shipped.select("part", (F.col("m") * F.col("pb") <= F.col("by_bucket")).alias("whole")))
        dense = _by_part(big, whole.where("whole"), large)
        loose = _by_part(by_bucket, whole.where(~F.col("whole")), large)
        units = units.unionByName(_deal(dense, "part", "pb", 1)).unionByName(_deal(loose, "band", "bb", 2))
    wanted = units.groupBy("rep").agg(F.collect_list(F.struct("unit", "bi", "bj", "own", "kind")).alias("units"))
    # one row a representative and its blocks; texts move once, to meet them
    wanted = wanted.join(reps.select("rep", "mult", "bands"), "rep").select(F.col("rep").alias("doc_id"), "mult", "bands", "units")
    shipped = texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "mult", "bands", "units").mapInArrow(_expand(size), EXPANDED)
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = shipped.repartition(count, "kind", "unit", "bi", "bj").sortWithinPartitions("kind", "unit", "bi", "bj", "rep")
    found = materialize(met.mapInArrow(_verify(threshold), VERIFIED))

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min(F.when(~F.col("giant"), F.col("root"))).alias("root"))
    trees = found.where(F.col("giant") & (F.col("rep") != F.col("root"))).select(F.col("rep").alias("u"), F.col("root").alias("v"))
    if trees.limit(1).count():
        joined = connected_components(trees).withColumnsRenamed({"node": "rep", "component": "far"})
        linked = linked.join(joined, "rep", "left").withColumn("root", F.coalesce("far", "root")).drop("far")
    answer = equal.join(linked, "rep", "left")
    others = F.when(F.col("mult") > 0, F.col("mult") - 1).otherwise(0) + F.coalesce(F.col("links"), F.lit(0))
    answer = answer.select(*key, "rep", F.coalesce("root", "rep").alias("class_id"), others.alias("n_links"))
    out = every.select("doc_id", *key).join(answer, key, "left")
    out = out.select("doc_id", "rep", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"))
    if names is None:
        return out, None, None
    pairs = found.where(F.col("other").isNotNull()).select("rep", "other").distinct()
    return out, names, pairs.join(reps.select(F.col("rep").alias("other"), F.col("mult").alias("weight")), "other")


def _by_doc(nodes: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Numbered texts -> documents: links to distinct other documents, classes joined over all texts of a document."""
    nodes = materialize(nodes.withColumnRenamed("doc_id", "node").join(names.select("node", F.col("doc_id"), "many"), "node"))
    several = nodes.where("many")
    least = several.groupBy("doc_id").agg(F.min("class_id").alias("v"))
    joined = connected_components(several.select("doc_id", F.col("class_id").alias("u")).join(least, "doc_id").select("u", "v"))
    nodes = nodes.join(joined.withColumnsRenamed({"node": "class_id", "component": "far"}), "class_id", "left").withColumn("class_id", F.coalesce("far", "class_id"))

    of = several.select("node", "doc_id")
    met = pairs.join(of.select(F.col("node").alias("rep"), F.col("doc_id").alias("own")), "rep", "left").join(of.select(F.col("node").alias("other"), F.col("doc_id").alias("to")), "other", "left")
    met = met.withColumns({"at": F.when(F.col("to").isNull(), F.col("other")), "weight": F.when(F.col("to").isNull(), F.col("weight")).otherwise(1)})
    to_several = met.where(F.col("own").isNull()).select("rep", "to").distinct().groupBy("rep").agg(F.count("*").alias("more"))
    of_several = met.where(F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.col("to"))).select("own", "to", "at", "weight").distinct().groupBy(F.col("own").alias("doc_id")).agg(F.sum("weight").alias("total"))

    docs = nodes.join(to_several, "rep", "left").withColumn("n_links", F.col("n_links") + F.coalesce("more", F.lit(0)))
    docs = docs.groupBy("doc_id").agg(F.min("class_id").alias("node"), F.max("n_links").alias("n_links"), F.max("n_shingles").alias("n_shingles"), F.max("many").alias("many"))
    docs = docs.join(of_several, "doc_id", "left").withColumn("n_links", F.when(F.col("many"), F.coalesce("total", F.lit(0))).otherwise(F.col("n_links")))
    return docs.join(names.select("node", F.col("doc_id").alias("class_id")), "node").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "n_shingles")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, size: int = SIZE, recall: float = 0.999, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id linked with it, over any number of
    links), n_links (other documents of similarity ``threshold`` or more), n_shingles (of several texts, the most)."""
    out, names, pairs = _compared(docs, threshold, size, recall, block, id_col, text_col)
    return out.drop("rep") if names is None else _by_doc(out, names, pairs)


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, size: int = SIZE, recall: float = 0.999, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the least doc_id of each class; rows with null ids stay; columns as they were. Where a
    doc_id repeats, its texts are judged one by one."""
    nodes, names, _ = _compared(docs, threshold, size, recall, block, id_col, text_col)
    gone_id, gone_digest = unused(docs, "gone_id", "gone_digest")
    gone = nodes.where(F.col("class_id") != F.col("doc_id")).select(F.col("doc_id").alias(gone_id))
    # what goes grows with the documents, so it is never broadcast, however little it is here
    if names is None:
        return docs.join(gone.hint("merge"), docs[id_col] == gone[gone_id], "left_anti")
    gone = gone.join(names, gone[gone_id] == names["node"]).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest))
    return docs.join(gone.hint("merge"), (docs[id_col] == gone[gone_id]) & (_digest(docs[text_col]) == gone[gone_digest]), "left_anti")
