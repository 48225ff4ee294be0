import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seekmill.llm import exact_dedup, line_dedup, queries, sharding

SCHEMA = "doc_id long, text string, digest string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, "b"), (5, "long " * 200_000), (6, "é\n\tÀ  "), (7, "é\n\tÀ  ")]


def brute_lines(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line_dedup.key_of(line.encode()).decode()
            if len(k) >= min_chars and i is not None:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            k = line_dedup.key_of(line.encode()).decode()
            keep.append(i is None or len(k) < min_chars or len(held[k]) < min_docs or i == max(held[k]))
        text = "\n".join(x for x, y in zip(lines, keep) if y)
        out.append((i, len(lines), keep.count(False), hashlib.sha256(text.encode()).hexdigest()))
    return out


def run_lines(df, **k):
    out = line_dedup.apply_line_dedup(df, **k)
    return [tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()]


def test_lines_against_brute_force_with_a_hot_line(spark):
    r = random.Random(3)
    pool = [f"{'Word ' * 9}{k}" for k in range(40)] + ["ü" * 39, "ü" * 40, " " * 50, "short"]
    rows = [(i, "\n".join(r.choice(pool) + r.choice(["", " ", "\r", "\t"]) for _ in range(r.randrange(12)))) for i in range(400)]
    rows = [(i, t + "\n" + "THE line that every single document of these has" if i % 2 else t.lower()) for i, t in rows]
    assert sorted(run_lines(frame(spark, rows))) == sorted(brute_lines(rows))


def test_lines_odd_rows(spark):
    line = "x" * 45
    rows = ODD + [(10 + i, f"{line}\n{line}\nown {i}") for i in range(6)] + [(None, line)]
    assert sorted(map(repr, run_lines(frame(spark, rows)))) == sorted(map(repr, brute_lines(rows)))
    assert run_lines(frame(spark, [])) == []


def test_stream_runs_split_anywhere_gives_the_same_answer():
    r = random.Random(5)
    rows = sorted({(bytes([r.choice([1, 1, 1, 2, 3, 4])]), r.randrange(40), 0, p) for p in range(60)}, key=lambda x: (x[0], -x[1], x[3]))
    docs = defaultdict(set)
    for h, d, _, _ in rows:
        docs[h].add(d)
    want = sorted(x for x in rows if len(docs[x[0]]) >= 5 and x[1] != max(docs[x[0]]))
    starts = [i for i in range(1, len(rows)) if rows[i][:2] != rows[i - 1][:2]]
    for _ in range(200):
        cuts = [0, *sorted(r.sample(starts, r.randrange(0, 5))), len(rows)]
        out = [x for a, b in zip(cuts, cuts[1:]) for x in line_dedup.stream_runs(iter(rows[a:b]), 5)]
        total, keeper = Counter(), {}
        for kind, h, d, _, _, n in out:
            if kind == line_dedup.SUMMARY:
                total[h] += n
                keeper[h] = max(keeper.get(h, -1), d)
        got = [x[1:5] for x in out if x[0] == line_dedup.DROP or (x[0] == line_dedup.OPEN and total[x[1]] >= 5 and x[2] != keeper[x[1]])]
        assert sorted(got) == want


def test_bitmaps_round_trip(spark):
    keep = np.ones(21, bool)
    keep[[0, 7, 8, 20]] = False
    assert (line_dedup.unpack_bitmap(21, line_dedup.pack_bitmap(21, np.flatnonzero(~keep))) == keep).all()
    rows = [(i, "\n".join(["z" * 50, f"own {i}"])) for i in range(6)]
    out = {r["doc_id"]: r for r in line_dedup.line_bitmaps(frame(spark, rows)).collect()}
    assert out[5]["keep_bitmap"] is None and out[5]["n_dropped"] == 0
    assert line_dedup.unpack_bitmap(2, bytes(out[0]["keep_bitmap"])).tolist() == [False, True]


def test_exact_dedup_odd_rows_and_heavy_groups(spark):
    rows = ODD + [(100 + i, "hot") for i in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    for tracked in (16, 512):
        out = exact_dedup.exact_dedup(frame(spark, rows), tracked=tracked).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"].hex()) for r in out) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []
    left = exact_dedup.drop_copies(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "digest", "kept"]
    assert {(r["doc_id"], (r["text"] or "")[:9]) for r in left.collect()} == {(2, ""), (3, "a"), (None, "b"), (5, "long long"), (7, "é\n\tÀ  "), (399, "hot")}


def test_drop_copies_leaves_one_row_of_each_text(spark):
    rows = [(1, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (4, None), (4, ""), *[(9, "hot")] * 300, (10, "c")]
    for tracked in (16, 512):
        left = exact_dedup.drop_copies(frame(spark, rows), tracked=tracked)
        assert left.columns == ["doc_id", "text", "digest", "kept"]
        assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter([(3, "a"), (None, "b"), (4, ""), (9, "hot"), (10, "c")])


def test_drop_copies_stands_any_column_name(spark):
    names = ["gone_id", "GONE_DIGEST", "_gone_id", "_gone_digest", "kept", "n", "_kept", "_n", "heavy", "keep_id", "h"]
    rows = [(1, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (5, "c")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", *names])
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    assert Counter(map(tuple, left.collect())) == Counter((*r, *range(len(names))) for r in [(3, "a"), (None, "b"), (5, "c")])


def test_every_digest_above_the_least_share_is_proposed(spark):
    assert exact_dedup.least_share(4096) == 3.5 / 8192 and exact_dedup.least_share(12) == 3.5 / 16
    rows = [f"hot {i % 8}" for i in range(800)] + [f"single {i}" for i in range(400)] + [f"pair {i % 200}" for i in range(400)]
    df = spark.createDataFrame([(x,) for x in rows], "x string").select(F.unhex(F.sha2("x", 256)).alias("digest")).repartition(7)
    want = {r["h"] for r in spark.createDataFrame([(f"hot {i}",) for i in range(8)], "x string").select(F.xxhash64(F.unhex(F.sha2("x", 256))).alias("h")).collect()}
    found = {r["h"] for r in exact_dedup.frequent_digests(df, 128).collect()}  # a share of 1/16 each, where 1/73 is enough
    assert want <= found and len(found) < 73
    assert exact_dedup.frequent_digests(df.limit(0), 128).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_feistel_is_a_permutation(n):
    places = [sharding.locate(x, n, 16, 7) for x in range(n)]
    assert sorted(s + 16 * k for s, k in places) == list(range(n))


def test_shard_rows(spark):
    rows = ODD + [(i, f"t{i % 7}") for i in range(100, 400)]
    out = sharding.shard_rows(frame(spark, rows), 16, 7).collect()
    n = len(rows)
    assert sorted(r["row_number"] for r in out) == list(range(n))
    assert all((r["shard"], r["slot"]) == sharding.locate(r["row_number"], n, 16, 7) for r in out)
    by = Counter(r["shard"] for r in out)
    assert max(by.values()) - min(by.values()) <= 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    again = sharding.shard_rows(frame(spark, rows[::-1]).repartition(7), 16, 7).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert sharding.shard_rows(frame(spark, [])).collect() == []


def test_queries_over_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    got = [tuple(r) for r in queries.op2_line_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(brute_lines(rows))
    out = queries.op8_sharding(spark, sf).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted((x % 16, x // 16) for x in range(len(rows)))
