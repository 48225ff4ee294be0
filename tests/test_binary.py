import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from seekmill.operators import trie
from seekmill.sources import binary, readers, sinks


def vectors(spark, n, dim=3, parts=4):
    rows = [(i * 7 - 50, [float(i + d) / 2 for d in range(dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


def whole(path):
    """The files of a set, end to end."""
    return b"".join(f.read_bytes() for f in sorted(path.iterdir()) if not f.name.startswith((".", "_")))


def test_a_file_in_one_and_in_seven_ranges(spark, tmp_path):
    rows, _ = vectors(spark, 60)
    data = struct.pack("<Iii", binary.VECTOR_MAGIC, 60, 3) + b"".join(struct.pack("<i3f", i, *v) for i, v in rows)
    (tmp_path / "v.dat").write_bytes(data)
    for path in (tmp_path / "v.dat", tmp_path):
        for ranges in (None, 1, 7, 500):
            df = binary.read_vectors(spark, str(path), ranges)
            assert sorted((r["vec_id"], list(r["embedding"])) for r in df.collect()) == sorted(rows)
            assert df.rdd.getNumPartitions() == {None: 1, 500: 60}.get(ranges, ranges)
    (tmp_path / "short.dat").write_bytes(data[:-1]), (tmp_path / "magic.dat").write_bytes(b"x" + data), (tmp_path / "tiny.dat").write_bytes(b"abc")
    (tmp_path / "long.dat").write_bytes(data[:4] + struct.pack("<ii", 2, 3) + data[12:])
    assert binary.read_vectors(spark, str(tmp_path), 7).count() == 62
    (tmp_path / "none").mkdir()
    assert binary.read_vectors(spark, str(tmp_path / "none")).collect() == []


def test_a_set_is_one_file_end_to_end(spark, tmp_path):
    rows, df = vectors(spark, 500)
    for _ in range(2):  # the second replaces the first
        binary.write_vectors(df, str(tmp_path / "set"))
        data = whole(tmp_path / "set")
        assert struct.unpack_from("<Iii", data) == (binary.VECTOR_MAGIC, 500, 3) and len(data) == 12 + 500 * 16
        (tmp_path / "one.dat").write_bytes(data)
        for path in ("set", "one.dat"):
            got = readers.read_vectors(spark, str(tmp_path / path), 3).collect()
            assert sorted((r["vec_id"], list(r["embedding"])) for r in got) == sorted(rows)
    assert sum(r["vec_id"] == -50 for r in binary.read_vectors(spark, f"file:{tmp_path}").collect()) == 2
    binary.write_vectors(df.limit(0), str(tmp_path / "empty"))
    assert whole(tmp_path / "empty") == struct.pack("<Iii", binary.VECTOR_MAGIC, 0, 0) and binary.read_vectors(spark, str(tmp_path / "empty")).collect() == []
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").repartition(2, "vec_id")
    with pytest.raises(Exception, match="numbers"):
        binary.write_vectors(odd, str(tmp_path / "odd"))
    with pytest.raises(Exception, match="32 bits"):
        binary.write_vectors(spark.createDataFrame([(1 << 31, [1.0])], "vec_id long, embedding array<float>"), str(tmp_path / "odd"))
    assert not (tmp_path / "odd" / binary.HEADER).exists()


def batch(ids):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[float(i)] for i in ids], pa.list_(pa.float32()))], names=["vec_id", "embedding"])


def test_failed_and_repeated_attempts_leave_no_rows(spark, tmp_path):
    def fails():
        yield batch([1, 2])
        raise OSError("lost executor")

    make = lambda: binary.VectorFiles({"path": str(tmp_path / "set")}).writer(None, True)
    writer = make()
    with pytest.raises(OSError):
        writer.write(fails())
    slow = writer.write(iter([batch([1, 2, 3])]))  # a repeated attempt that ended after another had counted
    good = writer.write(iter([batch([1, 2]), batch([3])]))
    assert len(list((tmp_path / "set").iterdir())) == 3 and slow.files != good.files
    writer.commit([good, writer.write(iter([])), None])
    assert [r["vec_id"] for r in binary.read_vectors(spark, str(tmp_path / "set")).collect()] == [1, 2, 3]
    again = make()  # from here on until the commit the folder is no set
    again.abort([again.write(iter([batch([9])])), None])
    assert not (tmp_path / "set" / binary.HEADER).exists()
    again = make()
    again.commit([again.write(iter([batch([9])]))])
    assert [r["vec_id"] for r in binary.read_vectors(spark, str(tmp_path / "set")).collect()] == [9]
    with pytest.raises(FileExistsError):
        binary.VectorFiles({"path": str(tmp_path / "set")}).writer(None, False)


def brute_nodes(words):
    """Preorder of a trie of nested dictionaries."""
    root = {}
    for w in words:
        at = root
        for ch in w:
            at = at.setdefault(ch, {})
    out, todo = [], [("", "", root)]
    while todo:
        key, path, node = todo.pop()
        if key:
            out.append(struct.pack("<H", len(key.encode())) + key.encode())
        out.append(struct.pack("<BQI", path in words, words.get(path, 0), len(node)))
        todo += [(ch, path + ch, node[ch]) for ch in sorted(node, reverse=True)]
    return b"".join(out)


def brute_file(words):
    entries = [(w.encode(), words[w]) for w in sorted(words)]
    return b"TRIE" + struct.pack("<IQ", 1, len(entries)) + b"".join(struct.pack("<I", len(w)) + w + struct.pack("<Q", f) for w, f in entries) + brute_nodes(words)


def test_preorder_of_small_dictionaries():
    r = random.Random(1)
    for _ in range(300):
        words = {"".join(r.choice("ab增é") for _ in range(r.randrange(6))): r.randrange(1, 99) for _ in range(r.randrange(12))}
        assert trie.preorder(words) == brute_nodes(words)


def test_ranges_settle_nodes_of_earlier_ranges():
    """Cut anywhere, the steps and the stacks' ends name the owner of every node."""
    r = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(25)})
        cuts = [0, *sorted(r.sample(range(1, len(words)), min(4, len(words) - 1))), len(words)]
        steps, before = [], None
        for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
            steps += list(trie.walk(part, before, iter([(w, 1) for w in words[a:b]])))
            before = words[b - 1]
        ends = [(s[1], s[2], s[8], s[9]) for s in steps if s[0] == trie.END]
        at = {(s[1], s[2]): s[3] for s in steps if s[0] == trie.WORD}
        for _, part, _, word, _, shared, of_part, of_seq, _, _ in (s for s in steps if s[0] == trie.WORD):
            if of_part is None:
                of_part, of_seq = max((p, q) for p, q, low, high in ends if p < part and low <= shared <= high)
            first = min((w for w in words if w.startswith(word[:shared])), default=None)
            assert (of_part == trie.ROOT) == (shared == 0) and (shared == 0 or at[of_part, of_seq] == first)


def test_trie_set_against_brute_force(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few words are one range
    r = random.Random(3)
    words = {"".join(r.choice("abcé增") for _ in range(r.randrange(0, 8))): r.randrange(1, 1000) for _ in range(1500)}
    words |= {"x" * 5000: 3, "x" * 4999 + "y": 4, "x" * 17: 5, "y": 2}
    df = spark.createDataFrame([("en", w, f) for w, f in words.items()] + [("cn", "y", 99)], "lang string, word string, freq long").repartition(7)
    sinks.write_trie(df, str(tmp_path / "set"))
    assert whole(tmp_path / "set") == brute_file(words) == sinks.trie_bytes(dict(sorted(words.items())))
    assert len([f for f in (tmp_path / "set").iterdir() if f.name.startswith("1-")]) > 1
    assert {tuple(x) for x in readers.read_trie(spark, str(tmp_path / "set")).collect()} == set(words.items())
    (tmp_path / "one.dat").write_bytes(whole(tmp_path / "set"))
    assert {tuple(x) for x in readers.read_trie(spark, str(tmp_path / "one.dat")).collect()} == set(words.items())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sinks.write_trie(df.limit(0), str(tmp_path / "empty"))
    assert whole(tmp_path / "empty") == brute_file({}) and readers.read_trie(spark, str(tmp_path / "empty")).collect() == []
