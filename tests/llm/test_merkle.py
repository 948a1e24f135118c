import hashlib
import zlib

import pytest
from llm_cases import empty, frame, rows
from pyspark.sql import functions as F

from tieline.llm import merkle
from tieline.llm.common import ranked


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, path of each node) by rolling up lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // merkle.FAN * merkle.FAN
            p.append(("".join(nodes[run : at[i]]), "".join(nodes[at[i] + 1 : run + merkle.FAN])))
        at = [a // merkle.FAN for a in at]
        nodes = [sha("".join(nodes[i : i + merkle.FAN])) for i in range(0, len(nodes), merkle.FAN)]
    return nodes[0], paths


def plain(data):
    """Sorted (doc_id, source, leaf, subroot, root, path) of the rows."""
    groups = {}
    for r in data:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf((r[0], r[3], r[2], r[4], r[1])), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            out.append((x[3], s, x[2], trees[s][0], root, tuple(path + top)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple(tuple(p) for p in r.path)) for r in df.collect()), key=repr)


def many():
    """Sources of 1, 2, 15, 16, 17, 256, 257 and 700 rows, and 40 of one row each."""
    data = rows()
    for n in (1, 2, 15, 16, 17, 256, 257, 700):
        data += [(10_000 * n + i, "text %d" % i, "en", "of%d" % n, i) for i in range(n)]
    return data + [(-i, "x", None, "single%d" % i, None) for i in range(40)]


@pytest.mark.parametrize("depth", [3, 2, 1])
def test_against_plain_python(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)  # 1 and 2: several stages of blocks
    data = many() if depth < 3 else many()[:400]
    assert found(merkle.manifest(frame(spark, data).repartition(5))) == plain(data)


def test_few_rows(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    for data in (rows()[:1], [(None, None, None, None, None)] * 20, [(1, "a", "en", "s", 1)] * 300):
        assert found(merkle.manifest(frame(spark, data))) == plain(data)


def test_tampering_shows(spark):
    data = [(i, "Text With Capitals %d" % i if i % 3 else "small %d" % i, "en", "s%d" % (i % 4), 9) for i in range(300)] + [(None, "A", "en", "s1", 1), (500, None, "en", "s1", 1)]
    got = merkle.manifest(frame(spark, data), merkle.tampered(F.col("text")))
    got = got.withColumn("folded", merkle.folded(F.col("seen"), F.col("path"))).collect()
    text = {r[0]: r[1] for r in data}
    changed = {d for d, t in text.items() if d is not None and t != (t and t.lower()) and zlib.crc32(str(d).encode()) % 5 == 0}
    assert 10 < len(changed) < 200
    assert {r.doc_id for r in got if r.folded != r.root} == changed
    assert all((r.leaf != r.seen) == (r.doc_id in changed) for r in got)


def test_ranks_of_equal_rows_are_spread_over_ranges(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.lit(1).alias("k"))
    got = ranked(df, ["g"], ["k"])
    assert sorted(r["rank"] for r in got.collect()) == list(range(5000)) and {r.total for r in got.collect()} == {5000}
