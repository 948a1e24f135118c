"""Versions of the warehouse: all or nothing, pinned readers, untouched files, conflicts, compaction and vacuum; merges of repeated keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tieline.operators import merge as m
from tieline.plans import versions, warehouse as wh
from tieline.plans.warehouse import Warehouse


def tags(spark, rows):
    return spark.createDataFrame([(w, k, t) for w, k, t in rows], "ws string, tag_key string, tag string")


def held(house):
    return sorted(tuple(r) for r in house.read("tags").select("ws", "tag_key", "tag").collect())


def files(house):
    return {os.path.join(d, f) for d, _, names in os.walk(house.path("tags")) for f in names if f.endswith(".parquet")}


def test_a_failure_before_the_swap_changes_nothing(spark, folder):
    house = Warehouse(spark, folder + "/w", buckets=2)
    house.merge("tags", tags(spark, [("a", "x", "X"), ("b", "y", "Y")]))
    before, version = held(house), house.log.latest()
    with pytest.raises(RuntimeError, match="power"):
        with house.transaction():
            house.merge("tags", tags(spark, [("a", "z", "Z")]))
            assert len(held(house)) == 3  # inside, the change is seen
            raise RuntimeError("power")
    assert held(house) == before and house.log.latest() == version
    house.merge("tags", tags(spark, [("a", "z", "Z")]))
    assert len(held(house)) == 3


def test_readers_keep_their_version(spark, folder):
    house = Warehouse(spark, folder + "/w", buckets=2)
    house.merge("tags", tags(spark, [("a", "x", "X")]))
    reader, frame, old = house.pinned(), house.read("tags"), held(house)
    house.merge("tags", tags(spark, [("a", "x2", "X2")]))
    house.replace("tags", tags(spark, [("a", "only", "O")]))
    assert held(reader) == old and sorted(tuple(r) for r in frame.collect()) == old
    assert held(house) == [("a", "only", "O")]
    with pytest.raises(ValueError, match="read-only"):
        reader.merge("tags", tags(spark, [("a", "x", "X")]))


def test_other_workspaces_files_stay(spark, folder):
    house = Warehouse(spark, folder + "/w", buckets=1)
    house.merge("tags", tags(spark, [(f"w{i}", "x", "X") for i in range(50)]))
    before = {f: os.stat(f).st_mtime_ns for f in files(house)}
    house.merge("tags", tags(spark, [("w7", "new", "N")]))
    after = files(house)
    assert before.keys() <= after and all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    added = spark.read.parquet(*(after - before.keys()))
    assert {r.ws for r in added.collect()} == {"w7"} and len(held(house)) == 51


def test_random_changes_against_a_dict(spark, folder, monkeypatch):
    monkeypatch.setattr(wh, "MAX_FOLDERS", 3)
    rng, house, want = random.Random(5), Warehouse(spark, folder + "/w", buckets=2), {}
    for step in range(12):
        rows = [(f"w{rng.randrange(6)}", f"k{rng.randrange(8)}", f"t{step}") for _ in range(4)]
        rows = list({r[:2]: r for r in rows}.values())
        gone = f"w{rng.randrange(6)}"
        with house.transaction():
            house.merge("tags", tags(spark, rows))
            for w, k, t in rows:
                want.setdefault((w, k), t)  # tags keep their first spelling
            if step % 4 == 3:
                house.put("tags", house.read("tags").limit(0), spark.createDataFrame([(gone,)], "ws string"))
                want = {k: t for k, t in want.items() if k[0] != gone}
        assert held(house) == sorted((*k, t) for k, t in want.items())
    assert all(len(e["folders"]) <= 3 for e in house._state()["tables"]["tags"].values())
    folders = len(os.listdir(house.path("tags")))
    assert house.vacuum(keep=1, older_than_hours=24) == 0  # nothing is that old
    assert house.vacuum(keep=1, older_than_hours=0) > 0 and len(os.listdir(house.path("tags"))) < folders
    assert held(house) == sorted((*k, t) for k, t in want.items()) and house.log.versions() == [house.log.latest()]


def test_writers_of_other_buckets_both_commit(spark, folder):
    house, other = (Warehouse(spark, folder + "/w", buckets=64) for _ in range(2))
    house.merge("tags", tags(spark, [("a", "x", "X"), ("b", "x", "X")]))
    with house.transaction():
        house.merge("tags", tags(spark, [("a", "y", "Y")]))
        other.merge("tags", tags(spark, [("b", "y", "Y")]))
    assert held(house) == [("a", "x", "X"), ("a", "y", "Y"), ("b", "x", "X"), ("b", "y", "Y")]
    with pytest.raises(versions.Conflict):
        with house.transaction():
            house.merge("tags", tags(spark, [("a", "z", "Z")]))
            other.merge("tags", tags(spark, [("a", "w", "W")]))
    assert ("a", "w", "W") in held(house) and ("a", "z", "Z") not in held(house)


def test_a_version_that_is_still_written_is_not_read(spark, folder):
    house = Warehouse(spark, folder + "/w", buckets=1)
    house.merge("tags", tags(spark, [("a", "x", "X")]))
    with open(f"{house.root}/_log/{house.log.latest() + 1:012d}.json", "w") as f:
        f.write('{"seq": 1, "tab')
    assert house.log.latest() == 1 and held(house) == [("a", "x", "X")]
    with pytest.raises(versions.Conflict, match="being written"):
        house.merge("tags", tags(spark, [("a", "y", "Y")]))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_keys_merge_as_rows_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    rules = {"new": m.PREFER_NEW, "old": m.PREFER_OLD, "kept": m.KEEP, "put": m.REPLACE, "either": m.EITHER, "most": m.LARGEST, "total": m.SUM}
    value = lambda: rng.choice([None, "a", "b", "c"])
    batch = [(f"k{rng.randrange(5)}", value(), value(), value(), value(), rng.choice([True, False]), rng.randrange(9), rng.randrange(9), i) for i in range(40)]
    schema = "k string, new string, old string, kept string, put string, either boolean, most long, total long, ord long"
    df = spark.createDataFrame(rng.sample(batch, len(batch)), schema)
    want = {}
    for k, new, old, kept, put, either, most, total, _ in batch:
        if k not in want:
            want[k] = [new, old, kept, put, either, most, total]
            continue
        w = want[k]
        want[k] = [new if new is not None else w[0], w[1] if w[1] is not None else old, w[2], put, w[4] or either, max(w[5], most), w[6] + total]
    got = m.merge_rows(df.limit(0).drop("ord"), df, ["k"], rules).drop("inserted")
    assert {r.k: list(r)[1:] for r in got.select("k", *rules).collect()} == want


def test_nulls_do_not_hide_values_without_an_order(spark):
    df = spark.createDataFrame([("1", "B", None), ("1", "A", "x@y")], "id string, name string, email string")
    got = m.merge_rows(df.limit(0), df, ["id"], {"name": m.PREFER_NEW, "email": m.PREFER_NEW}).first()
    assert (got.name, got.email) == ("B", "x@y")
