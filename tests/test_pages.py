"""Keyset pages against a sort of all rows, with nulls, ties, hot workspaces and cursors of rows that have gone."""

import random

import pytest

from tieline.operators import pages as pg
from tieline.operators.people import page_of

ORDERS = [
    [("n", False, False), ("id", False, True)], [("n", True, False), ("id", False, True)],
    [("n", False, True), ("id", False, True)], [("n", True, True), ("m", True, False), ("id", False, True)],
]


def table(spark, n=300):
    rng = random.Random(4)
    some = lambda top: None if rng.random() < 0.3 else rng.randrange(top)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b"]), some(6), some(3), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ws string, n int, m int, id int").repartition(5)


def in_order(rows, ws, order):
    names, out = ["n", "m", "id"], [r[1:] for r in rows if r[0] == ws]
    for name, descending, nulls_first in reversed(order):
        at = names.index(name)
        held = sorted((r for r in out if r[at] is not None), key=lambda r: r[at], reverse=descending)
        none = [r for r in out if r[at] is None]
        out = none + held if nulls_first else held + none
    return [r[2] for r in out]


@pytest.mark.parametrize("order", ORDERS)
def test_all_pages_follow_each_other(spark, order):
    rows, df = table(spark)
    starts = pg.starts(df, order, 25).cache()
    pages = {1: pg.first(df, order, 25)} | {p: pg.after(df, order, starts.filter(f"page = {p}"), 25) for p in range(2, 10)}
    got = {}
    for page, found in pages.items():
        for r in sorted(found.collect(), key=lambda r: r.position):
            got.setdefault(r.ws, []).append(r.id)
    assert got == {ws: in_order(rows, ws, order)[:225] for ws in ("hot", "a", "b")}


def test_a_cursor_outlives_its_row(spark):
    rows, df = table(spark, 60)
    order = ORDERS[1]
    want = in_order(rows, "hot", order)
    cursor = df.filter(f"ws = 'hot' AND id = {want[9]}").cache()
    cursor.count()
    left = df.filter(f"id <> {want[9]}")
    assert [r.id for r in pg.after(left, order, cursor, 5).orderBy("position").collect()] == want[10:15]


def test_pages_by_number_are_the_same(spark):
    rows, df = table(spark, 120)
    people = df.selectExpr("ws", "cast(id AS string) AS person_id", "concat('x', n) AS name", "m AS current_company")
    order = pg.people_order("company")
    starts = pg.starts(people, order, 10).filter("page = 4")
    by_key = {(r.ws, r.position + 30, r.person_id) for r in pg.after(people, order, starts, 10).collect()}
    assert by_key == {(r.ws, r.position, r.person_id) for r in page_of(people, "company", 4, 10).collect()}


def test_empty_and_unknown(spark):
    df = table(spark, 4)[1].limit(0)
    assert pg.starts(df, ORDERS[0], 3).count() == 0 and pg.first(df, ORDERS[0], 3).count() == 0
    with pytest.raises(ValueError, match="unknown sort"):
        pg.people_order("shoe size")
