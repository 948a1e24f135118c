import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm_cases import empty, frame, rows
from tieline.llm import simhash
from tieline.llm.common import DOCUMENT, pick


def groups(pairs):
    """{doc row -> smallest id of its component} by comparing all pairs of (id, fingerprint)."""
    fps = np.array([f for _, f in pairs], np.int64).view(np.uint64)
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= simhash.RADIUS):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(pairs))]


@pytest.mark.parametrize("shard_rows", [1 << 17, 9])
def test_against_all_pairs(spark, shard_rows):
    pairs = [(r[0], simhash.fingerprint(r[1])) for r in rows()]
    want = sorted(((d, f, g) for (d, f), g in zip(pairs, groups(pairs))), key=repr)
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark), shard_rows=shard_rows).select("doc_id", "fp", "component_id").collect()]
    assert sorted(got, key=repr) == want


def test_crowded_fingerprints_over_many_shards(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 5)
    fps = [int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 62, (60, 2))]
    fps += [int(x) for x in rng.integers(0, 2**63, 200)]
    pairs = list(enumerate(fps))
    found = simhash.components(spark.createDataFrame(pairs, "doc_id long, fp long"), shard_rows=40)
    by = {r.fp: r.component_id for r in found.collect()}
    assert [by[f] for f in fps] == groups(pairs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(1, 12))
def test_every_pair_meets_in_a_home_shard(points, shards):
    points = np.array(sorted(set(points) | {p ^ 5 for p in points}), np.uint64)
    tree = simhash.Tree(points, shards)
    at, leaf, home = tree.route(points)
    homes = dict(zip(at[home].tolist(), leaf[home].tolist()))
    assert len(homes) == len(points) == home.sum()
    reached = set(zip(at.tolist(), leaf.tolist()))
    assert len(reached) == len(at)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= simhash.RADIUS):
            assert (int(j), homes[i]) in reached or (i, homes[int(j)]) in reached


def test_copies_a_row_do_not_grow_with_small_tables():
    points = np.unique(np.random.default_rng(3).integers(0, 2**63, 400_000).astype(np.uint64) * np.uint64(2))
    tree = simhash.Tree(points[:: len(points) // 50_000], -(-len(points) // (1 << 17)))
    assert len(tree.route(points)[0]) < 1.8 * len(points)


def alike(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").encode().lower().split() for t in (a, b)))
    return 1.0 if not x | y else len(x & y) / len(x | y)


def near_groups(data):
    """Row numbers kept, by comparing all pairs of texts."""
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0, i))
    owner = {i: i for i in order}

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    rank = {i: k for k, i in enumerate(order)}
    for i in order:
        for j in order[rank[i] + 1 :]:
            a, b = find(i), find(j)
            if a != b and alike(data[i][1], data[j][1]) >= 0.8:
                a, b = sorted((a, b), key=rank.get)
                owner[b] = a
    return [i for i in order if find(i) == i]


def edited():
    """Groups of near copies around the threshold, up to a large one, beside other texts."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 3000, n)]
    data = []
    for size, edits, copies in ((200, 1, 5), (200, 4, 6), (300, 9, 4), (60, 1, 8), (30, 1, 3), (1000, 10, 40), (900, 40, 5), (8, 1, 3)):
        base = word(size)
        data.append(base)
        for _ in range(copies):
            x = list(base)
            for at in rng.choice(size, edits, replace=False):
                x[at] = "edit%d" % rng.integers(10**9)
            data.append(x)
    texts = [" ".join(x) for x in data] + [" ".join(word(100)) for _ in range(30)]
    return [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t in enumerate(texts)]


def test_one_of_each_against_all_pairs(spark):
    data = [r for r in rows() if r[0] != 123] + [(1000 + r[0], *r[1:]) for r in edited()]
    kept = simhash.one_of_each(pick(frame(spark, data), *DOCUMENT)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted((tuple(data[i]) for i in near_groups(data)), key=repr)
    assert simhash.one_of_each(pick(frame(spark), *DOCUMENT)).filter("doc_id = 123").count() == 1
    assert simhash.one_of_each(pick(empty(spark), *DOCUMENT)).collect() == []
    assert simhash.near_duplicates(empty(spark)).collect() == []


def chained():
    """Texts that share most shingles with a middle one only: groups whose first and last members are not alike, beside a passage all have."""
    rng = np.random.default_rng(21)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    data, passage = [], word(8)
    for g in range(60):
        base = word(120)
        for k in range(7):  # windows that slide: neighbours are alike, far ones are not
            data.append(passage + base[k * 6 : k * 6 + 80])
    for n in (700, 900):  # longer than a sketch, close to the threshold on both sides
        base = word(n)
        for edits in (18, 19, 20, 21, 22, 24, 28, 34):
            x = list(base)
            for at in rng.choice(n // 6, edits, replace=False):
                x[at * 6] = "e%d" % rng.integers(10**9)
            data.append(x)
        data.append(base)
    order = rng.permutation(len(data))
    return [(int(i), " ".join(data[at]), "en", "s", 1) for i, at in enumerate(order)]


def test_one_of_each_leaves_out_no_link(spark):
    data = chained()
    kept = simhash.one_of_each(pick(frame(spark, data), *DOCUMENT)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(data[i][0] for i in near_groups(data))


def drifted():
    """A text and versions of it, each with edits of its own: most are like none of the others, some are like a few."""
    rng = np.random.default_rng(33)
    base = [f"b{x}" for x in rng.integers(0, 10**6, 150)]
    data = []
    for edits in [5] * 60 + [3] * 20 + [2] * 12:
        x = list(base)
        for at in rng.choice(len(base), edits, replace=False):
            x[at] = "e%d" % rng.integers(10**9)
        data += [x, x[: 118 + int(rng.integers(0, 30))]]
    order = rng.permutation(len(data))
    return [(int(i), " ".join(data[at]), "en", "s", 1) for i, at in enumerate(order)]


def test_versions_too_far_apart_make_no_candidates(spark, monkeypatch):
    data, made, confirmed = drifted(), [], simhash.confirmed

    def counted(pairs, *args):
        made.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(simhash, "confirmed", counted)
    kept = simhash.one_of_each(pick(frame(spark, data), *DOCUMENT)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(data[i][0] for i in near_groups(data))
    real = sum(alike(data[i][1], data[j][1]) >= 0.8 for i in range(len(data)) for j in range(i))
    assert len(kept) > 60 and sum(made) < 2 * real + len(data), (made, real, len(kept))


def test_parities_bound_what_sets_do_not_share():
    rng = np.random.default_rng(12)
    for size, edits in ((0, 0), (1, 1), (30, 4), (300, 50), (5000, 700)):
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[edits:], rng.integers(0, 2**63, edits).astype(np.uint64)]))
        differ = int(np.bitwise_count((simhash.parities(x) ^ simhash.parities(y)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(x, y)) and (size < 30 or differ > 0)


def test_first_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(6)
    often = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    counts = rng.integers(3, 90, len(often))
    for n in (1, 2, 4, 5, 9, 10, 61, 400):
        for _ in range(30):
            x = np.unique(np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), rng.choice(often, 5)]))
            y = np.unique(np.concatenate([rng.permutation(x)[: max(1, int(len(x) * rng.uniform(0.78, 1)))], rng.integers(0, 2**63, 1).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if common >= 0.8 * len(np.union1d(x, y)):
                first = [simhash.first_shingles(s, 0.8, (often, counts)) for s in (x, y)]
                assert len(np.intersect1d(*first))


def test_similarity_is_exact_for_short_texts_and_close_for_long_ones():
    rng = np.random.default_rng(4)
    for n, slack in ((400, 0), (20_000, 0.08)):
        for share in (0.95, 0.8, 0.5):
            a = np.unique(rng.integers(0, 2**32, n).astype("<u4"))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < share], rng.integers(0, 2**32, n // 10).astype("<u4")]))
            want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got = simhash.similarity(a[: simhash.SKETCH].tobytes(), b[: simhash.SKETCH].tobytes())
            assert abs(got - want) <= slack


def test_chain_is_one_component(spark):
    from tieline.llm.components import roots

    n = 300
    edges = [(i, i + 1) for i in range(0, n)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
