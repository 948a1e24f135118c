import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import empty, frame, rows

from tieline.llm import periods, queries
from tieline.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(w):
    """{(start, length): smallest period} by comparing the words with themselves at every shift."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if q + i - s >= max(12, 2 * q):
                out.setdefault((s, q + i - s), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found(lists):
    """find_runs over several documents at once, as lists of local (start, length, period)."""
    ids = np.array([x for d in lists for x in d], np.int64)
    sizes = np.array([len(d) for d in lists], np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(lists)), sizes)
    out = [[] for _ in lists]
    for s, n, q in zip(*[x.tolist() for x in periods.find_runs(ids, doc, (ends - sizes)[doc], ends[doc])]):
        out[doc[s]].append((s - int(ends[doc[s]] - sizes[doc[s]]), n, q))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=120), max_size=4), st.integers(1, 3))
def test_few_different_words(lists, alphabet):
    lists = [[x % alphabet for x in d] for d in lists]
    assert found(lists) == [brute(d) for d in lists]


@pytest.mark.parametrize("seed", range(12))
def test_nested_and_long_periods(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(6):
        w = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.randrange(3) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 16, 31, 33, 64]))]
            if rng.random() < 0.5:  # a repetition whose unit repeats itself
                unit = unit * rng.randrange(1, 4) + [rng.randrange(9)]
            w += (unit * rng.randrange(1, 7))[: rng.randrange(1, 400)] + [rng.randrange(9) for _ in range(rng.randrange(12))]
        lists.append(w)
    assert found(lists) == [brute(d) for d in lists]


def test_neighbouring_documents_do_not_meet():
    assert found([[1] * 11, [1] * 11, [], [1] * 12]) == [[], [], [], [(0, 12, 1)]]


def test_one_word_a_hundred_thousand_times():
    assert found([[7] * 100_000, [1, 2] * 50_000]) == [[(0, 100_000, 1)], [(0, 100_000, 2)]]


def test_awkward_rows(spark, monkeypatch):
    for chunk in (periods.CHUNK_BYTES, 1):
        monkeypatch.setattr(periods, "CHUNK_BYTES", chunk)
        want = []
        for d, text, *_ in rows():
            w = WORD.findall(text or "")
            runs = [(0, 30_000, 1)] if d == 123 else brute(w)
            want.append((d, len(w), runs, collapsed(w, runs)))
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(frame(spark)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periods.periodic_runs(empty(spark)).collect() == []


def planted(d, w):
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_against_plain_python(spark):
    directory = "/root/testdata/sf0.001"
    want, hit = {}, 0
    for r in table(spark, directory, "documents").collect():
        w = planted(r.doc_id, WORD.findall(r.text or ""))
        if len(w) > 3000:  # too slow by brute force; such lengths are compared above
            continue
        runs = brute(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        hit += bool(runs)
        text = "".join("%d,%d,%d\n" % x for x in runs)
        want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_periods"](spark, directory).collect()}
    assert hit > 10 and {d: got[d] for d in want} == want


def test_planted_rows(spark):
    from pyspark.sql import functions as F

    data = [(i, t) for i in range(60) for t in ("", None, "a b c", "one", " ".join("w%d" % k for k in range(50)))] + [(None, "a b"), (-3, "x y z")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = df.select("doc_id", "text", periods.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    assert len(got) == len(data)
    for r in got:
        assert WORD.findall(r.new or "") == planted(r.doc_id, WORD.findall(r.text or ""))
