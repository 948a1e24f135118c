import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from llm_cases import empty, frame, rows
from pyspark.sql import functions as F

from tieline.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(w, items, window):
    """(longest, hit words, items) of the words by comparing every stretch with every item's windows."""
    hit, found, longest, shortest = set(), set(), 0, window
    for item, x in items:
        n = min(len(x), window)
        shortest = min(shortest, n or window)
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
        for i in range(len(x)):
            for j in range(len(w)):
                k = 0
                while i + k < len(x) and j + k < len(w) and x[i + k] == w[j + k]:
                    k += 1
                longest = max(longest, k)
    return longest if longest >= shortest else 0, hit, found


def walked(made, docs):
    """What the automaton finds in documents that lie one after the other."""
    flat = np.array([made.words.get(x, -1) for d in docs for x in d], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs]) if docs else np.zeros(0, np.int64)
    first = np.cumsum([0] + [len(d) for d in docs])
    out = [(0, set(), set()) for _ in docs]
    for b, e in made.stretches(flat, doc):
        longest, spans, items = made.walk(flat[b:e].tolist())
        if longest >= made.shortest:
            d = doc[b]
            hit = {b - int(first[d]) + i for x, y in spans for i in range(x, y)}
            out[d] = (max(out[d][0], longest), out[d][1] | hit, out[d][2] | items)
    return out


letters = st.lists(st.sampled_from("abc"), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=5), st.lists(st.lists(st.sampled_from("abcx"), max_size=30), max_size=3), st.integers(1, 6))
def test_every_window(items, docs, window):
    named = [(str(i), [x.encode() for x in w]) for i, w in enumerate(items)]
    docs = [[x.encode() for x in d] for d in docs]
    assert walked(dc.Automaton(named, window), docs) == [brute(d, named, window) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(letters, min_size=1, max_size=4), st.integers(1, 5))
def test_states_are_right(items, window):
    """Every string of an item leads from the start to a state whose longest string is no shorter; no state is met by two end sets."""
    made = dc.Automaton([(str(i), [x.encode() for x in w]) for i, w in enumerate(items)], window)
    ends = {}
    for k, w in enumerate(items):
        for i in range(len(w)):
            s = 0
            for j in range(i, len(w)):
                s = made.go[s * made.size + made.words[w[j].encode()]]
                ends.setdefault("".join(w[i : j + 1]), (s, set()))[1].add((k, j))
                assert made.length[s] >= j - i + 1 > made.length[made.link[s]]
    by = {}
    for s, places in ends.values():
        assert by.setdefault(s, places) == places


ITEMS = [(1, rows()[0][1][:200]), (2, rows()[0][1][:90]), (2, "ß Ünïcode 𝒳 ß ünïcode"), (3, None), (4, ""), (5, " ,.\n"), (None, rows()[1][1][:120]), (6, "word word"), (7, rows()[2][1]), (7, rows()[2][1]), (30, "W1, w2!")]


@pytest.mark.parametrize("shard_words", [1 << 18, 25])
def test_awkward_rows(spark, shard_words):
    items = spark.createDataFrame(ITEMS, SCHEMA).select("*", F.lit(1).alias("doc_id"), F.lit("x").alias("TEXT"))
    coded = [(None if i is None else str(i), words(t)) for i, t in ITEMS]
    want = []
    for d, text, *_ in rows():
        w = words(text)
        _, hit, found = brute(w[:100] if d == 123 else w, coded, dc.WINDOW)
        hit = len(w) if d == 123 else len(hit)
        want.append((d, text, len(w), hit, sorted(found - {None})))
    got = [(r.doc_id, r.text, r.n_words, r.n_hit, r["items"]) for r in dc.matches(frame(spark), items, shard_words=shard_words).withColumn("n_hit", dc.n_hit()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, SCHEMA)
    assert dc.matches(empty(spark), items).collect() == []
    got = dc.matches(frame(spark), items.limit(0)).collect()
    assert len(got) == len(rows()) and all(r.spans == [] and r.longest == 0 for r in got)
    assert any(r.n_words for r in got)


def test_spans_and_documents_go(spark):
    item = " ".join("item%d" % i for i in range(14))
    own = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    docs = [(1, f"{own(30, 'a')}, (ITEM0 {item[6:]})! {own(5, 'b')}"), (2, f"{own(9, 'c')} {item}"), (3, own(40, "d")), (4, own(50, "é") + "\n" + " ".join(item.split()[:9])), (5, None), (6, "short item here: x y."), (7, f"{own(60, 'f')} x  Y {own(9, 'g')}")]
    items = spark.createDataFrame([(1, item), (2, "x y")], SCHEMA)
    got = {r.doc_id: r for r in dc.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), items, max_length=1).collect()}
    assert sorted(got) == [1, 3, 4, 5, 6, 7]  # most of 2 is an item
    assert got[1].text == f"{own(30, 'a')}, ()! {own(5, 'b')}" and (got[1].n_hit, got[1].longest, got[1]["items"]) == (14, 14, ["1"])
    assert got[3].text == docs[2][1] and got[4].text == docs[3][1] and got[5].text is None
    assert got[6].text == "short item here: ." and got[7].text == f"{own(60, 'f')}  {own(9, 'g')}"
    kept = {r.doc_id: r.text for r in dc.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert kept[7] == docs[6][1] and kept[1] == got[1].text  # the shorter window is within the default length limit
