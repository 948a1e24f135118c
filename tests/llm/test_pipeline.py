"""Each stage on what the one before kept, against plain Python over the same rows."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tieline.llm import line_dedup, mixing
from tieline.llm.common import DOCUMENT, stored, table

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, DIRECTORY, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIRECTORY), name)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == DOCUMENT
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    names = entry.queries().keys()
    assert all(any(n.startswith("op%d_" % i) for n in names) for i in range(1, 14)) and "pipeline" in names


def test_toxicity_keeps_clean_documents(spark, stages):
    toxic = {r.doc_id for r in table(spark, DIRECTORY, "labels").collect() if r.toxic}
    kept = {r.doc_id for r in stages["toxicity"]}
    clean = {r.doc_id for r in table(spark, DIRECTORY, "labels").collect() if not r.toxic}
    assert clean <= kept and len(toxic & kept) <= len(toxic) / 2


def test_line_dedup(stages):
    sites, first = defaultdict(set), {}
    for r in stages["toxicity"]:
        for line in (r.text or "").split("\n"):
            if line.strip(" \t\n\x0b\f\r"):
                sites[line.strip(" \t\n\x0b\f\r")].add(r.source)
                first[line.strip(" \t\n\x0b\f\r")] = min(first.get(line.strip(" \t\n\x0b\f\r"), r.doc_id), r.doc_id)
    gone = {k for k, s in sites.items() if len(s - {None}) >= line_dedup.MIN_SITES}
    cut = lambda r: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\n\x0b\f\r") not in gone or first[x.strip(" \t\n\x0b\f\r")] == r.doc_id)
    assert {r.doc_id: r.text for r in stages["line_dedup"]} == {r.doc_id: None if r.text is None else cut(r) for r in stages["toxicity"]}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_simhash_keeps_one_of_each_group_of_near_copies(stages):
    rows = sorted(stages["line_dedup"], key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in rows]
    owner = list(range(len(rows)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                owner[max(a, b)] = min(a, b)
    assert sorted(stages["simhash"]) == sorted(rows[i] for i in range(len(rows)) if find(i) == i)


def test_mixing(stages):
    sizes = {r.doc_id: len((r.text or "").split()) for r in stages["simhash"]}
    source = {r.doc_id: r.source for r in stages["simhash"]}
    copies = Counter(r.doc_id for r in stages["mixing"])
    assert max(copies.values()) <= mixing.MAX_EPOCHS
    assert {tuple(r) for r in stages["mixing"]} <= {tuple(r) for r in stages["simhash"]}
    totals, got = Counter(), Counter()
    for d, n in sizes.items():
        totals[source[d]] += n
        got[source[d]] += n * copies[d]
    assert got.total() == pytest.approx(totals.total(), rel=0.1)


def test_packing(stages):
    pieces = stages["packing"]
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    copies = Counter(r.doc_id for r in stages["mixing"])
    whole = {p.doc_id: p.doc_tokens for p in pieces}
    assert tokens == Counter({d: n * whole[d] for d, n in copies.items()})


def test_run_is_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, DIRECTORY).collect()
    assert Counter((p.doc_id, p.doc_tokens) for p in got).keys() == Counter((p.doc_id, p.doc_tokens) for p in stages["packing"]).keys()
    assert sum(p.length for p in got) == sum(p.length for p in stages["packing"])


def test_awkward_tables(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and extra columns whose names clash go through all stages, and so do no rows."""
    from llm_cases import empty, frame

    for name, docs in (("awkward", frame(spark)), ("empty", empty(spark))):
        folder = f"{tmp_path}/{name}"
        docs.toDF(*[c if c != "TEXT" else "text_" for c in docs.columns]).write.parquet(folder + "/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert pieces if name == "awkward" else not pieces
