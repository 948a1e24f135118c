import random

import pytest
from llm_cases import empty, frame
from tieline.llm import suffix_dedup


def brute(docs):
    """Removed bytes of each document by a set of all 100-byte strings."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(data[i : i + 100])
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g))
    return out


def cases(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(3)]
    docs = []
    for i in range(60):
        a = rng.randrange(300)
        docs.append((i, rng.choice(["", "a" * rng.randrange(300), "ü" * 90]) + rng.choice(base)[a : a + rng.randrange(80, 200)] + rng.choice(base)[50:250]))
    near = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    for i in range(20):
        x = list(near)
        for _ in range(5):
            x[rng.randrange(len(x))] = "#"
        docs.append((70 + i, "".join(x)))
    return docs + [(100, None), (101, ""), (102, "short"), (103, "x" * 99), (104, "x" * 100), (105, "x" * 100)]


def answers(df):
    return {r.doc_id: (r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), bytes(r.kept)) for r in suffix_dedup.repeated_spans(df).collect()}


def test_against_a_set_of_all_strings(spark):
    docs = cases()
    assert answers(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


@pytest.mark.parametrize("block", [300, 50, 1])
def test_parts_of_long_texts(spark, block, monkeypatch):
    """The passes themselves, with blocks so small that every text is cut."""
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    docs = cases(3)[: 30 if block == 1 else None]
    ids = [d for d, _ in docs]
    batch = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "h1": pa.array([0] * len(docs), pa.int64()), "h2": pa.array([0] * len(docs), pa.int64()), "text": [t for _, t in docs]})

    def earliest(batches):
        best = {}
        for b in batches:
            for anchor, name, doc, _, _, place in zip(*[c.to_pylist() for c in b.columns]):
                best[anchor, name] = min(best.get((anchor, name), (doc, place)), (doc, place))
        return best

    def opened(best):
        names = [a for a, _ in best]
        return {v for (a, _), v in best.items() if names.count(a) > 1}

    def lists(**kinds):
        out = batch
        for kind, places in kinds.items():
            out = out.append_column(kind, pa.array([[p for d, p in places if d == i] for i in ids], pa.list_(pa.int64())))
        return out

    run = earliest(suffix_dedup._runs([batch]))
    grain = earliest(suffix_dedup._grains([lists(places=opened(run))]))
    window = earliest(suffix_dedup._windows([lists(places=opened(grain))]))
    cut = next(suffix_dedup._cut([lists(run=run.values(), open_run=opened(run), grain=grain.values(), open_grain=opened(grain), window=window.values())]))
    got = {r["doc_id"]: (r["n_bytes"], sum(r["ends"]) - sum(r["starts"]), len(r["starts"]), r["kept"]) for r in cut.to_pylist()}
    assert got == brute(docs)


def test_awkward_rows(spark):
    rows = suffix_dedup.repeated_spans(frame(spark)).collect()
    assert len(rows) == 75
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_bytes, bytes(r.kept)))
    assert by[120] == [(0, b"")] and by[121] == [(0, b"")]
    assert len(set(by[3])) == 1 and len(by[3]) == 3
    assert by[123][0][0] == 150_000 and by[123][0][1] == b"word "  # all but the first period is covered by repeats
    assert len(by[None]) == 2 and len(set(by[None])) == 1
    assert suffix_dedup.repeated_spans(empty(spark)).collect() == []


def shared_ids(n):
    """Texts that share an id or have none, with passages that smaller ids, their likes and they themselves hold too."""
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    common, known, own = word(150), word(200), word(130)
    docs = [(1, word(50) + known), (2, "x" * 20 + common), (2, common + "y" * 30), (2, common + "y" * 30), (3, common + known[:120]), (3, own + word(40) + own)]
    docs += [(None, f"{i:07d}" + (known if i % 2 else own + common[:100]) + (word(110) * 2 if i % 50 == 0 else "")) for i in range(n)]
    return docs + [(None, own + own), (None, None), (2, None)]


def brute_rows(docs):
    """As `brute`, for rows that may share ids: earlier is a smaller id, or before in the same row."""
    least = {}
    for d, t in docs:
        data = (t or "").encode()
        for i in range(len(data) - 99):
            key = data[i : i + 100]
            least[key] = min(least.get(key, (2, 0)), (d is None, d or 0))
    out = []
    for d, t in docs:
        data, seen = (t or "").encode(), set()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            key = data[i : i + 100]
            if key in seen or least[key] < (d is None, d or 0):
                gone[i : i + 100] = b"\1" * 100
            seen.add(key)
        out.append((d, len(data), bytes(x for x, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 8, 13])
def test_texts_that_share_an_id(spark, parts):
    docs = shared_ids(60)
    random.Random(parts).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.repeated_spans(df).collect()), key=repr) == brute_rows(docs)


def test_many_rows_without_id(spark):
    docs = shared_ids(30_000)
    got = suffix_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got), key=repr) == brute_rows(docs)
