import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_cases import empty, frame, rows
from tieline.llm import packing
from tieline.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CACHED = WordTokenizer(PATH, entries=50, chunks=20)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aAßẞKÅñÑéİΣσkå.,!?;:' \n\t'<|>endoftxsrv1½ﬁ́\x1c\xa0")))))
def test_cached_ids_are_those_of_the_whole_text(text):
    assert CACHED([text])[0] == np.array(ids_of(text), "<u2").tobytes()


def test_special_strings_in_texts():
    for text in ("a<|endoftext|>b", "<|startoftext|> x", "don't we'll it's", "ΑΣ ας", "a" * 5000):
        assert CACHED([text])[0] == np.array(ids_of(text), "<u2").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBéİ1 '<|>$#%&*_-()[]{}\"/\\^`~=+@.,endoftx"))))
def test_symbols_after_a_word(text):
    assert CACHED([text])[0] == np.array(ids_of(text), "<u2").tobytes()


def test_a_word_is_encoded_once_whatever_symbols_follow():
    tokenizer, text = WordTokenizer(PATH), "Onble onble$$$ onble### onble|&% onble>, ONBLE. x<|endoftext|> it's"
    assert tokenizer([text])[0] == np.array(ids_of(text), "<u2").tobytes()
    assert not any(x.startswith(("o", "O")) for x in tokenizer.others)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aBÉéİßªΣ1'<|>,. \n\t\r\x0b\x0c\x1c\x85\xa0\u3000́endofxt")))), max_size=12))
def test_texts_of_one_batch(texts):
    """Stretches of 20 chunks end inside texts."""
    assert CACHED.encode(pa.array(texts, pa.string())).to_pylist() == [np.array(ids_of(t), "<u2").tobytes() for t in texts]


def test_a_distinct_word_of_a_batch_is_looked_up_once():
    asked = []

    class Asked(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    tokenizer = WordTokenizer(PATH)
    tokenizer.words = Asked()
    texts = ["Onble onble, ONBLE.", "onble... <|ENDOFTEXT|> <|endoftext|> onble,", None, "a|b onble"] * 50
    assert tokenizer.encode(pa.array(texts, pa.string()).slice(1)).to_pylist() == [np.array(ids_of(t), "<u2").tobytes() for t in texts[1:]]
    assert sorted(asked) == sorted(["onble", ",", ".", "...", "", "<|ENDOFTEXT|>", "<|endoftext|>", "a|b"])


@pytest.mark.parametrize("n", [0, 1, 300, (1 << 16) + 3])
def test_counted_ids(n):
    rng = np.random.default_rng(n)
    docs = [rng.integers(0, 1 << 16, k).astype("<u2") if i % 3 else np.full(k, 7, "<u2") for i, k in enumerate(rng.integers(0, 5, n))]
    got = list(zip(*[x.tolist() for x in packing.counted(docs)], strict=True))
    assert got == [(i, t, c) for i, d in enumerate(docs) for t, c in sorted(Counter(d.tolist()).items())]


def test_document_frequencies_of_all_tasks(spark):
    docs = frame(spark).repartition(3)
    both = packing.tokenised(docs, PATH).cache()
    got = {r.id: r.df for r in packing.document_frequencies(both.filter("terms IS NOT NULL")).collect()}
    want = Counter(i for r in rows() for i in {*ids_of(r[1]), packing.END})
    assert got == want


@pytest.mark.parametrize("shard_tokens", [1 << 20, 4096])
def test_round_trip(spark, shard_tokens):
    pieces = packing.packed(frame(spark), PATH, shard_tokens=shard_tokens).collect()
    sequences = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        sequences[p.sequence_id].append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    want = Counter()
    for r in rows():
        ids = ids_of(r[1]) + [1]
        want.update((r[0], i, x, len(ids)) for i, x in enumerate(ids))
    got = Counter((p.doc_id, p.start + i, int(x), p.doc_tokens) for p in pieces for i, x in enumerate(np.frombuffer(p.ids, "<u2")))
    assert got == want
    if shard_tokens == 1 << 20:
        assert len(sequences) <= 1 + -(-sum(want.values()) // 2048)
    assert packing.packed(empty(spark), PATH).collect() == []


def test_neighbours_share_words_with_their_seed():
    """Against scores from the formula, term by term."""
    rng = np.random.default_rng(1)
    docs = [rng.integers(10 * (i % 4), 10 * (i % 4) + 12, 40).astype("<u2") for i in range(40)]
    frequency = np.zeros(1 << 16)
    for d in docs:
        frequency[np.unique(d)] += 1
    idf = np.where(frequency > 0, np.maximum(0, np.log((40 - frequency + 0.5) / (frequency + 0.5))), 0)
    index = packing.Index(docs, idf, 40.0)
    for seed in range(40):
        want = []
        for d in docs:
            tf = Counter(d.tolist())
            want.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / 40)) for t in set(docs[seed].tolist()) if tf[t]))
        assert np.allclose(index.scores(seed), want)
    windows = list(packing.fill(np.full(40, 40), index, 400))
    assert [sum(x[2] for x in w) for w in windows] == [400] * 4
    first = windows[0]
    assert {d % 4 for d, _, _ in first} == {first[0][0] % 4}


@pytest.mark.parametrize("shards", [1, 20, 200])
def test_best_neighbours_meet_however_many_shards(spark, shards):
    """The share of documents whose best neighbours by BM25 over all documents lie in their own shard; by chance it would be 1 / shards."""
    rng = np.random.default_rng(6)
    topics = [rng.integers(2000, 40_000, 30) for _ in range(400)]
    docs = [np.concatenate([rng.choice(topics[i % 400], 40), rng.integers(5, 1500, 60)]).astype("<u2") for i in range(4000)]
    frequency = np.zeros(1 << 16)
    for d in docs:
        frequency[np.unique(d)] += 1
    idf = np.where(frequency > 0, np.maximum(0, np.log((len(docs) - frequency + 0.5) / (frequency + 0.5))), 0)
    rows = spark.createDataFrame([(i, bytearray(d.tobytes())) for i, d in enumerate(docs)], "row long, ids binary")
    shared = spark.sparkContext.broadcast(idf)
    placed = packing.placed(rows, shared, 100.0, -(-100 * len(docs) // shards)).collect()
    shard = {r.row: r.shard for r in placed}
    assert len(shard) == len(docs) and len(set(shard.values())) == shards
    index = packing.Index(docs, idf, 100.0)
    met = []
    for seed in range(0, 4000, 16):
        scores = index.scores(seed)
        scores[seed] = -1
        met.append(max(shard[int(d)] == shard[seed] for d in np.argsort(-scores)[:3]))
    assert np.mean(met) >= 0.9
