import random

import numpy as np
import pytest
from llm_cases import empty, frame, rows
from tieline.llm import toxicity

BAD = ["trash", "moron", "idiotic", "pathetic", "scum"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["w%s" % rng.choice("abcdefghijklmnopqrst") * rng.randrange(1, 4) for _ in range(rng.randrange(5, 200))]
        toxic = i % 3 == 0
        for _ in range(rng.choice([1, 2, 6]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    data = corpus(900, 1)
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0, x) for d, _, x in data] + [(None, 0, 1), (5, 0, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs, labels.select("doc_id", "toxic"))


def test_held_out(spark, model):
    data = corpus(600, 2)
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string"), model).collect()}
    assert sum(got[d].toxic == bool(x) for d, _, x in data) >= 590
    mild = np.mean([got[d].severity for d, t, x in data if x and sum(w.strip(".") in BAD for w in t.lower().split()) == 1])
    severe = np.mean([got[d].severity for d, t, x in data if x and sum(w.strip(".") in BAD for w in t.lower().split()) >= 5])
    assert severe > mild > 0.5


def test_one_weight_for_ordered_cuts(model):
    assert (np.diff(model.cuts) > 0).all() and all(w > 0 for w in model.weights.values())
    above = model.above("moron trash")
    assert above[0] > above[1]
    score = sum(model.weights.get(f, 0) for f in toxicity.features("moron trash"))
    assert above == pytest.approx(1 / (1 + np.exp(model.cuts - score)))


def test_long_clean_text_and_a_word_at_its_end(model):
    clean = "wa wb wc wd " * 50_000
    assert model.above(clean)[0] < 0.5 < model.above(clean + " moron trash scum")[0]


def test_awkward_rows(spark, model):
    docs = frame(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.severities(docs, labels).collect()
    assert len(got) == len(rows()) and not any(r.toxic for r in got)
    assert toxicity.severities(empty(spark), labels).collect() == []
    assert not any(r.toxic for r in toxicity.severities(docs, labels.limit(0)).collect())
    both = toxicity.scored(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert {r.severity for r in both} == {both[0].severity} and not both[0].toxic
