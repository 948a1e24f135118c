"""Severity of toxic text by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import bounded_batches, pick, stored

LETTERS = re.compile(r"[^\W\d_]+")
STEM = 4
GRADES = 3


def features(text: str | None) -> set[str]:
    """Lower-case words of a whole text, and the first letters of longer ones, marked."""
    found = set(LETTERS.findall((text or "").lower()))
    return found | {"^" + w[:STEM] for w in found if len(w) > STEM}


@dataclass
class Model:
    """P(grade > k) = 1 / (1 + exp(cuts[k] - weight of the features)): one weight a feature for all ordered cuts."""

    weights: dict[str, float]
    cuts: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        get = self.weights.get
        score = sum(get(f, 0.0) for f in sorted(features(text) & self.weights.keys()))
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, n): at most `rows` distinct texts with a label, half of them of either kind if there are as many, by an even
    hash. Labels that are null or contradict each other are left out."""
    clear = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    draw = F.xxhash64(F.lit(3), "doc_id")
    halves = [clear.filter(F.col("toxic") == t).orderBy(draw, "doc_id").limit(rows // 2).select("doc_id", "toxic") for t in (0, 1)]
    taken = halves[0].union(halves[1])
    return docs.filter(F.col("text").isNotNull()).join(F.broadcast(taken), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def selected(sample: DataFrame, least_docs: int, least_z: float, least_odds: float) -> tuple[DataFrame, DataFrame]:
    """(doc, f) and (f, feature) of the features that occur with toxic texts more often than chance explains, by `least_odds` in log
    odds at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, toxic, feature = [], [], []
            for d, x, t in zip(batch.column("doc").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = sorted(features(t))
                doc += [d] * len(found)
                toxic += [x] * len(found)
                feature += found
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(toxic, pa.int32()), pa.array(feature, pa.string())], ["doc", "toxic", "feature"])

    rows = stored(sample.mapInArrow(run, "doc long, toxic int, feature string"), "features")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = F.col("hits") + 0.5, F.col("misses") + 0.5
    odds = F.log(a / (F.lit(size.get(1, 0) + 1) - a)) - F.log(b / (F.lit(size.get(0, 0) + 1) - b))
    counts = rows.groupBy("feature").agg(F.sum("toxic").alias("hits"), F.sum(1 - F.col("toxic")).alias("misses"))
    kept = counts.filter((F.col("hits") >= least_docs) & (odds > least_odds) & (odds / F.sqrt(1 / a + 1 / b) > least_z))
    kept = stored(kept.select(F.monotonically_increasing_id().alias("f"), "feature"), "kept")
    return rows.join(kept, "feature").select("doc", "f"), kept


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, least_docs: int = 3, least_z: float = 2.5, least_odds: float = 1.5, strength: float = 0.1, steps: int = 600) -> Model | None:
    """Fitted on a sample of at most `train_rows` labelled texts; None without toxic and harmless ones.

    The labels know two grades. Toxic texts are graded by how many of the selected features with no harmless text they hold: up to the
    median of these counts 1, above it 2. Weights are not negative, so harmless words make up for nothing, and those that do not help
    are pulled to zero; cuts keep their order."""
    sample = stored(training_rows(docs, labels, train_rows).withColumn("doc", F.monotonically_increasing_id()), "sample")
    found, kept = selected(sample, least_docs, least_z, least_odds)
    texts = sample.select("doc", F.col("toxic").cast("int").alias("toxic")).orderBy("doc").toArrow().to_pydict()  # `train_rows` at most
    names = dict(zip(*kept.orderBy("feature").select("f", "feature").toArrow().to_pydict().values(), strict=True))
    if not names or len(set(texts["toxic"])) < 2:
        return None
    rows = found.toArrow()  # numbers only: the selected features of `train_rows` texts
    known = np.array(sorted(names))
    at = np.stack([np.searchsorted(texts["doc"], rows.column("doc").to_numpy()), np.searchsorted(known, rows.column("f").to_numpy())], 1)
    at = at[np.lexsort((at[:, 1], at[:, 0]))]
    names = [names[f] for f in known.tolist()]
    toxic, n, m = np.array(texts["toxic"]), len(texts["doc"]), len(names)
    telling = np.bincount(at[:, 1], toxic[at[:, 0]] == 0, m) == 0
    marks = np.bincount(at[:, 0], telling[at[:, 1]], n)
    grade = np.where(toxic == 0, 0, np.where(marks > np.median(marks[toxic == 1]), 2, 1))
    weight, cuts, each = np.zeros(m), np.arange(1.0, GRADES), np.arange(n)
    moment, second = np.zeros(m + GRADES - 1), np.zeros(m + GRADES - 1)
    for step in range(1, steps + 1):
        score = np.bincount(at[:, 0], weight[at[:, 1]], n)
        p = 1 / (1 + np.exp(np.clip(cuts - score[:, None], -60, 60)))
        # The likelihood of a grade is the difference of the cumulative probabilities on its two sides.
        edge, slope = (np.column_stack([np.full(n, first), x, np.zeros(n)]) for first, x in ((1.0, p), (0.0, p * (1 - p))))
        own = np.maximum(edge[each, grade] - edge[each, grade + 1], 1e-12)
        up, down = slope[each, grade] / own, slope[each, grade + 1] / own
        by_weight = -np.bincount(at[:, 1], (up - down)[at[:, 0]], m)
        by_cut = [-((grade == k) * down - (grade == k + 1) * up).sum() for k in range(GRADES - 1)]
        gradient = np.concatenate([by_weight + strength, by_cut]) / n
        moment, second = 0.9 * moment + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight = np.maximum(weight - move[:m], 0)
        cuts = cuts - move[m:]
        cuts[1:] = np.maximum(cuts[1:], cuts[:-1] + 1e-3)
    return Model({f: float(w) for f, w in zip(names, weight, strict=True) if w > 1e-3}, cuts)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with severity (expected grade, 0 to 2), grade (the likeliest) and toxic (a grade above 0 is likelier than not). Null and
    empty texts have no features. Without a model nothing is toxic. Texts are read whole."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most the selected features of the bounded sample
    added = "severity double, grade int, toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held.value is None:
                above = np.zeros((batch.num_rows, GRADES - 1))
            else:
                above = np.array([held.value.above(t.as_py()) for t in batch.column("text")]).reshape(-1, GRADES - 1)
            own = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            new = [pa.array(above.sum(1).round(6)), pa.array(own.argmax(1), pa.int32()), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "severity", "grade", "toxic"])

    return docs.mapInArrow(run, docs.select("*", *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in added.split(", ")]).schema)


def severities(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """(doc_id, severity, grade, toxic) for each row of `docs` (doc_id, text); `labels` has doc_id and toxic (0 or 1). Repeated rows and
    rows without id are scored like any other; a table without rows gives none; other columns of either are left out."""
    docs = pick(docs, "doc_id", "text")
    model = fit(docs, pick(labels, "doc_id", "toxic"), **settings)
    return scored(docs, model).drop("text")
