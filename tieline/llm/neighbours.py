"""Nearest neighbours by largest inner product: balanced posting lists, whose centroids are searched by a graph in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tieline.llm.common import pick, ranked, stored

SPACING = 0.2
FOUND = "query_id long, vec_id long, score double"


class Lists:
    """Centroids of a balanced tree of halvings, a graph that links each to its nearest ones, and the search in it.

    Vectors get one more component, which makes them all of length `reach`, the largest there is; then the largest inner product is
    the smallest distance."""

    def __init__(self, sample: np.ndarray, reach: float, count: int, degree: int = 16, seed: int = 5):
        self.reach = reach
        rng = np.random.default_rng(seed)
        leaves = [(self.lift(sample), count)]
        done = []
        while leaves:
            rows, parts = leaves.pop()
            if parts == 1 or len(rows) < 2:
                done.append(rows.mean(0))
                continue
            axis = rows[rng.integers(len(rows))] - rows[rng.integers(len(rows))]
            for _ in range(8):  # two means, of which each keeps its share of the rows
                order = np.argsort(rows @ axis, kind="stable")
                cut = max(1, min(len(rows) - 1, len(rows) * (parts // 2) // parts))
                axis = rows[order[cut:]].mean(0) - rows[order[:cut]].mean(0)
            leaves += [(rows[order[:cut]], parts // 2), (rows[order[cut:]], parts - parts // 2)]
        self.centroids = np.array(done)
        self.norms = (self.centroids**2).sum(1)
        n = len(done)
        near = min(degree, n - 1)
        gaps = self.norms[:, None] + self.norms - 2 * self.centroids @ self.centroids.T
        np.fill_diagonal(gaps, np.inf)
        self.links = np.argsort(gaps, axis=1)[:, :near]
        far = rng.integers(n, size=(n, 4))
        self.links = np.concatenate([self.links, far], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.reach**2 - (x**2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def lift_queries(self, x: np.ndarray) -> np.ndarray:
        x = x * (self.reach / np.sqrt((x**2).sum(1)))[:, None]
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of the nearest centroids found by a best-first walk that keeps `width` of them, nearest first."""
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        own = (x**2).sum(1)[:, None]
        gap = lambda ids: own + self.norms[ids] - 2 * np.einsum("qd,qkd->qk", x, self.centroids[ids])
        seen = np.zeros((len(x), n), bool)
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        seen[rows, ids] = True
        gaps, walked = gap(ids), np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(gaps, axis=1, kind="stable")[:, :width]
            ids, gaps, walked = (np.take_along_axis(a, order, 1) for a in (ids, gaps, walked))
            open_ = ~walked & np.isfinite(gaps)
            if not open_.any():
                return ids, np.sqrt(np.maximum(gaps, 0))
            best = open_.argmax(1)[:, None]
            np.put_along_axis(walked, best, True, 1)
            new = np.where(open_.any(1)[:, None], self.links[np.take_along_axis(ids, best, 1)[:, 0]], 0)
            fresh = gap(new)
            fresh[seen[rows, new] | ~open_.any(1)[:, None]] = np.inf
            for c in range(1, new.shape[1]):  # a link that occurs twice counts once
                fresh[(new[:, :c] == new[:, c : c + 1]).any(1), c] = np.inf
            seen[rows, new] |= open_.any(1)[:, None]
            ids, gaps, walked = np.concatenate([ids, new], 1), np.concatenate([gaps, fresh], 1), np.concatenate([walked, np.zeros(new.shape, bool)], 1)

    def postings(self, x: np.ndarray, slack: float, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list, and for vectors near a border others within `slack` of its distance, unless a list taken
        is so near to them that it stands for them: nearer than `SPACING` times the vector's distance."""
        ids, gaps = self.search(self.lift(x), 4 * copies)
        taken = np.zeros(ids.shape, bool)
        taken[:, 0] = True
        for c in range(1, ids.shape[1]):
            near = (gaps[:, c] <= (1 + slack) * gaps[:, 0]) & (taken.sum(1) < copies)
            between = np.sqrt(((self.centroids[ids[:, :c]] - self.centroids[ids[:, c]][:, None]) ** 2).sum(2))
            taken[:, c] = near & ~(taken[:, :c] & (between < SPACING * gaps[:, c : c + 1])).any(1)
        row, column = np.nonzero(taken)
        return row, ids[row, column]

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Distances of lifted rows to all centroids."""
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + self.norms - 2 * x @ self.centroids.T, 0))

    def probes(self, x: np.ndarray, ratio: float, width: int, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list): all lists within `ratio` of the nearest centroid's distance, and as many as hold `least` rows. Queries for
        which a walk of `width` ends within these bounds are compared with every centroid."""
        x = self.lift_queries(x)

        def within(at: np.ndarray, ids: np.ndarray, gaps: np.ndarray):
            held = np.cumsum(rows[ids], axis=1) - rows[ids]
            taken = ((gaps <= ratio * gaps[:, :1]) | (held < least)) & np.isfinite(gaps)
            more = (taken.sum(1) == np.isfinite(gaps).sum(1)) & (taken.sum(1) < len(self.centroids))
            row, column = np.nonzero(taken & ~more[:, None])
            return at[row], ids[row, column], at[more]

        row, found, rest = within(np.arange(len(x)), *self.search(x, width))
        parts = [(row, found)]
        if len(rest):
            every = self.gaps(x[rest])
            order = np.argsort(every, axis=1, kind="stable")
            parts.append(within(rest, order, np.take_along_axis(every, order, 1))[:2])
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def ratio_for(self, x: np.ndarray, wanted: list[tuple[int, list[int]]], recall: float) -> float:
        """The smallest ratio at which a share `recall` of the `wanted` (query, lists that hold one of its neighbours) is found."""
        gaps = self.gaps(self.lift_queries(x))
        near = np.maximum(gaps.min(1), 1e-9 * self.reach)
        need = np.sort([gaps[q, at].min() / near[q] for q, at in wanted])
        return float(max(1.0, need[min(len(need) - 1, int(np.ceil(recall * len(need))))])) * (1 + 1e-9)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros((0, dim)), *(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in chunks)]).astype(np.float64)


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The `k` nearest of `vectors` for each query. A matrix product finds those that could be among them; their scores are then summed
    in component order, so that equal vectors score equal wherever they lie."""
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    keep = min(k, len(ids))
    floor = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
    slack = 1e-9 * (1 + np.sqrt((queries**2).sum(1)) * np.sqrt((vectors**2).sum(1).max()))
    q, v = np.nonzero((rough >= (floor - slack)[:, None]) & np.isfinite(rough))
    score = np.zeros(len(q))
    for d in range(queries.shape[1]):
        score += queries[q, d] * vectors[v, d]
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    top = place < k
    return query_ids[q[top]], ids[v[top]], score[top]


def exact(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the `k` nearest of all `rows` for a bounded set of queries. A task returns its `k` best for each."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.array([], t) for t in (np.int64, np.int64, np.float64)]
        for batch in batches:
            if batch.num_rows:
                new = best_of(queries, query_ids, matrix(batch.column("embedding"), dim), batch.column("vec_id").to_numpy(), k)
                q, v, score = (np.concatenate(x) for x in zip(best, new, strict=True))
                order = np.lexsort((v, -score, q))
                top = np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k
                best = [x[order[top]] for x in (q, v, score)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.mapInArrow(run, FOUND).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part; rows that share an id are rows of their own."""
    rows = pick(vectors, "vec_id", "embedding").filter("vec_id IS NOT NULL AND size(embedding) > 0")
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.filter(sound)


def nearest(vectors: DataFrame, is_query, k: int = 20, sample_rows: int = 20_000, list_rows: int = 2048, most_lists: int = 4096, slack: float = 0.1, copies: int = 4, ratio: float = 1.06, recall: float = 0.985, trials: int = 256, width: int = 128, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of each row for which `is_query(vec_id)` holds, its own row left out. Rows
    that share a vec_id are candidates and queries of their own.

    Centroids are fitted on a sample of at most `sample_rows` vectors; every vector is in a list, those near borders in up to `copies`. How
    far a query reaches is fitted too: at most `trials` queries are compared with all rows, and lists are searched up to that multiple of
    the nearest centroid's distance, at least `ratio`, at which a share `recall` of their true neighbours is found, however many lists that
    takes. A list longer than `block` rows, as of a vector that is repeated very often, is searched in blocks, and so are its queries. Vectors that
    are null, zero, empty, hold null or non-finite components or lack an id take no part, nor do those whose length is not the
    commonest. Equal scores rank by vec_id. A table without rows gives none. Other columns are left out."""
    spark = vectors.sparkSession
    rows = ranked(usable(vectors), [], ["vec_id"]).withColumnRenamed("vec_id", "name").withColumnRenamed("rank", "vec_id").drop("total")
    rows = stored(rows, "vectors")  # from here on vec_id is a row's number in the order of ids
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("long")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = lengths["dim"], lengths["n"]
    rows = rows.filter(F.size("embedding") == dim)
    draw = F.xxhash64(F.lit(1), "vec_id")
    share = min(1.0, 1.2 * sample_rows / n)
    sample = rows.filter(F.pmod(draw, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(draw).limit(sample_rows).select("embedding").collect()
    lists = Lists(np.array([r.embedding for r in sample]), float(np.sqrt(lengths["long"])), max(1, min(most_lists, -(-n // list_rows))))
    shared = spark.sparkContext.broadcast(lists)  # at most `most_lists` centroids

    def routed(batches: Iterator[pa.RecordBatch], route) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                row, at = route(matrix(part.column("embedding"), dim))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), part.column("vec_id").take(pa.array(row)), part.column("embedding").take(pa.array(row))], ["list", "id", "v"])

    spec = "list long, id long, v array<double>"
    posted = stored(rows.mapInArrow(lambda b: routed(b, lambda x: shared.value.postings(x, slack, copies)), spec), "postings")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(i, 0) for i in range(len(lists.centroids))])
    queries = rows.filter(is_query(F.col("name")))
    tried = queries.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(trials).collect()
    if tried:
        x, at = np.array([r.embedding for r in tried], float), {r.vec_id: i for i, r in enumerate(tried)}
        true = F.broadcast(exact(rows, x, np.array(list(at), np.int64), k).select("query_id", "vec_id"))  # at most `k` rows a trial
        where = posted.select(F.col("id").alias("vec_id"), "list").join(true, "vec_id").groupBy("query_id", "vec_id").agg(F.collect_list("list").alias("at")).collect()
        if where:
            ratio = max(ratio, lists.ratio_for(x, [(at[r.query_id], r["at"]) for r in where], recall))
    asked = queries.mapInArrow(lambda b: routed(b, lambda x: shared.value.probes(x, ratio, width, held, 8 * k)), spec)
    asked = stored(asked, "probes")
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    blocks = F.broadcast(spark.createDataFrame([(i, -(-sizes.get(i, 0) // block), -(-asks.get(i, 0) // block)) for i in range(len(held)) if sizes.get(i) and asks.get(i)], "list long, parts int, ask_parts int"))
    spread = lambda c: F.pmod(F.xxhash64(F.lit(2), "id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = posted.join(blocks, "list").select("list", "id", "v", spread("parts").alias("part"), every("ask_parts").alias("ask_part"))
    right = asked.join(blocks, "list").select("list", "id", "v", spread("ask_parts").alias("ask_part"), every("parts").alias("part"))
    key = ["list", "part", "ask_part"]

    def compare(postings: pa.Table, queries: pa.Table) -> pa.Table:
        if not postings.num_rows or not queries.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        v, ids = matrix(postings.column("v"), dim), postings.column("id").to_numpy()
        q, query_ids = matrix(queries.column("v"), dim), queries.column("id").to_numpy()
        found = [best_of(q[i : i + 256], query_ids[i : i + 256], v, ids, k) for i in range(0, len(q), 256)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, FOUND)
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = once.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = rows.select("vec_id", "name")
    best = best.join(names, "vec_id").drop("vec_id").withColumnRenamed("name", "found")
    best = best.join(names.select(F.col("vec_id").alias("query_id"), F.col("name").alias("asked")), "query_id")
    return best.select(F.col("asked").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score")
