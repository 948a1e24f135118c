"""Lexical retrieval packing: shards with a BM25 index each; neighbours of a seed document fill its window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tieline.llm.common import bounded_batches, pick, running_start, stored
from tieline.llm.tokens import word_tokenizer

END = 1
K1, B = 1.2, 0.75
DIM = 128  # directions that documents are placed by
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECE_COLUMNS = [x.split()[0] for x in PIECE.split(", ")]


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, count) of the distinct 16-bit ids of each document, in this order."""
    kind = np.uint32 if len(docs) <= 1 << 16 else np.int64
    number = np.repeat(np.arange(len(docs), dtype=kind), [len(x) for x in docs])
    key = np.sort((number << 16) + np.concatenate([np.zeros(0, "<u2"), *docs]))
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[edge] >> 16).astype(np.int64), (key[edge] & 0xFFFF).astype(np.int64), np.diff(np.append(edge, len(key)))


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, terms): 16-bit ids with the end id; null text is empty. Each task adds a row without ids, whose terms are how many of
    its documents hold each id, as 32-bit pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokenizer(tokenizer).encode, np.array([END], "<u2").tobytes()
        total = np.zeros(1 << 16, np.uint32)
        for batch in batches:
            rows = [x + end for x in encode(batch.column("text")).to_pylist()]
            total += np.bincount(counted([np.frombuffer(x, "<u2") for x in rows])[1], minlength=1 << 16).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], ["doc_id", "ids", "terms"])
        found = np.flatnonzero(total)
        terms = np.stack([found.astype("<u4"), total[found]], 1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([terms], pa.binary())], ["doc_id", "ids", "terms"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, terms binary")


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(id, df) over all documents, from the rows with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                pairs = np.frombuffer(x.as_buffer(), "<u4").reshape(-1, 2)
                total[pairs[:, 0]] += pairs[:, 1]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["id", "df"])

    return terms.select("terms").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df").alias("df"))


class Index:
    """BM25 postings of the documents of one shard. Terms in more than half of all documents weigh nothing."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        doc, term, count = counted(docs)
        size, count = np.array([len(d) for d in docs], float), count.astype(float)
        weighty = idf[term] > 0
        self.terms = np.split(term[weighty], np.searchsorted(doc[weighty], np.arange(1, len(docs))))
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[doc] / mean))
        # Postings of terms in an eighth of the documents are kept as rows over all of them, which add up faster.
        self.n = len(docs)
        often = np.flatnonzero(np.bincount(term, minlength=len(idf)) * 8 > self.n)
        self.place = np.full(len(idf), -1)
        self.place[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), np.float32)
        frequent = self.place[term] >= 0
        self.rows[self.place[term[frequent]], doc[frequent]] = weight[frequent]
        used = np.flatnonzero((weight > 0) & ~frequent)
        order = used[np.argsort(term[used], kind="stable")]
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, doc: int) -> np.ndarray:
        terms = self.terms[doc]
        place = self.place[terms]
        begin, end = self.begin[terms], self.begin[terms + 1]
        size = end - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        here = np.zeros(len(self.rows), np.float32)
        here[place[place >= 0]] = 1
        return np.bincount(self.doc[at], self.weight[at], self.n) + here @ self.rows


def best_first(scores: np.ndarray, rest: np.ndarray, some: int = 64) -> Iterator[np.ndarray]:
    """`rest` by falling score, the first `some` at once and then all others."""
    order = -scores[rest]
    if len(rest) > 4 * some:
        top = np.sort(np.argpartition(order, some)[:some])
        yield rest[top[np.argsort(order[top], kind="stable")]]
        others = np.ones(len(rest), bool)
        others[top] = False
        rest, order = rest[others], order[others]
    yield rest[np.argsort(order, kind="stable")]


def fill(sizes: np.ndarray, index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length). A seed, which is what the window before cut off or else the first unused
    document, is followed by its best unused neighbours that fit whole; what is left is filled by cutting the best one that does
    not fit."""
    left, begin, free = int(sizes.sum()), np.zeros(len(sizes), np.int64), np.ones(len(sizes), bool)
    cut, next_free = None, 0
    while left:
        if cut is None:
            while not free[next_free]:
                next_free += 1
            seed = next_free
            free[seed] = False
        else:
            seed = cut
        out, room, cut = [(seed, int(begin[seed]), int(sizes[seed] - begin[seed]))], window, None
        room -= out[0][2]
        rest = np.flatnonzero(free)
        if room and len(rest):
            best = None
            for part in best_first(index.scores(seed), rest):
                for d in part[sizes[part] <= room].tolist():
                    if sizes[d] <= room:
                        out.append((d, 0, int(sizes[d])))
                        free[d] = False
                        room -= int(sizes[d])
                over = part[free[part]]
                if best is None and len(over):
                    best = int(over[0])
                if not room or best is not None:
                    break
            if room and best is not None:
                out.append((best, 0, room))
                free[best] = False
                begin[best] = room
                cut = best
        left -= sum(x[2] for x in out)
        yield out


@lru_cache(maxsize=1)
def directions() -> np.ndarray:
    """A seeded direction of `DIM` signs for each term."""
    return (2 * np.random.default_rng(3).integers(0, 2, (1 << 16, DIM), np.int8) - 1).astype(np.float32)


def outlines(batch: pa.RecordBatch, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of ids, strongest term, unit vector) of each row: BM25 weights of its terms, projected on `DIM` directions."""
    ids = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("ids")]
    size = np.array([len(x) for x in ids], np.int64)
    doc, term, count = counted(ids)
    count = count.astype(np.float32)
    weight = (idf[term] * count / (count + K1 * (1 - B + B * size[doc] / mean))).astype(np.float32)
    end = np.searchsorted(doc, np.arange(len(ids)), "right")
    top, vectors, along, start = np.full(len(ids), -1, np.int64), np.zeros((len(ids), DIM), np.float32), directions(), 0
    for i, stop in enumerate(end.tolist()):
        if stop > start:
            w, t = weight[start:stop], term[start:stop]
            top[i] = t[w.argmax()]
            vectors[i] = w @ along[t]
        start = stop
    return size, top, vectors / np.maximum(np.sqrt((vectors**2).sum(1)), 1e-9)[:, None]


class Halvings:
    """A balanced tree of halvings by two means, fitted on a sample; leaves are numbered so that near ones lie side by side."""

    def __init__(self, sample: np.ndarray, leaf_rows: int):
        self.axis, self.cut, self.child, self.leaves = [], [], [], 0
        self.rng = np.random.default_rng(9)
        self.top = self._grow(sample, leaf_rows)

    def _grow(self, rows: np.ndarray, leaf_rows: int) -> int:
        """Index of a node, or -1 - leaf."""
        if len(rows) >= 2 * leaf_rows:
            axis = rows[self.rng.integers(len(rows))] - rows[self.rng.integers(len(rows))]
            for _ in range(8):
                along = rows @ axis
                high = along > np.median(along)
                if not high.any():
                    break
                axis = rows[high].mean(0) - rows[~high].mean(0)
            along = rows @ axis
            # The widest gap near the middle, so that a group of like rows is not cut where it need not be.
            order = np.sort(along)
            middle = order[len(order) * 2 // 5 : len(order) * 3 // 5 + 1]
            gap = int(np.diff(middle).argmax()) if len(middle) > 1 else 0
            cut = float(middle[gap : gap + 2].mean())
            if (along > cut).any() and (along <= cut).any():
                at = len(self.axis)
                self.axis.append(axis)
                self.cut.append(cut)
                self.child.append(None)
                self.child[at] = (self._grow(rows[along <= cut], leaf_rows), self._grow(rows[along > cut], leaf_rows))
                return at
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> np.ndarray:
        out, work = np.zeros(len(x), np.int64), [(self.top, np.arange(len(x)))]
        while work:
            node, at = work.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                far = x[at] @ self.axis[node] > self.cut[node]
                work += [(self.child[node][0], at[~far]), (self.child[node][1], at[far])]
        return out


class Places:
    """Centroids of unit vectors, by the leaves of a tree and a few rounds of k-means, in an order in which like ones lie side by side."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, rounds: int = 8):
        at = Halvings(sample, leaf_rows).route(sample)
        for _ in range(rounds if len(sample) else 0):
            total = np.zeros((at.max() + 1, DIM), np.float32)
            np.add.at(total, at, sample)
            size = np.sqrt((total**2).sum(1))
            self.centroids = total[size > 1e-6] / size[size > 1e-6, None]
            if not len(self.centroids):
                break
            at = self.route(sample)
        else:
            self.centroids = self.centroids[np.argsort(Halvings(self.centroids, 1).route(self.centroids), kind="stable")] if len(sample) else sample

    def route(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row."""
        if not len(self.centroids):
            return np.zeros(len(x), np.int64)
        return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 1024] @ self.centroids.T).argmax(1) for i in range(0, len(x), 1024))])

    def route_by_groups(self, x: np.ndarray, tried: int = 6) -> np.ndarray:
        """The nearest centroid among those of the `tried` nearest groups; a group is some that lie side by side."""
        n = len(self.centroids)
        width = max(1, int(np.sqrt(n)))
        if n <= tried * width:
            return self.route(x)
        begin = np.arange(0, n, width)
        middle = np.add.reduceat(self.centroids, begin)
        middle /= np.maximum(np.sqrt((middle**2).sum(1)), 1e-9)[:, None]
        near = np.argpartition(-(x @ middle.T), tried, axis=1)[:, :tried]
        best, found = np.full(len(x), -np.inf, np.float32), np.zeros(len(x), np.int64)
        for g, b in enumerate(begin.tolist()):
            at = np.flatnonzero((near == g).any(1))
            if len(at):
                score = x[at] @ self.centroids[b : b + width].T
                one = score.argmax(1)
                value = score[np.arange(len(at)), one]
                better = value > best[at]
                best[at[better]], found[at[better]] = value[better], b + one[better]
        return found


def placed(tails: DataFrame, idf: Broadcast, mean: float, shard_tokens: int, sample_rows: int = 20_000, leaf_rows: int = 8) -> DataFrame:
    """(row, shard) of rows (row, ids): documents in the order of their nearest centroids, then of their strongest terms, cut every
    `shard_tokens` ids or so. The centroids are fitted on at most `sample_rows` documents; all are placed by them."""
    spark = tails.sparkSession

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(outlines(batch, idf.value, mean)[2]), pa.list_(pa.float32()))], ["v"])

    n, draw = tails.count(), F.xxhash64(F.lit(4), "row")
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    sample = tails.filter(F.pmod(draw, F.lit(1 << 30)) <= int(share * (1 << 30))).select("ids", draw.alias("draw")).orderBy("draw").limit(sample_rows).select("ids")
    sample = np.array([r.v for r in sample.mapInArrow(drawn, "v array<float>").collect()], np.float32).reshape(-1, DIM)
    tree = spark.sparkContext.broadcast(Places(sample, leaf_rows))  # about sample_rows / leaf_rows centroids at most

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, top, vectors = outlines(batch, idf.value, mean)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(size), pa.array(tree.value.route_by_groups(vectors)), pa.array(top)], ["row", "n", "leaf", "top"])

    rows = stored(tails.mapInArrow(found, "row long, n long, leaf long, top long"), "outlines")  # ranges sample what they deal
    rows = rows.repartitionByRange("leaf", "top", "row").sortWithinPartitions("leaf", "top", "row")
    rows = stored(rows.select("row", "n", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("at")), "order")
    counts = rows.groupBy("part").agg(F.sum("n").alias("all"))
    starts = running_start(counts, [], "part", "all", "start").select("part", "start")
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "part")
    return rows.select("row", F.floor((F.col("start") + F.col("own")) / shard_tokens).alias("shard"))


def packed(docs: DataFrame, tokenizer: str, window: int = 2048, shard_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most `window` ids: PIECE.

    A document's ids are the tokenizer's and an end id, so null and empty texts are one id. Whole windows of long documents are
    sequences of their own; what remains of each document is put in an order in which documents of like BM25 weights lie side by side (see
    `placed`), and this order is cut into shards of about `shard_tokens` ids each. So neighbours meet in a shard's index however many
    shards there are, and a group of equal documents of any size is cut like any other stretch. Repeated rows are documents of their own. Document frequencies and the mean length are those of all documents. Sequences other than the last of
    a shard are full. Texts of any length are read whole; a table without rows gives none. Other columns are left out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = (F.length("ids") / 2).cast("long")
    both = stored(tokenised(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "tokens")
    tokens, terms = both.filter("terms IS NULL").drop("terms"), both.filter("terms IS NOT NULL")
    n, total = tokens.agg(F.count("*"), F.sum(size)).first()
    frequency = np.zeros(1 << 16)
    for r in document_frequencies(terms).collect():  # one row for each id of the tokenizer at most
        frequency[r.id] = r.df
    idf = spark.sparkContext.broadcast(np.where(frequency > 0, np.maximum(0, np.log((n - frequency + 0.5) / (frequency + 0.5))), 0))
    mean = (total or 1) / max(1, n)

    def pieces(rows: list[tuple], sequences: np.ndarray, offsets: np.ndarray) -> pa.Table:
        key, start, ids, whole = zip(*rows, strict=True) if rows else ((),) * 4
        columns = [pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(whole, pa.int64()), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
        return pa.table(columns, PIECE_COLUMNS)

    def long_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole windows: even sequence numbers, counted from the number of the task."""
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = np.frombuffer(ids.as_buffer(), "<u2")
                rows = [(key, s, x[s : s + window], len(x)) for s in range(0, len(x) - window + 1, window)]
                yield from pieces(rows, 2 * (number + np.arange(len(rows))), np.zeros(len(rows), np.int64)).to_batches()
                number += len(rows)

    def shard(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("row").to_numpy(), kind="stable")
        ids = [np.frombuffer(x.as_buffer(), "<u2") for x in group.column("ids")]
        ids, keys, starts = [ids[i] for i in order], group.column("doc_id").to_pylist(), group.column("start").to_pylist()
        keys, starts = [keys[i] for i in order], [starts[i] for i in order]
        rows, sequences, offsets = [], [], []
        for k, window_pieces in enumerate(fill(np.array([len(x) for x in ids]), Index(ids, idf.value, mean), window)):
            at = 0
            for d, start, length in window_pieces:
                rows.append((keys[d], starts[d] + start, ids[d][start : start + length], starts[d] + len(ids[d])))
                sequences.append(2 * ((key[0].as_py() << 32) + k) + 1)
                offsets.append(at)
                at += length
        return pieces(rows, np.array(sequences, np.int64), np.array(offsets, np.int64))

    full = tokens.filter(size >= window).select("doc_id", "ids")
    start = size - size % window
    rest = tokens.filter(size % window > 0).select("doc_id", "row", start.alias("start"), F.expr(f"substring(ids, 2 * (length(ids) div 2 - length(ids) div 2 % {window}) + 1)").alias("ids"))
    rest = rest.join(placed(rest.select("row", "ids"), idf, mean, shard_tokens), "row")
    return full.mapInArrow(long_ones, PIECE).union(rest.groupBy("shard").applyInArrow(shard, PIECE))
