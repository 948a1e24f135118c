"""Repeated byte strings by prefix doubling over sampled positions.

Doubling every byte position would send each of them through seven sorts. Here the names (ranks) of the strings of 1, 2, 4, ... 64 and
100 bytes at a position are built from pairs of names within the row, as fingerprints, which agree across the cluster; Spark sorts only
where names must meet. The first round is at `ANCHOR` bytes, over sampled positions: of the anchor names in each 100-byte window the
smallest is taken, so equal windows take equal anchors. Runs of windows with one anchor are named by their first and last window.
An anchor name whose runs are all alike is settled. The others go on to a round at `CORE` bytes, which the windows of each `GRAIN` shifts
against the anchor share, and what that leaves open to the round at `LENGTH` bytes, window by window."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import bounded_batches, pick, stored

LENGTH, ANCHOR = 100, 32
WINDOW = LENGTH - ANCHOR + 1
GRAIN = 8
GRAINS = 16  # above WINDOW / GRAIN
CORE = LENGTH - GRAIN + 1
BLOCK = 1 << 20  # bytes looked at together
PLACE = np.uint64((1 << 21) - 1)
LAST = np.iinfo(np.int64).max
ROW = 1 << 44  # places of runs are below
KEY = ["doc_id", "h1", "h2"]  # rows that agree in all three are one document
NAMED = ["anchor", "name", *KEY, "place"]
KINDS = ["run", "open_run", "grain", "open_grain", "window"]


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    out = x * np.uint64(0x9E3779B97F4A7C15)
    out += y
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def doubled(name: np.ndarray, step: int, level: int) -> np.ndarray:
    """`pair` of each name with the one `step` behind it, by fewer operations: the names of two bytes are spread already."""
    out = name[:-step] * np.uint64(0x9E3779B97F4A7C15 + (level << 33))
    out += name[step:]
    out ^= out >> np.uint64(32)
    return out


TWO_BYTES = pair(pair(np.arange(1 << 16, dtype=np.uint64), np.uint64(0x5851F42D4C957F2D)), np.uint64(0x14057B7EF767814F))


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) for the values low to high of each index."""
    size = high - low + 1
    row = np.repeat(np.arange(len(low)), size)
    return row, low[row] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def among(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each of `x` is in the sorted `wanted`."""
    if not len(wanted):
        return np.zeros(len(x), bool)
    at = np.searchsorted(wanted, x)
    return wanted[np.minimum(at, len(wanted) - 1)] == x


class Block:
    """Texts, or parts of a long one that overlap, end to end, with their windows of LENGTH bytes in runs of one anchor. Positions are
    those in the block; `shift` of a run's segment leads to those in the text."""

    def __init__(self, segments: list[tuple[int, int, bytes]]):
        row, start, data = zip(*segments, strict=True)
        size = np.array([len(x) for x in data])
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(data), np.uint8)
        name, step = TWO_BYTES[(raw[:-1].astype(np.uint16) << np.uint16(8)) | raw[1:]], 2
        while step < ANCHOR:
            name, step = doubled(name, step, step), 2 * step
        self.names, self.bytes = name, len(raw)
        low = (name & ~PLACE) | np.arange(len(name), dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
        segment, self.window = spread(begin, begin + size - LENGTH)
        where = (low[self.window] & PLACE).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        self.first, self.last = self.window[edge], self.window[np.concatenate([edge[1:], [len(where)]]) - 1]
        self.at, segment = where[edge], segment[edge]
        self.row, self.shift = np.array(row)[segment], (np.array(start) - begin)[segment]
        self.anchor = name[self.at]

    @cached_property
    def half(self) -> np.ndarray:
        return doubled(self.names, ANCHOR, ANCHOR)

    @cached_property
    def full(self) -> np.ndarray:
        return self._longer(LENGTH)

    @cached_property
    def core(self) -> np.ndarray:
        return self._longer(CORE)

    def _longer(self, size: int) -> np.ndarray:
        return pair(self.half[: self.bytes - size + 1], self.half[size - 2 * ANCHOR : self.bytes - 2 * ANCHOR + 1])

    def run_names(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        shape = ((at - first) * WINDOW + (last - at + WINDOW)).astype(np.uint64)
        return pair(pair(self.full[first], self.full[last]), shape)

    def split(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs in the sorted `wanted` in grains: number of the run, grain, first and last window."""
        mine = np.flatnonzero(among(self.row * ROW + self.at + self.shift, wanted))
        row, grain = spread((self.at - self.last)[mine] // GRAIN, (self.at - self.first)[mine] // GRAIN)
        run = mine[row]
        return run, grain, np.maximum(self.first[run], self.at[run] - grain * GRAIN - GRAIN + 1), np.minimum(self.last[run], self.at[run] - grain * GRAIN)

    def grain_places(self, run: np.ndarray, grain: np.ndarray) -> np.ndarray:
        return (self.row[run] * ROW + self.at[run] + self.shift[run]) * GRAINS + grain


def blocks(texts: list[bytes]) -> Iterator[Block]:
    held, size = [], 0
    for row, text in enumerate(texts):
        for start in range(0, len(text) - LENGTH + 1, BLOCK):
            held.append((row, start, text[start : start + BLOCK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= BLOCK // 2:
                yield Block(held)
                held, size = [], 0
    if held:
        yield Block(held)


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [(x.as_py() or "").encode() for x in batch.column("text")]


def listed(batch: pa.RecordBatch, column: str, unit: int) -> np.ndarray:
    """The places of a list column, sorted, with their row before them; `unit` is above all places."""
    lists = batch.column(column)
    size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    row = np.repeat(np.arange(len(size)), size)
    return np.sort(row * unit + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def sent(batch: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """NAMED of a batch: the first of each name of a text, with its document."""
    if not found:
        return
    anchor, name, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
    kept = np.sort(np.unique(pair(name, row.astype(np.uint64)), return_index=True)[1])
    row = row[kept]
    document = [batch.column(c).to_numpy(zero_copy_only=False)[row] for c in KEY]
    columns = (anchor[kept].view(np.int64), name[kept].view(np.int64), *document, place[kept])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], NAMED)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text."""
    for batch in batches:
        yield from sent(batch, [(b.anchor, b.run_names(b.at, b.first, b.last), b.row, b.at + b.shift) for b in blocks(texts_of(batch))])


def _grains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grains of the runs at `places`, under the name of what their windows share."""
    for batch in batches:
        wanted, found = listed(batch, "places", ROW), []
        for b in blocks(texts_of(batch)):
            run, grain, first, last = b.split(wanted)
            shared = pair(pair(b.anchor[run], b.core[b.at[run] - grain * GRAIN]), grain.astype(np.uint64))
            found.append((shared, b.run_names(b.at[run], first, last), b.row[run], (b.at + b.shift)[run] * GRAINS + grain))
        yield from sent(batch, found)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the grains at `places`."""
    for batch in batches:
        wanted, found = listed(batch, "places", ROW * GRAINS), []
        for b in blocks(texts_of(batch)):
            run, grain, first, last = b.split(np.unique(wanted // GRAINS))
            mine = among(b.grain_places(run, grain), wanted)
            index, start = spread(first[mine], last[mine])
            run = run[mine][index]
            found.append((b.anchor[run], pair(b.full[start], (b.at[run] - start).astype(np.uint64)), b.row[run], start + b.shift[run]))
        yield from sent(batch, found)


def repeats(texts: list[bytes], runs: np.ndarray, grains: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """For each text whether its bytes go, from the sorted places of the runs, grains and windows that are all new: any other window
    is a repeat."""
    size = np.array([len(t) + 1 for t in texts], np.int64)  # and a byte between texts that stays
    begin = np.cumsum(size) - size
    change = np.zeros(size.sum() + 1, np.int32)
    for b in blocks(texts):
        new = np.zeros(b.bytes + 1, np.int32)
        mine = among(b.row * ROW + b.at + b.shift, runs)
        new[b.first[mine]] += 1
        new[b.last[mine] + 1] -= 1
        run, grain, first, last = b.split(np.unique(grains // GRAINS))
        mine = among(b.grain_places(run, grain), grains)
        index, at = spread(first[mine], last[mine])
        known = np.cumsum(new) > 0
        known[at] = True
        owner = np.searchsorted(b.first, b.window, "right") - 1
        start, row = b.window + b.shift[owner], b.row[owner]
        old = ~known[b.window] & ~among(row * ROW + start, windows)
        at = (begin[row] + start)[old]
        change[at] += 1
        change[at + LENGTH] -= 1
    gone = np.cumsum(change) > 0
    return [gone[a : a + n - 1] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, texts = {kind: listed(batch, kind, ROW * GRAINS if "grain" in kind else ROW) for kind in KINDS}, texts_of(batch)
        gone = repeats(texts, np.setdiff1d(own["run"], own["open_run"]), np.setdiff1d(own["grain"], own["open_grain"]), own["window"])
        edges = [np.flatnonzero(np.diff(g, prepend=False, append=False)) for g in gone]
        kept = [np.frombuffer(t, np.uint8)[~g].tobytes() if g.any() else t for t, g in zip(texts, gone, strict=True)]
        spans = pa.list_(pa.int64())
        columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([e[::2] for e in edges], spans), pa.array([e[1::2] for e in edges], spans), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "starts", "ends", "kept"])


def _first(docs: DataFrame, work, twins: DataFrame | None, kind: str) -> DataFrame:
    """(anchor, doc_id, h1, h2, place), stored: of each name the documents with the smallest doc_id that hold it, and there its first
    place. h1 and h2 are null where the id tells the document.

    Copies meet in the tasks that read them before they are sent. `twins` are documents that share their id with others: as none of
    them is earlier, each asks on its own whether a smaller id holds its names."""
    named = ", ".join(f"{x} long" for x in NAMED)
    least = docs.mapInArrow(work, named).groupBy("anchor", "name").agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"))
    alone = [F.lit(None).cast("long").alias(h) for h in KEY[1:]]
    if twins is None:
        return stored(least.select("anchor", "doc_id", *alone, "place"), kind)
    least = stored(least, "names")
    shared = twins.select("doc_id").distinct()
    own = docs.join(twins, KEY, "left_semi").mapInArrow(work, named).join(least.select("anchor", "name", "doc_id"), ["anchor", "name", "doc_id"], "left_semi")
    single = least.join(shared, "doc_id", "left_anti").select("anchor", "doc_id", *alone, "place")
    return stored(single.union(own.select("anchor", *KEY, "place")), kind)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) for each row of `docs` (doc_id, text): the maximal byte ranges [start, end) covered by
    a 100-byte string that also starts earlier, and the bytes left.

    Earlier: in a smaller doc_id, or before in the same document; rows without doc_id come after all others. A row repeated with id and
    text is one document and gets one answer. Of texts that share an id, or have none, neither is earlier: each loses what smaller ids
    hold and what it repeats itself. Null and empty texts have no bytes; those under 100 bytes lose none. Texts of any length are read
    whole, in parts that overlap. A table without rows gives none. Other columns are left out."""
    bounded_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    known = stored(docs.select(*KEY).distinct(), "known")
    ids = stored(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h1").alias("h1"), F.min("h2").alias("h2")), "ids")
    twins = known.join(ids.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    twins = None if twins.isEmpty() else stored(twins, "twins")
    single = ids.filter("n = 1").select(*KEY)

    def listed_by_document(rows: DataFrame, *lists) -> DataFrame:
        """One row for each document, with h1 and h2 also where its id tells it."""
        rows = rows.groupBy(*KEY).agg(*lists)
        known = rows.filter("h1 IS NOT NULL")
        return rows.filter("h1 IS NULL").drop("h1", "h2").join(single, "doc_id").select(*known.columns).union(known)

    found, asked = {}, None
    for kind, work in (("run", _runs), ("grain", _grains), ("window", _windows)):
        found[kind] = first = _first(docs if asked is None else docs.join(asked, KEY), work, twins, kind)
        if kind == "window":
            break
        shared = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
        found["open_" + kind] = stored(first.join(shared, "anchor", "left_semi").drop("anchor"), "open_" + kind)
        asked = listed_by_document(found["open_" + kind], F.collect_list("place").alias("places"))
    rows = None
    for kind, df in found.items():
        df = df.select(*KEY, "place", F.lit(KINDS.index(kind)).cast("byte").alias("kind"))
        rows = df if rows is None else rows.union(df)
    lists = listed_by_document(rows, *[F.collect_list(F.when(F.col("kind") == i, F.col("place"))).alias(kind) for i, kind in enumerate(KINDS)])
    cut = docs.join(lists, KEY, "left").mapInArrow(_cut, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))
