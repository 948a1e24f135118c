"""Periodic runs of words: stretches that repeat with a period, found by a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import bounded_batches, pick, words

MIN_WORDS = 12
LEAST = 4  # words of the shortest factor named; every run of 12 words or more repeats one of them at its period
RUNS = "array<struct<start:long,length:long,period:long>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
CHUNK_BYTES = 4 << 20


def named(doc: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose (left, right) recurs in their document, and a number for each distinct one, by sorting."""
    order = np.lexsort((at, right, left, doc))
    d, a, b, p = doc[order], left[order], right[order], at[order]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    name = np.cumsum(new) - 1
    often = np.bincount(name, minlength=1)[name] > 1
    return p[often], np.unique(name[often], return_inverse=True)[1]


def factors(ids: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The dictionary: per power of two m, (m, names by position, positions, their names) of the factors of m words that recur in
    their document, the last two ordered by name and position; -1 where a factor does not recur. Longer ones are pairs of shorter."""
    n, out = len(ids), []
    if n < LEAST:
        return out
    at = np.flatnonzero(np.arange(n) + LEAST <= stop)
    mixed = ids.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32))
    rolled = np.zeros(len(at), np.uint64)
    for k in range(LEAST):  # a hash drops most positions; what stays is named exactly
        rolled = (rolled ^ mixed[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    found = np.minimum(np.searchsorted(twice, rolled), len(twice) - 1)
    at = at[twice[found] == rolled]
    pairs = np.unique(np.concatenate([at, at + 2]))
    code = ids[pairs].astype(np.int64) * (int(ids.max()) + 1) + ids[pairs + 1]
    two = np.unique(code, return_inverse=True)[1]
    at, name = named(doc[at], two[np.searchsorted(pairs, at)], two[np.searchsorted(pairs, at + 2)], at)
    m = LEAST
    while len(at):
        names = np.full(n, -1, np.int32)
        names[at] = name
        out.append((m, names, at, name))
        longer = at[at + 2 * m <= stop[at]]
        longer = longer[names[longer + m] >= 0]
        at, name = named(doc[longer], names[longer], names[longer + m], longer)
        m *= 2
    return out


def common_length(table: list, ids: np.ndarray, stop: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from j on equal those from i on (i < j, one document)."""
    length = np.zeros(len(i), np.int64)
    last = len(ids) - 1
    for m, names, _, _ in reversed(table):
        a, b = i + length, np.minimum(j + length, last)
        more = (j + length < stop[i]) & (names[a] >= 0) & (names[a] == names[b])
        length += m * more
    open_ = np.ones(len(i), bool)
    for _ in range(LEAST - 1):
        b = j + length
        open_ &= (b < stop[i]) & (ids[i + length] == ids[np.minimum(b, last)])
        length += open_
    return length


def find_runs(ids: np.ndarray, doc: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period. `ids` are the words of several documents one after the other;
    `doc`, `begin` and `stop` give each position's document, its first word and the one after its last.

    Occurrences of a factor of m words that follow one of them at a distance from m to 2m form an arithmetic progression. Its first
    and second members propose the distance as a period where the word before does not continue it; all later members share the
    second one's word before, so they are only listed where that one starts a run. A run's proposals that are multiples of its period
    cover the same stretch, and the smallest stays."""
    table = factors(ids, doc, stop)
    none = np.zeros(0, np.int64)
    starts, periods = [none], [none]
    width = 4 * len(ids) + 4

    def starts_here(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (i == begin[i]) | (ids[i - 1] != ids[j - 1])

    def listed(i: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> None:
        count = high - low
        rows = np.repeat(np.arange(len(i)), count)
        j = at[low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)]
        good = starts_here(i[rows], j)
        starts.append(i[rows][good])
        periods.append(j[good] - i[rows][good])

    for m, _, at, name in table:
        key = name.astype(np.int64) * width + at
        low, high = np.searchsorted(key, key + (1 if m == LEAST else m)), np.searchsorted(key, key + 2 * m)
        some = high > low
        i, low, high = at[some], low[some], high[some]
        if m == LEAST:
            listed(i, low, high, at)  # at most 2 * LEAST - 1 each
            continue
        listed(i, low, low + 1, at)
        rest = high - low > 1
        i, low, high = i[rest], low[rest] + 1, high[rest]
        go = starts_here(i, at[low])
        listed(i[go], low[go], high[go], at)
    start, period = np.concatenate(starts).astype(np.int64), np.concatenate(periods).astype(np.int64)
    length = period + common_length(table, ids, stop, start, start + period)
    good = length >= np.maximum(MIN_WORDS, 2 * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _chunk(doc_ids: list, texts: list[bytes]) -> pa.RecordBatch:
    split = [t.split() for t in texts]  # bytes split at the six blanks of `[^\x20\x09-\x0D]+`
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes)
    flat = [w for ws in split for w in ws]
    ids = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    start, length, period = find_runs(ids, doc, (ends - sizes)[doc], ends[doc])
    owner = doc[start] if len(start) else start
    gone = np.zeros(len(flat) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    keep = np.cumsum(gone)[:-1] == 0
    cut = set(owner.tolist())
    collapsed = [b" ".join(compress(w, keep[e - len(w) : e].tolist()) if d in cut else w).decode() for d, (w, e) in enumerate(zip(split, ends.tolist(), strict=True))]
    run = pa.StructArray.from_arrays([pa.array(start - (ends - sizes)[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(split)))])
    runs = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), run)
    return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, size = [], [], 0
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            ids.append(d)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield _chunk(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield _chunk(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of `docs` (doc_id, text), as FOUND.

    A run is a stretch of at least 12 words and two periods that no neighbouring word extends, under its smallest period; `runs` is
    ordered by start, then period, and overlapping runs are all listed. `collapsed` is the text's words without those that a run
    holds after its first period, joined by single spaces. Every document is searched on its own, whole, in time n log n; null and
    empty texts have no words. Repeated rows and rows without id are found like any others. Other columns are left out; a table
    without rows gives none."""
    bounded_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(_found, FOUND)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or where 10 divides the CRC-32 of the decimal doc_id, its words with the ones from a on replaced by repeats of the
    first p of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    repeated = F.transform(F.array(words(text)), lambda w: _repeated(w, F.floor(h / 10)))[0]  # the words are split once
    return F.when(h % 10 == 0, repeated).otherwise(text)


def _repeated(w: Column, g: Column) -> Column:
    n = F.size(w)
    a = g % F.greatest(n, F.lit(1))
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    copies = F.array_repeat(F.slice(w, (a + 1).cast("int"), p), F.ceil((n - a) / p).cast("int"))
    changed = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(copies), F.lit(1), (n - a).cast("int")))
    return F.array_join(F.when(n > 0, changed).otherwise(w), " ")
