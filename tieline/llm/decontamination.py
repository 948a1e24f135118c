"""Training text without benchmark items: longest matches along a generalised suffix automaton of the items' words."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import bounded_batches, pick, stored

WINDOW = 10
SHARD_WORDS = 1 << 18  # words of items in one automaton, which has at most twice as many states
GRAM = 4
CHUNK_BYTES = 4 << 20
# Bytes of words as they are, lower-cased; all others become blanks. Every byte of a character beyond ASCII is part of a word.
LETTERS = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))
SPANS = "array<struct<start:long,length:long>>"
FOUND = f"doc_id long, text string, n_words long, longest long, spans {SPANS}, items array<string>"


class Automaton:
    """Generalised suffix automaton of the items' words. `go` has a state's follower by state * size + word; `link` its longest suffix
    in another state; `length` its longest string."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.words: dict[bytes, int] = {}
        coded = [(item, [self.words.setdefault(w, len(self.words)) for w in ws]) for item, ws in items if ws]
        self.size, self.window = max(1, len(self.words)), window
        self.go: dict[int, int] = {}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = [(item, ids, self._add(ids)) for item, ids in coded]
        self.go = {s * self.size + c: t for s, out in enumerate(self.follow) for c, t in out.items()}
        del self.follow
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=window)
        self._mark(ends)
        self.gram = min(GRAM, self.shortest)
        grams = [hashed(np.array(ids, np.int64), self.gram) for _, ids in coded]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.follow.append(follow)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The follower of `state` that stands for strings one word longer than those of `state` and no others."""
        old = self.follow[state][word]
        if self.length[old] == self.length[state] + 1:
            return old
        new = self._state(self.length[state] + 1, dict(self.follow[old]), self.link[old])
        self.link[old] = new
        while state >= 0 and self.follow[state].get(word) == old:
            self.follow[state][word] = new
            state = self.link[state]
        return new

    def _add(self, ids: list[int]) -> int:
        last = 0
        for c in ids:
            if c in self.follow[last]:
                last = self._split(last, c)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and c not in self.follow[at]:
                self.follow[at][c] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, c)
            last = new
        return last

    def _mark(self, ends: list[tuple[str | None, list[int], int]]) -> None:
        """`at_window`: the state of a state's suffix of `window` words. `holders`: items by state of a window. `whole`: for the states
        that end in items shorter than the window, (their length, the items), shortest last."""
        self.at_window, own = np.full(len(self.link), -1, np.int64), {}
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= self.window:
                self.at_window[s] = s if self.length[self.link[s]] < self.window else self.at_window[self.link[s]]
        self.at_window = self.at_window.tolist()
        holders: dict[int, set] = {}
        for item, ids, end in ends:
            if len(ids) < self.window:
                own.setdefault(end, set()).add(item)
                continue
            s = 0
            for i, c in enumerate(ids):
                s = self.go[s * self.size + c]
                if i + 1 >= self.window:
                    holders.setdefault(self.at_window[s], set()).add(item)
        self.holders = {s: frozenset(x) - {None} for s, x in holders.items()}
        self.whole: dict[int, tuple] = {}
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__) if own else ():
            mine = ((self.length[s], frozenset(own[s]) - {None}),) if s in own else ()
            if mine or self.link[s] in self.whole:
                self.whole[s] = mine + self.whole.get(self.link[s], ())

    def stretches(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """Where matches of `shortest` words can be: runs of words whose successive grams, never across documents, are all grams of an
        item, by hash; what is only equal by hash is settled by the walk. A longer match lies in one of them whole."""
        g = self.gram
        n = len(ids) - g + 1
        if n <= 0 or not len(self.grams):
            return []
        known = np.flatnonzero((ids[:n] >= 0) & (doc[:n] == doc[g - 1 :]))
        if g > 1:
            known = known[np.all([ids[known + k] >= 0 for k in range(1, g)], axis=0)]
        codes = hashed(ids, g)[known]
        at = known[self.grams[np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)] == codes]
        if not len(at):
            return []
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(doc[at], prepend=-1) != 0))
        begin, end = at[new], np.append(at[new[1:] - 1], at[-1]) + g
        long_enough = end - begin >= self.shortest
        return list(zip(begin[long_enough].tolist(), end[long_enough].tolist(), strict=True))

    def walk(self, ids: list[int]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(longest match, word spans covered by windows, items of these windows) of a stretch."""
        go, link, length, size, window = self.go, self.link, self.length, self.size, self.window
        state = matched = longest = 0
        spans, items = [], set()
        for i, c in enumerate(ids):
            then = go.get(state * size + c)
            while then is None and state:
                state = link[state]
                matched = length[state]
                then = go.get(state * size + c)
            if then is None:
                continue
            state, matched = then, matched + 1
            longest = max(longest, matched)
            hit = 0
            if matched >= window:
                hit = window
                items |= self.holders[self.at_window[state]]
            for n, owners in self.whole.get(state, ()):
                if n <= matched:
                    hit = max(hit, n)
                    items |= owners
            if hit:
                begin = i + 1 - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return longest, spans, items


def hashed(ids: np.ndarray, gram: int) -> np.ndarray:
    n = max(0, len(ids) - gram + 1)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = (out ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _walked(shared: Broadcast):
    def chunk(automaton: Automaton, rows: list[dict]) -> pa.RecordBatch:
        split = [(r["text"] or "").encode().translate(LETTERS).split() for r in rows]
        sizes = np.array([len(w) for w in split], np.int64)
        first = np.cumsum(sizes) - sizes
        flat = [w for ws in split for w in ws]
        ids = np.fromiter(map(automaton.words.get, flat, repeat(-1)), np.int64, len(flat))
        doc = np.repeat(np.arange(len(rows)), sizes)
        for r, w in zip(rows, split, strict=True):
            r["n_words"] = len(w)
        for b, e in automaton.stretches(ids, doc):
            longest, spans, items = automaton.walk(ids[b:e].tolist())
            if longest >= automaton.shortest:
                r, at = rows[doc[b]], b - int(first[doc[b]])
                r["longest"] = max(r["longest"], longest)
                before = [(s["start"], s["start"] + s["length"]) for s in r["spans"]]
                r["spans"] = [{"start": x, "length": y - x} for x, y in united(before + [(at + x, at + y) for x, y in spans])]
                r["items"] = sorted(items.union(r["items"]))
        return pa.RecordBatch.from_pylist(rows, SCHEMA)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_pylist():
                rows.append(r)
                size += len(r["text"] or "")
                if size >= CHUNK_BYTES:
                    yield chunk(automaton, rows)
                    rows, size = [], 0
            if rows:
                yield chunk(automaton, rows)

    return walked


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("items", pa.list_(pa.string()))])


def automata(items: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(shard, automaton) of items (item_id, text), built by Spark tasks and stored. Items are dealt to shards of about `shard_words`
    words by a hash; equal rows count once. An item with more words than that is still walked whole."""
    items = pick(items, "item_id", "text").distinct()
    total = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    shards = -(-total // shard_words)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(((None if i is None else str(i), t or "") for i, t in zip(*[group.column(c).to_pylist() for c in ("item_id", "text")], strict=True)), key=repr)
        made = Automaton([(i, t.encode().translate(LETTERS).split()) for i, t in rows], window)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([pickle.dumps(made)], pa.binary())})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("text", "item_id"), F.lit(max(1, shards))).cast("long"))
    return stored(dealt.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, n_words, longest, spans, items) of every row of `docs` (doc_id, text) against `items` (item_id, text), as FOUND.

    Words are runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased. A window is `window` consecutive words of an item, or a
    whole item of fewer words; `spans` are the stretches of words that occurrences of windows cover, `items` the ids of the items with
    occurring windows, as sorted strings, `longest` the length of the longest string of words that some item has too (0 where it is
    shorter than every window). Every document is walked whole, with each shard's automaton in turn: a task holds one shard. Items
    that repeat an id are one item with the windows of all; one without id marks words but is not listed; one without words has no
    windows. Repeated documents and documents without id are rows of their own, null texts have no words. Other columns are left
    out. Without items nothing matches; a table without rows gives none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    found = pick(docs, "doc_id", "text").select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    made = automata(items, window, shard_words)
    shards = [r.shard for r in made.select("shard").collect()]  # one number for each `shard_words` words of items
    if not shards:
        shared = spark.sparkContext.broadcast(pickle.dumps(Automaton([], window)))
        return found.mapInArrow(_walked(shared), FOUND)
    for i, shard in enumerate(sorted(shards)):
        if i:
            found = stored(found, "matched")
        shared = spark.sparkContext.broadcast(bytes(made.filter(F.col("shard") == shard).first().automaton))
        found = found.mapInArrow(_walked(shared), FOUND)
    return found


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_length: int = WINDOW - 1, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_hit, longest, items) of the documents kept: spans of more than `max_length` words go from the text, from
    their first word's first byte to their last word's last, and documents go where spans cover more than `max_coverage` of the words.
    What else there is stays as it was; rows are treated as `matches` says."""
    found = matches(docs, items, window, shard_words).withColumn("n_hit", n_hit()).filter(F.col("n_hit") <= F.col("n_words") * max_coverage)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, [s for s in spans if s["length"] > max_length]) for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns("spans")

    return found.mapInArrow(cut, "doc_id long, text string, n_words long, longest long, items array<string>, n_hit long")


def _without(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    data = text.encode()
    filled = np.frombuffer(data.translate(LETTERS), np.uint8) != 32
    edge = np.diff(filled.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        out.append(data[at : begins[s["start"]]])
        at = ends[s["start"] + s["length"] - 1]
    return b"".join([*out, data[at:]]).decode()


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win
  FROM (SELECT *, least(len(w), {WINDOW}) AS size, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT r, size, i, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT dw.r, dw.i, dw.size FROM dw SEMI JOIN iw USING (size, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM dw JOIN iw USING (size, win) WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""
