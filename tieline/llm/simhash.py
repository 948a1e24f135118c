"""SimHash near-duplicates: fingerprints in a vantage-point tree whose leaves are Spark partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import pick, stored
from tieline.llm.components import roots

SHINGLE, SEED, RADIUS = 3, 42, 2


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the shingles, repeats included; of fewer words the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as a signed long: a bit is set if it is set in more than half of the shingle hashes."""
    return folded(shingle_hashes(text, shingle))


def folded(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def distances(point: np.uint64, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(to ^ point)


class Tree:
    """Vantage points of the shards, fitted on a bounded sample of distinct fingerprints. A point lies in the near child if its
    distance is at most `mu`, else in the far one; a ball around it also reaches the other child if the distance is within the
    radius of the border (triangle inequality)."""

    def __init__(self, sample: np.ndarray, shards: int, seed: int = 7, radius: int = RADIUS):
        self.vantage, self.mu, self.child, self.radius = [], [], [], radius
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.top = self._grow(sample, shards)

    def _grow(self, points: np.ndarray, shards: int) -> int:
        """Index of a node, or -1 - leaf."""
        split = self._split(points) if shards > 1 and len(points) > 1 else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        vantage, mu, near = split
        at = len(self.vantage)
        self.vantage.append(vantage)
        self.mu.append(mu)
        self.child.append(None)
        self.child[at] = (self._grow(points[near], (shards + 1) // 2), self._grow(points[~near], shards // 2))
        return at

    def _split(self, points: np.ndarray):
        """Of a few vantage points the one with the fewest points near its border."""
        best = None
        for vantage in self.rng.choice(points, min(8, len(points)), replace=False):
            d = distances(vantage, points)
            mu = int(np.median(d))
            near = d <= mu
            if near.all():
                mu -= 1
                near = d <= mu
            if not near.any():
                continue
            crossing = int((np.abs(2 * d.astype(int) - 2 * mu - 1) < 2 * self.radius).sum()) + abs(int(near.sum()) * 2 - len(points)) // 4
            if best is None or crossing < best[0]:
                best = (crossing, vantage, mu, near)
        return best and best[1:]

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, is home): the leaf of each point, and other leaves that its ball reaches: where a point's own leaf is on the near
        side of a border, it visits the far side, not the other way round, as either meeting finds a pair."""
        out, work = [], [(self.top, np.arange(len(points)), np.ones(len(points), bool))]
        while work:
            node, at, home = work.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), -node - 1), home))
                continue
            d = distances(self.vantage[node], points[at]).astype(int)
            near, mu = d <= self.mu[node], self.mu[node]
            closer, farther = near | (~home & (d - self.radius <= mu)), ~near | (d + self.radius > mu)
            for child, here, reach in ((self.child[node][0], near, closer), (self.child[node][1], ~near, farther)):
                work.append((child, at[reach], (home & here)[reach]))
        if not out:
            return np.array([], int), np.array([], int), np.array([], bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_links(points: np.ndarray, home: np.ndarray, radius: int = RADIUS, small: int = 512) -> np.ndarray:
    """Links within the radius between the points of one shard, of which at least one is at home there, as a forest: the links of
    a connected group are left out where others already connect it. Vantage points prune on within the shard."""
    parent = np.arange(len(points))
    rng = np.random.default_rng(len(points))
    links = []

    def compare(rows: np.ndarray, cols: np.ndarray) -> None:
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[cols][None, :]) <= radius)
            other = part[a] != cols[b]
            for i, j in zip(part[a][other].tolist(), cols[b][other].tolist(), strict=True):
                x, y = _find(parent, i), _find(parent, j)
                if x != y:
                    parent[y] = x
                    links.append((i, j))

    work = [(np.flatnonzero(home), np.arange(len(points)))]
    while work:
        mine, reach = work.pop()  # mine: at home in this part; reach: all whose balls reach it
        if not len(mine):
            continue
        if len(mine) <= small:
            compare(mine, reach)
            continue
        vantage = points[rng.choice(mine)]
        dm, dr = distances(vantage, points[mine]).astype(int), distances(vantage, points[reach]).astype(int)
        mu = int(np.median(dm))
        if (dm <= mu).all():
            mu -= 1
        if not (dm <= mu).any():
            compare(mine, reach)
            continue
        work.append((mine[dm <= mu], reach[dr - radius <= mu]))
        work.append((mine[dm > mu], reach[dr + radius > mu]))
    return np.array(links, np.int64).reshape(-1, 2)


def components(fps: DataFrame, radius: int = RADIUS, sample_rows: int = 100_000, shard_rows: int = 1 << 17) -> DataFrame:
    """(doc_id, fp) -> (fp, root, component_id): fingerprints linked at `radius` or fewer differing bits. root names the component;
    component_id is its smallest doc_id, null if none of its rows has one.

    Distinct fingerprints only take part, each with its smallest doc_id, so copies cost nothing. The tree is fitted on a sample of
    at most `sample_rows` of them; every fingerprint is compared, in the shard where it lies, with all whose balls reach there."""
    spark = fps.sparkSession
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    n = nodes.count()
    if not n:
        return nodes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    shards = -(-n // shard_rows)
    share = min(1.0, sample_rows / n)
    draw = F.xxhash64("fp")
    taken = nodes.filter(F.pmod(draw, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(draw).limit(sample_rows).select("fp").collect()
    tree = spark.sparkContext.broadcast(Tree(np.array([r.fp for r in taken], np.int64).view(np.uint64), shards, radius=radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            at, leaf, home = tree.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(fp[at]), pa.array(home)], ["leaf", "fp", "home"])

    def link(group: pa.Table) -> pa.Table:
        fp, home = group.column("fp").to_numpy(), group.column("home").to_numpy()
        pairs = shard_links(fp.view(np.uint64), home, radius)
        return pa.table({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    routed = nodes.select("fp").mapInArrow(route, "leaf long, fp long, home boolean")
    links = routed.groupBy("leaf").applyInArrow(link, "a long, b long")
    found = roots(links)
    member = stored(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, **settings: int) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text).

    Null and empty texts have fingerprint 0 and link like any other. Rows without doc_id never give a component its id but belong to
    one; a component of such rows only has id null. Repeated rows are returned as often as they occur. Tables without rows give
    none. Other columns are left out. Texts of any length are read whole."""
    fps = stored(with_fingerprint(pick(docs, "doc_id", "text")).drop("text"), "docfps")
    return fps.join(components(fps, **settings), "fp").select("doc_id", "fp", "component_id")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """`docs` with the column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], [*batch.schema.names, "fp"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("fp")).schema)


# Near copies by similarity. A radius wide enough for texts that share four fifths of their shingles (10 bits and more) prunes nothing
# in 64 bits, whose distances crowd around 32. So besides the tree, texts meet by their first shingles in an order common to all: two sets
# that share `least` of their shingles cannot both lack a common one among their n - ceil(least * n) + 1 first ones.

NEAR_SHINGLE, SIMILARITY = 5, 0.8
COUNTED, FREQUENT = 50_000, 200_000  # texts whose shingles are counted, and shingles known as frequent; both only choose the order
PART_TEXTS = 500  # of those counted, for each part of their shingles
SKETCH = 512  # smallest hashes of a text that `similarity` compares
WORDS = 8  # longs of 64 parities that two texts are compared by before their sets are
MARKS = "row long, whole long, fp long, n long, first array<long>, odd array<long>"


def similarity(a: bytes, b: bytes) -> float:
    """Share of shingles in common, from the smallest hashes of both texts; two without shingles are alike."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.union1d(x, y)[:SKETCH] if max(len(x), len(y)) == SKETCH else np.union1d(x, y)
    common = np.intersect1d(x, y, assume_unique=True)
    return 1.0 if not len(both) else float((common <= both[-1]).sum() / len(both))


def shingle_counts(hashes: DataFrame, parts: int) -> DataFrame:
    """(h, n). Most shingles occur once, so tables of them before the shuffle would shrink nothing and take memory by the size of a task's
    texts; after it they are as small as the parts are."""
    return hashes.repartition(parts, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def frequent_shingles(rows: DataFrame, shingle: int, texts: int = COUNTED, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that several of at most some `texts` rows (row, text) hold."""
    spark, n = rows.sparkSession, rows.count()
    share = min(1.0, texts / max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64))], ["h"])

    taken = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(texts, n) // PART_TEXTS))
    counts = shingle_counts(taken.mapInArrow(run, "h long"), parts)
    held = counts.filter("n > 2").orderBy(F.desc("n"), "h").limit(most).toPandas()
    hashes = held["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], held["n"].to_numpy(np.int64)[order]


def first_shingles(found: np.ndarray, least: float, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of distinct hashes those that come first, rare ones before frequent ones: as many as no similar set can lack."""
    hashes, counts = frequent
    if not len(found):
        return found
    at = np.minimum(np.searchsorted(hashes, found), max(len(hashes) - 1, 0))
    often = np.where(hashes[at] == found, counts[at], 0) if len(hashes) else np.zeros(len(found), np.int64)
    order = np.lexsort((found, often))
    return found[order[: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """Distinct hashes are dealt into classes, a bit for each, which is set if the class has an odd number. The bits that differ
    between two sets are never more than the hashes that only one of them holds."""
    odd = np.bincount((found % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def marked(rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """MARKS of rows (row, text): a name of the shingle set, the fingerprint, the number of distinct shingles, the first ones, and parities."""
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text"):
                hashes = shingle_hashes(t.as_py(), shingle)
                found = np.unique(hashes)
                with np.errstate(over="ignore"):
                    whole = int((found * np.uint64(0x9E3779B97F4A7C15) ^ (found >> np.uint64(31))).sum(dtype=np.uint64).view(np.int64))
                out.append((whole, folded(hashes), len(found), first_shingles(found, least, frequent.value).view(np.int64), parities(found)))
            whole, fp, n, first, odd = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(whole, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], ["row", "whole", "fp", "n", "first", "odd"])

    return rows.mapInArrow(run, MARKS)


def confirmed(pairs: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows (row, text) that share `least` of their shingles, by the whole sets; only texts of pairs are read."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(held, pa.binary())], ["row", "held"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for p, q in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= least * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    pairs = stored(pairs, "candidates")
    named = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    held = rows.join(named, "row", "left_semi").mapInArrow(sets, "row long, held binary")
    side = lambda n: held.select(F.col("row").alias(n), F.col("held").alias("s" + n))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def needed(least: float, both: Column) -> Column:
    """How many shingles two sets that share `least` of them have in common, by the sum of their sizes."""
    return F.ceil(F.lit(least / (1 + least)) * both - F.lit(1e-6))


def possible(least: float) -> Column:
    """Whether sets of n and _n shingles, `common` of which are among the first ones of both, can share `least` of them: of the set whose first
    ones end earlier, only those after them can be common besides."""
    need = needed(least, F.col("n") + F.col("_n"))
    after = F.ceil(F.lit(least) * F.greatest("n", "_n") - F.lit(1e-9)) - 1
    return (F.col("common") + after >= need) & (F.least("n", "_n") >= F.lit(least) * F.greatest("n", "_n") - F.lit(1e-9))


def meetings(open_: DataFrame, least: float) -> DataFrame:
    """Rows (key, row, n, root, at, odd0, ...) of different roots that meet by a key, if they can share `least` of their shingles: (low, row, _n,
    n, _at, at), low is the one with fewer shingles. `at` counts the shingles that come before the key in the order common to all.

    The first shingle that two sets share leaves enough after it in both to share what they need, and so do all those of their common ones
    counted here; the shorter set needs no key beyond those that leave enough for a partner of its own size. Parities bound the shingles that
    only one of both sets holds. So texts that share a passage, or edits of one text that have gone too far from each other, make no rows."""
    odd = [f"odd{i}" for i in range(WORDS)]
    short = open_.filter(F.col("at") + needed(least, 2 * F.col("n")) <= F.col("n"))
    short = short.select("key", F.col("row").alias("low"), F.col("n").alias("_n"), F.col("root").alias("_root"), F.col("at").alias("_at"), *[F.col(c).alias("_" + c) for c in odd])
    need, both = needed(least, F.col("n") + F.col("_n")), F.col("n") + F.col("_n")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("_" + c))) for c in odd), F.lit(0))
    meet = F.expr("root <> _root AND (_n < n OR _n = n AND low < row)") & (F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) >= need) & (apart + 2 * need <= both)
    return open_.join(short, "key").filter(meet).select("low", "row", "_n", "n", "_at", "at")


def one_of_each(docs: DataFrame, shingle: int = NEAR_SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, **settings: int) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows without id come last, ties as they lie in the
    stored table. Returns the columns of `docs` (doc_id, text and any others).

    Texts with the same set of shingles are one. Pairs that share `least` of their distinct shingles, by 64-bit hashes of the whole sets,
    link. Candidates are texts whose fingerprints meet in the tree at `radius` bits, and texts that share as many of their first shingles as
    every pair to be linked does. First each is compared with the first text of those it meets; then, of texts that share first shingles, all
    pairs that no links connect yet. So a large group of near copies makes few pairs and no link between groups is left out. Texts without words, null ones too, are copies of each other, as are rows that repeat. Texts of any length are read
    whole. A table without rows gives none."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    texts = rows.select(F.col("_row").alias("row"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("row"))
    marks = stored(marked(texts, shingle, least), "marks")
    place = stored(rows.select(F.col("_row").alias("row"), order.alias("at")), "places")
    sets = marks.select("row", "whole").join(place, "row").groupBy("whole").agg(F.min("at").alias("at"))
    leads = stored(sets.select("at", F.col("at.row").alias("row")).join(marks.drop("whole"), "row"), "leads")

    found = components(leads.select(F.col("row").alias("doc_id"), "fp"), radius, **settings)
    near = leads.select("row", "fp").join(found, "fp").select(F.col("component_id").alias("low"), "row")
    keys = leads.select("row", "n", F.posexplode("first").alias("at", "key"))
    # Plain columns, not a struct, are aggregated without a sort of all keys.
    ends = keys.groupBy("key").agg(F.min("row").alias("low"), F.min_by("n", "row").alias("_n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    ends = stored(ends.select("key", "low", "_n"), "shared")
    met = stored(keys.join(ends, "key"), "met")
    alike = lambda pairs: pairs.groupBy("low", "row", "_n", "n").agg(F.count(F.lit(1)).alias("common")).filter(possible(least)).select("low", "row")
    ordered = lambda pairs: pairs.filter("low <> row").select(F.least("low", "row").alias("a"), F.greatest("low", "row").alias("b")).distinct()
    pairs = stored(ordered(near.union(alike(met.filter("low <> row")))), "pairs")
    links = stored(confirmed(pairs, texts, shingle, least), "alike")

    odd = leads.select("row", *[F.col("odd")[i].alias(f"odd{i}") for i in range(WORDS)])
    tied = met.select("key", "row", "n", "at").join(roots(links).withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    several = tied.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("key")
    open_ = stored(tied.join(several, "key").join(odd, "row"), "open")
    # What follows the last of the shingles counted in either set bounds those that are not.
    last = meetings(open_, least).groupBy("low", "row", "_n", "n").agg(F.count(F.lit(1)).alias("common"), F.max("at").alias("at"), F.max("_at").alias("_at"))
    can = F.col("common") + F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) - 1 >= needed(least, F.col("n") + F.col("_n"))
    rest = ordered(last.filter(can)).join(pairs, ["a", "b"], "left_anti")
    links = stored(links.union(confirmed(rest, texts, shingle, least)), "alike")

    member = leads.select("row", "at").join(roots(links).withColumnRenamed("node", "row"), "row", "left")
    first = member.groupBy(F.coalesce("root", "row").alias("root")).agg(F.min("at").alias("at"))
    kept = first.select(F.col("at.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)
