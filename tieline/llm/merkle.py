"""Merkle manifest of a dataset: a digest per row, sixteen to a node, a subroot per group and one root, with every row's proof."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import DOCUMENT, pick, ranked, stored

FAN = 16
DEPTH = 3  # levels nested in one row: a block holds at most FAN ** DEPTH rows
PATH = "array<struct<left:string,right:string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def levels_of(total: Column) -> Column:
    """How often `total` nodes are rolled up until one remains."""
    return reduce(lambda a, b: a + b, [(total > FAN**k).cast("int") for k in range(16)])


def nested(rows: DataFrame, payload: list[str]) -> DataFrame:
    """(grp, block, levels, node, kids) of rows (grp, rank, levels, node, *payload): the rank's digits are grouped away one after the
    other, lowest first, each time nesting the children's structs; one shuffle serves all of them."""
    digits = [F.pmod(F.floor(F.col("rank") / FAN**i), F.lit(FAN)).cast("int").alias(f"d{i}") for i in range(DEPTH)]
    block = F.floor(F.col("rank") / FAN**DEPTH).cast("long").alias("block")
    out = rows.select("grp", "levels", block, *digits, "node", *payload).repartition("grp", "block")
    inner = payload
    for level in range(1, DEPTH + 1):
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{level - 1}").alias("d"), "node", *inner)))
        out = out.groupBy("grp", "levels", "block", *[f"d{i}" for i in range(level, DEPTH)]).agg(kids.alias("kids"))
        node = F.when(F.col("levels") >= level, digest(F.array_join("kids.node", ""))).otherwise(F.col("kids")[0]["node"])
        out = out.withColumn("node", node)
        inner = ["kids"]
    return out


def rolled_up(rows: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Stored block tables from the rows up to one block a group. Each stage has at most a 4096th of the rows before it."""
    stages = []
    while True:
        stages.append(stored(nested(rows, payload), "blocks"))
        if not stages[-1].agg(F.max("block")).first()[0]:
            return stages
        rows = stages[-1].select("grp", F.col("block").alias("rank"), F.greatest(F.col("levels") - DEPTH, F.lit(0)).alias("levels"), "node")
        payload = []


def unfolded(blocks: DataFrame, carry: list[str], payload: list[str]) -> DataFrame:
    """(grp, rank, path, *carry, *payload): the rows of blocks (grp, block, levels, kids, path, *carry), each with its siblings left and
    right of it prepended to the path, lowest level first."""
    out = blocks.select("grp", F.col("block").alias("rank"), "levels", "path", *carry, "kids")
    for level in range(DEPTH, 0, -1):
        out = out.select("grp", "rank", "levels", "path", *carry, F.col("kids.node").alias("nodes"), F.posexplode("kids").alias("at", "kid"))
        sides = F.struct(F.array_join(F.slice("nodes", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("nodes", F.col("at") + 2, F.lit(FAN)), "").alias("right"))
        path = F.when(F.col("levels") >= level, F.concat(F.array(sides), "path")).otherwise(F.col("path"))
        rest = [F.col("kid.kids")] if level > 1 else [F.col("kid.node").alias("node"), *[F.col("kid")[p].alias(p) for p in payload]]
        out = out.select("grp", (F.col("rank") * FAN + F.col("kid.d")).alias("rank"), "levels", path.alias("path"), *carry, *rest)
    return out


def met(blocks: DataFrame, paths: DataFrame, carry: list[str]) -> DataFrame:
    """Blocks with the path and the carried columns of their own row one stage above, brought together by grouping: two rows a group."""
    fields = dict(blocks.dtypes) | dict(paths.dtypes)
    both = ["levels", "kids", "path", *carry]
    here, there = [
        df.select("grp", key.cast("long").alias("block"), *[F.col(c) if c in own else F.lit(None).cast(fields[c]).alias(c) for c in both])
        for df, key, own in ((blocks, F.col("block"), ["levels", "kids"]), (paths, F.col("rank"), ["path", *carry]))
    ]
    return here.union(there).groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in both])


def proven(leaves: DataFrame, group: str, order: list[str], payload: list[str]) -> DataFrame:
    """(grp, rank, leaf, *payload, subroot, root, path) of leaves (group, leaf, *order, *payload): every leaf's siblings up to the root."""
    rows = ranked(stored(leaves, "leaves"), [group], [*order, "leaf"])  # texts are digested once
    rows = rows.select(F.col(group).alias("grp"), "rank", levels_of(F.col("total")).alias("levels"), F.col("leaf").alias("node"), *payload)
    stages = rolled_up(rows, payload)
    tops = ranked(stages[-1].select(F.col("grp").alias("name"), F.col("node").alias("subroot")), [], ["name"])
    tops = tops.select(F.lit(0).alias("grp"), "rank", levels_of(F.col("total")).alias("levels"), F.col("subroot").alias("node"), "name", "subroot")
    upper = rolled_up(tops, ["name", "subroot"])
    paths = upper[-1].select("grp", "block", "levels", "kids", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    for i in range(len(upper) - 1, -1, -1):
        paths = unfolded(paths, ["root"], ["name", "subroot"] if i == 0 else [])
        if i:
            paths = met(upper[i - 1], paths, ["root"])
    paths = paths.select(F.col("name").alias("grp"), F.lit(0).alias("rank"), "path", "subroot", "root")
    for i in range(len(stages) - 1, -1, -1):
        paths = unfolded(met(stages[i], paths, ["subroot", "root"]), ["subroot", "root"], payload if i == 0 else [])
    return paths.withColumnRenamed("node", "leaf").drop("levels")


def folded(own: Column, path: Column) -> Column:
    """The root that a digest and its proof lead to."""
    return F.aggregate(path, own, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, seen) of every row of `docs`: the digest of its five columns, the roots of its source
    and of the table, and its siblings, level by level, as struct(left, right) of digests in order.

    `seen` is a text to prove in place of the stored one; its digest comes back under that name. Rows ascend by doc_id in their
    source, nulls first, and by digest where ids tie; repeated rows are leaves of their own. Null sources are a group, the first.
    Null columns are `-` in the digest and differ from empty ones. Texts of any length are read whole. A table without rows has
    no proofs. Other columns are left out."""
    docs = pick(docs, *DOCUMENT)
    others = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    leaves = docs.select("doc_id", "source", leaf(*others, F.col("text")).alias("leaf"), leaf(*others, F.col("text") if seen is None else seen).alias("seen"))
    return proven(leaves, "source", ["doc_id"], ["doc_id", "seen"]).withColumnRenamed("grp", "source").drop("rank")


def tampered(text: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the CRC-32 of the decimal doc_id; without id as it is."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def _sql(levels: int = 5, source_levels: int = 3) -> str:
    """DuckDB SQL for up to 16 ** levels rows a source and 16 ** source_levels sources."""
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    hashed = lambda text: "sha256(" + " || ".join([one("doc_id"), one("source"), one("lang"), one("n_chars"), one(text)]) + ")"
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    ctes = [
        f"given AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS changed FROM documents)",
        f"leaves AS (SELECT doc_id, source, {hashed('text')} AS leaf, {hashed('changed')} AS seen FROM given)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total, leaf AS node FROM leaves)",
    ]

    def up(name: str, group: str, count: int) -> None:
        for k in range(1, count + 1):
            ctes.append(f"{name}g{k} AS (SELECT {group}, rank // 16 AS rank, any_value(total) AS total, list(node ORDER BY rank) AS nodes FROM {name}{k - 1} GROUP BY {group}, rank // 16)")
            ctes.append(f"{name}{k} AS (SELECT *, CASE WHEN total > {16 ** (k - 1)} THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {name}g{k})")

    up("n", "source", levels)
    ctes.append(f"s0 AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS total, 0 AS grp FROM n{levels})")
    up("s", "grp", source_levels)
    ctes.append(f"p0 AS (SELECT n0.doc_id, n0.leaf, n0.source, n0.rank, n0.total, s0.node AS subroot, (SELECT node FROM s{source_levels}) AS root, s0.rank AS srank, s0.total AS stotal, '' AS proof, n0.seen AS cur FROM n0 JOIN s0 ON n0.source IS NOT DISTINCT FROM s0.source)")
    last = 0
    for name, group, rank, total, count in (("n", "source", "rank", "total", levels), ("s", None, "srank", "stotal", source_levels)):
        for k in range(1, count + 1):
            on = f"p.{rank} // {16**k} = g.rank" + (" AND p.source IS NOT DISTINCT FROM g.source" if group else "")
            at = f"(p.{rank} // {16 ** (k - 1)} % 16)"
            left, right = f"array_to_string(g.nodes[1:{at}], '')", f"array_to_string(g.nodes[{at} + 2:], '')"
            ctes.append(f"p{last + 1} AS (SELECT p.* REPLACE (CASE WHEN p.{total} > {16 ** (k - 1)} THEN p.proof || {left} || {right} ELSE p.proof END AS proof, CASE WHEN p.{total} > {16 ** (k - 1)} THEN sha256({left} || p.cur || {right}) ELSE p.cur END AS cur) FROM p{last} p JOIN {name}g{k} g ON {on})")
            last += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM p{last}"


SQL = _sql()
