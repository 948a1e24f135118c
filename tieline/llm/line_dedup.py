"""Boilerplate lines: those on many distinct sites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import BLANKS, pick, stored

LG_K = 12
MIN_SITES = 10


def line_key(line: Column) -> Column:
    """Lines are compared without white space around them; empty ones are none."""
    return F.btrim(line, F.lit(BLANKS))


def lines_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, pos, h1, h2) for each line that is not empty; two hashes name the line."""
    lines = docs.select(*row_key(), "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    return lines.filter(key != "").select("r1", "r2", "doc_id", "source", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id").alias("r2")]


def widespread(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, keeper) of the lines on `min_sites` distinct sources or more; keeper is the smallest doc_id with the line.

    One HyperLogLog sketch a line, merged by the aggregation, holds its sites. Estimates more than five standard errors from the
    threshold decide; for lines nearer to it the distinct sources are counted. Rows without source spread no line."""
    near = max(2, math.ceil(5 * 1.04 / math.sqrt(1 << LG_K) * min_sites))
    lines = lines_of(docs)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("source", LG_K).alias("sites"), F.min("doc_id").alias("keeper"))
    spread = stored(sketched.select("h1", "h2", "keeper", F.hll_sketch_estimate("sites").alias("sites")).filter(F.col("sites") >= min_sites - near), "spread")
    sure = spread.filter(F.col("sites") > min_sites + near)
    unsure = spread.filter(F.col("sites") <= min_sites + near)
    exact = lines.join(unsure.select("h1", "h2", "keeper"), ["h1", "h2"]).groupBy("h1", "h2", "keeper", "source").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h1", "h2", "keeper").agg(F.count("source").alias("sites")).filter(F.col("sites") >= min_sites)
    return stored(sure.select("h1", "h2", "keeper").union(exact.select("h1", "h2", "keeper")), "widespread")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` (doc_id, text, source and any others) with text cut, and n_lines and n_removed in a struct `lines`.

    A line on `min_sites` sources or more goes from every document but those with its smallest doc_id, so no text leaves the corpus.
    Lines are split at \\n and compared without white space around them; empty lines stay, as does the text of documents that
    lose nothing. A document may be left empty. Null texts stay null and have no lines; repeated rows are cut alike; where no row
    with a line has an id, the line stays in all of these. A table without rows gives none."""
    found = widespread(docs, min_sites)
    hits = lines_of(docs).join(found, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = hits.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(*row_key(), F.struct("*").alias("row")).join(gone, ["r1", "r2"], "left")
    rows = rows.select("row", "gone", F.split("row.text", "\n").alias("all"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(F.col("all"), i)), "\n")
    filled = F.coalesce(F.size(F.filter("all", lambda x: line_key(x) != "")), F.lit(0)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cut)
    lines = F.struct(F.when(F.col("all").isNull(), 0).otherwise(filled).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"))
    kept = [F.col(f"row.{c}").alias(c) if c != "text" else text.alias("text") for c in docs.columns]
    return rows.select(*kept, lines.alias("lines"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for each row of `docs`; other columns are left out."""
    out = without_boilerplate(pick(docs, "doc_id", "text", "source"), min_sites)
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", "text")


SQL = f"""
WITH keyed AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, source, i, parts[i] AS line, trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
          FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM keyed)),
spread AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
judged AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone FROM lines l LEFT JOIN spread s ON l.k = s.k),
per_row AS (SELECT r, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
                   string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS cut FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE coalesce(cut, '') END AS text
FROM keyed LEFT JOIN per_row USING (r)
"""
