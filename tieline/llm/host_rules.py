"""Document rules, and verdicts on whole hosts from the share of their documents that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions.text import let
from tieline.llm.common import BLANKS, blanks_to_spaces, pick, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, GRAM = 10, 20, 5
MAX_HOST_RATE, LEAST_STRENGTH, MOST_STRENGTH = 0.5, 2.0, 10_000.0


def repeated_words(grams: Column) -> Column:
    """Words in windows found twice or more, from the window hashes in text order. Sorted with their places, equal windows are
    neighbours; the places of these, sorted, cover `GRAM` words each, less what the next one covers too."""
    placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        same = lambda x, i, j: F.coalesce(x["h"] == F.get(p, j)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get(at, i + 1) - x, F.lit(GRAM)))), F.lit(0).cast("long"), lambda a, b: a + b)

    return let(placed, lambda p: let(places(p), covered))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source) and the measures of the text, over all its words and lines."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", "source", text.alias("text"))
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.select(
        "doc_id", "source", hashes.alias("hashes"), lines.alias("lines"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    windows = let(F.col("hashes"), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)])))
    df = df.select(
        "doc_id", "source", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") >= GRAM, windows).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    repeats = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), repeated_words(F.col("grams"))).otherwise(0).cast("long")
    df = df.withColumn("n_repeat_words", repeats).drop("grams")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior of the failure rate by moments over all hosts (host, n, failed): the mean is the share of all documents that fail;
    the strength follows from how far the hosts' rates spread beyond what their sizes explain, within fixed limits."""
    mean_row = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("f")).first()
    if not mean_row["k"]:
        return 0.0, LEAST_STRENGTH
    k, n, f = mean_row["k"], mean_row["n"], mean_row["f"]
    mean = f / n
    rate = F.col("failed") / F.col("n")
    spread = hosts.agg(F.sum(F.round(F.pow(rate - F.lit(mean), 2) * 1e15).cast("decimal(38,0)")).alias("v"), F.sum(F.round(F.lit(1e15) / F.col("n")).cast("decimal(38,0)")).alias("w")).first()
    within = mean * (1 - mean) * float(spread["w"]) / 1e15 / k
    between = float(spread["v"]) / 1e15 / k - within
    strength = MOST_STRENGTH if between <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, mean * (1 - mean) / between - 1))
    return mean * strength, (1 - mean) * strength


def host_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs, host_failed, kept) per row.

    A document fails by its own measures; a host (`source`) whose failure rate, shrunk towards that of all hosts by a beta prior,
    is above `max_rate` takes all its documents with it. The failures are summed by host before anything is joined. Rows without
    source belong to no host and are judged alone, with null host counts. Null and empty texts have no words and fail. Repeated rows
    count each. A table without rows gives none; other columns are left out."""
    rows = stored(measured(pick(docs, "doc_id", "text", "source")), "measures")
    hosts = rows.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    a, b = prior(hosts)
    shrunk = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdicts = hosts.select("source", F.col("n").alias("host_docs"), F.col("failed").alias("host_failed"), (shrunk > max_rate).alias("host_rejected"))
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return rows.join(verdicts, "source", "left").withColumn("kept", kept).drop("source", "host_rejected")


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
grams AS (SELECT r, i, ws[i:i + {GRAM - 1}] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {GRAM - 2})) AS i FROM w WHERE len(ws) >= {GRAM})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, sum(least({GRAM}, coalesce(next - i, {GRAM})))::BIGINT AS n_repeat_words
            FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM docs JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f WHERE source IS NOT NULL GROUP BY source),
mean AS (SELECT sum(failed) / sum(n) AS p, count(*) AS k FROM hosts),
spread AS (SELECT any_value(p) AS p, sum(pow(failed / n - p, 2)) / any_value(k) - any_value(p) * (1 - any_value(p)) * sum(1.0 / n) / any_value(k) AS between_hosts FROM hosts, mean),
strength AS (SELECT p, CASE WHEN between_hosts <= 0 THEN {MOST_STRENGTH} ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, p * (1 - p) / between_hosts - 1)) END AS s FROM spread),
verdicts AS (SELECT source, n, failed, (failed + p * s) / (n + s) > {MAX_HOST_RATE} AS rejected FROM hosts, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n AS host_docs, failed AS host_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN verdicts USING (source)
"""
