"""Small tables with the awkward cases: nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n, vocabulary=400):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "\n".join(sentences(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5)))
        out.append((i, text, "en", "src%d" % (i % 7), len(text)))
    out += [(100 + i, out[i][1], "en", "src%d" % (i % 3), 5) for i in range(6)]  # copies
    out += [(120, None, None, None, None), (121, "", "en", "src1", 0), (122, " \n\t\n", "en", "src2", 4), (None, "a text without id " * 9, "en", "src0", 1), (None, "a text without id " * 9, "en", "src0", 1)]
    out += [(123, "word " * 30_000, "en", None, 150_000), (124, "ß Ünïcode 𝒳 " * 40, "de", "é", 7)]
    out += [out[3], out[3]]  # rows repeated as a whole
    return out


def frame(spark, data=None):
    """With extra columns whose names clash with inputs and outputs."""
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.select("*", F.lit("x").alias("TEXT"), F.lit(1).alias("shard"), F.lit(2).alias("kept"), F.lit(3).alias("row"), F.lit(4).alias("n"))


def empty(spark):
    return frame(spark, []).limit(0)
