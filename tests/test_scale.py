"""Plans that must not grow beyond the work: expressions written once, tasks for small files, compiled methods."""

import re
import sys

from pyspark.sql import functions as F

from tieline.functions import dates, text as t


def once(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_clean_treats_every_character_as_before(spark):
    drop, blank = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‍﻿]"), re.compile(r"[ \t\n\x0b\f\r   -     　]+")
    chars = [chr(c) for c in range(sys.maxunicode // 16) if not 0xD800 <= c <= 0xDFFF]
    texts = ["a" + c + c + "b " + c for c in chars] + [None, "", " plain text "]
    want = [blank.sub(" ", drop.sub("", x or "")).strip(" ") for x in texts]
    assert once(spark, texts, t.clean) == want


def test_raw_rows_of_a_small_file_are_many_tasks(spark, tmp_path):
    from tieline.checks import ingest
    from tieline.sources.binding import Binding

    Binding(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    seen = []
    rows = spark.range(40_000).coalesce(1).withColumn("ws", F.lit("w"))
    raw = ingest.raw_rows(rows, "profile", F.col("id"), {"first name": F.sha2(F.col("id").cast("string"), 512)})
    ingest.run(lambda base, owner, out: seen.append(base), raw)
    assert raw.rdd.getNumPartitions() == 1 and seen[0].count() == 40_000 and len(seen[0].inputFiles()) > 1
    assert "map(" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_delimiter_reads_its_sample_once(spark):
    from tieline.sources.delimited import delimiter_of

    rows = spark.createDataFrame([("a;b\n\nc;d",), ("a,b|c",), ("x",), ("",), (None,), ('"a;b;c",d\r\n1,2',)], "x string")
    found = rows.select(delimiter_of(F.col("x")).alias("d"))
    assert [r.d for r in found.collect()] == [";", ",", ",", ",", ",", ","]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_absent_hours_are_no_refused_numbers(spark):
    assert [str(x) for x in once(spark, ["1995-03-04", "1995-03-04 05:06", "1995-03-04T05:06:07", "4 Mar 1995", "1995"], dates.parse_date)] == [
        "1995-03-04 00:00:00", "1995-03-04 05:06:00", "1995-03-04 05:06:07", "1995-03-04 00:00:00", "1995-01-01 00:00:00"]
    plan = spark.range(1).select(dates.parse_date(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "try_cast(concat(0, regexp_extract" in plan.lower() or "concat(0, regexp_extract" in plan
