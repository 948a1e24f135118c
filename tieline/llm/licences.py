"""Licence notices: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tieline.functions.text import let
from tieline.llm.common import pick, stored

UNKNOWN = "unknown"

#: Usual notices of licence families, in the words of the licences or of the notices they ask for.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "This project is released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL version 2 or later.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal.",
        "Dedicated to the public domain under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Sentences with words of notices that are none.
OTHERS = [
    "She lost her driving licence and had to pass the test again.",
    "The institute released a report on public health this year.",
    "You need a license to fish in the lake.",
    "The general public was not admitted, and all seats were reserved.",
    "The software was released under pressure of time.",
    "A copy of the letter may be obtained from the library.",
    "Version 2.0 of the program is free of errors.",
    "The Apache helicopter is under repair.",
    "Permission to land was granted without restriction.",
    "They work under the terms of a new contract.",
]


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " "), "")


def grams(words: Column, n: int) -> Column:
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", *[w if k == 0 else F.get(words, i + k) for k in range(n)]))
    return F.slice(pairs, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def with_grams(df: DataFrame) -> DataFrame:
    """`df` (text) with w1, w2, w3: words, pairs and triples of neighbours."""
    df = df.withColumn("w1", words_of(F.col("text")))
    return df.withColumn("w2", let(F.col("w1"), lambda w: grams(w, 2))).withColumn("w3", let(F.col("w1"), lambda w: grams(w, 3)))


def notices(spark: SparkSession, variants: int = 24) -> DataFrame:
    """(text, family): each template as it is, and variants that miss a tenth of its words or stand in front of a name or year."""
    rows = [(family, t) for family, texts in TEMPLATES.items() for t in texts] + [(UNKNOWN, t) for t in OTHERS]
    df = spark.createDataFrame(rows, "family string, template string").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    left = F.filter(F.split("template", " "), lambda w, i: (F.col("v") < 3) | (F.pmod(F.xxhash64(F.col("v"), i, w), F.lit(10)) > 0))
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", "Copyright 2019 Jane Doe.", "See the file for details.")]), F.pmod("v", F.lit(3)) + 1)
    return df.select(F.trim(F.concat_ws(" ", F.array_join(left, " "), ends)).alias("text"), "family")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(r1, r2, pos, text): lines that are not blank."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id").alias("r2"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.filter(F.trim(F.translate("text", "\t\r\x0b\x0c", "    ")) != "")


def runs(docs: DataFrame) -> DataFrame:
    """(r1, r2, run, text, w1): paragraphs, which are lines between blank ones, and their words."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id").alias("r2"), F.posexplode(F.split("text", r"\n[ \t\r\x0b\x0c]*\n")).alias("run", "text"))
    # explode keeps filters on the words from being moved under them, where they would be split again.
    return rows.select("*", F.explode(F.array(words_of(F.col("text")))).alias("w1")).filter(F.size("w1") > 0)


def units(rows: DataFrame, width: int) -> DataFrame:
    """(r1, r2, run, pos, text) of what is compared of each run: its lines, and with pos -1 the run as a whole, where it has several
    lines, and overlapping runs of `width` words, where it is longer."""
    unit = "array<struct<pos:int,text:string>>"
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text"))), lambda u: F.trim(F.translate(u["text"], "\t\r\x0b\x0c", "    ")) != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w1") - width // 2 - 1, F.lit(0)), F.lit(width // 2))
    parts = F.transform(starts, lambda at: F.struct(F.lit(-1).alias("pos"), F.array_join(F.slice("w1", at + 1, width), " ").alias("text")))
    none = F.array().cast(unit)
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("pos"), F.col("text").alias("text")))).otherwise(none)
    every = F.concat(lines.cast(unit), whole.cast(unit), F.when(F.size("w1") > width, parts).otherwise(none).cast(unit))
    return rows.select("r1", "r2", "run", F.explode(every).alias("u")).select("r1", "r2", "run", "u.pos", "u.text")


class Scanner:
    """Multinomial logistic regression over hashed words, pairs and triples."""

    def __init__(self, docs: DataFrame, sample_rows: int = 5000, features: int = 1 << 14, overlap: float = 0.6):
        spark = docs.sparkSession
        self.families = [*TEMPLATES, UNKNOWN]
        self.overlap = overlap
        self.pairs = None
        self.hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
        sample = self._background(docs, sample_rows).select("text", F.lit(UNKNOWN).alias("family"))
        number = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")) - 1
        rows = notices(spark).unionByName(sample).withColumn("label", number.cast("double"))
        rows = stored(self._featured(with_grams(rows)).select("text", "label", "features"), "notices")
        held = F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(4)) == 0
        self.model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60).fit(rows.filter(~held).coalesce(2))
        self.temperature = self._calibrated(self.model.transform(rows.filter(held)))

    def _background(self, docs: DataFrame, sample_rows: int) -> DataFrame:
        """At most `sample_rows` paragraphs by an even hash, without those that hold a template's words to a large part."""
        lines = paragraphs(docs)
        n = lines.count()
        share = min(1.0, 1.2 * sample_rows / max(1, n))
        draw = F.xxhash64(F.lit(4), "r1", "pos")
        drawn = lines.filter(F.pmod(draw, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(draw, "text").limit(sample_rows)
        return stored(with_grams(drawn.select("text")).withColumn("close", self._closest(F.col("w2"), list(TEMPLATES))).filter("close < 0.5").select("text"), "background")

    def _pairs(self) -> dict[str, list[list[str]]]:
        """The distinct pairs of words of each template, by family."""
        if self.pairs is None:
            spark = SparkSession.getActiveSession()
            known = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, text string")
            self.pairs = {f: [] for f in TEMPLATES}
            for r in with_grams(known).collect():
                self.pairs[r.family].append(list(dict.fromkeys(r.w2)))
        return self.pairs

    def _vocabulary(self) -> dict[int, Column]:
        """The words, pairs and triples of all templates."""
        spark = SparkSession.getActiveSession()
        rows = with_grams(spark.createDataFrame([(t,) for texts in TEMPLATES.values() for t in texts], "text string")).collect()
        return {n: F.array(*[F.lit(x) for x in sorted({x for r in rows for x in r[f"w{n}"]})]) for n in (1, 2, 3)}

    def _telling(self) -> Column:
        """Pairs of which a text must hold one to hold `overlap` of any template: of each template more than it may lack."""
        out = []
        for p in (p for parts in self._pairs().values() for p in parts):
            out += sorted(p, key=lambda x: (-len(x), x))[: len(p) - math.ceil(self.overlap * len(p) - 1e-9) + 1]
        return F.array(*[F.lit(x) for x in dict.fromkeys(out)])

    def _kin(self) -> Column:
        """"a>b" where a template of b holds enough of one of a to be taken for it."""
        known = self._pairs()
        kin = [f"{a}>{b}" for a in known for b in known if a != b and any(len(set(x) & set(y)) >= self.overlap * len(x) for x in known[a] for y in known[b])]
        return F.array(*[F.lit(x) for x in kin]).cast("array<string>")

    def _closest(self, pairs: Column, families: list[str]) -> Column:
        """The largest share of a template's pairs of words that a paragraph holds."""
        parts = [p for f in families for p in self._pairs()[f]]
        shares = [F.size(F.array_intersect(pairs, F.array(*[F.lit(x) for x in p]))) / F.lit(len(p)) for p in parts]
        return F.greatest(*shares) if len(shares) > 1 else shares[0]

    def _featured(self, df: DataFrame) -> DataFrame:
        return self.hashing.transform(df.withColumn("grams", F.concat("w1", "w2", "w3")))

    def _calibrated(self, held: DataFrame) -> float:
        """The temperature under which held-out notices and paragraphs are likeliest; bounded by the sample."""
        rows = [(r.raw, int(r.label)) for r in held.select(vector_to_array("rawPrediction").alias("raw"), "label").collect()]

        def loss(t: float) -> float:
            total = 0.0
            for raw, label in rows:
                top = max(raw)
                total += math.log(sum(math.exp((x - top) / t) for x in raw)) - (raw[label] - top) / t
            return total

        return min((0.25 * 1.25**i for i in range(20)), key=loss)

    def scan(self, docs: DataFrame, width: int = 64) -> DataFrame:
        """(r1, r2, run, pos, family, probability, share) of the units that are notices: a family is likelier than not after
        calibration, and the unit holds enough of one of its templates. Texts that hold enough of none are left out before the model."""
        telling = self._telling()
        rows = runs(docs).filter(F.arrays_overlap(let(F.col("w1"), lambda w: grams(w, 2)), telling))
        rows = units(rows, width).select("*", F.explode(F.array(words_of(F.col("text")))).alias("w1"))
        rows = rows.select("*", F.explode(F.array(let(F.col("w1"), lambda w: grams(w, 2)))).alias("w2")).filter(F.arrays_overlap("w2", telling))
        rows = rows.withColumn("w3", let(F.col("w1"), lambda w: grams(w, 3)))
        for n, known in self._vocabulary().items():  # what else a run of lines holds must not outweigh its notice
            rows = rows.withColumn(f"g{n}", F.when(F.col("pos") >= 0, F.col(f"w{n}")).otherwise(F.array_intersect(f"w{n}", known)))
        rows = self.model.transform(self.hashing.transform(rows.withColumn("grams", F.concat("g1", "g2", "g3"))))
        # explode keeps the filters below from being moved under the model, where it would run once for each use of its output.
        raw = F.explode(F.array(vector_to_array("rawPrediction")))
        rows = rows.select("r1", "r2", "run", "pos", "w2", raw.alias("raw")).withColumn("top", F.array_max("raw"))
        spread = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp((x - F.col("top")) / F.lit(self.temperature)))
        rows = rows.withColumn("probability", 1 / spread).withColumn("family", F.element_at(F.array(*[F.lit(f) for f in self.families]), F.array_position("raw", F.col("top")).cast("int")))
        rows = rows.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= 0.5))
        share = F.lit(0.0)
        for family in TEMPLATES:
            share = F.when(F.col("family") == family, self._closest(F.col("w2"), [family])).otherwise(share)
        return rows.withColumn("share", share).filter(F.col("share") >= self.overlap).select("r1", "r2", "run", "pos", "family", "probability", "share")

    def found(self, docs: DataFrame) -> DataFrame:
        """(r1, r2, n, families): notices on lines, and one for each family that a run holds over several lines or amid other words,
        unless it holds more of a family that is easily taken for that one."""
        line = F.when(F.col("pos") >= 0, F.col("pos"))
        each = self.scan(docs).groupBy("r1", "r2", "run", "family").agg(F.countDistinct(line).alias("lines"), F.max("share").alias("share"))
        each = each.groupBy("r1", "r2", "run").agg(F.collect_list(F.struct("family", "lines", "share")).alias("all"))  # one a family at most
        kin = self._kin()
        beaten = lambda f: F.exists("all", lambda g: F.array_contains(kin, F.concat_ws(">", f["family"], g["family"])) & (g["share"] > f["share"]))
        each = each.select("r1", "r2", F.explode(F.filter("all", lambda f: (f["lines"] > 0) | ~beaten(f))).alias("f"))
        return each.groupBy("r1", "r2").agg(F.sum(F.greatest("f.lines", F.lit(1))).alias("n"), F.array_sort(F.collect_set("f.family")).alias("families"))


def licences(docs: DataFrame, **settings: float) -> DataFrame:
    """(doc_id, n_paragraphs, n_notices, families) for each row of `docs` (doc_id, text); families sorted, each once.

    Every line of every text, every run of lines between blank ones and, where it is long, every overlapping part of it that can hold enough
    of a template is classified; the classifier is fitted on the templates and at most `sample_rows` lines. n_paragraphs counts lines
    that are not blank. Null and empty texts have none. Repeated rows get the same answer. A table without rows gives none. Other columns are
    left out."""
    docs = pick(docs, "doc_id", "text")
    found = Scanner(docs, **settings).found(docs)
    filled = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id").alias("r2"), F.size(filled).cast("long").alias("n_paragraphs"))
    out = rows.join(found, ["r1", "r2"], "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.array().cast("array<string>")).alias("families"))
