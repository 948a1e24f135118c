"""The operators over their tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.llm import decontamination, host_rules, licences, line_dedup, merkle, mixing, neighbours, packing, periods, sharding, simhash, suffix_dedup, toxicity
from tieline.llm.common import pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_line_dedup", line_dedup.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@query("op4_host_rules", host_rules.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_verdicts(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.numbered(table(spark, sf_dir, "documents"))).drop("row")


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffled(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), 24)
    text = F.col("row.text")
    return placed.select(F.col("row.doc_id").alias("doc_id"), sharding.text_size(text).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_licences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


@query("op9_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_periods")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periods.periodic_runs(docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.reduce("runs", F.lit(None).cast(periods.RUNS[6:-1]), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = found.withColumn("top", longest)
    run = [F.col("top")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli")
    digests = [F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *run, milli, *digests)


@query("op12_decontamination", decontamination.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontamination.n_hit())
    items = [F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")]
    return found.select("doc_id", "n_words", "n_hit", *items, (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_merkle", merkle.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered(F.col("text")))
    found = found.withColumn("proof_sha256", merkle.proof_digest(F.col("path"))).withColumn("folded_root", merkle.folded(F.col("seen"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
