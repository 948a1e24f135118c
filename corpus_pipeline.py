"""Documents to packed training sequences: drop toxic ones, cut boilerplate lines, keep one of each group of near-duplicates, mix the
sources to their targets, pack. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.llm import line_dedup, mixing, packing, simhash, toxicity
from tieline.llm.common import DOCUMENT, pick, stored, table
from tieline.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likeliest side is a grade above 0 go; the model is fitted on the labelled ones among `docs`."""
    docs = pick(docs, *DOCUMENT)
    model = toxicity.fit(docs.select("doc_id", "text"), pick(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    return toxicity.scored(docs, model).filter(~F.col("toxic")).select(*DOCUMENT)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; n_chars follows where lines went."""
    cut = line_dedup.without_boilerplate(pick(docs, *DOCUMENT))
    chars = F.when(F.col("lines.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*DOCUMENT)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share four fifths of their five-word shingles, or are linked by others that do, the one with the smallest doc_id
    stays; rows without id come last. Texts without words are one group, repeated rows are copies. An empty table stays empty; other columns
    than those of documents are left out, whatever they are called."""
    return simhash.one_of_each(pick(docs, *DOCUMENT))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, up to three times. Null is a source, the last; documents without words, which
    add none to any target, leave the mix. Repeated rows take part on their own. An empty table stays empty; other columns are left out."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids. Null and empty texts are their end id, repeated rows documents of their own, null
    ids stay null; long texts are cut, never dropped. An empty table gives no pieces; other columns are left out."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_lines), ("simhash", keep_one_of_each), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
