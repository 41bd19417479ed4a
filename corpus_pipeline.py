"""From raw documents to training sequences, stage by stage.

Each stage takes what the one before kept. All but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.common import keep_ids, staged, table
from rolecall.llm.decontamination import find_leaks
from rolecall.llm.jaccard_join import jaccard_components
from rolecall.llm.language_id import UNKNOWN, fit_languages, identify_languages
from rolecall.llm.packing import pack_binary
from rolecall.llm.queries import tokenizer_path
from rolecall.llm.secret_scan import redacted, scan_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts and texts without letters.

    The model learns from the labelled rows. Without any, texts with letters stay.
    """
    model = fit_languages(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return identify_languages(rows, model).filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Rows without doc_id or without words belong to no group and stay. Of rows
    that share the kept doc_id one stays.
    """
    found = staged(jaccard_components(docs), "groups").filter("doc_id IS NOT NULL")
    heads = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"))
    heads = staged(heads, "heads")
    one = keep_ids(docs, heads.filter("rows = 1 OR n = 0").select("doc_id"), "doc_id")
    first = keep_ids(docs, heads.filter("rows > 1 AND n > 0").select("doc_id"), "doc_id").dropDuplicates(["doc_id"])
    return one.unionByName(first).unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks = staged(find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "leaked")
    small = leaks.limit(500_001).count() <= 500_000
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(F.broadcast(leaks) if small else leaks, same, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars, where there is one, follows the text."""
    found = scan_secrets(docs).withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        changed = (F.size("spans") > 0) & F.col("n_chars").isNotNull()
        found = found.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths, with their ids."""
    return pack_binary(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Classification, near copies by components, retrieval and tokens cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to `documents`, writing and rereading between stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
