"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.llm.common import materialise, read_table
from findmill.llm.decontaminate import clean
from findmill.llm.ngram_join import ngram_join
from findmill.llm.packing import place, token_pieces
from findmill.llm.quality import with_quality
from findmill.llm.queries import byte_encoder
from findmill.llm.secret_scan import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that are not toxic. A null text is judged as an empty one; repeated rows stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"), row.alias("row"))
    judged = with_quality(known, read_table(spark, sf_dir, "labels"), host=F.col("host"), path=F.col("path"), keep=["row"])
    return judged.filter("keep").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Documents without words are in no group and stay. Of rows with one doc_id one stays; rows without a doc_id are told
    apart by their text, and yield to a near duplicate that has one.
    """
    nameless = F.col("doc_id").isNull()
    empty = nameless & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # above every doc_id in use; longer than any column's name, so it clashes with none
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    key = max(docs.columns, key=len) + "_key"
    keyed = docs.filter(~empty).withColumn(key, F.coalesce(F.col("doc_id").cast("long"), stand_in))
    joined = ngram_join(keyed.select(F.col(key).alias("doc_id"), "text"), size=5, percent=75)
    first = joined.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    kept = keyed.join(first, key, "left_semi").dropDuplicates([key])
    return kept.select(docs.columns).union(docs.filter(empty))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked also where they are encoded; n_chars follows the text. Null texts stay null."""
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens. Null texts are empty."""
    pieces = token_pieces(docs.select("doc_id", "text"), byte_encoder(), limit=2048, end_id=0)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), limit=2048)


#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
    ("without_secrets", without_secrets), ("packed", packed),
]

#: Classification, passage search, decoding and packing are not expressible in SQL; tests/llm holds the
#: brute-force checks of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and reread as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
