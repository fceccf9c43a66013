"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.llm import oracles
from findmill.llm.common import read_table
from findmill.llm.decontaminate import contaminated
from findmill.llm.html_text import extract_text
from findmill.llm.importance import draw, importance_weights
from findmill.llm.ngram_join import ngram_join
from findmill.llm.packing import Encoder, place, token_pieces
from findmill.llm.piece_coder import decode, with_ids
from findmill.llm.pii import KINDS as PERSONAL
from findmill.llm.pii import all_spans, find_personal
from findmill.llm.quality import with_quality
from findmill.llm.ranked_search import ranked_search
from findmill.llm.secret_scan import KINDS, joined, scan_secrets
from findmill.llm.substring_dedup import kept_digest, remove_repeats
from findmill.llm.token_counts import token_counts
from findmill.llm.vector_dedup import vector_links


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(tokenizer_path("byte_bpe_50k.json"), ranks=tokenizer_path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, special={"<|endoftext|>": 50256})


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), byte_encoder(), limit=2048, end_id=0)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), limit=2048)


def _kind_is(kind: str):
    return lambda s: s["kind"] == kind


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"), size=5, percent=75)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["depth"] == 0)
    of_kind = [F.size(F.filter(base, _kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *of_kind, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = with_quality(docs, read_table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"), keep=["doc_id"])
    return judged.select("doc_id", "p_text", "p_toxic", "q_host", "q_path", "p_quality", "keep")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(remove_repeats(read_table(spark, sf_dir, "documents"), size=20))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _kind_is(k))).cast("long").alias(f"n_{k}") for k in PERSONAL]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(all_spans()).alias("spans"))


def op11_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    coded = with_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    back = coded.withColumn("decoded", decode(F.col("ids"), model))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), top=10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = importance_weights(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), n_buckets=10_000, longest=1)
    return draw(weights, least_words=20, percent=10, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_best_fit_packing": op1_best_fit_packing, "op2_decontamination": op2_decontamination, "op3_embedding_dedup": op3_embedding_dedup, "op4_ngram_join": op4_ngram_join, "op5_token_counts": op5_token_counts, "op6_html_extraction": op6_html_extraction, "op7_secret_scan": op7_secret_scan, "op8_quality_classifier": op8_quality_classifier, "op9_substring_dedup": op9_substring_dedup, "op10_personal_data": op10_personal_data, "op11_piece_coding": op11_piece_coding, "op12_ranked_search": op12_ranked_search, "op13_importance_resampling": op13_importance_resampling}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": oracles.OP3, "op4_ngram_join": oracles.OP4, "op9_substring_dedup": oracles.OP9, "op12_ranked_search": oracles.OP12, "op13_importance_resampling": oracles.OP13}
