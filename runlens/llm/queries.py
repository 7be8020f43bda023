"""One query for each operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import documents, new_folder
from .fingerprints import edited_fingerprints
from .language import fit_language_model, predict_language
from .licence_sql import licence_sql
from .licenses import scan_licenses
from .lines import dedup_lines
from .mixing import mix_sources
from .neighbours import nearest_neighbours
from .quality import select_quality
from .search import lexical_sql, ranked_search
from .simhash import simhash_components
from .spelling import spelling_variants
from .token_files import read_token_files, write_token_files
from .urls import RULES, filter_urls
from .urls import SQL as URL_SQL


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of a mixture whose weights are the sources' sizes to the power of 0.5."""
    mixed = mix_sources(documents(spark, sf_dir), temperature=0.5)
    return mixed.select("doc_id", "source", F.col("__block").alias("source_block"), F.col("__slot").alias("slot"), F.col("__offset").alias("offset_in_block"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    both = bpe_decode(bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def document_path() -> F.Column:
    """Files of a tree /source/language/hundreds/..., with a licence file for each eighth document, a level up for each 32nd."""
    root = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")))
    id_ = F.coalesce("doc_id", F.lit(-1))
    folder = F.when(id_ % 32 == 0, root).otherwise(F.concat(root, F.lit("/"), F.floor(id_ / 4000).cast("string"), F.when(id_ % 8 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.floor(id_ / 500).cast("string")))))
    return F.concat(folder, F.when(id_ % 8 == 0, "/LICENSE-").otherwise("/doc-"), id_.cast("string"), F.lit(".txt"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), document_path())


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after line dedup at 50 words, with the digest of what is left."""
    out = dedup_lines(documents(spark, sf_dir), min_words=50)
    return out.select("doc_id", F.col("__removed").cast("long").alias("lines_removed"), F.length("text").cast("long").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit_language_model(docs.filter(~held_out))
    return predict_language(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, tokenizer_path(), end_id=2)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir), shingle=3, max_bits=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = select_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.select("doc_id", "expected_grade", "tail_probability", "keep")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), one_in=97)


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_bpe, op3_licenses, op4_neighbours, op5_lines, op6_language, op7_token_files, op8_simhash, op9_fingerprints, op10_quality, op11_search, op12_spelling, op13_urls)}


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licence_sql(), "op11_search": lexical_sql(), "op13_urls": URL_SQL}
