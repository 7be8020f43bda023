"""A training-data pipeline over `documents`: quality, line dedup, near-duplicates, mixing, BPE. Part of subpackage llm."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.bpe import bpe_decode, bpe_encode
from runlens.llm.common import checkpoint_dir, free, new_folder
from runlens.llm.lines import dedup_lines
from runlens.llm.mixing import mixed_order
from runlens.llm.quality import select_quality
from runlens.llm.queries import tokenizer_path
from runlens.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is large enough; the model is fitted on the labelled ones among docs.

    Null texts are rated as empty ones, and rows without doc_id by their text like any other. Repeated rows stay or go together. Columns of docs
    that are named like the operator's results are kept as they are. No documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = {k: free(docs, f"__{k}") for k in ("expected", "tail", "keep")}
    return select_quality(docs, labels, **names).filter(F.col(names["keep"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later repeats of runs of 50 words or more; n_chars follows the text.

    Null and empty texts stay as they are; rows without doc_id come last in the order of places. No documents give none.
    """
    out = dedup_lines(docs, min_words=50)
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id (null last), of each group of near copies (five words, similarity 0.8).

    Texts without words, null ones included, are copies of each other; of rows alike in doc_id and text one stays. No documents give none.
    """
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mixture by the sources' sizes to the power of 0.5.

    Rows without a source are a source of their own; null and empty texts count as one character. No documents give none.
    """
    return mixed_order(docs, temperature=0.5)


def stored_position(docs: DataFrame) -> DataFrame:
    """docs with __position, which rises in the order in which rows were written, whatever splits they are read in.

    Files are numbered by the task that wrote them. A table that wasn't read from files has the order of its partitions.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return docs.withColumn("__position", F.monotonically_increasing_id())
    number = lambda pattern: F.coalesce(F.expr(f"try_cast(regexp_extract(_metadata.file_name, '{pattern}', 1) as bigint)"), F.lit(0))
    return docs.withColumn("__position", F.shiftleft(number("^part-([0-9]+)"), 42) + F.shiftleft(number("-c([0-9]+)[.]"), 32) + F.col("_metadata.row_index"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, whether decoding gives its text back, and its position in the mixed order (gaps between files).

    Null texts have no ids, like empty ones. No documents give no rows.
    """
    path = tokenizer_path()
    both = bpe_decode(bpe_encode(stored_position(docs), path), path)
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"), F.col("__position").alias("position"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_dups), ("mixing to target weights", mixing), ("bpe encoding and decoding", bpe)]

#: SQL can't express the fitted model, the SimHash groups or the ids; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written as Parquet in the shared folder and read again for the next."""
    checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
    return docs
