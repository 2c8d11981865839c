"""A corpus pipeline over ``documents``: five filtering and encoding stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

Null texts pass the filters and are encoded to no tokens.  Rows that repeat with the
same id and text are one document and leave the near-duplicate stage once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bpe import encode_decode
from tablelens.llm.decontaminate import decontaminate
from tablelens.llm.line_dedup import dedup_lines
from tablelens.llm.minhash import near_duplicates
from tablelens.llm.registry import TOXIC_FROM, toxicity_scores, vocabulary_path
from tablelens.session import scratch_path

#: The toxicity model has no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels, score="_tl_score", terms="_tl_terms").filter(F.col("_tl_score") < TOXIC_FROM).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines under repeated three-line windows go; n_chars follows the text."""
    out = dedup_lines(docs, total="_tl_total", removed="_tl_removed")
    return out.withColumn("n_chars", F.when(F.col("_tl_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def _by_row(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """``docs`` whose (doc_id, text) is (left_semi) or isn't (left_anti) among the marked rows."""
    keyed = docs.withColumn("_tl_hash", F.xxhash64("text"))
    marked = marked.select(F.col("doc_id").alias("_tl_id"), F.col("text_hash").alias("_tl_marked")).distinct()
    same = (F.col("_tl_hash") == F.col("_tl_marked")) & F.col("doc_id").eqNullSafe(F.col("_tl_id"))
    return keyed.join(marked, same, how)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents near each other (five-word shingles, similarity 0.8), the one of the smallest id stays."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return _by_row(docs, found.filter("kept"), "left_semi").dropDuplicates(["doc_id", "_tl_hash"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go."""
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _by_row(docs, found.filter("contaminated"), "left_anti").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids (packed), number of tokens and the digest of the decoded text."""
    new = ("ids", "n_tokens", "decoded_sha256")
    out = encode_decode(docs.select([c for c in docs.columns if c not in new]), vocabulary_path(), decoded="_tl_decoded")
    return out.withColumn("decoded_sha256", F.sha2(F.col("_tl_decoded").cast("binary"), 256)).drop("_tl_decoded")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("decontamination", decontamination), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_path(spark, f'pipeline-{name}')}/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
