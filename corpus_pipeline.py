"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage but the last returns the columns of documents and drops others. Defined
results: a null text counts as empty, is scored like any other, is a copy of other texts
without words and has no tokens; null ids keep their rows in the dedup stages; repeated
rows are treated alike; texts of any length are taken whole; an empty table gives an
empty one. Line dedup cuts later repeats out of texts, whose n_chars follows; a document
of which nothing is left goes. Of near copies the one with the least id stays. Mixing
repeats a document for each epoch that takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, lines, mixing, quality, simhash
from tessera.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses the trees, the winnowing, the fingerprints and the encoder; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go; without labels of both classes the share of label 1 decides for all."""
    trees = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, trees).where("score >= 0.5").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of 50 words or more go, and with them documents of which nothing is left."""
    found = lines.deduplicated(docs)
    left = (F.col("removed_words") == 0) | (F.trim(F.col("text")) != "")
    n_chars = F.when(F.col("removed_words") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where(left).withColumn("n_chars", n_chars).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.keep_one_of_each(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, each as often as an epoch takes it."""
    return mixing.mixed(docs).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (empty for a null text) and number of tokens."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
