"""A corpus from raw documents to token ids: five stages, each an operator of boardfoot.llm.

Stages join their decisions to rows by a key of the row itself, not by doc_id: rows with a null or repeated id are documents
of their own in every stage. Texts can be null or empty. Columns that a stage does not know are kept. An empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardfoot.llm.bpe import encode_decode
from boardfoot.llm.mixing import mix_sources
from boardfoot.llm.near_duplicates import near_duplicates
from boardfoot.llm.quality import resample
from boardfoot.llm.queries import pii_key, token_digests, tokenizer_path
from boardfoot.llm.surrogates import replace_pii
from boardfoot.plans.shared import broadcast_if_small, lower_batches, materialize

#: Rows up to which a list of documents to drop or repeat is broadcast (16 bytes each); beyond, Spark shuffles.
SMALL = 1_000_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a 64-bit key of each row, and the key's column: a hash of the row's file and place in it, which every
    read of the file gives. A frame that does not come straight from files is written first."""
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    try:
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.xxhash64(place["file_path"], place["row_index"])), name
    except AnalysisException:
        docs = materialize(docs, "rows")
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.xxhash64(place["file_path"], place["row_index"])), name


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """`docs` without the rows whose key is in `dropped`, and without the key."""
    return docs.join(broadcast_if_small(materialize(dropped.select(key), "dropped"), SMALL), key, "left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; null and empty texts are kept. Rejected are few, so they are what is joined."""
    rows, key = keyed(docs)
    decided = resample(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=(key,))
    return without(rows, key, decided.where(~F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: one of the smallest id (null last). Texts without words are in no group."""
    rows, key = keyed(docs)
    found = materialize(near_duplicates(rows, id_col=key, k=5, num=80, den=100).select(key, F.col("component_id").alias("group")), "groups")
    found = found.join(found.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group").join(rows.select(key, "doc_id"), key)
    first = found.groupBy("group").agg(F.min_by(key, F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first"))
    return without(rows, key, found.join(first, "group").where(F.col(key) != F.col("first")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the new text (null for null)."""
    return replace_pii(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Documents without words are not taken."""
    rows, key = keyed(docs)
    taken = mix_sources(rows, row_col=key).where("taken > 0").select(key, (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    copies = f"{key}_copies"
    taken = broadcast_if_small(materialize(taken.withColumnRenamed("copies", copies), "copies"), SMALL)
    return rows.join(taken, key).withColumn(key, F.explode(F.sequence(F.lit(1), copies))).drop(key, copies)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token count and digests of its ids and of what they decode to; a null text has no ids."""
    lower_batches(spark, 500)
    return token_digests(encode_decode(docs, tokenizer_path()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of `sf_dir`; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn, cluster and tokenise; SQL has no words for that. tests/llm holds them against plain Python.
ORACLE_SQL = None
