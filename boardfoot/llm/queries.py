"""One query a numbered operator: it applies the operator, with production parameters, to its whole table."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardfoot.llm.bpe import encode_decode
from boardfoot.llm.licenses import license_report
from boardfoot.llm.manifest import lower_ascii, manifest, proof_digest
from boardfoot.llm.mixing import mix_sources
from boardfoot.llm.near_duplicates import near_duplicates
from boardfoot.llm.nearest import nearest
from boardfoot.llm.order_minhash import against_next, fingerprint, likeness
from boardfoot.llm.periods import digest_runs, periodic_runs, planted_period
from boardfoot.llm.quality import resample
from boardfoot.llm.range_join import near_vectors
from boardfoot.llm.repeats import remove_repeats
from boardfoot.llm.sql import ORACLES as _SQL
from boardfoot.llm.surrogates import replace_pii
from boardfoot.llm.toxicity import score_toxicity
from boardfoot.plans.shared import lower_batches


def pii_key(spark: SparkSession) -> str:
    """The secret on which replacements depend, from the session's configuration; without it a public value, fit for tests only, and a warning."""
    key = spark.conf.get("spark.boardfoot.pii.key", None)
    if key is None:
        warnings.warn("spark.boardfoot.pii.key is not set: surrogates are made with a public key, from which who knows it can tell them", stacklevel=2)
    return key or "not-a-secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document without the bytes that a repeated string of 200 bytes covers."""
    found = remove_repeats(_table(spark, sf_dir, "documents"), span=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50."""
    return nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether importance resampling keeps each document."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group at a similarity of 0.85 of 3-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's licence phrases and templates."""
    return license_report(_table(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links within its label at a cosine of 0.98."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data and secrets."""
    return replace_pii(_table(spark, sf_dir, "documents"), pii_key(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to."""
    lower_batches(spark, 500)
    return token_digests(encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, its proof and what the proof gives, where every fifth document's text has been put in small letters."""
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = manifest(_table(spark, sf_dir, "documents"), tampered={"text": lower_ascii(F.col("text"))}, where=fifth)
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's periodic runs of words, with runs planted in every tenth document."""
    return digest_runs(periodic_runs(_table(spark, sf_dir, "documents"), edit=planted_period))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are."""
    found = against_next(_table(spark, sf_dir, "documents"))
    own, edited = F.col("signature"), F.col("edited_signature")
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"), likeness(own, edited).alias("near_edited"), likeness(own, F.col("next_signature")).alias("near_next"), "next_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are; the path is all that this library knows of them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_remove_repeats, op2_nearest, op3_mix_sources, op4_importance_resampling, op5_toxicity, op6_near_duplicates, op7_licenses, op8_near_vectors, op9_surrogates, op10_bpe, op11_manifest, op12_periodic_runs, op13_fingerprints)}
ORACLES: dict[str, str] = dict(_SQL)
