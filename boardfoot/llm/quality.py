"""Keep good documents by importance resampling.

Two hashed n-gram models, of target text (documents labelled as good) and of raw text (all documents), give each document
the log of how much likelier the target model makes it. Gumbel noise, a fixed function of the id, is added to it, and the
k documents with the largest sums stay: a sample without replacement in proportion to the importance weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.llm.text_arrays import ALNUM, NOT_SPACE, U64, Texts, mix, texts
from boardfoot.plans.shared import materialize, small_batches

REPEAT, ROW_START, MERGE = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F), U64(0xA0761D6478BD642F)


def grams(lot: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each unigram and bigram of a lot of texts.

    Tokens are runs of letters and digits and runs of other signs, in their case. Signs of one kind are told apart by
    their first 3 bytes; a token that repeats the one before it is the token "repeat".
    """
    starts, ends, rows = lot.words(NOT_SPACE)
    word = ALNUM[lot.data]
    inner = np.flatnonzero((word[1:] != word[:-1]) & NOT_SPACE[lot.data[1:]] & NOT_SPACE[lot.data[:-1]]) + 1
    inner = inner[~np.isin(inner, lot.at)]
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    rows = np.searchsorted(lot.at, starts, side="right") - 1
    signs = ~word[starts]
    token = lot.hashes(starts, np.where(signs, np.minimum(ends, starts + 3), ends))
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (rows[1:] == rows[:-1])
    token[same] = REPEAT
    before = np.full(len(token), ROW_START, U64)
    inside = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    before[inside] = token[inside - 1]
    pairs = mix(before * MERGE + token)
    return np.concatenate([token % U64(buckets), pairs % U64(buckets)]).astype(np.int64), np.concatenate([rows, rows])


def ngram_counts(rows: DataFrame, target_ids: list, buckets: int) -> DataFrame:
    """(bucket, raw, target): n-grams of all texts and of those of the target ids. Each task gives a row a bucket at most."""
    ids = rows.sparkSession.sparkContext.broadcast(np.sort(np.array(target_ids, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            chosen = pc.is_in(b.column("id").cast(pa.int64()), pa.array(ids.value)).to_numpy(zero_copy_only=False)
            for lot in texts(b.column("text")):
                bucket, row = grams(lot, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[lot.first + row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    got = rows.mapInArrow(count, "bucket long, raw long, target long")
    return got.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise, a fixed function of the id."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, least: int = 4096) -> float | None:
    """The k-th largest value of a double column, exactly: counts in 1,024 ranges, then in the range where the k-th lies,
    until at most `least` values are left, or one. None if there are fewer than k."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    above = 0
    for _ in range(40):
        inside = df.where(F.col(column).between(low, high))
        if low == high:
            return low
        if inside.count() <= least:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - above - 1]
        width = (high - low) / 1024
        part = F.least(F.floor((F.col(column) - low) / width), F.lit(1023))
        found = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("part")).collect()
        for r in found:
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
    raise RuntimeError("the k-th value was not found")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, buckets: int = 10_000, max_target: int = 20_000, prior: float = 10.0, seed: int = 4, carry: tuple[str, ...] = (), batch: int = 500) -> DataFrame:
    """One row a document: id, log_weight, sample_key (log_weight plus noise), kept, and the columns that `carry` names.

    The target model is fitted on at most `max_target` ids labelled 1, chosen by the hash of the id; the raw model counts
    all documents. `prior` n-grams a bucket, dealt as in the raw text, stand in for target text not seen. `k` is how many are kept; by default as many as the target model makes likelier than the raw one does
    (log_weight >= 0). Documents that tie with the k-th are kept too, so repeated rows fare alike. Null and empty texts
    have log_weight 0, as there is nothing against them; without labelled documents all are kept. Ids are whole numbers.
    Repeated ids are documents of their own. An empty table gives an empty one. Python sees `batch` documents at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"))
    id_type, carried_type = rows.schema["id"].dataType.simpleString(), rows.schema["carried"].dataType.simpleString()
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    good_ids = [r[0] for r in good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_target).collect()]
    with small_batches(docs.sparkSession, batch):
        counts = ngram_counts(rows, good_ids, buckets).collect()  # at most `buckets` rows
    raw, target = np.ones(buckets), np.zeros(buckets)
    for bucket, r, t in counts:
        raw[bucket] += r
        target[bucket] += t
    target += raw * (prior * buckets / raw.sum())
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum()) if good_ids else np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = np.zeros(b.num_rows)
            for lot in texts(b.column("text")):
                bucket, row = grams(lot, buckets)
                weight[lot.first : lot.first + lot.rows] = np.bincount(row, shared.value[bucket], lot.rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("carried"), pa.array(weight)], ["id", "carried", "log_weight"])

    keys = rows.mapInArrow(weigh, f"id {id_type}, carried {carried_type}, log_weight double")
    with small_batches(docs.sparkSession, batch):
        keys = materialize(keys.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("id"), seed)), "sample-keys")
    if k is None:
        k = keys.where("log_weight >= 0").count()
    least = kth_largest(keys, "sample_key", min(k, keys.count()))
    kept = F.col("sample_key") >= F.lit(least) if least is not None else F.lit(False)
    return keys.select(F.col("id").alias(id_col), "log_weight", "sample_key", kept.alias("kept"), *(["carried.*"] if carry else []))
