"""Score texts for toxicity by non-negative positive-unlabelled learning.

A linear model on hashed words is trained with numpy from confirmed toxic texts and unlabelled ones. Its risk is
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])`` with the logistic loss: the second part is what unlabelled
text would cost if all were clean, less the share that is toxic; where it would be negative, the step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.llm.text_arrays import ALNUM, U64, texts

BUCKETS = 1 << 18


def word_buckets(column: pa.Array) -> list[np.ndarray]:
    """The distinct hash buckets of each text's words."""
    out: list[np.ndarray] = []
    for lot in texts(column):
        lot = lot.lowered()
        starts, ends, rows = lot.words(ALNUM)
        keys = np.unique(rows.astype(U64) * U64(BUCKETS) + lot.hashes(starts, ends) % U64(BUCKETS))
        cuts = np.searchsorted(keys, np.arange(1, lot.rows, dtype=U64) * U64(BUCKETS))
        out += np.split((keys % U64(BUCKETS)).astype(np.int32), cuts)
    return out


class Sparse:
    """Rows of buckets as one binary matrix over the buckets that `columns` keeps."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray) -> None:
        place = np.full(BUCKETS, -1, np.int32)
        place[columns] = np.arange(len(columns))
        found = place[np.concatenate([*rows, np.zeros(0, np.int32)])]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), len(columns)
        self.row, self.col = owner[found >= 0], found[found >= 0]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def sums(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, per_row[self.row], self.width)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-4, least: float = 0.005, lift: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) by Adam on the whole sample. Only buckets in at least `least` of the positive texts, and `lift` times as common there as elsewhere, get a weight."""
    df_p, df_u = (np.bincount(np.concatenate([*x, np.zeros(0, np.int32)]), minlength=BUCKETS) for x in (positive, unlabelled))
    enough = df_p >= max(3, least * len(positive))
    columns = np.flatnonzero(enough & (df_p / len(positive) >= lift * (df_u + 1) / (len(unlabelled) + 2)))
    p, u = Sparse(positive, columns), Sparse(unlabelled, columns)
    theta, m, v = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x.times(theta[:-1]) + theta[-1], -30, 30))) for x in (p, u))
        loss_p, loss_u = -np.log1p(-sp), -np.log1p(-su)  # l(-)
        negative = loss_u.mean() - prior * loss_p.mean()
        up = np.append(p.sums(sp - 1), (sp - 1).sum()) / p.n  # slope of l(+)
        gp = np.append(p.sums(sp), sp.sum()) / p.n  # slopes of l(-)
        gu = np.append(u.sums(su), su.sum()) / u.n
        grad = prior * up + (gu - prior * gp) if negative >= 0 else -(gu - prior * gp)
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    return columns, theta[:-1], float(theta[-1])


def held_out_rows(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_positive: int = 4000, max_unlabelled: int = 12000, steps: int = 300) -> DataFrame:
    """One row a document: id, held_out, score (0 to 1) and predicted (score >= threshold).

    Learns from at most `max_positive` toxic texts and `max_unlabelled` texts without regard to labels, both of rows that
    are not held out and both chosen by the hash of their id (12,000 unlabelled texts hold some hundreds of toxic ones at the shares seen here, enough to weigh words that 1 in 200 toxic texts has); the prior is the share of toxic labels among such rows. Null
    and empty texts get the model's bias as score. Without a toxic text to learn from (no such label, or no document of its id) every score is 0; if all
    labels are toxic the prior is 0.99. An empty table gives an empty one. Repeated ids are scored each;
    a label whose id is repeated counts as toxic if one of its rows is. Other columns are not looked at.
    """
    known = labels.where(~held_out_rows(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    n_known, n_toxic = known.agg(F.count("*"), F.sum(F.expr("y = 1").cast("long"))).first()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    model = np.zeros(0, np.int64), np.zeros(0), -np.inf
    if n_toxic:
        toxic = known.where("y = 1").select(id_col).orderBy(F.xxhash64(F.lit(5), id_col), id_col).limit(max_positive)
        toxic_ids = [r[0] for r in toxic.collect()]  # at most max_positive ids
        train = rows.where(~held_out_rows(F.col("id")))
        share = min(1.0, max_unlabelled / max(1, train.count()))
        any_row = (F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).alias("u")
        wanted = F.coalesce(F.col("id").isin(toxic_ids), F.lit(False))
        sample = train.select(any_row, wanted.alias("p"), "text").where("u or p")

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("p"), pa.array(word_buckets(b.column("text")), pa.list_(pa.int32()))], ["u", "p", "buckets"])

        got = sample.mapInArrow(features, "u boolean, p boolean, buckets array<int>").limit(max_positive + 2 * max_unlabelled).toArrow()
        u, p = got.column("u").to_numpy(), got.column("p").to_numpy()
        lists = [np.asarray(x.values, np.int32) for x in got.column("buckets")]
        positive, unlabelled = ([x for x, k in zip(lists, marks) if k] for marks in (p, u))
        if positive and unlabelled:
            model = fit_nnpu(positive, unlabelled, min(0.99, max(0.0001, n_toxic / n_known)), steps)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, weights, bias = shared.value
        full = np.zeros(BUCKETS)
        full[columns] = weights
        for b in batches:
            z = np.array([full[x].sum() for x in word_buckets(b.column("text"))]) + bias
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) * (bias > -np.inf))], ["id", "score"])

    out = rows.mapInArrow(scored, f"id {id_type}, score double")
    return out.select(F.col("id").alias(id_col), held_out_rows(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

