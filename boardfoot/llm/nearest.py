"""Approximate nearest neighbours with score-aware quantisation.

Vectors are scaled to unit length and cut into parts of two components; each part is one of 16 centres (four bits). Centres
and codes minimise ``parallel * (residual along the vector)**2 + across * (rest of the residual)**2``: an error along the
vector changes its largest inner products most, so it weighs more. A query makes a table of its inner products with all
centres; sums of table entries rank the codes, and the best of each block are scored again on the original vectors. How far the
two scores lie apart for these tells how far down the codes the true best can be: all down to there are scored again as well, so
in a dense group, whose codes cannot be told apart, all members are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.llm.range_join import matrix, unit, usable
from boardfoot.plans.shared import materialize, small_batches

CENTRES, PART = 16, 2
#: Rows beyond k that a block hands on, for scores that differ only by rounding; scores are compared to so many digits there.
SPARE, DIGITS = 16, 12
#: Rows that are encoded, and queries that have their tables, at a time.
ENCODED, TABLED = 1024, 256


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, PART), with zeros at the end if the length asks for it."""
    extra = -x.shape[1] % (2 * PART)
    return np.pad(x, ((0, 0), (0, extra))).reshape(len(x), -1, PART)


def anisotropic_encode(x: np.ndarray, centres: np.ndarray, ratio: float, sweeps: int = 2) -> np.ndarray:
    """Codes of unit vectors by coordinate descent; `ratio` is how much more an error along the vector weighs."""
    p = _parts(x)
    n, m, _ = p.shape
    error = ((p[:, :, None, :] - centres[None]) ** 2).sum(-1)  # rows, parts, centres
    along = ((p[:, :, None, :] - centres[None]) * p[:, :, None, :]).sum(-1)
    codes = error.argmin(-1)
    rows, cols = np.arange(n), np.arange(m)
    total = along[rows[:, None], cols, codes].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (error[:, j] + (ratio - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            total = rest + along[rows, j, codes[:, j]]
    return codes.astype(np.uint8)


def fit_centres(x: np.ndarray, ratio: float, rounds: int = 6, seed: int = 2) -> np.ndarray:
    """(parts, CENTRES, PART) centres for unit vectors: encode, then solve each centre's weighted least squares."""
    p = _parts(x)
    n, m, _ = p.shape
    rng = np.random.default_rng(seed)
    centres = p[rng.choice(n, CENTRES, replace=n < CENTRES)].transpose(1, 0, 2).copy()
    for step in range(rounds):
        codes = anisotropic_encode(x, centres, ratio if step else 1.0)
        cols = np.arange(m)
        residual = p - centres[cols, codes]
        total = (residual * p).sum((1, 2))
        for j in range(m):
            mine = (residual[:, j] * p[:, j]).sum(1)
            for c in range(CENTRES):
                at = np.flatnonzero(codes[:, j] == c)
                if not len(at):
                    continue
                u = p[at, j]
                goal = total[at] - mine[at] + (u * u).sum(1)  # of <centre, u>, for no error along the vector
                a = len(at) * np.eye(PART) + (ratio - 1) * u.T @ u
                centres[j, c] = np.linalg.solve(a, u.sum(0) + (ratio - 1) * u.T @ goal)
    return centres


def nearest(rows: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = 128, sample: int = 10_000, parallel_at: float = 0.2, block: int = 1 << 13, lot: int = 1 << 10, margin: float = 3.0) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is a multiple of `every`, the k other rows of largest cosine found.

    Score is the cosine of the original vectors in double precision; ties go to the smaller id. Vectors that are null, zero
    or hold null or non-finite components, and rows without an id, take no part, neither as queries. All vectors have one
    length. If ids repeat, rows of the query's own id are no candidates. Centres are fitted on at most `sample` rows, chosen by the hash of
    the id; all rows are encoded. Of a block of up to `block` vectors the best `rerank` codes are scored exactly for each query, and then
    every code whose sum is not below the k-th exact score by more than `margin` times the root mean square of those codes' errors:
    there is no cap. Work is the stated queries against all codes; what leaves a block is `k` rows and SPARE more a query. A task holds
    one block and up to `lot` queries at a time, however many there are of either.
    `parallel_at` is the cosine from which scores matter; it sets the weight of errors along the vector.
    """
    spark = rows.sparkSession
    fit = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fit = fit.where(F.col("id").isNotNull() & usable(F.col("vector")))
    n = fit.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = int(min(1.0, sample / n) * (1 << 30))
    chosen = fit.where(F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(1 << 30)) <= share * 1.2).orderBy(F.xxhash64(F.lit(2), "id"), "id").limit(sample).toArrow()
    x = unit(matrix(chosen.column("vector").combine_chunks())) if chosen.num_rows else None
    if x is None:
        x = unit(matrix(fit.limit(1).toArrow().column("vector").combine_chunks()))
    dim = x.shape[1]
    ratio = (dim - 1) * parallel_at**2 / (1 - parallel_at**2) if dim > 1 else 1.0
    shared = spark.sparkContext.broadcast(fit_centres(x, max(1.0, ratio)))  # dim * 16 numbers

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks: ids in order, codes two to a byte, and the vectors at unit length."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            i, c, x = (np.concatenate(a) for a in zip(*held))
            by_id = np.argsort(i, kind="stable")
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (i[by_id], np.ascontiguousarray(c[by_id].T), x[by_id])], ["ids", "codes", "units"])

        size = min(ENCODED, block)
        for b in (b.slice(s, size) for b in batches for s in range(0, b.num_rows, size)):
            if sum(len(h[0]) for h in held) + b.num_rows > block:
                yield flush()
            x = unit(matrix(b.column("vector")))
            found = anisotropic_encode(x, shared.value, max(1.0, ratio))
            held.append((b.column("id").to_numpy(), found[:, ::2] << 4 | found[:, 1::2], x))
        if held:
            yield flush()

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, lot):
                part = b.slice(s, lot)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([matrix(part.column("vector")).tobytes()], pa.binary())], ["queries", "vectors"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            for r in range(b.num_rows):
                ids, q = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in ("ids", "queries"))
                codes = np.frombuffer(b.column("codes")[r].as_py(), np.uint8).reshape(-1, len(ids))
                units = np.frombuffer(b.column("units")[r].as_py()).reshape(len(ids), -1)
                wanted = unit(np.frombuffer(b.column("vectors")[r].as_py()).reshape(len(q), -1))
                out_q, out_v, out_s = [], [], []
                for i, query in enumerate(q):
                    if i % TABLED == 0:
                        table = np.einsum("qmp,mcp->qmc", _parts(wanted[i : i + TABLED]), centres).astype(np.float32)
                        pair = (table[:, ::2, :, None] + table[:, 1::2, None, :]).reshape(len(table), len(codes), 256)
                    rough = pair[i % TABLED, 0][codes[0]]
                    for j in range(1, len(codes)):
                        rough += pair[i % TABLED, j][codes[j]]
                    others = np.flatnonzero(ids != query)
                    if len(others) > rerank:
                        some = others[np.argpartition(rough[others], len(others) - rerank)[len(others) - rerank :]]
                        exact = units[some] @ wanted[i]
                        error = np.sqrt(np.mean((exact - rough[some]) ** 2))
                        least = np.partition(exact, len(exact) - k)[len(exact) - k] - margin * error if k <= rerank else -np.inf
                        others = np.union1d(some, others[rough[others] >= least])
                    exact = np.round(np.einsum("ij,j->i", units[others], wanted[i]), DIGITS)
                    # Ids ascend, so of equal scores those of smaller ids come first.
                    best = np.argsort(-exact, kind="stable")[: k + SPARE]
                    out_q.append(np.full(len(best), query))
                    out_v.append(ids[others[best]])
                    out_s.append(exact[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (out_q, out_v, out_s)], ["query_id", "id", "near"])

    codes = materialize(fit.mapInArrow(encode, "ids binary, codes binary, units binary"), "codes")
    queries = fit.where(F.col("id") % every == 0)
    asked = materialize(queries.mapInArrow(lots, "queries binary, vectors binary"), "queries")
    # A stated set of queries against all rows, block by block: some rows of this product, each a block of either side.
    # A row goes to Python by itself: a batch of them would hold as many copies of a block as there are lots of queries.
    with small_batches(spark, 1):
        found = materialize(codes.crossJoin(asked).mapInArrow(scan, "query_id long, id long, near double"), "near")
    by_near = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    few = found.withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= k + SPARE).select("query_id", "id").distinct()
    few = few.join(fit, "id").join(queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # Scaled by a power of two, which changes no digit, so that squares neither overflow nor vanish.
    power = lambda v: F.pow(F.lit(2.0), -F.floor(F.log2(F.greatest(F.array_max(F.transform(v, F.abs)), F.lit(2.0**-1000)))))
    scaled = lambda v: F.transform(v, lambda x: x * power(F.col(v)))
    few = few.select("query_id", "id", scaled("query").alias("query"), scaled("vector").alias("vector"))
    score = dot("query", "vector") / (F.sqrt(dot("query", "query")) * F.sqrt(dot("vector", "vector")))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = few.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
