"""Near-duplicate vectors of one label: an exact range join in a metric space.

Unit vectors with cosine c lie ``sqrt(2 - 2c)`` apart. In every cell (at first a label) some vectors become pivots; a vector's
home is the cell of its nearest pivot. By the triangle inequality a neighbour of a vector of cell i cannot lie in cell j
unless ``(d_j**2 - d_i**2) / (2 * d(p_i, p_j)) <= radius``, so only vectors near a boundary are copied across it. Cells
are split until they are small or a split does not halve them, and each is joined by itself. Equal vectors are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.llm.components import components
from boardfoot.plans.shared import materialize


def usable(vector: Column) -> Column:
    """Whether a vector can have a cosine: not null, without null or non-finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of doubles."""
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _split(members: DataFrame, radius: float, pivots: int) -> DataFrame:
    """Members of large cells dealt to the cells of pivots, with copies across boundaries. `members` has count and size."""
    size = F.greatest(F.lit(1), F.floor(F.lit(float(1 << 40)) * pivots / F.col("count"))).cast("long")
    chosen = members.where(F.pmod(F.xxhash64("depth", "id"), F.lit(1 << 40)) < size)
    at = chosen.groupBy("cell").agg(F.collect_list(F.col("vector").cast("array<float>")).alias("pivots"))
    # A cell may have got no pivot by chance; it then stays as it is, and is joined in blocks.
    dealt = members.join(at, "cell", "left").withColumn("pivots", F.coalesce("pivots", F.array(F.col("vector").cast("array<float>"))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            take, child, home = [], [], []
            for cell in np.unique(cells):
                rows = np.flatnonzero(cells == cell)
                p = unit(np.unique(matrix(batch.column("pivots")[rows[0]].values), axis=0))
                x = unit(matrix(batch.column("vector").take(pa.array(rows))))
                d2 = np.maximum(2 - 2 * x @ p.T, 0)
                best = d2.argmin(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[best]
                near = d2 - d2[np.arange(len(x)), best][:, None] <= 2 * apart * radius + 1e-9
                near[np.arange(len(x)), best] = True
                i, j = np.nonzero(near)
                take.append(rows[i])
                child.append(np.array([hash((int(cell), int(k))) for k in range(len(p))], np.int64)[j])
                home.append(j == best[i])
            take, child, home = (np.concatenate(a) for a in (take, child, home))
            got = batch.select(["id", "vector", "n", "home", "count"]).take(pa.array(take))
            own = pa.array(home & got.column("home").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(child), *[got.column(c) for c in ("id", "vector", "n")], own, got.column("count")], ["cell", "id", "vector", "n", "home", "parent"])

    return dealt.mapInArrow(deal, "cell long, id long, vector array<double>, n long, home boolean, parent long")


def _cell_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links of the asking vectors of a cell to all of it: (a, b, links). b is the cell's first vector that links reach from a."""
    asks = table.column("asks").to_numpy()
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    x = unit(matrix(table.column("vector").combine_chunks()))
    q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
    links, low_q, low_d = np.zeros(len(q), np.int64), ids[q], ids[d]
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(q), 256):
        near = x[q[s : s + 256]] @ x[d].T >= threshold
        near &= ids[q[s : s + 256]][:, None] != ids[d]
        links[s : s + 256] = near @ n[d]
        i, j = np.nonzero(near)
        rows.append(i + s)
        cols.append(j)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    while len(rows):
        before = low_q.copy(), low_d.copy()
        np.minimum.at(low_q, rows, low_d[cols])
        np.minimum.at(low_d, cols, low_q[rows])
        if (before[0] == low_q).all() and (before[1] == low_d).all():
            break
    a, b = np.concatenate([ids[q], ids[d]]), np.concatenate([low_q, low_d])
    count = np.concatenate([links, np.zeros(len(d), np.int64)])
    some = (a != b) | (count > 0)
    return pa.table({"a": a[some], "b": b[some], "links": count[some].astype(np.int64)})


def near_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell_size: int = 256, block: int = 4096, pivots: int = 8, max_depth: int = 8) -> DataFrame:
    """One row a vector: id, n_links (vectors linked with it), component_id and kept (id = component_id).

    Two rows are linked if their labels are equal and not null and their cosine is `threshold` or more. Vectors that are null,
    zero or hold null or non-finite components, and rows without a label, have no links; nor have rows without an id, whose
    component_id is null and which are not kept. Vectors of one label have one length. Rows with equal ids are different
    vectors. An empty table gives an empty one; other columns are not looked at.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    classes = materialize(given.where(fit).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    now = classes.select(F.xxhash64("label").alias("cell"), F.col("rep").alias("id"), "vector", "n", F.lit(True).alias("home"), F.lit(None).cast("long").alias("parent"))
    leaves, depth = [], 0
    while True:
        now = materialize(now, "cells")
        counts = now.groupBy("cell").agg(F.count("*").alias("count"))
        counted = now.join(counts, "cell")
        large = (F.col("count") > cell_size) & (F.col("parent").isNull() | (F.col("count") < 0.5 * F.col("parent")))
        large = large if depth < max_depth else F.lit(False)
        leaves.append(counted.where(~large).select("cell", "id", "vector", "n", "home", "count"))
        big = counted.where(large)
        if big.isEmpty():
            break
        now, depth = _split(big.withColumn("depth", F.lit(depth)), radius, pivots), depth + 1
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    # A cell is joined block by block, so a task holds two blocks whatever the cell.
    leaf = leaf.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(8), "id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = leaf.where("home").select("cell", F.col("block").alias("i"), every.alias("j"), "id", "vector", "n", F.lit(True).alias("asks"))
    has = leaf.select("cell", every.alias("i"), F.col("block").alias("j"), "id", "vector", "n", F.lit(False).alias("asks"))
    found = asks.unionByName(has).groupBy("cell", "i", "j").applyInArrow(lambda t: _cell_links(t, threshold), "a long, b long, links long")
    found = materialize(found, "vector-links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found, "a", "b").withColumnRenamed("node", "rep")
    classes = classes.join(links, "rep", "left").join(parts, "rep", "left")
    classes = classes.select("label", "vector", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = given.where(fit).join(classes, ["label", "vector"]).select("id", "n_links", "component_id")
    out = out.unionByName(given.where(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
