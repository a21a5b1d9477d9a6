"""A Merkle manifest of a dataset: a digest a row, a tree a source, a tree of the sources, and each row's proof.

Rows get their place among their source's by a sort that is dealt by range (`numbered`), so a source that holds a third of all
rows is spread like any other. From there a run is a number of places, and all work is within runs: at each level lag and lead
columns of fixed offsets, masked by the node's slot and the length of its run, hold a node's siblings, and the first child of a
run hashes its parent. Only digests are shuffled, never texts; a level has a sixteenth of the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.plans.shared import broadcast_if_small, materialize, numbered

#: Up to so many sources (some 30 bytes each) the table of sources is broadcast to their rows; beyond, Spark shuffles.
SMALL = 100_000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def row_digest(*fields: Column) -> Column:
    """SHA-256 of a row's fields: each its UTF-8 byte count, a colon and its text; `-` for null. Numbers are decimal."""
    told = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in told]), 256)


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """`nodes` (tree, pos, n, hash) with their run and the digests left and right of them in it, each in one text."""
    nodes = nodes.withColumn("run", F.floor(F.col("pos") / fan))
    w = Window.partitionBy("tree", "run").orderBy("pos")
    slot, length = F.col("pos") - F.col("run") * fan, F.least(F.lit(fan), F.col("n") - F.col("run") * fan)
    left = [F.when(slot >= d, F.lag("hash", d).over(w)) for d in range(fan - 1, 0, -1)]
    right = [F.when(slot + d < length, F.lead("hash", d).over(w)) for d in range(1, fan)]
    return nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right)})


def _parents(level: DataFrame, fan: int) -> DataFrame:
    """The level above one that has its siblings. A tree of one node is done: its node goes up as it is."""
    first = level.where(F.col("pos") == F.col("run") * fan)
    up = F.when(F.col("n") > 1, F.sha2(F.concat("hash", "right"), 256)).otherwise(F.col("hash"))
    return first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / fan).alias("n"), up.alias("hash"))


def _step() -> Column:
    """What a node adds to a proof: one pair of texts, or nothing if it is its tree's root."""
    return F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def _climb(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """The levels above `nodes`, with siblings, written, the last of one node a tree. The largest tree has `most` nodes."""
    levels = [with_siblings(nodes, fan)]
    while most > 1 or len(levels) == 1:
        levels.append(materialize(with_siblings(_parents(levels[-1], fan), fan), "level"))
        most = -(-most // fan)
    return levels[1:]


def _paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, run, path, and what `top` has): for the nodes below `levels`, the proof from their parent up. `top` (tree, path and
    more) begins where the trees end."""
    extra = [c for c in top.columns if c not in ("tree", "path")]
    up = levels[-1].select("tree", "pos").join(top, "tree").select("tree", F.col("pos").alias("run"), "path", *extra)
    for level in reversed(levels[:-1]):
        up = level.select("tree", "pos", "run", _step().alias("own")).join(up, ["tree", "run"]).select("tree", F.col("pos").alias("run"), F.concat("own", "path").alias("path"), *extra)
    return up


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, where: Column | None = None, fan: int = 16) -> DataFrame:
    """One row a document: id, source, leaf, presented (its leaf as it is checked), subroot, root, path (siblings left and right,
    level by level up to the root) and folded_root (the root worked out from `presented` and the siblings).

    `tampered`: columns that replace fields of the rows `where` before they are checked. Rows ascend by id in their source, null
    first, rows of one id by their leaf; equal rows are nodes of their own. Null is a source of its own, before all others.
    Null and empty fields differ. Columns that are not fields have no effect. An empty table gives an empty one.
    """
    leaf = row_digest(*[F.col(f) for f in fields])
    changed = row_digest(*[(tampered or {}).get(f, F.col(f)) for f in fields])
    presented = leaf if where is None else F.when(where, changed).otherwise(leaf)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf.alias("hash"), presented.alias("presented"))
    rows = numbered(rows, [F.asc_nulls_first("source"), F.asc_nulls_first("id"), "hash"], "place")
    sources = materialize(numbered(rows.groupBy("source").agg(F.min("place").alias("start"), F.count("*").alias("n")), ["start"], "tree"), "sources")
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    s, r = broadcast_if_small(sources, SMALL).alias("s"), rows.alias("r")
    rows = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.id", "r.source", "r.hash", "r.presented", "s.tree", "s.n", (F.col("r.place") - F.col("s.start")).alias("pos"))

    levels = _climb(rows, most, fan)
    subroots = levels[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "hash")
    above = _climb(subroots, n_sources, fan)
    top = above[-1].select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("hash").alias("root"))
    ends = with_siblings(subroots, fan).join(_paths(above, top), ["tree", "run"]).select(F.col("pos").alias("tree"), F.concat(_step(), "path").alias("path"), F.col("hash").alias("subroot"), "root")
    found = with_siblings(rows, fan).join(_paths(levels, materialize(ends, "ends")), ["tree", "run"])
    path = F.concat(_step(), "path")
    fold = F.aggregate(path, F.col("presented"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    return found.select(F.col("id").alias(id_col), "source", F.col("hash").alias("leaf"), "presented", "subroot", "root", path.alias("path"), fold.alias("folded_root"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a proof in their order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def lower_ascii(x: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(x, CAPITALS, CAPITALS.lower())
