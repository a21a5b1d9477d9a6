"""Mix sources to target weights by entropy balancing (DataFrame functions only).

Each document gets a rate between 0 and `cap` copies. Rates maximise a weighted entropy under one token constraint a
source. The dual has one multiplier a source and gives ``rate = cap * sigmoid(lam * (1 + size / scale))``: documents are
tilted exponentially by their size. Newton steps on the dual run on a table of (source, size) classes, whose rows are
counts: all documents of one size in one source share a rate, so nothing larger than that table is shuffled, and a
source that holds a third of all rows costs no more than any other.

Rates become whole copies per class by systematic rounding down the sizes, and a few passes of exact correction.
Copies are dealt to the documents of a class by the hash of their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.plans.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take `weights` in turn and share ``total`` times all words. A target stops at
    `cap` times its source; the excess is shared again by weight. The level at which this ends is the largest of the
    levels that arise when sources are capped one by one in the order of cap / weight. One row a source passes one task.
    """
    row = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (row % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("full") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"capped": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    s = s.withColumns({"all_words": F.sum("source_size").over(whole), "all_weight": F.sum("weight").over(whole)})
    s = s.withColumn("level", (F.col("all_words") * total - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    s = s.withColumn("level", F.max("level").over(whole))
    return s.select("source", "source_size", F.least("full", F.col("weight") * F.col("level")).alias("target"))


def _rate(cap: float) -> Column:
    x = 1 + F.col("size") / F.col("scale")
    return F.when(F.col("lam").isNull(), F.lit(float(cap))).otherwise(cap / (1 + F.exp(-F.col("lam") * x)))


def _newton(classes: DataFrame, targets: DataFrame, cap: float, tolerance: float, max_steps: int) -> DataFrame:
    """(source, target, scale, lam): the dual's multipliers; lam is null where the target is all that the cap lets through."""
    scale = classes.groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = targets.join(scale, targets.source.eqNullSafe(scale.source)).select(targets.source, "target", "scale", "source_size")
    saturated = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    state = state.select("source", "target", "scale", F.when(~saturated, F.lit(0.0)).alias("lam"), F.lit(-80.0).alias("lo"), F.lit(80.0).alias("hi"))
    state = materialize(state, "dual")
    for _ in range(max_steps):
        at = classes.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).where("s.lam is not null")
        r = _rate(cap)
        got = F.sum(F.col("n") * F.col("size") * r)
        slope = F.sum(F.col("n") * F.col("size") * (1 + F.col("size") / F.col("scale")) * r * (1 - r / cap))
        moved = at.groupBy("s.source").agg(*[F.first(f"s.{c}").alias(c) for c in ("target", "scale", "lam", "lo", "hi")], got.alias("got"), slope.alias("slope"))
        lo = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("got") < F.col("target"), F.col("hi")).otherwise(F.col("lam"))
        moved = moved.withColumns({"lo": lo, "hi": hi, "miss": F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))})
        step = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        lam = F.when(F.col("miss") <= tolerance, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = materialize(moved.withColumn("lam", lam), "dual-step")
        done = state.where("lam is null").unionByName(moved.drop("got", "slope", "miss"))
        worst = moved.agg(F.max("miss")).first()[0]
        state = done
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "target", "scale", "lam")


def _class_copies(classes: DataFrame, dual: DataFrame, cap: float, passes: int) -> DataFrame:
    """(source, size, n, copies): whole copies of each class, so that each source's words come near its target."""
    c = classes.alias("c").join(dual.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "size", "n", "target", (F.col("n") * _rate(cap)).alias("share"))
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.col("share") - F.floor("share")).over(down)
    c = c.withColumns({"run": run, "part": F.col("share") - F.floor("share")})
    extra = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("part") + 0.5)
    most = F.col("n") * int(cap)
    c = c.select("source", "size", "n", "target", F.least(F.floor("share") + extra, most).cast("long").alias("copies"))
    for _ in range(passes):
        c = materialize(c, "copies")
        miss = c.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss"))
        j = c.alias("c").join(miss.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source"))).select("c.*", "m.miss")
        room = F.when(F.col("miss") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        use = (room > 0) & (F.col("size") <= F.abs("miss"))
        best = j.groupBy("source").agg(F.max(F.when(use, F.col("size"))).alias("best"))
        j = j.alias("j").join(best.alias("b"), F.col("j.source").eqNullSafe(F.col("b.source"))).select("j.*", "b.best")
        move = F.least(F.floor(F.abs("miss") / F.col("size")), room) * F.signum("miss")
        c = j.select("source", "size", "n", "target", (F.col("copies") + F.when(F.col("size") == F.col("best"), move).otherwise(0)).cast("long").alias("copies"))
    return materialize(c.drop("target"), "copies")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), total: float = 1.5, cap: float = 2.0, tolerance: float = 1e-9, max_steps: int = 60, passes: int = 3, deal: int = 200, row_col: str | None = None) -> DataFrame:
    """One row a document: id, size, source_size, target and taken (words the mix takes, repeats counted).

    `taken` is a whole number of copies times `size`, at most `cap` copies. Null or blank texts have size 0 and nothing is
    taken; a null source is a source; repeated ids are documents of their own; an empty table gives an empty table; other
    columns are not looked at, but for `row_col`: it tells rows apart, ends ties, and is returned too. The same rows give the same result whatever their order or partitions.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("id"), (F.col(row_col) if row_col else F.lit(None).cast("long")).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    classes = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    targets = materialize(source_targets(classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, total, cap), "targets")
    wordy = classes.where("size > 0")
    dual = _newton(wordy, targets, cap, tolerance, max_steps)
    copies = _class_copies(wordy, dual, cap, passes)
    # A class with many documents is ranked in buckets of about `deal`, each behind the count of those before it.
    plan = copies.select("source", "size", F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra"), F.ceil(F.col("n") / deal).cast("long").alias("buckets"))
    d = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")), "left")
    d = d.select("d.*", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("buckets", F.lit(1)).alias("buckets"))
    even = d.where("extra = 0").select("id", "row", "source", "size", "base")
    dealt = d.where("extra > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("buckets")))
    counts = dealt.groupBy("source", "size", "bucket").agg(F.count("*").alias("k"))
    behind = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("behind", F.coalesce(F.sum("k").over(behind), F.lit(0))).drop("k")
    same = F.col("t.source").eqNullSafe(F.col("k.source")) & (F.col("t.size") == F.col("k.size")) & (F.col("t.bucket") == F.col("k.bucket"))
    dealt = dealt.alias("t").join(counts.alias("k"), same).select("t.*", "behind").repartition("source", "size", "bucket")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64(F.lit(12), "id"), "id", "row")) + F.col("behind")
    dealt = dealt.select("id", "row", "source", "size", (F.col("base") + (rank <= F.col("extra")).cast("long")).alias("base"))
    out = even.unionByName(dealt).alias("o").join(targets.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
    return out.select(F.col("o.id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("base") * F.col("size")).cast("long").alias("taken"), *([F.col("row").alias(row_col)] if row_col else []))
