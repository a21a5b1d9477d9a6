"""Scores of lines and rows, and what follows from them. Terms are added in a fixed order, so sums are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.functions import vocabulary as V
from boardfoot.functions.text import filled, strip
from boardfoot.operators.cleaning import has_species_word


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def candidate_score(text: Column) -> Column:
    """How much a line looks like stock, 0 to 1."""
    t = strip(text)
    score = F.lit(0.0)
    for weight, patterns in V.CANDIDATE_SIGNALS:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | (has_species_word(t) if p == V.SPECIES_WORD else t.rlike(p))
        score = score + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    score = score + F.when((F.length(t) < 8) & (score <= 0), F.lit(-0.20)).otherwise(F.lit(0.0))
    return F.when(F.length(t) >= 3, clamp(score)).otherwise(F.lit(0.0))


def is_candidate(text: Column, least: float = 0.20) -> Column:
    return candidate_score(text) >= least


def row_score(c: dict[str, Column]) -> Column:
    """The confidence in a parsed row, to 3 places. Keys of `c` are its fields; those left out are null."""
    null = F.lit(None).cast("string")
    has = lambda k: filled(c.get(k, null)).isNotNull()
    add = lambda test, w: F.when(test, F.lit(w)).otherwise(F.lit(0.0))
    quantity = F.upper(strip(c.get("quantity", null)))
    number = c.get("quantity_numeric", F.lit(None).cast("double"))
    raw = F.coalesce(c.get("raw_text", null), F.lit(""))
    score = add(has("species"), 0.25)
    score = score + F.when(c["thickness"].rlike(r"^\d{1,2}/\d$"), F.lit(0.30)).when(has("thickness"), F.lit(0.15)).otherwise(F.lit(0.0))
    score = score + add(has("grade"), 0.20)
    score = score + F.when(number > 0, F.lit(0.15)).when(quantity.isin("T/L", "TL", "CALL") | quantity.rlike(r"\d"), F.lit(0.10)).otherwise(F.lit(0.0))
    for key, w in (("price", 0.05), ("length", 0.05), ("color", 0.03), ("surface", 0.03), ("cut_type", 0.03)):
        score = score + add(has(key), w)
    for w, p in V.ROW_PENALTIES:
        score = score + add(raw.rlike(p), w)
    bare = ~has("thickness") & ~has("grade")
    score = score + add(~has("species") & bare, -0.30) + add(bare, -0.15)
    rest = strip(F.regexp_replace(raw, r"""[\d,]+['"]?\s*""", ""))
    score = score + add(bare & (raw != "") & (F.length(rest) < 15) & ~raw.rlike(V.FRACTION), -0.20)
    return F.round(clamp(score), 3)


#: The note of a row for review, and the warnings of a file's report.
REVIEW_NOTE = " [needs review]"
REJECTED = " rows rejected as non-inventory (contact info, addresses, junk text, etc.)"
FLAGGED = " rows flagged for manual review (low confidence)"


def classify(confidence: Column) -> Column:
    return F.when(confidence >= V.ACCEPT, "accept").when(confidence >= V.REVIEW, "review").otherwise("reject")


def split_by_class(rows: DataFrame, include_review: bool = True) -> DataFrame:
    """Rows with their class; without review, rows for review are rejected, with it their notes say so."""
    kind = classify(F.col("confidence"))
    if not include_review:
        return rows.withColumn("class", F.when(kind == "review", "reject").otherwise(kind))
    old = F.col("notes") if "notes" in rows.columns else F.lit(None).cast("string")
    notes = F.when(kind == "review", F.concat(F.coalesce(old, F.lit("")), F.lit(REVIEW_NOTE))).otherwise(old)
    return rows.withColumn("class", kind).withColumn("notes", notes)


def warnings(c: dict[str, Column]) -> Column:
    """What is missing or odd in a row, as texts."""
    missing = lambda k: filled(c[k]).isNull()
    tests = [
        (missing("species"), F.lit("Missing species")), (missing("thickness"), F.lit("Missing thickness")), (missing("grade"), F.lit("Missing grade")),
        (missing("quantity") & (F.coalesce(c["quantity_numeric"], F.lit(0.0)) == 0), F.lit("Missing quantity")),
        (F.length(c["grade"]) > 40, F.lit("Grade field suspiciously long")), (c["species"].rlike(r"\d"), F.lit("Species contains digits")),
        (~missing("thickness") & ~c["thickness"].rlike(r"^\d{1,2}/\d{1,2}$"), F.concat(F.lit("Non-standard thickness format: "), c["thickness"])),
    ]
    return F.filter(F.array(*[F.when(t, w) for t, w in tests]), lambda w: w.isNotNull())


def dedupe_rows(rows: DataFrame) -> DataFrame:
    """Of a file's rows with equal fields the one of highest confidence; on ties accepted before review, then the first."""
    low = lambda k: F.coalesce(F.lower(k), F.lit(""))
    key = ["upload_id", low("species"), low("thickness"), low("grade"), "quantity_numeric", low("color")]
    rank = F.when(F.col("confidence") >= V.ACCEPT, 0).otherwise(1)
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), rank, "source_row", "id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def parse_report(rows: DataFrame) -> DataFrame:
    """Per file: raw rows, those of each class, and warnings on rejected rows and rows for review."""
    kind = classify(F.col("confidence"))
    per = rows.groupBy("upload_id").agg(F.count("*").alias("raw"), *[F.count_if(kind == k).alias(k) for k in ("accept", "review", "reject")])
    said = [F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(text))) for k, text in (("reject", REJECTED), ("review", FLAGGED))]
    return per.withColumn("warnings", F.array_compact(F.array(*said)))


#: Rows that a strategy needs before it counts, in the order of preference on ties.
STRATEGIES = {"table": 5, "columns": 5, "text": 3}


def pick_strategy(rows: DataFrame) -> DataFrame:
    """Per file the extraction (method) with most good rows among those with enough rows."""
    per = rows.groupBy("upload_id", "method").agg(F.count("*").alias("rows"), F.count_if(F.col("confidence") >= V.REVIEW).alias("good"))
    order = F.create_map(*[F.lit(x) for i, m in enumerate(STRATEGIES) for x in (m, i)])
    least = F.create_map(*[F.lit(x) for m, n in STRATEGIES.items() for x in (m, n)])
    per = per.where(F.col("rows") >= F.try_element_at(least, F.col("method")))
    w = Window.partitionBy("upload_id").orderBy(F.desc("good"), F.try_element_at(order, F.col("method")))
    return per.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("upload_id", "method", "rows", "good")
