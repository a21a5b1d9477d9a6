"""What a document's extractions find: lines of its text, columns of its words, its tables; and which of them counts.

Each branch gives the same columns. They are written once, together; the choice is an aggregate of that table, and the rows of
the chosen branch are read back from it by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.functions import vocabulary as V
from boardfoot.operators.layout import column_texts
from boardfoot.operators.lines import carry_species, parse_lists, scored_products, text_facts
from boardfoot.operators.scoring import dedupe_rows, parse_report, pick_strategy
from boardfoot.operators.tables import scored_rows
from boardfoot.plans.shared import materialize, once_each

SCHEMA = (
    ("upload_id", "long"), ("method", "string"), ("source_row", "int"), ("species", "string"), ("thickness", "string"), ("grade", "string"), ("quantity", "string"),
    ("quantity_numeric", "double"), ("description", "string"), ("length", "string"), ("surface", "string"), ("color", "string"), ("cut_type", "string"),
    ("treatment", "string"), ("price", "string"), ("product", "string"), ("product_normalized", "string"), ("raw_text", "string"), ("confidence", "double"), ("class", "string"),
)
# What is said of a file without rows, and of one all of whose rows are rejected.
NO_STRUCTURE = "Could not auto-parse structure. Try AI parsing."


def _branch(rows: DataFrame, method: str, *order: str) -> DataFrame:
    """Rows of one extraction in the common columns, numbered in `order` if they are not yet."""
    if "source_row" not in rows.columns:
        rows = rows.withColumn("source_row", F.row_number().over(Window.partitionBy("upload_id").orderBy(*order)) - 1)
    rows = rows.withColumn("method", F.lit(method))
    return rows.select(*[(F.col(k) if k in rows.columns else F.lit(None)).cast(kind).alias(k) for k, kind in SCHEMA])


def text_branch(lines: DataFrame) -> DataFrame:
    """Rows of text lines (upload_id, line_no, text)."""
    return _branch(parse_lists(lines).withColumn("raw_text", F.col("text")), "text")


def columns_branch(words: DataFrame) -> DataFrame:
    """Rows of words with places (upload_id, page, seq, x0, top, text), column by column; files of one column have none."""
    kept = once_each(column_texts(words), ["text"], text_facts).where(F.col("header").isNotNull() | F.col("likely"))
    rows = carry_species(kept.repartition("upload_id"), "y", by=("upload_id", "col")).where(F.col("header").isNull())
    return _branch(scored_products(rows, kept).withColumn("raw_text", F.col("text")), "columns", "y", "col")


def tables_branch(grid: DataFrame) -> DataFrame:
    """Rows of table cells (upload_id, table_no, row, col, value)."""
    return _branch(scored_rows(grid), "table", "table_no", "row", "part")


def extractions(lines: DataFrame, words: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """The rows of all branches, with method; written, since what follows reads them twice."""
    found = text_branch(lines)
    if words is not None:
        found = found.unionByName(columns_branch(words))
    if grid is not None:
        found = found.unionByName(tables_branch(grid))
    return materialize(found, "extractions")


def chosen_rows(found: DataFrame) -> DataFrame:
    """The rows of each file's best branch (`pick_strategy`)."""
    return found.join(pick_strategy(found).select("upload_id", "method"), ["upload_id", "method"], "left_semi")


def combine_accepted(rows: DataFrame) -> DataFrame:
    """Rows that are accepted or for review, without doubles; of doubles an accepted one stays before one for review."""
    kept = rows.where(F.col("confidence") >= V.REVIEW)
    return dedupe_rows(kept) if "id" in rows.columns else dedupe_rows(kept.withColumn("id", F.col("source_row"))).drop("id")


def ingest_files(lines: DataFrame, words: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Scored rows of each file's best extraction, without rejects and doubles."""
    return combine_accepted(chosen_rows(extractions(lines, words, grid)))


def upload_report(uploads: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Per upload (id) what came of it: status, method, row_count, confidence (mean, to 3 places), error, warnings and parsed_at.

    `found` are all extracted rows with their method. An upload without a branch that has enough rows failed, as has one all of
    whose rows are rejected; only the former has an error text, and its method is that of the last branch tried.
    """
    best = chosen_rows(found)
    kept = combine_accepted(best).groupBy("upload_id").agg(F.count("*").alias("row_count"), F.round(F.avg(F.col("confidence").cast("decimal(10,3)")), 3).cast("double").alias("confidence"))
    per = parse_report(best).select("upload_id", "warnings").join(best.groupBy("upload_id").agg(F.min("method").alias("method")), "upload_id").join(kept, "upload_id", "left")
    j = uploads.join(per, uploads.id == per.upload_id, "left")
    parsed = F.coalesce(F.col("row_count") > 0, F.lit(False))
    error = F.when(F.col("method").isNull(), F.lit(NO_STRUCTURE))
    return j.select(
        "id", F.when(parsed, "parsed").otherwise("failed").alias("status"), F.coalesce("method", F.lit("text")).alias("method"), F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), error.alias("error"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.when(parsed, now).alias("parsed_at"),
    )
