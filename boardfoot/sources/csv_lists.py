"""Stock lists in CSV files, one list a file. A line break inside quotes is part of its cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardfoot.functions.normalize import normalize_grade, normalize_species, normalize_thickness
from boardfoot.functions.text import filled, strip
from boardfoot.operators.cleaning import is_noise
from boardfoot.operators.sheets import csv_field
from boardfoot.plans.shared import broadcast_if_small, materialize, once_each

#: Pieces of files (some 100 bytes each) up to which their sums are broadcast to the lines.
PIECES = 200_000


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the files at `path`. Files are read line by line, so one that is larger than a task is read by several; lines
    are written once with the piece of the file they come from and their place in it."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("piece"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    return record_cells(csv_records(materialize(lines, "csv-lines")))


def list_cells(lists: DataFrame) -> DataFrame:
    """The same of lists (file, value) that stand in a table, each whole in one row."""
    lines = lists.select("file", F.lit(0).alias("piece"), F.posexplode(F.split("value", r"\r?\n")).alias("place", "line"))
    return record_cells(csv_records(lines))


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, record, text) from lines (file, piece, place, line): lines up to one that leaves no quote open are one record,
    counted from 0; blank ones are none.

    Whether a quote is open before a line is the parity of all quotes before it in its file: those before it in its piece, which
    is as much as a task reads, and those of the pieces before, which are sums by piece. Records are numbered in the same way. The
    sums are a row a piece, and what is in a piece is dealt and sorted once. A record is blank if the line it begins with is.
    """
    line = F.regexp_replace("line", r"\r$", "")
    lines = lines.withColumns({"line": line, "quotes": F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))})
    inside = Window.partitionBy("file", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before(value: Column, of: DataFrame, name: str) -> DataFrame:
        """(file, piece) with the sum of `value` over the pieces before, as `name`."""
        sums = materialize(of.groupBy("file", "piece").agg(F.sum(value).alias("total")), "pieces")
        earlier = F.sum("total").over(Window.partitionBy("file").orderBy("piece")) - F.col("total")
        return broadcast_if_small(sums.select("file", "piece", earlier.alias(name)), PIECES)

    lines = lines.withColumn("open", F.sum("quotes").over(inside) - F.col("quotes"))
    lines = lines.join(before(F.col("quotes"), lines, "open_before"), ["file", "piece"]).withColumn("even", (F.col("open") + F.col("open_before")) % 2 == 0)
    lines = lines.where(~F.col("even") | (strip(F.col("line")) != "")).withColumn("starts", F.when(F.col("even"), 1).otherwise(0))
    starts = before(F.col("starts"), lines, "starts_before")
    lines = lines.withColumn("record", F.sum("starts").over(inside)).join(starts, ["file", "piece"]).withColumn("record", F.col("record") + F.col("starts_before") - 1)
    parts = F.sort_array(F.collect_list(F.struct("piece", "place", "line")))
    return lines.groupBy("file", "record").agg(F.array_join(parts["line"], "\n").alias("text"))


def record_cells(records: DataFrame) -> DataFrame:
    """(file, source_row, col, header, value) of every filled cell; rows are counted from 0 below the header, without blank ones.
    Quoted commas and line breaks stay in their cell."""
    cells = lambda text: F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r""",((?:"[^"]*+(?:""[^"]*+)*+"|[^,]*))"""), 1)
    bare = lambda x: F.replace(F.regexp_replace(strip(x), '^"|"$', ""), F.lit('""'), F.lit('"'))
    records = materialize(records, "csv-records")
    heads = records.where("record = 0").select("file", F.transform(cells(F.col("text")), bare).alias("heads"))
    body = records.where("record > 0").select("file", (F.col("record") - 1).alias("source_row"), F.posexplode(cells(F.col("text"))).alias("col", "value"))
    long = body.join(broadcast_if_small(materialize(heads, "csv-heads"), PIECES), "file")
    return long.select("file", "source_row", "col", F.try_element_at("heads", F.col("col") + 1).alias("header"), filled(bare(F.col("value"))).alias("value")).where("value is not null")


def csv_rows(cells: DataFrame) -> DataFrame:
    """Product rows of CSV cells: fields by their header, later columns first, noise left out. What a cell says is worked out once
    a different cell, and what a field is spelled like once a different text."""
    c = once_each(cells, ["header", "value"], {"field": F.when(~is_noise(F.col("value")), csv_field(F.col("header")))}).where("field is not null")
    pick = lambda f: F.max_by("value", F.when(F.col("field") == f, F.col("col"))).alias(f)
    wide = c.groupBy("file", "source_row").agg(*[pick(f) for f in ("species", "thickness", "grade", "quantity", "product", "price", "length")])
    number = F.replace(F.col("quantity"), F.lit(","), F.lit("")).try_cast("double")
    feet = F.concat(F.format_number(number.cast("long"), 0), F.lit(" BF"))
    out = materialize(wide, "csv-rows")
    for k, normal in (("species", normalize_species), ("thickness", normalize_thickness), ("grade", normalize_grade)):
        out = once_each(out, [k], {f"{k}_": normal(F.col(k))})
    out = once_each(out, ["quantity"], {"quantity_": F.coalesce(feet, "quantity"), "quantity_numeric": number})
    out = out.select("file", "source_row", *[F.col(f"{k}_").alias(k) for k in ("species", "thickness", "grade", "quantity")], "quantity_numeric", "product", "price", "length")
    return out.withColumn("product", F.coalesce("product", filled(F.concat_ws(" ", "thickness", "grade")))).where("product is not null")
