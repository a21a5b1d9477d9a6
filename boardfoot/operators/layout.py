"""Words with places on a page (upload_id, page, seq, x0, top, text) to columns of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardfoot.functions.normalize import normalize_species
from boardfoot.operators.lines import carry_species, header_text, is_species_header
from boardfoot.plans.shared import materialize


def word_lines(words: DataFrame, height: float = 6.0, page: float = 10_000.0) -> DataFrame:
    """Words with the line they stand on; pages follow each other."""
    return words.withColumn("y", F.rint((F.col("top") + F.col("page") * page) / height) * height)


def column_boundaries(lines: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """(upload_id, bounds): where columns begin, from the first word of each line; closer than 1.5 tolerances is one column."""
    first = lines.groupBy("upload_id", "y").agg(F.min("x0").alias("x"))
    xs = first.groupBy("upload_id").agg(F.array_sort(F.collect_set(F.rint(F.col("x") / tolerance) * tolerance)).alias("xs"))
    far = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > tolerance * 1.5), F.array_append(acc, x)).otherwise(acc)
    return xs.select("upload_id", F.aggregate("xs", F.array().cast("array<double>"), far).alias("bounds"))


def words_to_columns(words: DataFrame, least: int = 0) -> DataFrame:
    """(upload_id, y, col, text): the words of each line in the column whose midpoint they come before, joined from left to right;
    of files with `least` columns or more."""
    lines = word_lines(words)
    bounds = column_boundaries(lines)
    j = lines.join(bounds.where(F.size("bounds") >= least) if least else bounds, "upload_id")
    mids = F.zip_with(F.slice("bounds", F.lit(1), F.size("bounds") - 1), F.slice("bounds", F.lit(2), F.size("bounds") - 1), lambda a, b: (a + b) / 2)
    col = F.when(F.size("bounds") > 1, F.size(F.filter(mids, lambda m: m <= F.col("x0")))).otherwise(0)
    per = j.withColumn("col", col).groupBy("upload_id", "y", "col").agg(F.sort_array(F.collect_list(F.struct("x0", "seq", "text"))).alias("w"))
    return per.select("upload_id", "y", "col", F.array_join(F.col("w.text"), " ").alias("text"))


def column_texts(words: DataFrame) -> DataFrame:
    """The texts of files of several columns, written: what follows reads them again."""
    return materialize(words_to_columns(words, least=2), "column-texts")


def carry_column_species(columns: DataFrame) -> DataFrame:
    """Column texts with the species last named above in the same column; the naming texts themselves go."""
    head = F.when(is_species_header(F.col("text")), normalize_species(header_text(F.col("text"))))
    return carry_species(columns.withColumn("header", head), "y", by=("upload_id", "col")).where("header is null").drop("header")
