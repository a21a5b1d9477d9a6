"""Tables in the shared folder and places in an order."""

from pyspark.sql import functions as F

from boardfoot.plans.shared import numbered, once_each
from boardfoot.sources import csv_lists


def test_places_follow_the_order_without_gaps_or_a_single_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 11).alias("g"))
    got = numbered(df, [F.asc_nulls_first("g"), F.desc("k")], "place", first=10)
    rows = [(r["g"], r["k"]) for r in sorted(got.collect(), key=lambda r: r["place"])]
    assert [r["place"] for r in got.orderBy("place").collect()] == list(range(10, 5010))
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_places_of_no_rows(spark):
    assert numbered(spark.range(0), ["id"], "place").collect() == []


def test_values_are_worked_out_once_a_distinct_key(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"), F.lit("x").alias("t"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(k):
        seen.add(1)
        return f"k{k}"

    want = {(i, f"k{i % 4 or None}") for i in range(1000)}
    assert {(r["id"], r["v"]) for r in once_each(df, ["k", "t"], {"v": slow("k")}).collect()} == want
    assert seen.value == 4
    assert {(r["id"], r["v"]) for r in once_each(df, ["k", "t"], {"v": slow("k")}, max_rows=3).collect()} == want
    assert seen.value == 1004


def test_rows_of_a_csv_file_are_not_one_task(spark):
    """Blank lines between records and inside quotes, over pieces; neither numbering nor headers deal a file's cells to one task."""
    text = ["", "Species,Grade", "", 'Ash,"a', "", 'b"', "  ", "Elm,FAS"]
    lines = spark.createDataFrame([("f", i // 4, i, x) for i, x in enumerate(text)], "file string, piece int, place long, line string")
    records = csv_lists.csv_records(lines)
    assert {(r["record"], r["text"]) for r in records.collect()} == {(0, "Species,Grade"), (1, 'Ash,"a\n\nb"'), (2, "Elm,FAS")}
    cells = csv_lists.record_cells(records)
    assert {(r["source_row"], r["header"], r["value"]) for r in cells.collect()} == {(0, "Species", "Ash"), (0, "Grade", "a\n\nb"), (1, "Species", "Elm"), (1, "Grade", "FAS")}
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan
