"""Queries take every upload and every row of it, whatever its number."""

import pytest
from pyspark.sql import functions as F

from boardfoot import queries as Q

ROWS = 60


@pytest.fixture(scope="module")
def t(spark):
    """One upload of many rows, its number not 1 modulo 10 or 50."""
    n = F.col("id").cast("int")
    cols = {"upload_id": F.lit(12).cast("long"), "source_row": n, "species": F.lit("Cherry"), "thickness": F.lit("4/4"), "grade": F.lit("FAS"), "color": F.lit("Red"), "product": F.lit("4/4 Cherry FAS"), "quantity": F.concat(n, F.lit("00")), "quantity_numeric": n * 100.0}
    tables = {"fx_products": spark.range(1, ROWS + 1).withColumns(cols)}
    tables["fx_lines"] = spark.createDataFrame([(12, 0, "CHERRY"), (12, 1, "T/L 4/4 FAS")], "upload_id long, line_no long, text string")
    return tables.__getitem__


@pytest.mark.parametrize(
    "query, value, want",
    [
        (Q.x20_explode_llm_rows, "count(*)", ROWS),
        (Q.a14_column_boundaries, "count(*)", 2),  # a row a boundary
        (Q.w6_words_to_columns, "max(y)", 12.0 * (ROWS // 2)),
        (Q.w2_carry_species_columns, "max(y)", 12.0 * (ROWS // 2)),
        (Q.a16_first_numeric_cell, "count(*)", ROWS),
        (Q.x14_table_rows, "count(*)", ROWS),
        (Q.w8_multi_species_grid, "count(DISTINCT part)", ROWS),
        (Q.w3_two_column_rows, "max(row)", ROWS + 8),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_takes_all_rows(t, query, value, want):
    assert query(t).agg(F.expr(value)).first()[0] == want


def test_sheets_are_dealt_once(spark):
    """Products are read and dealt once for all cells, headers and rows of their sheets."""
    df = Q.QUERIES["x14_table_rows"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.count("FileScan") == 1
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
