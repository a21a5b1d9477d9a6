"""Files whose table, columns or text holds most, worked out by hand; wide tables; what is read of each source, and how often."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boardfoot.operators import extract, tables
from boardfoot.plans import shared

GOLDEN = json.loads((Path(__file__).parent / "golden" / "extract.json").read_text())
FILES = dict(enumerate(GOLDEN))
GRID = "upload_id long, table_no int, row int, col int, value string"


@pytest.fixture(scope="module")
def files(spark):
    cases = [(i, GOLDEN[k]) for i, k in FILES.items()]
    lines = spark.createDataFrame([(i, n, x) for i, c in cases for n, x in enumerate(c["lines"])], "upload_id long, line_no long, text string")
    words = spark.createDataFrame([(i, 0, n, float(x), float(y), w) for i, c in cases for n, (x, y, w) in enumerate(c["words"])], "upload_id long, page int, seq int, x0 double, top double, text string")
    grid = spark.createDataFrame([(i, 0, r, n, v) for i, c in cases for r, row in enumerate(c["grid"]) for n, v in enumerate(row)], GRID)
    return lines.repartition(3), words.repartition(3), grid.repartition(3)


def test_best_extraction_of_each_file(files):
    got = {}
    for r in extract.ingest_files(*files).collect():
        got.setdefault(FILES[r["upload_id"]], []).append(r)
    for name, case in GOLDEN.items():
        rows = sorted(got.get(name, []), key=lambda r: r["source_row"])
        assert [{k: r[k] for k in w} for r, w in zip(rows, case["rows"])] == case["rows"] and len(rows) == len(case["rows"]), name
        assert {r["method"] for r in rows} <= {name}


def test_report_of_each_file(spark, files):
    uploads = spark.createDataFrame([(i,) for i in FILES], "id long")
    report = extract.upload_report(uploads, extract.extractions(*files), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    got = {FILES[r["id"]]: r for r in report.collect()}
    for name, case in GOLDEN.items():
        assert {k: got[name][k] for k in case["report"]} == case["report"]
        assert (got[name]["parsed_at"] is None) == (case["report"]["status"] == "failed")


def test_extractions_are_written_once(files, monkeypatch):
    written = []
    monkeypatch.setattr(extract, "materialize", lambda df, name: written.append(name) or shared.materialize(df, name))
    rows = extract.ingest_files(*files)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert written == ["extractions"] and plan.count("extractions-") == 2 and "LocalTableScan" not in plan


def test_wide_tables(spark):
    """Each species' columns reach seven cells; a header in lower case or with other signs begins none; of two columns of a field the
    last counts, also one of the next species."""
    head = ["RED OAK: Grade", "Grade", "Desc", "BFT", "Length", "", "", "", "ash grade", "Grade", "Qty", "Sap Gum - x: Grade"]
    rows = [head, ["4/4", "FAS", "White", "1,200'", "8'", None, None, None, "5/4", "#1C", "T/L", "9/4"], [None, None, None, None, None, None, None, None, "6/4", None, "call", None]]
    grid = spark.createDataFrame([(1, 0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], GRID)
    got = sorted((r["row"], r["part"], r["species"], r["thickness"], r["grade"], r["description"], r["quantity"], r["length"]) for r in tables.grid_rows(grid).collect())
    assert got == [(1, 0, "Red Oak", "4/4", "FAS", "White", "1,200 BF", "8'"), (1, 8, "Ash", "5/4", "9/4", None, "T/L", None), (2, 8, "Ash", "6/4", None, None, "Call", None)]


def test_no_files(spark):
    empty = spark.createDataFrame([], GRID)
    assert tables.grid_rows(empty).collect() == []


def test_each_text_is_parsed_once(spark, monkeypatch):
    from boardfoot.operators import lines

    parsed, real = [], lines.parse_product_line
    monkeypatch.setattr(lines, "parse_product_line", lambda df, text="text": parsed.append(df.count()) or real(df, text))
    texts = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(x).alias("text")) for i, x in enumerate(("CHERRY", "4/4 FAS 300'", "8/4 #1C 500'", "call us"))]))
    got = lines.parse_lists(spark.range(300).select(F.col("id").alias("upload_id"), texts.alias("l")).select("upload_id", "l.*"))
    rows = got.groupBy("species", "thickness", "source_row", "class").count().collect()
    assert sorted(map(tuple, rows)) == [("Cherry", "4/4", 0, "accept", 300), ("Cherry", "8/4", 1, "accept", 300)]
    assert sum(parsed) <= 3  # the different texts that are likely or headers, not 600 lines


def test_tables_do_not_meet_by_name(spark):
    """A table's header is one array: tables are dealt by table only, never by what their headers say."""
    grid = spark.createDataFrame([(1, 0, 0, 0, "Thickness"), (1, 0, 0, 1, "Ash Grade"), (1, 0, 1, 0, "4/4"), (1, 0, 1, 1, "FAS")], GRID)
    maps = tables.table_maps(grid)
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert [(r["part"], r["species"], r["c_thickness"], r["c_grade"], r["c_quantity"]) for r in maps.collect()] == [(0, "Ash", 0, 1, None)]
