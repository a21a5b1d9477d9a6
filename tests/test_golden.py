"""Rows worked out by hand (FIXTURES.md, part 3)."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from boardfoot.functions import normalize as N
from boardfoot.functions.stemming import porter_stem
from boardfoot.operators import cleaning, layout, lines, replies, scoring, search, sheets
from boardfoot.sources import csv_lists
from boardfoot.streaming import jobs

GOLDEN = json.loads((Path(__file__).parent / "golden" / "lines.json").read_text())


def test_product_lines(spark):
    df = spark.createDataFrame([(i, g["text"], g["species"]) for i, g in enumerate(GOLDEN)], "i int, text string, species string")
    rows = lines.parse_product_line(df)
    score = scoring.row_score({k: F.col(k) for k in (*lines.PARTS, "species")} | {"raw_text": F.col("text")})
    got = {r["i"]: r for r in rows.withColumn("score", score).withColumn("class", scoring.classify(F.col("score"))).collect()}
    for i, g in enumerate(GOLDEN):
        for k, v in g.items():
            assert got[i][k] == v, (g["text"], k)


@pytest.mark.parametrize("function, pairs", [
    (N.normalize_thickness, [('1"', "4/4"), ("1 inch", "4/4"), ("10/4 rgh", "10/4"), ("odd", "ODD"), ("", None), (None, None)]),
    (N.normalize_grade, [("1c s1f&btr", "#1C S1F & Better"), ("SEL & BTR", "Select & Better"), ("weird grade", "weird grade"), ("", None)]),
    (N.normalize_species, [("SAP GUM:", "Sap Gum"), ("Walnut - Steamed", "Walnut"), ("red oak x", "Oak"), ("washed maple", "Ash"), ("mystery wood", "Mystery Wood"), ("o'neil-q", "O'Neil-Q"), ("  ", None)]),
])
def test_normalizers(spark, function, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, x string")
    got = {r["i"]: r["y"] for r in df.select("i", function(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]


def test_quantities(spark):
    cases = [("4,300'", (4300.0, "4300")), ("call", (None, "CALL")), ("n/a", (None, "n/a")), ("", (None, None))]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string")
    got = {r["i"]: tuple(r["q"]) for r in df.select("i", N.normalize_quantity(F.col("x")).alias("q")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_headers_carry_down_inside_their_file(spark):
    rows = [(1, 0, "CHERRY"), (1, 1, "4,300' 4/4 #1C"), (2, 0, "T/L 4/4 FAS/SEL"), (1, 2, "Walnut:   Ash"), (1, 3, "T/L 8/4 FAS")]
    got = lines.parse_lists(spark.createDataFrame(rows, "upload_id long, line_no long, text string")).collect()
    assert {(r["upload_id"], r["line_no"]): r["species"] for r in got} == {(1, 1): "Cherry", (2, 0): None, (1, 3): "Walnut"}


def test_column_boundaries(spark):
    words = [(1, 0, i, float(x), 12.0 * i, "w") for i, x in enumerate((0, 31, 60, 120))]
    df = layout.word_lines(spark.createDataFrame(words, "upload_id long, page int, seq int, x0 double, top double, text string"))
    assert layout.column_boundaries(df).first()["bounds"] == [0.0, 60.0, 120.0]


def test_rate_limit(spark):
    want = [(0, 1, 0), (10, 1, 0), (20, 1, 0), (30, 1, 0), (40, 1, 0), (50, 0, 250), (290, 0, 10), (301, 1, 0), (311, 1, 0)]
    df = spark.createDataFrame([(i, "a", float(t), 1) for i, (t, _, _) in enumerate(want)], "id long, ip string, t double, failed int")
    got = {r["id"]: (r["allowed"], r["wait"]) for r in jobs.rate_limit(df).collect()}
    assert [got[i] for i in range(len(want))] == [(a, w) for _, a, w in want]


def test_bm25(spark):
    corpus = [(1, "4/4 red oak", "FAS"), (2, "red oaks plain", "x"), (3, "maple hard", "red oak oak oak"), (4, "44 ash", "z"), (5, "pine #1 common", "c"), (6, "elm", "1c")]
    products = spark.createDataFrame([(1, *r) for r in corpus], "group_id long, id long, a string, b string")
    postings = search.build_postings(products, ("a", "b"))
    terms = spark.createDataFrame([(1, 1, 0, "red oak"), (2, 1, 0, "oak"), (3, 1, 0, "4/4"), (4, 1, 0, "1c")], "query_id long, group_id long, term_no int, term string")
    got = {(r["query_id"], r["id"]): r["tf"] for r in search.term_postings(terms, postings).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 1): 1, (2, 2): 1, (2, 3): 3, (3, 4): 1, (4, 6): 1}
    queries = spark.createDataFrame([(1, 1, "elm")], "query_id long, group_id long, query string")
    scores = {r["id"]: r["score"] for r in search.bm25_search(queries, products, ("a", "b")).collect()}
    assert set(scores) == {6} and scores[6] == pytest.approx(1.6333843229066138)


def test_ratio():
    import pandas as pd

    assert search._ratios(pd.Series(["red oak"]), pd.Series(["oak red"])).iloc[0] == 0.6
    assert search._ratios(pd.Series(["rd ok"]), pd.Series(["oak red"])).iloc[0] < 0.6


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "electrical": "electr", "adjustment": "adjust", "controll": "control", "oaks": "oak"}
    assert {w: porter_stem(w) for w in pairs} == pairs


def test_replies_are_repaired(spark):
    body = '{"mill_name": "A", "products": [{"species": "oak", "thickness": "4/4", "grade": "fas", "raw_text": "oak 4/4 fas"}%s]}'
    texts = [body % "", "x\n```json\n" + body % "" + "\n```", "Sure {" + (body % ",")[1:] + " bye", "nothing"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "upload_id int, reply string")
    got = replies.explode_replies(replies.parse_replies(df)).collect()
    assert sorted((r["upload_id"], r["species"], r["grade"], r["class"]) for r in got) == [(i, "Oak", "FAS", "accept") for i in range(3)]


def test_csv_field(spark):
    df = spark.createDataFrame([("Wood Type",), ("QTY (bf)",), ("Product Desc",), ("other",)], "h string")
    assert [r[0] for r in df.select(sheets.csv_field(F.col("h"))).collect()] == ["species", "quantity", "product", None]


def test_mill_from_filename(spark):
    df = spark.createDataFrame([("OakRidge Stock List 1-2-2024.pdf",), ("abcdef0123456789abcdef.xlsx",), ("Hill_Mill_20240102.csv",)], "f string")
    assert [r[0] for r in df.select(cleaning.mill_from_filename(F.col("f"))).collect()] == ["Oak Ridge", None, "Hill Mill"]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Species,Thickness,Grade,"Qty (BF)",Product\r\nCherry,4/4,FAS,"1,200",\r\n\r\nAsh,8/4,#1C,call,"8/4 Ash, kiln dried"\r\n')
    cells = csv_lists.read_csv_cells(spark, str(tmp_path))
    got = {r["source_row"]: r for r in csv_lists.csv_rows(cells).collect()}
    assert {k: (r["species"], r["thickness"], r["quantity"], r["quantity_numeric"], r["product"]) for k, r in got.items()} == {
        0: ("Cherry", "4/4", "1,200 BF", 1200.0, "4/4 FAS"),
        1: ("Ash", "8/4", "call", None, "8/4 Ash, kiln dried"),
    }
    tables = spark.createDataFrame([("a", (tmp_path / "a.csv").read_text())], "file string, value string")
    assert csv_lists.list_cells(tables).drop("file").exceptAll(cells.drop("file")).count() == 0


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    """Breaks and quotes inside cells, blank lines between records and inside a cell, in files read in pieces of a few lines."""
    rows = [(f"4/4 {k}", 'said ""x"",\n\n' + "note " * (k % 5) + "\nend") for k in range(40)]
    text = "Product,Species\n" + "\n \n".join(f'{p},"{s}"' for p, s in rows) + "\n"
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text('Species\n"Ash\r\nOak"\nElm')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "64b")
        cells = csv_lists.read_csv_cells(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r["file"][-5:], r["source_row"], r["header"]): r["value"] for r in cells}
    want = {("a.csv", k, h): v for k, (p, s) in enumerate(rows) for h, v in (("Product", p), ("Species", s.replace('""', '"')))}
    assert got == want | {("b.csv", 0, "Species"): "Ash\nOak", ("b.csv", 1, "Species"): "Elm"}


def test_sheet_mill_info(spark):
    """A two-column sheet tells its mill in column H only; another one above its header."""
    two = [(r, c, v, None) for r, c, v in ((1, 1, "Stock of the week"), (1, 8, " "), (2, 8, "Brown and Sons"), (3, 8, "Brown Hardwood"), (4, 8, "ph 555-123"), (5, 8, "a@mill.example.com"), (9, 8, "z@late.example.com"), (10, 1, "white ash 1@2 lumber"), (3, 9, "x"), (3, 14, "y"))]
    two += [(r, 7, str(r), float(r)) for r in range(9, 21)]
    one = [(1, 1, "Springfield Lumber Co.", None), (2, 1, "sales@mill.example.com", None), (2, 2, "Springfield, PA 12345", None), (3, 1, "Species", None), (3, 2, "Grade", None), (4, 8, "b@late.example.com", None)]
    df = spark.createDataFrame([(1, *r) for r in two] + [(2, *r) for r in one], "upload_id long, row int, col int, value string, num_value double")
    got = {r["upload_id"]: tuple(r)[1:] for r in sheets.sheet_mill_info(df).collect()}
    assert got == {1: ("Brown and Sons", "a@mill.example.com", "ph 555-123", None), 2: ("Springfield Lumber Co.", "sales@mill.example.com", None, "Springfield, PA 12345")}
