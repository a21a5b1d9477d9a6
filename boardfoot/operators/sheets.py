"""Worksheet cells (upload_id, row, col, value, num_value) to product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.functions.normalize import normalize_grade, normalize_species, normalize_thickness
from boardfoot.functions.text import filled, found, strip, title
from boardfoot.operators.cleaning import has_species_word, is_noise
from boardfoot.operators.lines import carry_species

# Words of header cells and the field they name, the first that fits; parts of a product cell.
HEADERS = (("species", "species|wood"), ("thickness", "thick"), ("grade", "grade"), ("quantity", "qty|quantity|bf|bft|board feet"), ("product", "desc|product"), ("price", "price"), ("length", "length"))
HEADER_MARK = "species|product|description|grade|thick"
WIDTH = r"""(\d+["']?\s*&?\s*[Ww]|[\d.]+"\s*-\s*[\d."]+)"""
SURFACE = r"(?i)\b(15/16|13/16|S2S|S4S|RGH|Rough)\b"
COLOR = r"(?i)\b(White|Brown|Red|Natural|Sap|Heart|Calico|Wht)\b"
TREATMENT = r"(?i)\b(Wormy|Ambrosia|Stained|Steamed|Rustic|PG)\b"
MILL = r"(?i)(hardwood|lumber|sawmill|wood|forest|valley|timber)"
MILL_H = "(?i)(hardwood|lumber|sawmill|wood|forest)"


def is_species_cell(x: Column) -> Column:
    return has_species_word(x) & ~x.rlike(r"\d/\d")


def detect_layout(cells: DataFrame) -> DataFrame:
    """(upload_id, layout): two_column if columns A, G, I and N are used at the top and G holds numbers below row 9."""
    top = F.col("row") <= 20
    last = cells.groupBy("upload_id").agg(F.max("row").alias("last"))
    per = cells.join(last, "upload_id").groupBy("upload_id").agg(
        F.array_sort(F.collect_set(F.when(top & F.col("value").isNotNull() & F.col("col").isin(1, 7, 9, 14), F.col("col")))).alias("used"),
        F.count_if((F.col("col") == 7) & (F.col("row") >= 9) & (F.col("row") < F.least(F.lit(20), F.col("last"))) & F.col("num_value").isNotNull()).alias("numbers"),
    )
    return per.select("upload_id", F.when((F.size("used") == 4) & (F.col("numbers") >= 3), "two_column").otherwise("standard_table").alias("layout"))


def find_header_row(cells: DataFrame) -> DataFrame:
    """(upload_id, header_row): the first of rows 1 to 14 with two header words or more."""
    marked = cells.where(F.col("row").between(1, 14) & F.lower(strip(F.col("value"))).rlike(HEADER_MARK))
    return marked.groupBy("upload_id", "row").agg(F.count("*").alias("k")).where("k >= 2").groupBy("upload_id").agg(F.min("row").alias("header_row"))


def header_fields(cells: DataFrame) -> DataFrame:
    """(upload_id, header_row, col, field): which field each column of a headed sheet holds."""
    low = F.lower(strip(F.col("value")))
    field = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in HEADERS])
    at = cells.join(find_header_row(cells), "upload_id").where("row = header_row")
    return at.select("upload_id", "header_row", "col", field.alias("field")).where("field is not null")


def table_rows(cells: DataFrame) -> DataFrame:
    """Rows of headed sheets with a column a field; noise cells are left out. A row of a species alone heads those below.

    A row's cells are one array, and its sheet's header is found among the sheet's rows, so cells are read once and are dealt by
    sheet at most.
    """
    v = F.col("value")
    marked = F.coalesce(F.lower(strip(v)).rlike(HEADER_MARK), F.lit(False))
    rows = cells.select("upload_id", "row", F.struct("col", "value", "num_value", is_noise(v).alias("noise"), marked.alias("marked")).alias("cell"))
    rows = rows.groupBy("upload_id", "row").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    low = lambda c: F.lower(strip(c["value"]))
    named = F.transform("cells", lambda c: F.struct(c["col"].alias("col"), F.coalesce(*[F.when(low(c).rlike(p), F.lit(k)) for k, p in HEADERS]).alias("field")))
    head = F.when(F.col("row").between(1, 14) & (F.size(F.filter("cells", lambda c: c["marked"])) >= 2), F.struct("row", named.alias("fields")))
    rows = rows.withColumn("head", F.min(head).over(Window.partitionBy("upload_id"))).where(F.col("row") > F.col("head.row"))
    at = lambda k: F.filter("head.fields", lambda f: f["field"] == k)["col"]
    first = lambda k: F.get(F.filter("cells", lambda c: ~c["noise"] & F.array_contains(at(k), c["col"])), F.lit(0))
    wide = rows.select("upload_id", "row", *[first(k)["value"].alias(k) for k, _ in HEADERS], first("quantity")["num_value"].alias("quantity_numeric"))
    wide = wide.where(F.coalesce(*[F.col(k) for k, _ in HEADERS]).isNotNull())
    alone = F.col("own").isNotNull() & F.coalesce("thickness", "grade", "quantity", "product").isNull()
    wide = wide.withColumnRenamed("species", "own").withColumn("header", F.when(alone, normalize_species(F.col("own"))))
    wide = carry_species(wide, "row")
    text = F.col("product")
    thickness = F.coalesce(F.col("thickness"), found(text, r"^(\d+/\d+)\s+", 1))
    grade = F.coalesce(F.col("grade"), F.regexp_replace(text, r"^\d+/\d+\s+", ""))
    feet = F.concat(F.format_number(F.col("quantity_numeric").cast("long"), 0), F.lit(" BF"))
    out = wide.where("header is null").select("upload_id", F.col("row").alias("source_row"), F.coalesce(normalize_species(F.col("own")), "species").alias("species"), normalize_thickness(thickness).alias("thickness"), normalize_grade(grade).alias("grade"), F.coalesce(feet, "quantity").alias("quantity"), "quantity_numeric", "price", "length", "product")
    return out.withColumn("product", F.coalesce("product", filled(F.concat_ws(" ", "thickness", "grade")))).where("product is not null")


def with_sheet_parts(df: DataFrame, text: str) -> DataFrame:
    """`df` with width, surface, color and treatment of a product cell's column `text`, and as grade what is left."""
    x = F.col(text)
    df = df.withColumns({"width": strip(found(x, WIDTH, 1)), "_t": strip(F.regexp_replace(x, f"(?s){WIDTH}.*$", ""))})
    t = F.col("_t")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, SURFACE, ""), COLOR, ""), r"""\d+["']?\s*&?\s*[Ww]""", "")
    grade = normalize_grade(F.regexp_replace(rest, r"\s+", " "))
    color = F.replace(title(found(t, COLOR, 1)), F.lit("Wht"), F.lit("White"))
    return df.withColumns({"surface": found(t, SURFACE, 1), "color": color, "treatment": found(t, TREATMENT, 1), "grade": grade}).drop("_t")


def parse_sheet_row(df: DataFrame, product: str, quantity: str, number: str) -> DataFrame:
    """`df` with the fields of a product cell and its quantity cell; rows that are noise or too short go."""
    text = strip(F.col(product))
    df = df.where((F.length(text) >= 3) & ~is_noise(text))
    feet = F.concat(F.format_number(F.col(number).cast("long"), 0), F.lit(" BF"))
    rest = F.when(text.rlike(r"^\d+/\d+\s+"), strip(F.regexp_replace(text, r"^\d+/\d+\s+", ""))).otherwise(text)
    df = df.withColumns({"thickness": normalize_thickness(found(text, r"^(\d+/\d+)\s+", 1)), "quantity": F.coalesce(feet, strip(F.col(quantity))), "quantity_numeric": F.col(number), "description": rest})
    return with_sheet_parts(df, "description")


def two_column_rows(cells: DataFrame) -> DataFrame:
    """Rows of two-column sheets from row 9: products in A and I, quantities in G and N, species carried down each side."""
    side = F.when(F.col("col").isin(1, 7), "left").when(F.col("col").isin(9, 14), "right")
    c = cells.where(F.col("row") >= 9).withColumn("side", side).where("side is not null")
    first = F.col("col").isin(1, 9)
    wide = c.groupBy("upload_id", "side", "row").agg(F.max(F.when(first, F.col("value"))).alias("product"), F.max(F.when(~first, F.col("value"))).alias("quantity_text"), F.max(F.when(~first, F.col("num_value"))).alias("number"))
    wide = wide.where(filled(F.col("product")).isNotNull()).withColumn("header", F.when(is_species_cell(F.col("product")), normalize_species(F.col("product"))))
    rows = carry_species(wide, "row", by=("upload_id", "side")).where("header is null")
    return parse_sheet_row(rows, "product", "quantity_text", "number").drop("header", "quantity_text", "number")


def first_numeric_cell(cells: DataFrame) -> DataFrame:
    """(upload_id, row, product, quantity): products of column A of header-less sheets with the first number > 0 of columns 2 to 9."""
    number = F.when(F.col("col").between(2, 9) & (F.col("num_value") > 0), F.col("col"))
    per = cells.groupBy("upload_id", "row").agg(F.max(F.when(F.col("col") == 1, F.col("value"))).alias("product"), F.min_by("num_value", number).alias("quantity"))
    return per.where(filled(F.col("product")).isNotNull())


def sheet_mill_info(cells: DataFrame, head: int = 12) -> DataFrame:
    """(upload_id, mill_name, email, phone, location) of a sheet's head: the first name, the last of the others.

    Two-column sheets name their mill in column H of rows 1 to 8 and tell no location; their other cells are products. Other
    sheets tell all in the cells above the header.
    """
    v, at = F.col("value"), F.struct("row", "col")
    last = lambda p: F.max_by(v, F.when(v.rlike(p), at))
    layout = detect_layout(cells)
    marked = cells.where(filled(strip(v)).isNotNull()).join(layout, "upload_id").join(find_header_row(cells), "upload_id", "left")
    two = F.col("layout") == "two_column"
    top = marked.where(F.when(two, (F.col("col") == 8) & (F.col("row") <= 8)).otherwise(F.col("row") <= F.coalesce("header_row", F.lit(head))))
    named = F.when(two, v.rlike(MILL_H) | (F.col("row") <= 2)).otherwise(v.rlike(MILL) | ((F.col("row") == 1) & (F.length(v) > 4)))
    phone = F.max_by(v, F.when(v.rlike(r"\d{3}[-.\s]\d{4}") | (two & v.rlike(r"\d{3}[-.\s]\d{3}")), at))
    place = F.max_by(v, F.when(~two & v.rlike(r"[A-Z]{2}\s+\d{5}"), at))
    return top.groupBy("upload_id").agg(F.min_by(v, F.when(named, at)).alias("mill_name"), last("@").alias("email"), phone.alias("phone"), place.alias("location"))


def csv_field(header: Column) -> Column:
    """The field that a CSV header names, by the first word that fits."""
    low = F.lower(header)
    return F.coalesce(*[F.when(low.rlike(p.replace("|bft|board feet", "")), F.lit(k)) for k, p in HEADERS])
