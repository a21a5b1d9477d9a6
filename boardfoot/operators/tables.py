"""Tables found in documents, as cells (upload_id, table_no, row, col, value) with row 0 the header, to product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.functions.normalize import normalize_grade, normalize_species, normalize_thickness, product_string
from boardfoot.functions.text import filled, found, let, strip
from boardfoot.operators.cleaning import is_noise
from boardfoot.operators.lines import is_species_header
from boardfoot.operators.scoring import classify, row_score
from boardfoot.plans.shared import materialize, once_each

# Words of header cells and the field they name, the first that fits; and of the fields of a group of columns.
FIELDS = (("thickness", "thick|size"), ("grade", "grade"), ("description", "desc|color|surface|finish"), ("quantity", "bft|bf|qty|quantity|board feet"), ("length", "length|board"), ("price", "price"))
GROUP_FIELDS = (("grade", "grade"), ("description", "desc"), ("quantity", "bft|bf|qty|quantity"), ("length", "length|board"))
# The columns of fields that no header cell names; a header of so many cells stands for several species, each of
# which has the columns up to so many behind its own.
DEFAULTS = {"thickness": 0, "grade": 1, "description": 2, "quantity": 3, "length": 4}
WIDE, REACH = 10, 7
NAMES = tuple(k for k, _ in FIELDS)
KEY = ["upload_id", "table_no"]


def _field(low: Column, fields) -> Column:
    return F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in fields])


def table_maps(grid: DataFrame, least: int = WIDE) -> DataFrame:
    """(upload_id, table_no, part, species, and for each field the column that holds it): one row a table, or one a species for
    tables that are `least` cells wide. Of several columns of a field the last counts.

    What a header cell says is worked out once a text, of which there are few; a table's header is then one array.
    """
    head = materialize(grid.where("row = 0").select(*KEY, "col", strip(F.coalesce("value", F.lit(""))).alias("value")), "table-heads")
    x, low = F.col("value"), F.lower("value")
    named = F.coalesce(found(x, r"^([A-Za-z][A-Za-z\s]+?)[\s:]+(?:Grade|grade|GRADE)", 1), F.when(is_species_header(x), F.regexp_replace(x, ":+$", "")))
    group = strip(found(x, r"^([A-Za-z ]+?)[\s:]+(?:Grade|grade)", 1))
    names = lambda n: F.when(n.isNotNull(), F.struct(normalize_species(n).alias("species")))
    head = once_each(head, ["value"], {"field": F.when(low != "", _field(low, FIELDS)), "named": names(named), "group_field": _field(low, GROUP_FIELDS), "group": names(group)})
    per = head.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("col", "field", "named", "group_field", "group"))).alias("cells"))
    width = F.array_max(F.col("cells.col")) + 1
    last = lambda cells, test: F.array_max(F.filter(cells, test)["col"])

    at = lambda k: F.coalesce(last(F.col("cells"), lambda c: c["field"] == k), F.when(width > DEFAULTS[k], F.lit(DEFAULTS[k])) if k in DEFAULTS else F.lit(None)).cast("int").alias(f"c_{k}")
    first = F.get(F.filter("cells", lambda c: c["named"].isNotNull()), F.lit(0))["named"]["species"]
    one = F.array(F.struct(F.lit(0).alias("part"), first.alias("species"), *[at(k) for k in NAMES]))

    reached = lambda g: F.filter("cells", lambda c: c["group_field"].isNotNull() & (c["col"] > g["col"]) & (c["col"] <= g["col"] + REACH))
    of_group = dict(GROUP_FIELDS)

    def span(g: Column, near: Column) -> Column:
        held = lambda k: last(near, lambda c: c["group_field"] == k) if k in of_group else g["col"] if k == "thickness" else F.lit(None)
        return F.struct(g["col"].alias("part"), g["group"]["species"].alias("species"), *[held(k).cast("int").alias(f"c_{k}") for k in NAMES])

    many = F.transform(F.filter("cells", lambda c: c["group"].isNotNull()), lambda g: let(reached(g), lambda near: span(g, near)))
    return per.select(*KEY, F.inline(F.when(width < least, one).otherwise(many)))


def quantity_of(text: Column) -> tuple[Column, Column]:
    """(number, text) of a table's quantity: truckloads and calls by name, else the digits in it as board feet, else as it is."""
    named = F.when(text.rlike(r"(?i)^\d?T/?L$"), "T/L").when(text.rlike("(?i)^call"), "Call")
    number = F.when(named.isNull(), F.regexp_replace(text, r"[^\d.]", "").try_cast("double"))
    feet = F.concat(F.format_number(number.cast("long"), 0), F.lit(" BF"))
    return number, F.coalesce(named, feet, filled(text))


def grid_rows(grid: DataFrame, least: int = WIDE) -> DataFrame:
    """Rows of tables, one a data row and species: upload_id, table_no, row, part and the fields. Rows without a thickness, grade,
    description or quantity, rows that repeat the header and rows that are noise as a whole are left out.

    The cells of a row are one array, as wide as the table; a wide table's rows meet each of its species' columns. Rows are written
    as they stand in the table, and what their texts are normally spelled like is worked out once a text.
    """
    data = grid.where("row > 0")
    cell = F.struct("col", "value")
    rows = data.groupBy(*KEY, "row").agg(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), cell))).alias("cells"))
    rows = rows.select(*KEY, "row", F.col("cells.col").alias("cols"), F.col("cells.value").alias("values")).withColumn("raw_text", F.array_join("values", " | ")).where(~is_noise(F.col("raw_text")))
    get = lambda k: filled(strip(F.get("values", F.array_position("cols", F.col(f"c_{k}")).cast("int") - 1))).alias(k)
    rows = rows.join(table_maps(grid, least), KEY).select(*KEY, "row", "part", "species", *[get(k) for k in NAMES], "raw_text")
    rows = materialize(rows.where(F.coalesce("thickness", "grade", "description", "quantity").isNotNull()), "table-texts")
    again = F.coalesce(F.col("thickness").rlike("(?i)(grade|species|description|thick|qty)"), F.lit(False))
    rows = once_each(rows, ["thickness"], {"_again": again, "_thickness": normalize_thickness(found(F.col("thickness"), r"^(\d+/\d+)", 1))}).where(~F.col("_again"))
    number, quantity = quantity_of(F.col("quantity"))
    rows = once_each(rows, ["quantity"], {"quantity_numeric": number, "_quantity": quantity})
    rows = once_each(rows, ["grade"], {"_grade": normalize_grade(F.col("grade"))})
    rows = rows.withColumns({k: F.col(f"_{k}") for k in ("thickness", "quantity", "grade")})
    rows = rows.withColumn("product", filled(F.concat_ws(" ", "thickness", "grade", "description"))).where("product is not null")
    fields = {k: F.col(k) for k in ("species", "thickness", "grade", "length")}
    rows = rows.withColumn("product_normalized", product_string(fields, F.col("product")))
    return rows.select(*KEY, "row", "part", "species", *NAMES, "quantity_numeric", "product", "product_normalized", "raw_text")


def scored_rows(grid: DataFrame) -> DataFrame:
    """`grid_rows` with confidence and class. Rows are scored once a different row; of the species the score asks only whether there
    is one, so a row has both scores."""
    rows = materialize(grid_rows(grid), "table-rows")
    fields = ["thickness", "grade", "quantity", "quantity_numeric", "length", "price", "raw_text"]
    said = {k: F.col(k) for k in fields}
    rows = once_each(rows, fields, {"_named": row_score(said | {"species": F.lit("x")}), "_bare": row_score(said)})
    rows = rows.withColumn("confidence", F.when(filled(F.col("species")).isNotNull(), F.col("_named")).otherwise(F.col("_bare")))
    return rows.withColumn("class", classify(F.col("confidence"))).drop("_named", "_bare")
