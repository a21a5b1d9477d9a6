"""One query an operator, over the driver's tables or views of them, and the same in SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardfoot import sql_text as S
from boardfoot.functions import normalize as N
from boardfoot.functions import vocabulary as V
from boardfoot.operators import catalog, cleaning, extract, index, layout, lines, replies, scoring, search, sheets, store, tables, usage, workspaces
from boardfoot.sources.csv_lists import csv_rows, read_csv_cells
from boardfoot.sources.views import view, with_views
from boardfoot.plans.shared import materialize, shared_dir
from boardfoot.streaming import ingest, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = dt.datetime(2024, 1, 31)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def query(views: str = "", sql: str | None = None):
    """Register a query under its function's name. The function takes a lookup of tables and views by name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql is not None:
            ORACLES[f.__name__] = with_views(views, sql) if views else sql
        return f

    return register


# --- Sources, sinks and cleaning -------------------------------------------------------------------------------

DOC_LINES = "SELECT doc_id, CAST(u.i - 1 AS BIGINT) AS line_no, " + S.strip("u.line") + " AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) u WHERE " + S.strip("u.line") + " <> ''"


@query(sql=DOC_LINES)
def io2_document_lines(t):
    return cleaning.document_lines(t("documents"), "doc_id")


@query("fx_uploads", "SELECT id, CASE WHEN lower(regexp_extract(original_filename, '\\.([^.]+)$', 1)) = 'pdf' THEN 'pdf' WHEN lower(regexp_extract(original_filename, '\\.([^.]+)$', 1)) IN ('xlsx', 'xls') THEN 'excel' WHEN lower(regexp_extract(original_filename, '\\.([^.]+)$', 1)) = 'csv' THEN 'csv' ELSE 'unknown' END AS file_type FROM fx_uploads")
def io3_route_by_type(t):
    return t("fx_uploads").select("id", cleaning.file_type(F.col("original_filename")).alias("file_type"))


@query(sql="SELECT doc_id, CAST(length(" + S.strip("text") + ") < 50 AS INT) AS scanned FROM documents")
def io4_route_scanned(t):
    return t("documents").select("doc_id", cleaning.needs_ocr(F.col("text")).cast("int").alias("scanned"))


@query("fx_products fx_uploads fx_mills", "SELECT p.id, p.upload_id, u.group_id, m.id AS mill_id, p.mill_name FROM fx_products p JOIN fx_uploads u ON u.id = p.upload_id LEFT JOIN fx_mills m ON m.group_id = u.group_id AND m.name = p.mill_name")
def io5_append_products(t):
    parsed = t("fx_products").select("id", "upload_id", F.when(F.col("mill_name") != "Unknown Mill", F.col("mill_name")).alias("mill_name"))
    return catalog.append_products(parsed, t("fx_uploads"), t("fx_mills")).select("id", "upload_id", "group_id", "mill_id", "mill_name")


@query("fx_products", "SELECT id, upload_id, mill_name FROM fx_products WHERE upload_id % 7 <> 0 UNION ALL SELECT p.id + 1000000000, p.upload_id, coalesce(o.n, 'Unknown Mill') FROM fx_products p LEFT JOIN (SELECT upload_id, min(mill_name) AS n FROM fx_products WHERE mill_name <> 'Unknown Mill' GROUP BY 1) o USING (upload_id) WHERE p.upload_id % 7 = 0")
def io6_replace_upload_rows(t):
    p = t("fx_products").select("id", "upload_id", "mill_name")
    fresh = p.where("upload_id % 7 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "upload_id", F.lit(None).cast("string").alias("mill_name"))
    return catalog.replace_upload_rows(p, fresh)


@query("fx_uploads fx_products", "SELECT u.id, CASE WHEN n > 0 THEN 'parsed' ELSE 'failed' END AS status, coalesce(n, 0) AS row_count, coalesce(c, 0e0) AS parsing_confidence FROM fx_uploads u LEFT JOIN (SELECT upload_id, count(*) AS n, round(sum(CAST(id % 101 AS BIGINT)) / 100e0 / count(*), 3) AS c FROM fx_products GROUP BY 1) p ON p.upload_id = u.id")
def io7_upload_summary(t):
    return catalog.upload_summary(t("fx_uploads"), t("fx_products"))


@query("fx_lines", "SELECT upload_id, line_no, CAST(" + S.any_match("text", V.JUNK) + " AS INT) AS junk FROM fx_lines")
def f2_is_junk_line(t):
    return t("fx_lines").select("upload_id", "line_no", cleaning.is_junk_line(F.col("text")).cast("int").alias("junk"))


@query("fx_lines", "SELECT upload_id, line_no, CAST(length(" + S.strip("text") + ") < 2 OR " + S.any_match(S.strip("text"), V.NOISE) + " AS INT) AS noise FROM fx_lines")
def f3_is_noise_text(t):
    return t("fx_lines").select("upload_id", "line_no", cleaning.is_noise(F.col("text")).cast("int").alias("noise"))


@query("fx_lines", "SELECT upload_id, line_no, text FROM fx_lines WHERE NOT " + S.any_match("text", V.JUNK) + " AND length(text) >= 4 AND NOT (line_no > 3 AND text = upper(text) AND NOT regexp_matches(text, '[0-9]') AND length(text) > 30 AND NOT " + S.has_species_word("text") + ")")
def f4_clean_lines(t):
    return cleaning.clean_lines(t("fx_lines")).select("upload_id", "line_no", "text")


@query("fx_lines", "SELECT upload_id, line_no, CAST(" + S.has_species_word("text") + " AS INT) AS found FROM fx_lines")
def f5_has_species_word(t):
    return t("fx_lines").select("upload_id", "line_no", cleaning.has_species_word(F.col("text")).cast("int").alias("found"))


@query("fx_lines", "SELECT upload_id, line_no, CAST(len(list_filter(p, lambda w: " + S.has_species_word("w") + ")) >= len(p) * 0.8e0 AS INT) AS all_species FROM (SELECT *, regexp_split_to_array(" + S.strip("text") + ", '\\s{2,}') AS p FROM fx_lines)")
def f6_is_all_species(t):
    return t("fx_lines").select("upload_id", "line_no", cleaning.is_all_species(F.col("text")).cast("int").alias("all_species"))


@query("fx_lines", "SELECT text, CAST(" + S.is_species_header("text") + " AS INT) AS header FROM (SELECT DISTINCT text FROM fx_lines)")
def f7_is_species_header(t):
    return t("fx_lines").select("text").distinct().select("text", lines.is_species_header(F.col("text")).cast("int").alias("header"))


@query("fx_lines", "SELECT upload_id, line_no, CAST(" + S.has_species_word("text") + " AND NOT regexp_matches(text, '[0-9]/[0-9]') AS INT) AS header FROM fx_lines")
def f8_is_species_header_cell(t):
    return t("fx_lines").select("upload_id", "line_no", sheets.is_species_cell(F.col("text")).cast("int").alias("header"))


@query("fx_lines", "SELECT upload_id, line_no, s >= 0.15e0 AS candidate FROM (SELECT upload_id, line_no, " + S.candidate_score("x") + " AS s FROM (SELECT upload_id, line_no, " + S.strip("text") + " AS x FROM fx_lines))")
def f9_is_candidate(t):
    return t("fx_lines").select("upload_id", "line_no", scoring.is_candidate(F.col("text"), 0.15).alias("candidate"))


@query("fx_products", "SELECT id, " + S.classify("confidence") + " AS class FROM fx_products")
def f10_classify_rows(t):
    return t("fx_products").select("id", scoring.classify(F.col("confidence")).alias("class"))


@query("fx_products", "SELECT id, CASE WHEN confidence >= 0.7e0 THEN 'accept' WHEN confidence >= 0.4e0 THEN 'review' ELSE 'reject' END AS class, CASE WHEN confidence >= 0.4e0 AND confidence < 0.7e0 THEN ' [needs review]' END AS notes FROM fx_products")
def f11_split_by_class(t):
    return scoring.split_by_class(t("fx_products").drop("notes")).select("id", "class", "notes")


@query("fx_products", "SELECT id, CASE WHEN confidence >= 0.7e0 THEN 'accept' ELSE 'reject' END AS class FROM fx_products")
def f11_split_without_review(t):
    return scoring.split_by_class(t("fx_products"), include_review=False).select("id", "class")


@query("fx_products", "SELECT id, array_to_string(list_filter([CASE WHEN species IS NULL THEN 'Missing species' END, CASE WHEN thickness IS NULL THEN 'Missing thickness' END, CASE WHEN grade IS NULL THEN 'Missing grade' END, CASE WHEN regexp_matches(species, '[0-9]') THEN 'Species contains digits' END, CASE WHEN NOT regexp_matches(thickness, '^[0-9]{1,2}/[0-9]{1,2}$') THEN concat('Non-standard thickness format: ', thickness) END], lambda w: w IS NOT NULL), '; ') AS warnings FROM fx_products")
def f12_validate_rows(t):
    p = t("fx_products")
    return p.select("id", F.array_join(scoring.warnings({k: F.col(k) for k in ("species", "thickness", "grade", "quantity", "quantity_numeric")}), "; ").alias("warnings"))


@query("fx_users", "SELECT id, email FROM fx_users WHERE contains(lower(email), 'user1') AND role = 'user' AND is_active = 1 AND is_suspended = 0")
def f13_filter_users(t):
    return usage.filter_users(t("fx_users"), "USER1", "user", "active").select("id", "email")


@query("fx_sessions fx_users", f"SELECT s.id, s.user_id FROM fx_sessions s JOIN fx_users u ON u.id = s.user_id AND u.is_active = 1 AND u.is_suspended = 0 WHERE s.expires_at > {NOW_SQL}")
def f14_live_sessions(t):
    return usage.live_sessions(t("fx_sessions"), t("fx_users"), now()).select("id", "user_id")


@query("fx_sessions", f"SELECT id FROM fx_sessions WHERE expires_at < {NOW_SQL}")
def f14_expired_sessions(t):
    return usage.expired_sessions(t("fx_sessions"), now()).select("id")


@query("fx_invitations", f"SELECT id, CASE WHEN status = 'pending' AND expires_at < {NOW_SQL} THEN 'expired' ELSE status END AS status FROM fx_invitations")
def f15_expire_invitations(t):
    return workspaces.expire_invitations(t("fx_invitations"), now()).select("id", "status")


@query("fx_products", "SELECT id, group_id, CAST(confidence < 0.5e0 AS INT) AS low, CAST(is_reviewed = 0 AS INT) AS unreviewed, CAST(is_flagged = 1 AS INT) AS flagged FROM fx_products WHERE confidence < 0.5e0 OR is_reviewed = 0 OR is_flagged = 1")
def f16_review_queue(t):
    return catalog.review_queue(t("fx_products"))


BAD_NAME = "len(list_filter(w, lambda x: list_contains([" + ", ".join(map(S.quote, V.SPECIES_WORDS)) + "], x))) >= len(w) * 0.7e0 AND len(w) >= 2"
MILL_NAMES = "SELECT DISTINCT text AS name FROM fx_lines"


@query("fx_lines", f"SELECT name, CAST(regexp_matches(n, '\\.(com|net|org|io)\\b') OR contains(n, '@') OR length(n) < 4 OR ({BAD_NAME}) OR regexp_matches(n, '\\b(email|phone|fax|http|www)\\b') OR name = '' AS INT) AS bad FROM (SELECT *, list_filter(regexp_split_to_array(n, '\\s+'), lambda x: x <> '') AS w FROM (SELECT name, lower({S.strip('name')}) AS n FROM ({MILL_NAMES})))")
def f17_is_bad_mill_name(t):
    return t("fx_lines").select(F.col("text").alias("name")).distinct().select("name", cleaning.is_bad_mill_name(F.col("name")).cast("int").alias("bad"))


@query("fx_lines", f"SELECT name, CAST(length(n) >= 3 AND NOT regexp_matches(n, '[@.](com|net|org|io)\\b') AND NOT regexp_matches(n, 'https?://') AS INT) AS good FROM (SELECT name, lower({S.strip('name')}) AS n FROM ({MILL_NAMES}))")
def f18_is_valid_mill_name(t):
    return t("fx_lines").select(F.col("text").alias("name")).distinct().select("name", cleaning.is_valid_mill_name(F.col("name")).cast("int").alias("good"))


@query("fx_products", "SELECT id, species, confidence FROM fx_products WHERE group_id = 3 AND contains(lower(species), 'oak') AND is_reviewed = 0 ORDER BY confidence DESC NULLS LAST, id LIMIT 50 OFFSET 10")
def f1_list_products(t):
    page, _ = catalog.list_products(t("fx_products"), group_id=3, species="oak", unreviewed=True, sort="confidence", descending=True, offset=10, limit=50)
    return page.select("id", "species", "confidence")


# --- Scalars -----------------------------------------------------------------------------------------------------


@query("fx_lines", "SELECT upload_id, line_no, " + S.candidate_score("x") + " AS score FROM (SELECT upload_id, line_no, " + S.strip("text") + " AS x FROM fx_lines)")
def x1_candidate_score(t):
    return t("fx_lines").select("upload_id", "line_no", scoring.candidate_score(F.col("text")).alias("score"))


@query("fx_products", "SELECT id, " + S.row_score("species", "thickness", "grade", "quantity", "quantity_numeric", "color", "product") + " AS score FROM fx_products")
def x2_row_score(t):
    fields = {k: F.col(k) for k in ("species", "thickness", "grade", "quantity", "quantity_numeric", "color")} | {"raw_text": F.col("product")}
    return t("fx_products").select("id", scoring.row_score(fields).alias("score"))


@query("fx_products_raw", "SELECT id, " + S.thickness("thickness_raw") + " AS thickness FROM fx_products_raw")
def x3_normalize_thickness(t):
    return t("fx_products_raw").select("id", N.normalize_thickness(F.col("thickness_raw")).alias("thickness"))


@query("fx_products_raw", "SELECT id, " + S.grade("grade_raw") + " AS grade FROM fx_products_raw")
def x4_normalize_grade(t):
    return t("fx_products_raw").select("id", N.normalize_grade(F.col("grade_raw")).alias("grade"))


SPECIES_SQL = "SELECT id, n.species FROM fx_products_raw JOIN (SELECT species_raw, " + S.species("species_raw") + " AS species FROM (SELECT DISTINCT species_raw FROM fx_products_raw)) n USING (species_raw)"


@query("fx_products_raw", SPECIES_SQL)
def x5_normalize_species(t):
    return N.with_species(t("fx_products_raw").select("id", "species_raw"), "species_raw", "species").select("id", "species")


@query("fx_lines", "SELECT upload_id, line_no, TRY_CAST(n AS DOUBLE) AS number, CASE WHEN TRY_CAST(n AS DOUBLE) IS NULL AND upper(x) IN ('CALL', 'T/L', 'TL') THEN upper(x) ELSE x END AS quantity FROM (SELECT *, " + S.find("x", "[0-9.]+") + " AS n FROM (SELECT upload_id, line_no, CASE WHEN text <> '' THEN " + S.replace(S.strip("text"), "[,']") + " END AS x FROM fx_lines))")
def x6_normalize_quantity(t):
    q = N.normalize_quantity(F.col("text"))
    return t("fx_lines").select("upload_id", "line_no", q["numeric"].alias("number"), q["text"].alias("quantity"))


@query("fx_products", "SELECT id, coalesce(nullif(concat_ws(' ', thickness, species, grade, color), ''), product) AS product FROM fx_products")
def x7_product_string(t):
    p = t("fx_products")
    return p.select("id", N.product_string({k: F.col(k) for k in ("thickness", "species", "grade", "color")}, F.col("product")).alias("product"))


@query("fx_lines", "SELECT upload_id, line_no, " + S.thickness("x") + " AS thickness FROM (SELECT upload_id, line_no, " + S.find("text", r"\b([0-9]{1,2}/[0-9])\b", 1) + " AS x FROM fx_lines)")
def x8_extract_thickness(t):
    return t("fx_lines").select("upload_id", "line_no", N.extract_thickness(F.col("text")).alias("thickness"))


@query("fx_lines", "SELECT upload_id, line_no, TRY_CAST(x AS DOUBLE) AS number, CASE WHEN TRY_CAST(x AS DOUBLE) IS NOT NULL THEN concat(x, ' BF') END AS quantity FROM (SELECT upload_id, line_no, replace(" + S.find("text", r"^([0-9,]+)'?\s", 1) + ", ',', '') AS x FROM fx_lines)")
def x9_extract_quantity(t):
    q = N.extract_quantity(F.col("text"))
    return t("fx_lines").select("upload_id", "line_no", q["numeric"].alias("number"), q["text"].alias("quantity"))


@query()
def x10_parse_product_line(t):
    return lines.parse_product_line(t("fx_lines").select("upload_id", "line_no", "text"))


LINE_A = "SELECT upload_id, line_no, TRY_CAST(replace(regexp_extract(text, {a}, 1), ',', '') AS DOUBLE) AS quantity_numeric, {th} AS thickness FROM fx_lines WHERE regexp_matches(text, {a}) AND NOT ({noise})"


@query("fx_lines", LINE_A.format(a=S.quote(V.LINE_A), th=S.thickness(f"regexp_extract(text, {S.quote(V.LINE_A)}, 2)"), noise=S.any_match(S.strip("text"), V.NOISE)))
def x10_format_a(t):
    return lines.parse_product_line(t("fx_lines").select("upload_id", "line_no", "text")).where("format = 'A'").select("upload_id", "line_no", "quantity_numeric", "thickness")


@query()
def x11_grade_parts(t):
    return lines.with_grade_parts(t("fx_lines").select("upload_id", "line_no", "text"), "text")


@query()
def x12_sheet_parts(t):
    return sheets.with_sheet_parts(t("fx_lines").select("upload_id", "line_no", "text"), "text")


def product_cells(t) -> DataFrame:
    """Products as worksheet cells: A species or product, G a quantity, I and N the same on the right."""
    p = t("fx_products")
    row = (F.col("source_row") + 8).cast("int")
    cell = lambda col, value, number: p.select("upload_id", row.alias("row"), F.lit(col).alias("col"), value.alias("value"), number.cast("double").alias("num_value"))
    none = F.lit(None)
    left = cell(1, F.when(F.col("source_row") % 4 == 1, F.col("species")).otherwise(F.col("product")), none)
    return left.unionByName(cell(7, F.col("quantity"), F.col("quantity_numeric"))).unionByName(cell(9, F.col("product"), none)).unionByName(cell(14, F.col("quantity"), F.col("quantity_numeric")))


CELLS_SQL = """, cells AS (SELECT upload_id, CAST(source_row + 8 AS INT) AS "row", c AS "col", CASE c WHEN 1 THEN CASE WHEN source_row % 4 = 1 THEN species ELSE product END WHEN 9 THEN product ELSE quantity END AS value, CASE WHEN c IN (7, 14) THEN quantity_numeric END AS num_value FROM fx_products, (VALUES (1), (7), (9), (14)) k(c)) """


@query()
def x13_parse_sheet_row(t):
    return sheets.parse_sheet_row(t("fx_products").select("id", "product", "quantity", "quantity_numeric"), "product", "quantity", "quantity_numeric")


@query()
def w3_two_column_rows(t):
    return sheets.two_column_rows(product_cells(t))


LAYOUT = """SELECT upload_id, CASE WHEN used = 4 AND numbers >= 3 THEN 'two_column' ELSE 'standard_table' END AS layout FROM (SELECT upload_id, count(DISTINCT "col") FILTER ("row" <= 20 AND value IS NOT NULL) AS used, count(*) FILTER ("col" = 7 AND "row" >= 9 AND "row" < least(20, last) AND num_value IS NOT NULL) AS numbers FROM (SELECT *, max("row") OVER (PARTITION BY upload_id) AS last FROM cells) GROUP BY upload_id)"""


@query("fx_products", CELLS_SQL + LAYOUT)
def a12_detect_layout(t):
    return sheets.detect_layout(product_cells(t))


@query("fx_products", CELLS_SQL + """SELECT upload_id, "row", max(value) FILTER ("col" = 1) AS product, arg_min(num_value, "col") FILTER ("col" BETWEEN 2 AND 9 AND num_value > 0) AS quantity FROM cells GROUP BY ALL HAVING max(value) FILTER ("col" = 1) <> ''""")
def a16_first_numeric_cell(t):
    return sheets.first_numeric_cell(product_cells(t))


def headed_cells(t) -> DataFrame:
    """Products as worksheets with a header in row 3 below the mill's name and address."""
    p = t("fx_products")
    cell = lambda r, c, v, n: F.struct(r.cast("int").alias("row"), F.lit(c).alias("col"), v.alias("value"), n.cast("double").alias("num_value"))
    none = F.lit(None)
    named = lambda r, c, v: cell(F.lit(r), c, F.lit(v), none)
    cols = ((1, "Species", "species"), (2, "Thickness", "thickness"), (3, "Grade", "grade"), (4, "Qty BF", "quantity"), (5, "Price", "color"))
    heads = [named(1, 1, "Springfield Lumber Co."), named(2, 1, "sales@mill.example.com"), named(2, 2, "Springfield, PA 12345"), *[named(3, i, h) for i, h, _ in cols]]
    body = [cell(F.col("source_row") + 3, i, F.col(c), F.col("quantity_numeric") if i == 4 else none) for i, _, c in cols]
    # Every upload has a first row, which brings the header along: products are read once.
    cells = F.array(*body)
    cells = F.when(F.col("source_row") == 1, F.concat(F.array(*heads), cells)).otherwise(cells)
    return p.select("upload_id", F.explode(cells).alias("c")).select("upload_id", "c.*").where("value is not null")


@query("fx_products", "SELECT DISTINCT upload_id, 3 AS header_row FROM fx_products")
def a13_find_header_row(t):
    return sheets.find_header_row(headed_cells(t))


@query("fx_products", "SELECT DISTINCT upload_id, 'Springfield Lumber Co.' AS mill_name, 'sales@mill.example.com' AS email, CAST(NULL AS VARCHAR) AS phone, 'Springfield, PA 12345' AS location FROM fx_products")
def a15_sheet_mill_info(t):
    return sheets.sheet_mill_info(headed_cells(t))


@query()
def x14_table_rows(t):
    return sheets.table_rows(headed_cells(t))


WIDE_ROWS = f"""SELECT upload_id, part, {S.species("CASE WHEN species IS NULL THEN NULL WHEN regexp_matches(species, '^[A-Za-z ]+:*$') THEN regexp_replace(species, ':+$', '') ELSE concat(species, ': Grade') END")} AS species, {S.thickness(S.find('thickness', '^[0-9]+/[0-9]+'))} AS thickness, {S.grade('grade')} AS grade, color AS description, TRY_CAST(quantity AS DOUBLE) AS quantity_numeric, concat(format('{{:,}}', CAST(quantity AS BIGINT)), ' BF') AS quantity
FROM (SELECT *, CASE WHEN max(source_row) OVER (PARTITION BY upload_id) > 1 THEN 8 * (source_row - 1) ELSE 0 END AS part, max(source_row) OVER (PARTITION BY upload_id) > 1 AS wide, string_agg(concat_ws(' | ', thickness, grade, color, quantity), ' | ' ORDER BY source_row) OVER (PARTITION BY upload_id) AS raw_text FROM fx_products) WHERE NOT {S.any_match('raw_text', V.NOISE)} AND (NOT wide OR regexp_matches(species, '^[A-Za-z ]+:*$')) AND concat_ws('', {S.find('thickness', '^[0-9]+/[0-9]+')}, grade, color) <> ''"""


@query("fx_products", WIDE_ROWS)
def w8_multi_species_grid(t):
    """Products as one wide table an upload, eight columns a product; uploads of one product have a narrow table."""
    p = t("fx_products")
    at = lambda k: ((F.col("source_row") - 1) * 8 + k).cast("int")
    cells = [(F.concat(F.coalesce("species", F.lit("")), F.lit(": Grade")), "thickness"), ("Grade", "grade"), ("Desc", "color"), ("Qty", "quantity"), ("Length", None), ("", None), ("", None), ("", None)]
    cell = lambda row, k, value: F.struct(F.lit(row).alias("row"), at(k).alias("col"), value.cast("string").alias("value"))
    named = [cell(0, k, F.lit(h) if isinstance(h, str) else h) for k, (h, _) in enumerate(cells)]
    held = [cell(1, k, F.col(c)) for k, (_, c) in enumerate(cells) if c is not None]
    grid = p.select("upload_id", F.lit(0).alias("table_no"), F.explode(F.array(*named, *held)).alias("c")).select("upload_id", "table_no", "c.*")
    return tables.grid_rows(grid).select("upload_id", F.col("part").cast("long").alias("part"), "species", "thickness", "grade", "description", "quantity_numeric", "quantity")


CSV_FIELD = "CASE WHEN regexp_matches(h, 'species|wood') THEN 'species' WHEN regexp_matches(h, 'thick') THEN 'thickness' WHEN regexp_matches(h, 'grade') THEN 'grade' WHEN regexp_matches(h, 'qty|quantity|bf') THEN 'quantity' WHEN regexp_matches(h, 'desc|product') THEN 'product' WHEN regexp_matches(h, 'price') THEN 'price' WHEN regexp_matches(h, 'length') THEN 'length' END"


@query(sql=f"SELECT p_partkey, {CSV_FIELD} AS field FROM (SELECT p_partkey, lower(CASE p_partkey % 8 WHEN 0 THEN 'Wood Type' WHEN 1 THEN 'Thickness' WHEN 2 THEN 'GRADE' WHEN 3 THEN 'Qty (BF)' WHEN 4 THEN 'Product Desc' WHEN 5 THEN 'Price/MBF' WHEN 6 THEN 'Length' ELSE p_brand END) AS h FROM part)")
def x15_csv_field(t):
    h = F.element_at(F.array(*map(F.lit, ("Wood Type", "Thickness", "GRADE", "Qty (BF)", "Product Desc", "Price/MBF", "Length"))), F.when(F.col("p_partkey") % 8 < 7, (F.col("p_partkey") % 8 + 1).cast("int")).otherwise(1))
    return t("part").select("p_partkey", sheets.csv_field(F.when(F.col("p_partkey") % 8 < 7, h).otherwise(F.col("p_brand"))).alias("field"))


LISTED = f"""SELECT group_id AS list, row_number() OVER (PARTITION BY group_id ORDER BY id) - 1 AS source_row, {S.species('species_raw')} AS species, {S.thickness('thickness_raw')} AS thickness, {S.grade('grade_raw')} AS grade, concat(format('{{:,}}', qty), ' BF') AS quantity, CAST(qty AS DOUBLE) AS quantity_numeric, concat('said "', color_raw, '",', chr(10), 'see note') AS product FROM fx_products_raw"""


@query("fx_products_raw", LISTED)
def io1_read_csv_stock_lists(t):
    """The products of each group as a CSV file with quoted commas, quotes and line breaks, read back from the files."""
    p = t("fx_products_raw")
    spark = p.sparkSession
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.concat(F.lit('said "'), "color_raw", F.lit('",\nsee note'))
    line = F.concat_ws(",", "species_raw", quoted(F.col("thickness_raw")), quoted(F.col("grade_raw")), quoted(F.format_number("qty", 0)), quoted(note))
    head = p.select("group_id").distinct().select("group_id", F.lit(-1).cast("long").alias("id"), F.lit("Species,Thickness,Grade,Qty (BF),Product").alias("line"))
    path = f"{shared_dir(spark)}/lists-{dt.datetime.now().timestamp()}"
    lines_ = head.unionByName(p.select("group_id", "id", line.alias("line")))
    lines_.repartition("group_id").sortWithinPartitions("group_id", "id").select(F.col("line").alias("value"), F.col("group_id").alias("list")).write.partitionBy("list").text(path)
    rows = csv_rows(read_csv_cells(spark, path))
    return rows.select(F.regexp_extract("file", "list=([0-9]+)", 1).cast("long").alias("list"), F.col("source_row").cast("long").alias("source_row"), "species", "thickness", "grade", "quantity", "quantity_numeric", "product")


@query("fx_lines", "SELECT upload_id, line_no, unnest(CASE WHEN len(regexp_extract_all(text, '\\b[0-9]+/[0-9]\\b')) >= 2 AND len(p) >= 2 THEN p ELSE [text] END) AS segment FROM (SELECT upload_id, line_no, text, list_filter(list_transform(regexp_split_to_array(text, '\\s{3,}'), lambda s: " + S.strip("s") + "), lambda s: length(s) > 3) AS p FROM (SELECT upload_id, line_no, concat(text, CASE WHEN line_no % 2 = 0 THEN '    5/4 FAS 300''' ELSE '' END) AS text FROM fx_lines))")
def x16_split_multicolumn(t):
    x = F.concat("text", F.when(F.col("line_no") % 2 == 0, "    5/4 FAS 300'").otherwise(""))
    return t("fx_lines").withColumn("text", x).select("upload_id", "line_no", F.explode(lines.split_multicolumn(F.col("text"))).alias("segment"))


HEAD = f"SELECT upload_id, line_no, {S.find('text', V.DATE, 1)} AS stock_date, {S.find('text', V.EMAIL)} AS email, {S.find('text', V.PHONE)} AS phone, {S.find('text', f'({V.CITY_STATE_ZIP})', 1)} AS location FROM fx_lines WHERE line_no < 25"


@query("fx_lines", HEAD)
def x17_header_metadata(t):
    return cleaning.head_metadata(t("fx_lines"), "upload_id").drop("names")


@query("fx_uploads fx_lines", f"SELECT u.id AS upload_id, arg_min(stock_date, line_no) FILTER (stock_date IS NOT NULL) AS stock_date, arg_min(email, line_no) FILTER (email IS NOT NULL) AS email, arg_min(phone, line_no) FILTER (phone IS NOT NULL) AS phone, arg_min(location, line_no) FILTER (location IS NOT NULL) AS location, concat('Mill ', CAST(u.id % 50 AS VARCHAR), ' Lumber Co.') AS mill_name FROM fx_uploads u LEFT JOIN ({HEAD}) h ON h.upload_id = u.id GROUP BY u.id")
def a6_file_metadata(t):
    return cleaning.file_metadata(t("fx_lines"), t("fx_uploads"))


def _mill_sql(x: str) -> str:
    """`mill_from_filename` as SQL."""
    gone = lambda x, p, to="": f"regexp_replace({x}, '{p}', '{to}', 'g')"
    for p in (r"(?i)\.[a-z]+$", r"(?i)[\s_-]*(?:stock\s*(?:list|sheet)|send\s*out\s*inventory|inventory|kd|send\s*out|cam|stocklist)\b.*$", r"[\s_-]*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s*$", r"(?i)[\s_-]*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s*\d{2,4}\s*$", r"[\s_-]*\d{6,8}\s*$"):
        x = gone(x, p)
    x = S.strip(gone(gone(x, "([a-z])([A-Z])", r"\1 \2"), "[_-]+", " "))
    x = S.strip(gone(S.strip(gone(x, r"(?i)\b(Send Out|SendOut|Inventory|Stock)\b")), r"\s{2,}", " "))
    return f"SELECT id, CASE WHEN length(n) > 3 AND NOT regexp_matches(replace(n, ' ', ''), '^[0-9a-f]{{20,}}$') THEN n END AS mill_name FROM (SELECT id, {x} AS n FROM fx_uploads)"


@query("fx_uploads", _mill_sql("concat('OakRidgeLumber_', original_filename)"))
def x18_mill_from_filename(t):
    return t("fx_uploads").select("id", cleaning.mill_from_filename(F.concat(F.lit("OakRidgeLumber_"), "original_filename")).alias("mill_name"))


def stored_replies(p: DataFrame) -> DataFrame:
    """Products as replies of a language model, one an upload; some fenced, some with a comma too many."""
    item = F.struct(F.coalesce("species", F.lit("null")).alias("species"), "thickness", F.coalesce("grade", F.lit("N/A")).alias("grade"), "quantity", F.col("quantity_numeric").cast("string").alias("quantity_numeric"), F.col("product").alias("raw_text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_row", item.alias("p")))), lambda s: s["p"])
    body = F.to_json(F.struct(F.lit("A Mill").alias("mill_name"), listed.alias("products")))
    k = F.col("upload_id") % 3
    text = F.when(k == 0, F.col("body")).when(k == 1, F.concat(F.lit("Here:\n```json\n"), "body", F.lit("\n```"))).otherwise(F.concat(F.lit("Sure. "), F.regexp_replace("body", "]}$", ",]}"), F.lit(" Bye")))
    return p.groupBy("upload_id").agg(body.alias("body")).select("upload_id", text.alias("reply"))


@query("fx_products", "SELECT upload_id, count(*) AS products FROM fx_products GROUP BY 1")
def x19_parse_llm_json(t):
    return replies.parse_replies(stored_replies(t("fx_products"))).select("upload_id", F.size("parsed.products").cast("long").alias("products"))


@query()
def x20_explode_llm_rows(t):
    return replies.explode_replies(replies.parse_replies(stored_replies(t("fx_products"))))


@query(sql="SELECT doc_id, length(CASE WHEN length(text) > 15000 THEN concat(text[1:15000], chr(10), '[TRUNCATED]') ELSE text END) AS n, CAST(length(text) > 15000 AS INT) AS cut FROM documents")
def x21_truncate_text(t):
    x = replies.truncate_text(F.col("text"))
    return t("documents").select("doc_id", F.length(x["text"]).cast("long").alias("n"), x["cut"].alias("cut"))


@query(sql="SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' __ ' || p_type), '[^\\w\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def x22_slugify(t):
    return t("part").select("p_partkey", N.slugify(F.concat_ws(" __ ", "p_name", "p_type")).alias("slug"))


@query("fx_invitations", "SELECT id, sha256(token) AS token_hash FROM fx_invitations")
def x23_token_hash(t):
    return t("fx_invitations").select("id", workspaces.token_hash(F.col("token")).alias("token_hash"))


@query("fx_activity", "SELECT id, CAST(created_at AS DATE) AS day FROM fx_activity")
def x24_day_of(t):
    return t("fx_activity").select("id", F.to_date("created_at").alias("day"))


def _expand_sql(q: str) -> str:
    groups = "[" + ", ".join("{'k': " + S.quote(k) + ", 's': [" + ", ".join(map(S.quote, s)) + "]}" for k, s in search.SYNONYMS.items()) + "]"
    lists = f"list_concat([{q}], flatten(list_transform(list_filter({groups}, lambda g: contains({q}, g.k) OR len(list_filter(g.s, lambda s: contains({q}, s))) > 0), lambda g: g.s)))"
    return lists


@query("fx_searches", "SELECT query, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), '|') AS terms FROM (SELECT query, " + _expand_sql("query") + " AS l FROM (SELECT DISTINCT query FROM fx_searches))")
def x25_expand_query(t):
    return t("fx_searches").select("query").distinct().select("query", F.array_join(search.expand_query(F.col("query")), "|").alias("terms"))


@query("fx_products", "SELECT DISTINCT grade, nullif(CASE WHEN NOT contains(c, ' ') AND regexp_matches(c, '[/&#]') THEN " + S.strip("regexp_replace(grade, '[^\\w\\s]', '', 'g')") + " ELSE c END, '') AS phrase FROM (SELECT grade, " + S.strip("regexp_replace(grade, '[^\\w\\s/&#+]', ' ', 'g')") + " AS c FROM fx_products)")
def x26_fts_phrase(t):
    return t("fx_products").select("grade").distinct().select("grade", search.fts_phrase(F.col("grade")).alias("phrase"))


# --- Joins and rewrites ------------------------------------------------------------------------------------------


@query("fx_memberships fx_groups", "SELECT m.user_id, m.group_id, g.name, m.role, CAST(row_number() OVER (PARTITION BY m.user_id ORDER BY g.name, m.group_id) = 1 AS INT) AS is_default FROM fx_memberships m JOIN fx_groups g ON g.id = m.group_id AND g.is_active = 1")
def j1_user_groups(t):
    return workspaces.user_groups(t("fx_memberships"), t("fx_groups"))


@query("fx_memberships fx_users", "SELECT m.group_id, m.user_id, m.role, u.email, u.display_name FROM fx_memberships m LEFT JOIN fx_users u ON u.id = m.user_id")
def j2_group_roster(t):
    return workspaces.group_roster(t("fx_memberships"), t("fx_users"))


@query("fx_invitations fx_groups", f"SELECT i.id, lower(i.email) AS email, i.group_id, g.name AS group_name, g.slug FROM fx_invitations i JOIN fx_groups g ON g.id = i.group_id AND g.is_active = 1 WHERE i.status = 'pending' AND i.expires_at > {NOW_SQL}")
def j3_pending_invitations(t):
    return workspaces.pending_invitations(t("fx_invitations"), t("fx_groups"), now())


OUTCOME = f"CASE WHEN i.id IS NULL THEN 'unknown' WHEN i.status <> 'pending' THEN i.status WHEN i.expires_at < {NOW_SQL} THEN 'expired' WHEN lower(u.email) IS DISTINCT FROM lower(i.email) THEN 'wrong user' WHEN m.user_id IS NOT NULL THEN 'member' ELSE 'joined' END"


@query("fx_users fx_invitations fx_memberships", f"SELECT token, user_id, outcome, CASE WHEN outcome = 'joined' THEN group_id END AS group_id FROM (SELECT a.token, a.user_id, i.group_id, {OUTCOME} AS outcome FROM (SELECT concat('tok', CAST(id AS VARCHAR)) AS token, CASE WHEN id % 5 = 0 THEN id + 1 ELSE id END AS user_id FROM fx_users) a LEFT JOIN fx_invitations i ON i.token = a.token LEFT JOIN fx_users u ON u.id = a.user_id LEFT JOIN fx_memberships m ON m.user_id = a.user_id AND m.group_id = i.group_id)")
def j4_resolve_invitations(t):
    asked = t("fx_users").select(F.concat(F.lit("tok"), "id").alias("token"), F.when(F.col("id") % 5 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("user_id"))
    stored = t("fx_invitations").withColumn("token_hash", workspaces.token_hash(F.col("token"))).drop("token")
    return workspaces.resolve_invitations(asked, stored, t("fx_users"), t("fx_memberships"), now())


@query("fx_users fx_memberships fx_invitations", "SELECT w.group_id, w.email, CASE WHEN EXISTS (SELECT 1 FROM fx_memberships m JOIN fx_users u ON u.id = m.user_id WHERE m.group_id = w.group_id AND lower(u.email) = w.email) THEN 'member' WHEN EXISTS (SELECT 1 FROM fx_invitations i WHERE i.group_id = w.group_id AND lower(i.email) = w.email AND i.status = 'pending') THEN 'pending' ELSE 'ok' END AS verdict FROM (SELECT id % 25 AS group_id, lower(email) AS email FROM fx_users) w")
def j5_invite_conflicts(t):
    wanted = t("fx_users").select((F.col("id") % 25).alias("group_id"), "email")
    return workspaces.invite_conflicts(wanted, t("fx_memberships"), t("fx_users"), t("fx_invitations"))


@query("fx_activity fx_users", "SELECT a.id, a.action, a.created_at, u.email, u.display_name FROM (SELECT * FROM fx_activity ORDER BY created_at DESC, id DESC LIMIT 500) a LEFT JOIN fx_users u ON u.id = a.user_id")
def j6_activity_with_users(t):
    return usage.activity_with_users(t("fx_activity"), t("fx_users"))


@query("fx_mills fx_products", "SELECT m.id, m.group_id, m.name, count(p.id) AS products FROM fx_mills m LEFT JOIN fx_products p ON p.mill_id = m.id GROUP BY ALL")
def j7_mills_with_counts(t):
    return catalog.mills_with_counts(t("fx_mills"), t("fx_products"))


SEEN = "SELECT group_id, mill_name AS name, upload_id, concat('Town ', CAST(upload_id % 7 AS VARCHAR(20))) AS location, nullif(concat('555-000-', CAST(upload_id % 3 AS VARCHAR(20))), '555-000-0') AS phone, concat('mill', CAST(upload_id AS VARCHAR(20)), '@example.com') AS email FROM {fx_products}"
UPSERT = f"""SELECT id, group_id, name, NULL AS location, NULL AS phone, NULL AS email FROM fx_mills UNION ALL SELECT (SELECT max(id) FROM fx_mills) + row_number() OVER (ORDER BY f.upload_id, group_id, name), group_id, name, f.location, f.phone, f.email
FROM (SELECT group_id, trim(name)[1:100] AS name, arg_min(s, upload_id) AS f FROM ({SEEN.format(fx_products="fx_products")}) s GROUP BY 1, 2) n WHERE NOT EXISTS (SELECT 1 FROM fx_mills m WHERE m.group_id = n.group_id AND m.name = n.name)"""


@query("fx_mills fx_products", UPSERT)
def j8_upsert_mills(t):
    p = t("fx_products")
    return catalog.upsert_mills(t("fx_mills"), p.sparkSession.sql(SEEN, fx_products=p))


ACTIONS = "SELECT id, CASE WHEN group_id = 4 THEN 99 ELSE group_id END AS group_id, CASE id % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'flag' WHEN 2 THEN 'unflag' WHEN 3 THEN 'delete' ELSE 'set_mill' END AS action, 'New Mill' AS mill FROM {fx_products} WHERE source_row = 1"


@query("fx_products", "SELECT p.id, CASE WHEN a.action = 'review' THEN 1 ELSE is_reviewed END AS is_reviewed, CASE a.action WHEN 'flag' THEN 1 WHEN 'unflag' THEN 0 ELSE is_flagged END AS is_flagged, CASE WHEN a.action = 'set_mill' THEN a.mill ELSE mill_name END AS mill_name FROM fx_products p LEFT JOIN (SELECT * FROM (" + ACTIONS.format(fx_products="fx_products") + ") WHERE group_id <> 99) a ON a.id = p.id WHERE a.action IS DISTINCT FROM 'delete'")
def j9_bulk_update(t):
    p = t("fx_products")
    changes = p.sparkSession.sql(ACTIONS, fx_products=p)
    return catalog.bulk_update(p, changes).select("id", "is_reviewed", "is_flagged", "mill_name")


@query("fx_uploads fx_products", "SELECT 'upload' AS kind, id FROM fx_uploads WHERE id % 9 <> 0 UNION ALL SELECT 'product', id FROM fx_products WHERE upload_id % 9 <> 0 OR upload_id NOT IN (SELECT id FROM fx_uploads)")
def j10_delete_uploads(t):
    u = t("fx_uploads")
    left, rows = catalog.delete_uploads(u, t("fx_products"), u.where("id % 9 = 0").select("id", "group_id"))
    return left.select(F.lit("upload").alias("kind"), "id").unionByName(rows.select(F.lit("product").alias("kind"), "id"))


def _lost(table: str) -> str:
    """A fact as it was before workspaces: rows of users without one are in no group."""
    return f"SELECT x.id, x.user_id, CASE WHEN m.user_id IS NOT NULL THEN x.group_id END AS group_id FROM {{{table}}} x LEFT JOIN (SELECT DISTINCT user_id FROM {{fx_memberships}}) m ON m.user_id = x.user_id"


#: Tables before the backfill. Addresses share what stands before @, so that slugs clash.
BEFORE = {
    "users": "SELECT id, concat('User.', CAST(id % 400 AS VARCHAR(20)), '@m', CAST(id AS VARCHAR(20)), '.example.com') AS email, display_name FROM {fx_users}",
    "memberships": "SELECT group_id, user_id, role FROM {fx_memberships}",
    "groups": "SELECT id, name, slug FROM {fx_groups}",
    "uploads": _lost("fx_uploads"),
    "activity": _lost("fx_activity"),
    "searches": _lost("fx_searches"),
    "mills": "SELECT id, name, CASE WHEN id % 4 > 0 THEN group_id END AS group_id FROM {fx_mills}",
    "products": "SELECT p.id, p.upload_id, CASE WHEN u.group_id IS NOT NULL THEN p.group_id END AS group_id FROM {fx_products} p LEFT JOIN (" + _lost("fx_uploads") + ") u ON u.id = p.upload_id",
}
BEFORE_VIEWS = "fx_users fx_memberships fx_groups fx_uploads fx_activity fx_searches fx_mills fx_products"
_OLD = {k: v.format(**{n: n for n in BEFORE_VIEWS.split()}) for k, v in BEFORE.items()}
BASE_SLUG = "regexp_replace(regexp_replace(lower(split_part(email, '@', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
ASSIGNED = f""", old_users AS ({_OLD["users"]}), old_groups AS ({_OLD["groups"]}), alone AS (SELECT *, {BASE_SLUG} AS base FROM old_users u WHERE NOT EXISTS (SELECT 1 FROM fx_memberships m WHERE m.user_id = u.id)),
assigned AS (SELECT (SELECT max(id) FROM fx_groups) + row_number() OVER (ORDER BY id) AS new_group, id AS user_id, concat(display_name, chr(39), 's Workspace') AS name, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY id) = 1 AND base NOT IN (SELECT slug FROM old_groups) THEN base ELSE concat(base, '-', id) END AS slug FROM alone)
"""
TAKEN = "SELECT '{k}' AS kind, f.id, coalesce(f.group_id, a.new_group) AS group_id, NULL AS detail FROM ({old}) f LEFT JOIN assigned a ON a.user_id = f.user_id"
AFTER = " UNION ALL ".join(
    [
        "SELECT 'groups' AS kind, id, NULL AS group_id, concat(slug, ' ', name) AS detail FROM (SELECT id, name, slug FROM old_groups UNION ALL SELECT new_group, name, slug FROM assigned)",
        "SELECT 'memberships', user_id, group_id, role FROM (SELECT user_id, group_id, role FROM fx_memberships UNION ALL SELECT user_id, new_group, 'owner' FROM assigned)",
        *[TAKEN.format(k=k, old=_OLD[k]) for k in ("uploads", "activity", "searches")],
        f"SELECT 'mills', id, coalesce(group_id, (SELECT arg_min(new_group, user_id) FROM assigned)), NULL FROM ({_OLD['mills']})",
        f"SELECT 'products', f.id, coalesce(f.group_id, a.new_group), NULL FROM ({_OLD['products']}) f LEFT JOIN fx_uploads u ON u.id = f.upload_id LEFT JOIN assigned a ON a.user_id = u.user_id",
    ]
)


def before_backfill(t) -> dict[str, DataFrame]:
    views = {n: t(n) for n in BEFORE_VIEWS.split()}
    spark = views["fx_users"].sparkSession
    return {k: spark.sql(v, **{n: views[n] for n in views if "{" + n + "}" in v}) for k, v in BEFORE.items()}


@query(BEFORE_VIEWS, ASSIGNED + "SELECT new_group AS group_id, user_id, name, 'Auto-created personal workspace' AS description, slug FROM assigned")
def j11_backfill_groups(t):
    old = before_backfill(t)
    return workspaces.backfill_groups(old["users"], old["memberships"], old["groups"])


@query(BEFORE_VIEWS, ASSIGNED + AFTER)
def j11_backfill(t):
    """All tables after the backfill, one below the other."""
    new = workspaces.backfill(**before_backfill(t))
    told = {"groups": ("id", F.lit(None), F.concat_ws(" ", "slug", "name")), "memberships": ("user_id", F.col("group_id"), F.col("role"))}
    out = None
    for kind in ("groups", "memberships", "uploads", "activity", "searches", "mills", "products"):
        i, g, d = told.get(kind, ("id", F.col("group_id"), F.lit(None)))
        part = new[kind].select(F.lit(kind).alias("kind"), F.col(i).alias("id"), g.cast("long").alias("group_id"), d.cast("string").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@query("fx_products fx_uploads", "SELECT id, CASE WHEN upload_id % 6 = 0 AND upload_id IN (SELECT id FROM fx_uploads) THEN concat('Renamed ', CAST(upload_id AS VARCHAR)) ELSE mill_name END AS mill_name FROM fx_products")
def j12_rename_upload_mill(t):
    names = t("fx_uploads").where("id % 6 = 0").select(F.col("id").alias("upload_id"), F.concat(F.lit("Renamed "), "id").alias("new_name"))
    return catalog.rename_mill(t("fx_products"), names).select("id", "mill_name")


@query("fx_products", "SELECT id, CASE WHEN source_row = 2 THEN 'Teak' ELSE species END AS species, CASE WHEN source_row = 2 THEN concat_ws(' ', thickness, 'Teak', grade) ELSE product END AS product FROM fx_products")
def j12_correct_products(t):
    p = t("fx_products")
    fixes = p.where("source_row = 2").select("id", F.lit("Teak").alias("species"), F.lit(None).cast("string").alias("thickness"), F.lit(None).cast("string").alias("grade"))
    return catalog.correct_products(p, fixes, F.concat_ws(" ", "thickness", "species", "grade")).select("id", "species", "product")


def stored_products(t) -> tuple[DataFrame, str]:
    """The products and a store that holds them."""
    p = t("fx_products")
    path = f"{shared_dir(p.sparkSession)}/store-{dt.datetime.now().timestamp()}"
    store.write_products(p, path)
    return p, path


@query("fx_products fx_uploads", """, o AS (SELECT upload_id, min(mill_name) FILTER (mill_name <> 'Unknown Mill') AS n FROM fx_products GROUP BY 1),
a AS (SELECT id, upload_id, mill_name, species FROM fx_products WHERE NOT is_flagged = 1 OR upload_id NOT IN (SELECT upload_id FROM fx_products WHERE source_row = 6)
UNION ALL SELECT p.id + 1000000000, upload_id, coalesce(o.n, 'Unknown Mill'), species FROM fx_products p JOIN o USING (upload_id) WHERE is_flagged = 0 AND upload_id IN (SELECT upload_id FROM fx_products WHERE source_row = 6)),
b AS (SELECT id, upload_id, CASE WHEN upload_id IN (SELECT id FROM fx_uploads WHERE status = 'processing') THEN concat('Renamed ', upload_id) ELSE mill_name END AS mill_name, species FROM a WHERE NOT (id < 1000000000 AND upload_id IN (SELECT upload_id FROM fx_products WHERE source_row = 6)))
SELECT id, upload_id, mill_name, species FROM b WHERE upload_id NOT IN (SELECT id FROM fx_uploads WHERE uploaded_at >= TIMESTAMP '1998-01-01 00:00:00')""")
def io6_stored_changes(t):
    """A store of products after three changes on disk: uploads with six rows or more are parsed again without their flagged rows,
    unfinished ones get another mill's name, late ones are deleted."""
    p, path = stored_products(t)
    spark, uploads = p.sparkSession, t("fx_uploads")
    long = p.where("source_row = 6").select("upload_id")
    fresh = p.join(long, "upload_id", "left_semi").where("is_flagged = 0").withColumns({"id": F.col("id") + 1_000_000_000, "mill_name": F.lit(None).cast("string")})
    store.replace_uploads(spark, path, fresh.select(*p.columns), long)
    store.rename_mills(spark, path, uploads.where("status = 'processing'").select(F.col("id").alias("upload_id"), F.concat(F.lit("Renamed "), "id").alias("new_name")))
    store.delete_uploads(spark, path, uploads, uploads.where(F.col("uploaded_at") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "group_id"))
    return store.read_products(spark, path).select("id", "upload_id", "mill_name", "species")


@query("fx_products", "SELECT p.id, CASE WHEN a.action = 'review' THEN 1 ELSE is_reviewed END AS is_reviewed, CASE a.action WHEN 'flag' THEN 1 WHEN 'unflag' THEN 0 ELSE is_flagged END AS is_flagged, CASE WHEN a.action = 'set_mill' THEN a.mill ELSE mill_name END AS mill_name, CASE WHEN source_row = 2 THEN 'Teak' ELSE species END AS species FROM fx_products p LEFT JOIN (SELECT * FROM (" + ACTIONS.format(fx_products="fx_products") + ") WHERE group_id <> 99) a ON a.id = p.id WHERE a.action IS DISTINCT FROM 'delete'")
def j9_stored_update(t):
    """A store of products after changes and corrections of single products on disk."""
    p, path = stored_products(t)
    store.bulk_update(p.sparkSession, path, p.sparkSession.sql(ACTIONS, fx_products=p))
    fixes = p.where("source_row = 2").select("id", F.lit("Teak").alias("species"), F.lit(None).cast("string").alias("thickness"), F.lit(None).cast("string").alias("grade"))
    store.correct_products(p.sparkSession, path, fixes, F.concat_ws(" ", "thickness", "species", "grade"))
    return store.read_products(p.sparkSession, path).select("id", "is_reviewed", "is_flagged", "mill_name", "species")


@query("fx_products", "SELECT id, species, place FROM (SELECT id, species, row_number() OVER (ORDER BY species NULLS FIRST, id) - 1 AS place FROM fx_products) WHERE place BETWEEN 3000 AND 3049")
def f1_deep_page(t):
    """A page deep in all products, by their places."""
    return catalog.page_at(catalog.placed_products(t("fx_products"), "species"), 3000, 50).select("id", "species", "place")


@query("fx_products", "SELECT id, confidence FROM fx_products WHERE confidence < 0.5e0 OR confidence IS NULL OR (confidence = 0.5e0 AND id > 2000000) ORDER BY confidence DESC NULLS LAST, id LIMIT 50")
def f1_next_page(t):
    """The page behind a product, best first."""
    return catalog.products_after(t("fx_products"), {"id": 2_000_000, "confidence": 0.5}, "confidence", True, 50).select("id", "confidence")


# --- Aggregates and windows --------------------------------------------------------------------------------------


@query("fx_products", "SELECT group_id, count(*) AS products, count(DISTINCT upload_id) AS uploads, count(DISTINCT mill_name) AS mills, count(DISTINCT species) AS species, count(*) FILTER (confidence < 0.5e0) AS low_confidence, count(*) FILTER (is_reviewed = 0) AS unreviewed FROM fx_products GROUP BY 1")
def a1_catalog_stats(t):
    return catalog.catalog_stats(t("fx_products"))


@query("fx_products", "SELECT species, count(*) AS n FROM fx_products WHERE species IS NOT NULL GROUP BY 1 ORDER BY n DESC, species LIMIT 10")
def a2_top_species(t):
    return catalog.top_values(t("fx_products"), "species")


@query("fx_products", "SELECT mill_name, count(*) AS n FROM fx_products WHERE mill_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, mill_name LIMIT 10")
def a2_top_mills(t):
    return catalog.top_values(t("fx_products"), "mill_name")


@query("fx_products", "SELECT DISTINCT group_id, facet, value FROM (UNPIVOT (SELECT group_id, species, thickness, grade, mill_name FROM fx_products) ON species, thickness, grade, mill_name INTO NAME facet VALUE value) WHERE value IS NOT NULL")
def a3_facets(t):
    return catalog.facets(t("fx_products"))


def _count(table: str, name: str, key: str = "group_id") -> str:
    return f"coalesce((SELECT count(*) FROM {table} f WHERE f.{key} = g.id), 0) AS {name}"


@query("fx_groups fx_memberships fx_uploads fx_products fx_mills fx_searches", "SELECT id, name, " + ", ".join(_count(f"fx_{k}", v) for k, v in (("memberships", "members"), ("uploads", "uploads"), ("products", "products"), ("mills", "mills"), ("searches", "searches"))) + " FROM fx_groups g")
def a4_group_overview(t):
    return workspaces.group_overview(t("fx_groups"), members=t("fx_memberships"), uploads=t("fx_uploads"), products=t("fx_products"), mills=t("fx_mills"), searches=t("fx_searches"))


def _overview(t) -> DataFrame:
    live = usage.live_sessions(t("fx_sessions"), t("fx_users"), now())
    return usage.user_overview(t("fx_users"), uploads=t("fx_uploads"), searches=t("fx_searches"), actions=t("fx_activity"), live_sessions=live)


LIVE = f"(SELECT s.* FROM fx_sessions s JOIN fx_users u ON u.id = s.user_id AND u.is_active = 1 AND u.is_suspended = 0 WHERE s.expires_at > {NOW_SQL})"
OVERVIEW = "SELECT id, email, " + ", ".join(_count(a, b, "user_id") for a, b in (("fx_uploads", "uploads"), ("fx_searches", "searches"), ("fx_activity", "actions"), (LIVE, "live_sessions"))) + " FROM fx_users g"


@query("fx_users fx_uploads fx_searches fx_activity fx_sessions", OVERVIEW)
def a5_user_overview(t):
    return _overview(t)


@query("fx_users fx_uploads fx_searches fx_activity fx_sessions", OVERVIEW + " ORDER BY actions DESC, id LIMIT 10")
def k2_top_users(t):
    return usage.top_users(_overview(t), "actions")


METHODS = "SELECT id, upload_id, confidence, CASE source_row % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'columns' ELSE 'table' END AS method FROM {fx_products}"


@query("fx_products", "SELECT upload_id, method, \"rows\", good FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY good DESC, CASE method WHEN 'table' THEN 0 WHEN 'columns' THEN 1 ELSE 2 END) AS r FROM (SELECT upload_id, method, count(*) AS \"rows\", count(*) FILTER (confidence >= 0.4e0) AS good FROM (" + METHODS.format(fx_products="fx_products") + ") GROUP BY 1, 2) WHERE \"rows\" >= CASE method WHEN 'text' THEN 3 ELSE 5 END) WHERE r = 1")
def a7_pick_strategy(t):
    p = t("fx_products")
    return scoring.pick_strategy(p.sparkSession.sql(METHODS, fx_products=p))


@query("fx_products", "SELECT upload_id, method, count(*) AS n FROM (" + METHODS.format(fx_products="fx_products") + ") GROUP BY 1, 2")
def u3_union_strategies(t):
    p = t("fx_products").withColumn("method", F.lit(""))
    parts = [p.where(F.col("source_row") % 3 == k).withColumn("method", F.lit(m)) for k, m in ((0, "text"), (1, "columns"), (2, "table"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("upload_id", "method").agg(F.count("*").alias("n"))


@query()
def u3_extraction_branches(t):
    """What each extraction of each file finds."""
    found = extract.extractions(t("fx_lines"), page_words(t), t("fx_grid"))
    return found.groupBy("upload_id", "method").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= V.REVIEW).alias("good"), F.max("source_row").alias("last"))


HEAD_CELL = r"^([A-Za-z][A-Za-z\s]+?)[\s:]+(?:Grade|grade|GRADE)"
GRID_ROWS = f""", heads AS (SELECT h, CASE WHEN regexp_matches(h, '{HEAD_CELL}') THEN {S.species(f"regexp_extract(h, '{HEAD_CELL}', 1)")} WHEN {S.is_species_header('h')} THEN {S.species(S.replace('h', ':+$'))} END AS species FROM (SELECT DISTINCT {S.strip('value')} AS h FROM fx_grid WHERE row = 0 AND col = 1)),
cells AS (SELECT upload_id, table_no, row, max(value) FILTER (col = 0) AS t, max(value) FILTER (col = 1) AS g, nullif({S.strip("max(value) FILTER (col = 2)")}, '') AS d, nullif(max(value) FILTER (col = 3), '') AS q, max(value) FILTER (col = 4) AS l, string_agg(value, ' | ' ORDER BY col) AS raw_text FROM fx_grid WHERE row > 0 GROUP BY 1, 2, 3),
parts AS (SELECT c.*, species, {S.thickness(S.find('t', '^[0-9]+/[0-9]+'))} AS thickness, {S.grade('g')} AS grade, CASE WHEN regexp_matches(q, '(?i)^[0-9]?T/?L$') THEN 'T/L' WHEN regexp_matches(q, '(?i)^call') THEN 'Call' END AS word, TRY_CAST(regexp_replace(q, '[^0-9.]', '', 'g') AS DOUBLE) AS digits FROM cells c JOIN fx_grid h ON h.upload_id = c.upload_id AND h.table_no = c.table_no AND h.row = 0 AND h.col = 1 JOIN heads ON heads.h = {S.strip('h.value')})
SELECT upload_id, table_no, row, species, thickness, grade, d AS description, CASE WHEN word IS NULL THEN digits END AS quantity_numeric, coalesce(word, CASE WHEN digits IS NOT NULL THEN concat(format('{{:,}}', CAST(floor(digits) AS BIGINT)), ' BF') END, q) AS quantity, l AS length, concat_ws(' ', thickness, grade, d) AS product
FROM parts WHERE NOT {S.any_match('raw_text', V.NOISE)} AND concat_ws('', thickness, grade, d) <> ''"""


@query("fx_grid", GRID_ROWS)
def u3_table_rows(t):
    """The rows of the tables found in files."""
    return tables.grid_rows(t("fx_grid")).select("upload_id", "table_no", "row", "species", "thickness", "grade", "description", "quantity_numeric", "quantity", "length", "product")


@query("fx_products", "SELECT *, concat_ws('; ', CASE WHEN reject > 0 THEN concat(reject, ' rows rejected as non-inventory (contact info, addresses, junk text, etc.)') END, CASE WHEN review > 0 THEN concat(review, ' rows flagged for manual review (low confidence)') END) AS warnings FROM (SELECT upload_id, count(*) AS raw, count(*) FILTER (confidence >= 0.7e0) AS accept, count(*) FILTER (confidence >= 0.4e0 AND confidence < 0.7e0) AS review, count(*) FILTER (confidence < 0.4e0) AS reject FROM fx_products GROUP BY 1)")
def a8_parse_report(t):
    return scoring.parse_report(t("fx_products")).withColumn("warnings", F.array_join("warnings", "; "))


@query("fx_users fx_sessions fx_uploads fx_products fx_mills fx_searches", f"SELECT count(*) AS users, count(*) FILTER (is_active = 1) AS active, count(*) FILTER (role = 'admin') AS admins, count(*) FILTER (is_suspended = 1) AS suspended, count(*) FILTER (created_at >= {NOW_SQL} - INTERVAL 30 DAY) AS new_users, (SELECT count(*) FROM {LIVE}) AS live_sessions, (SELECT count(*) FROM fx_uploads) AS uploads, (SELECT count(*) FROM fx_products) AS products, (SELECT count(*) FROM fx_mills) AS mills, (SELECT count(*) FROM fx_searches) AS searches FROM fx_users")
def a9_platform_totals(t):
    live = usage.live_sessions(t("fx_sessions"), t("fx_users"), now())
    return usage.platform_totals(t("fx_users"), live, now(), uploads=t("fx_uploads"), products=t("fx_products"), mills=t("fx_mills"), searches=t("fx_searches"))


@query("fx_activity", "SELECT action, count(*) AS n FROM fx_activity GROUP BY 1")
def a10_activity_by_type(t):
    return usage.activity_by_type(t("fx_activity"))


@query("fx_users", f"SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM fx_users WHERE created_at >= {NOW_SQL} - INTERVAL 30 DAY GROUP BY 1")
def a11_daily_registrations(t):
    return usage.daily_counts(t("fx_users"), "created_at", now())


@query("fx_activity", f"SELECT group_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM fx_activity WHERE created_at >= {NOW_SQL} - INTERVAL 30 DAY GROUP BY 1, 2")
def a11_daily_by_group(t):
    return usage.daily_counts(t("fx_activity"), "created_at", now(), "group_id")


def page_words(t) -> DataFrame:
    """Products as words on pages, in two columns."""
    p = t("fx_products")
    side, line = F.col("source_row") % 2, F.floor(F.col("source_row") / 2)
    w = p.select("upload_id", "source_row", side.alias("side"), line.alias("line"), F.posexplode(F.split("product", " ")).alias("n", "text")).where("text <> ''")
    return w.select("upload_id", F.lit(0).alias("page"), (F.col("source_row") * 100 + F.col("n")).cast("int").alias("seq"), (F.col("side") * 300.0 + F.col("n") * 40).cast("double").alias("x0"), (F.col("line") * 12.0).cast("double").alias("top"), "text")


BOUNDS = """SELECT upload_id, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, l: CASE WHEN l[1] - acc[-1] > 45 THEN list_concat(acc, l) ELSE acc END) AS bounds
FROM (SELECT upload_id, list(DISTINCT x ORDER BY x) AS xs FROM (SELECT upload_id, line, round_even(min(side * 300e0 + n * 40) / 30, 0) * 30 AS x
FROM (SELECT upload_id, source_row % 2 AS side, source_row // 2 AS line, unnest(words) AS text, generate_subscripts(words, 1) - 1 AS n FROM (SELECT upload_id, source_row, string_split(product, ' ') AS words FROM fx_products)) WHERE text <> '' GROUP BY 1, 2) GROUP BY 1)"""


@query("fx_products", f"SELECT upload_id, unnest(bounds) AS bound, generate_subscripts(bounds, 1) - 1 AS place FROM ({BOUNDS})")
def a14_column_boundaries(t):
    found = layout.column_boundaries(layout.word_lines(page_words(t)))
    return found.select("upload_id", F.posexplode("bounds").alias("place", "bound")).withColumn("place", F.col("place").cast("long"))


WORDS = "SELECT upload_id, (source_row % 2) * 300e0 + n * 40 AS x0, (source_row // 2) * 12e0 AS y, source_row * 100 + n AS seq, text FROM (SELECT upload_id, source_row, unnest(words) AS text, generate_subscripts(words, 1) - 1 AS n FROM (SELECT upload_id, source_row, string_split(product, ' ') AS words FROM fx_products)) WHERE text <> ''"
IN_COLUMNS = f"""SELECT upload_id, y, col, string_agg(text, ' ' ORDER BY x0, seq) AS text FROM (SELECT w.*, CASE WHEN len(bounds) > 1 THEN len(list_filter(list_transform(range(1, len(bounds)), lambda k: (bounds[k] + bounds[k + 1]) / 2), lambda m: m <= x0)) ELSE 0 END AS col FROM ({WORDS}) w JOIN ({BOUNDS}) b USING (upload_id)) GROUP BY 1, 2, 3"""


@query("fx_products", IN_COLUMNS)
def w6_words_to_columns(t):
    return layout.words_to_columns(page_words(t)).withColumn("col", F.col("col").cast("long"))


COLUMN_SPECIES = f""", texts AS MATERIALIZED ({IN_COLUMNS}), heads AS (SELECT text, {S.species(S.header_text('text'))} AS head FROM (SELECT DISTINCT text FROM texts) WHERE {S.is_species_header('text')}),
below AS (SELECT upload_id, y, col, t.text, h.text IS NOT NULL AS named, last_value(head IGNORE NULLS) OVER (PARTITION BY upload_id, col ORDER BY y) AS species FROM texts t LEFT JOIN heads h USING (text))
SELECT upload_id, y, col, text, species FROM below WHERE NOT named"""


@query("fx_products", COLUMN_SPECIES)
def w2_carry_species_columns(t):
    return layout.carry_column_species(layout.words_to_columns(page_words(t))).withColumn("col", F.col("col").cast("long"))


@query("fx_lines", "SELECT upload_id, line_no, last_value(CASE WHEN header = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY upload_id ORDER BY line_no) AS species FROM (SELECT l.upload_id, l.line_no, l.text, CAST(l.text = p.species_raw AS INT) AS header FROM fx_lines l LEFT JOIN (SELECT DISTINCT species_raw FROM fx_products_raw WHERE species_raw <> '') p ON p.species_raw = l.text)")
def w1_carry_species(t):
    named = t("fx_products_raw").where("species_raw <> ''").select(F.col("species_raw").alias("text")).distinct().withColumn("header", F.col("text"))
    return lines.carry_species(t("fx_lines").join(F.broadcast(named), "text", "left"), "line_no").select("upload_id", "line_no", "species")


@query("fx_products", "SELECT id, row_number() OVER (PARTITION BY upload_id ORDER BY source_row) - 1 AS n FROM fx_products")
def w4_number_rows(t):
    return t("fx_products").select("id", (F.row_number().over(Window.partitionBy("upload_id").orderBy("source_row")) - 1).cast("long").alias("n"))


@query("fx_products", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY upload_id, coalesce(lower(species), ''), coalesce(lower(thickness), ''), coalesce(lower(grade), ''), quantity_numeric, coalesce(lower(color), '') ORDER BY confidence DESC, CASE WHEN confidence >= 0.7e0 THEN 0 ELSE 1 END, source_row, id) AS r FROM fx_products) WHERE r = 1")
def w5_dedupe_rows(t):
    return scoring.dedupe_rows(t("fx_products")).select("id")


@query("fx_activity", "SELECT id, user_id, rank FROM (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM fx_activity) WHERE rank <= 20")
def w7_recent_per_user(t):
    return catalog.recent_per_key(t("fx_activity"), "user_id", "created_at", 20).select("id", "user_id", F.col("rank").cast("long").alias("rank"))


@query("fx_memberships fx_uploads", "SELECT group_id, user_id, n, rank FROM (SELECT m.group_id, m.user_id, coalesce(c, 0) AS n, row_number() OVER (PARTITION BY m.group_id ORDER BY coalesce(c, 0) DESC, m.user_id) AS rank FROM fx_memberships m LEFT JOIN (SELECT group_id, user_id, count(*) AS c FROM fx_uploads GROUP BY 1, 2) u USING (group_id, user_id)) WHERE rank <= 10")
def k1_top_members(t):
    return workspaces.top_members(t("fx_memberships"), t("fx_uploads")).withColumn("rank", F.col("rank").cast("long"))


@query("fx_products fx_searches", "SELECT query, value, rank FROM (SELECT query, value, row_number() OVER (PARTITION BY query ORDER BY value) AS rank FROM (SELECT DISTINCT query FROM fx_searches) JOIN (SELECT DISTINCT value FROM (SELECT species AS value FROM fx_products UNION ALL SELECT grade FROM fx_products UNION ALL SELECT thickness FROM fx_products) WHERE value IS NOT NULL) ON contains(lower(value), lower(query))) WHERE rank <= 10")
def k3_suggest(t):
    return catalog.suggest(t("fx_products"), t("fx_searches")).select("query", "value", F.col("rank").cast("long").alias("rank"))


@query("fx_uploads", "SELECT id, uploaded_at FROM fx_uploads ORDER BY uploaded_at DESC, id DESC LIMIT 100")
def k5_uploads_newest(t):
    return t("fx_uploads").select("id", "uploaded_at").orderBy(*catalog.newest("uploaded_at", "id")).limit(100)


@query("fx_products", "SELECT upload_id, id, row_number() OVER (PARTITION BY upload_id ORDER BY source_row, id) AS place FROM fx_products")
def k5_upload_products(t):
    return catalog.upload_products(t("fx_products")).select("upload_id", "id", F.col("place").cast("long").alias("place"))


@query("fx_invitations", "SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY expires_at DESC, id DESC) AS place FROM fx_invitations")
def k5_invitations_newest(t):
    return workspaces.invitations_newest(t("fx_invitations"), "expires_at").select("group_id", "id", F.col("place").cast("long").alias("place"))


@query("fx_products", "SELECT upload_id, 1 - least(min(CASE WHEN confidence >= 0.7e0 THEN 0 ELSE 1 END), 1) AS has_accepted, count(*) AS kept FROM fx_products WHERE confidence >= 0.4e0 GROUP BY 1")
def u1_combine_accepted(t):
    p = t("fx_products")
    both = p.where(F.col("confidence") >= V.ACCEPT).withColumn("tier", F.lit(0)).unionByName(p.where((F.col("confidence") >= V.REVIEW) & (F.col("confidence") < V.ACCEPT)).withColumn("tier", F.lit(1)))
    return both.groupBy("upload_id").agg((1 - F.min("tier")).alias("has_accepted"), F.count("*").alias("kept"))


# --- Search ------------------------------------------------------------------------------------------------------

SEARCHED = ("species", "thickness", "grade", "color", "product")


def asked(t) -> DataFrame:
    """Each different query of each group, numbered by its first id."""
    return t("fx_searches").groupBy("group_id", "query").agg(F.min("id").alias("query_id")).select("query_id", "group_id", "query")


ASKED = "SELECT min(id) AS query_id, group_id, query FROM fx_searches GROUP BY group_id, query"


@query()
def q1_build_postings(t):
    return search.build_postings(t("fx_products"), SEARCHED)


POSTINGS = "SELECT group_id, token, count(*) AS n FROM (SELECT group_id, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS token FROM (" + " UNION ALL ".join(f"SELECT group_id, {c} AS value FROM fx_products" for c in SEARCHED) + ")) GROUP BY 1, 2"


@query("fx_products", POSTINGS)
def q1_token_counts(t):
    return search.build_postings(t("fx_products"), SEARCHED, stem=False).groupBy("group_id", "token").agg(F.count("*").alias("n"))


def stored(t) -> tuple[DataFrame, DataFrame]:
    """The queries asked and the products with what search reads of them, as tables: each tier reads them again."""
    columns = ["group_id", "id", *dict.fromkeys((*SEARCHED, *(c for c in search.WORD_COLUMNS if c in t("fx_products").columns)))]
    return materialize(asked(t), "asked"), materialize(t("fx_products").select(*columns), "searched")


EXPANDED = f"(SELECT list(z[1] ORDER BY z[2]) FROM (SELECT unnest(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2])) AS z))"
PLAIN_TERMS = f"""SELECT query_id, group_id, term_no, regexp_extract_all(lower(CASE WHEN NOT contains(c, ' ') AND regexp_matches(c, '[/&#]') THEN regexp_replace(term, '[^\\w\\s]', '', 'g') ELSE c END), '[a-z0-9]+') AS words FROM (SELECT *, {S.strip("regexp_replace(term, '[^\\w\\s/&#+]', ' ', 'g')")} AS c FROM (
SELECT query_id, group_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS term_no FROM (SELECT query_id, group_id, {EXPANDED}[1:10] AS terms FROM (SELECT *, {_expand_sql('query')} AS l FROM ({ASKED})))))"""


def _bm25(products: str) -> str:
    """BM25 without stems, as common table expressions that end in `bm25`."""
    words = " UNION ALL ".join(f"SELECT group_id, id, {i} AS col, regexp_extract_all(lower({c}), '[a-z0-9]+') AS words FROM {products}" for i, c in enumerate(SEARCHED))
    return f""", places AS MATERIALIZED ({words}), lengths AS (SELECT group_id, id, coalesce(sum(len(words)), 0) AS dl FROM places GROUP BY 1, 2), totals AS (SELECT group_id, count(*) AS docs, avg(dl) AS avgdl FROM lengths GROUP BY 1),
tf AS (SELECT query_id, term_no, group_id, id, count(*) AS tf FROM (SELECT q.query_id, q.term_no, p.group_id, p.id, p.col, p.pos - q.off AS at, any_value(q.m) AS m, count(*) AS k
FROM (SELECT query_id, group_id, term_no, len(words) AS m, unnest(words) AS token, generate_subscripts(words, 1) AS off FROM ({PLAIN_TERMS})) q
JOIN (SELECT group_id, id, col, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM places) p ON p.group_id = q.group_id AND p.token = q.token GROUP BY 1, 2, 3, 4, 5, 6) WHERE k = m GROUP BY 1, 2, 3, 4),
scored AS (SELECT query_id, term_no, id, greatest(1e-6, ln((docs - df + 0.5e0) / (df + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) AS score FROM (SELECT *, count(*) OVER (PARTITION BY query_id, term_no) AS df FROM tf) JOIN lengths USING (group_id, id) JOIN totals USING (group_id)),
bm25 AS (SELECT query_id, id, arg_min(score, term_no) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, term_no ORDER BY score DESC, id) AS r FROM scored) WHERE r <= 200 GROUP BY 1, 2)
"""


@query("fx_products fx_searches", _bm25("fx_products") + "SELECT query_id, id, round(score, 6) AS score FROM bm25")
def q2_bm25_plain(t):
    """Phrase search without stems."""
    return search.bm25_search(*stored(t), SEARCHED, stem=False).withColumn("score", F.round("score", 6))


@query()
def q2_bm25_search(t):
    return search.bm25_search(*stored(t), SEARCHED)


#: Products after a batch of changes: the second rows of uploads are of another species, flagged third rows are gone.
CHANGED = "SELECT group_id, id, CASE WHEN source_row = 2 THEN 'Teak' ELSE species END AS species, thickness, grade, color, product FROM {fx_products} WHERE NOT (source_row = 3 AND is_flagged = 1)"


def kept_index(t, stem: bool) -> str:
    """An index of all products that has then taken the changes: new words of some, others gone."""
    p = t("fx_products")
    path = f"{shared_dir(p.sparkSession)}/index-{dt.datetime.now().timestamp()}"
    index.update_index(path, 0, p, SEARCHED, stem=stem)
    new = p.sparkSession.sql(CHANGED + " AND source_row = 2", fx_products=p)
    index.update_index(path, 1, new, SEARCHED, p.where("source_row = 3 AND is_flagged = 1"), stem=stem)
    return path


@query("fx_products", f", changed AS ({CHANGED.format(fx_products='fx_products')}) SELECT group_id, token, count(*) AS n FROM (SELECT group_id, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS token FROM (" + " UNION ALL ".join(f"SELECT group_id, {c} AS value FROM changed" for c in SEARCHED) + ")) GROUP BY 1, 2")
def q1_index_counts(t):
    return index.live_postings(t("fx_products").sparkSession, kept_index(t, False)).groupBy("group_id", "token").agg(F.count("*").alias("n"))


@query("fx_products fx_searches", f", changed AS ({CHANGED.format(fx_products='fx_products')})" + _bm25("changed") + "SELECT query_id, id, round(score, 6) AS score FROM bm25")
def q2_indexed_search(t):
    """Phrase search in an index that changes have gone into."""
    return index.indexed_search(materialize(asked(t), "asked"), kept_index(t, False), stem=False).withColumn("score", F.round("score", 6))


ASKED_WORDS = f"SELECT query_id, group_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS words FROM ({ASKED})"
PLACES = " UNION ALL ".join(f"SELECT group_id, id, {i} AS col, regexp_extract_all(lower({c}), '[a-z0-9]+') AS words FROM fx_products" for i, c in enumerate(SEARCHED))
PHRASE_HITS = f"""SELECT query_id, id, count(*) AS tf FROM (SELECT q.query_id, p.id, p.col, p.pos - q.off AS at, len(any_value(q.words)) AS m, count(*) AS k
FROM (SELECT query_id, group_id, words, unnest(words) AS token, generate_subscripts(words, 1) AS off FROM ({ASKED_WORDS})) q
JOIN (SELECT group_id, id, col, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM ({PLACES})) p ON p.group_id = q.group_id AND p.token = q.token
GROUP BY 1, 2, 3, 4) WHERE k = m GROUP BY 1, 2"""


@query("fx_products fx_searches", PHRASE_HITS)
def j13_term_postings(t):
    terms = asked(t).select("query_id", "group_id", F.lit(0).alias("term_no"), F.col("query").alias("term"))
    return search.term_postings(terms, search.build_postings(t("fx_products"), SEARCHED, stem=False), stem=False).select("query_id", "id", "tf")


def _inside(cols, x: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), {x}), false)" for c in cols) + ")"


LIKE = f"""SELECT DISTINCT query_id, id FROM (
SELECT query_id, id, row_number() OVER (PARTITION BY query_id, pattern ORDER BY id) AS r FROM (
SELECT q.query_id, pattern, p.id FROM (SELECT query_id, group_id, unnest(list_distinct(list_concat([lower(query)], (SELECT list(z[1] ORDER BY z[2]) FROM (SELECT unnest(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2])) AS z) )[1:5]))) AS pattern FROM (SELECT *, {_expand_sql('query')} AS l FROM ({ASKED}))) q JOIN fx_products p ON p.group_id = q.group_id AND {_inside(("product", "species", "grade"), "q.pattern")}
UNION ALL
SELECT q.query_id, chr(10), p.id FROM (SELECT query_id, group_id, list_filter(string_split(lower(query), ' '), lambda w: length(w) > 2 AND NOT list_contains(['the', 'and', 'for', 'all', 'with', 'any'], w)) AS words FROM ({ASKED})) q JOIN fx_products p ON p.group_id = q.group_id AND len(q.words) >= 2 AND len(list_filter(q.words, lambda w: {_inside(("p.product", "p.species", "p.grade", "p.thickness", "p.mill_name"), "w")})) = len(q.words)
)) WHERE r <= 200"""


@query("fx_products fx_searches", LIKE)
def q3_partial_search(t):
    return search.partial_search(*stored(t))


@query("fx_products fx_searches", f"SELECT q.query_id, p.id FROM ({ASKED}) q JOIN fx_products p ON p.group_id = q.group_id AND {_inside(('product', 'species', 'grade'), 'lower(q.query)')}")
def j14_like_match(t):
    q = asked(t).select("query_id", "group_id", F.lower("query").alias("pattern"))
    return search.like_match(q, t("fx_products"), ("product", "species", "grade")).select("query_id", "id")


@query()
def q4_fuzzy_search(t):
    return search.fuzzy_search(*stored(t))


@query()
def u2_merge_search_tiers(t):
    q, p = stored(t)
    return search.merge_tiers(search.bm25_search(q, p, SEARCHED), search.partial_search(q, p), search.fuzzy_search(q, p))


@query()
def q5_search(t):
    return search.search(*stored(t), SEARCHED)


TIERS = "SELECT query_id, id, min(tier) AS tier, arg_min(score, tier) AS score FROM (SELECT query_id, id, 1 AS tier, score FROM bm25 UNION ALL SELECT query_id, id, 2, 0.5e0 FROM ({like})) GROUP BY 1, 2"


@query("fx_products fx_searches", _bm25("fx_products") + "SELECT query_id, id, CAST(tier AS BIGINT) AS tier, round(score, 6) AS score FROM (" + TIERS.format(like=LIKE) + ")")
def u2_merge_plain_tiers(t):
    """Phrases without stems before substrings."""
    q, p = stored(t)
    return search.merge_tiers(search.bm25_search(q, p, SEARCHED, stem=False), search.partial_search(q, p), None).select("query_id", "id", F.col("tier").cast("long").alias("tier"), F.round("score", 6).alias("score"))


@query("fx_products fx_searches", _bm25("fx_products") + "SELECT query_id, id, tier, round(score, 6) AS score, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM (" + TIERS.format(like=LIKE) + ")) WHERE rank <= 100")
def q5_search_plain(t):
    """The first page of phrases without stems, then substrings; likeness is left out."""
    found = search.search(*stored(t), SEARCHED, stem=False, fuzzy=False)
    return found.select("query_id", "id", "tier", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "total")


@query("fx_products fx_searches", f"SELECT query_id, id, rank, total FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM ({LIKE})) WHERE rank BETWEEN 11 AND 60")
def k4_page_results(t):
    found = search.partial_search(*stored(t)).select("query_id", "id", F.lit(2).alias("tier"), F.lit(0.5).alias("score"))
    return search.page_results(found, 50, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "total")


@query("fx_products fx_searches", f"SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM ({LIKE})) WHERE rank BETWEEN 11 AND 30")
def k4_next_page(t):
    """Twenty results of each query behind its tenth."""
    found = materialize(search.partial_search(*stored(t)).select("query_id", "id", F.lit(2).alias("tier"), F.lit(0.5).alias("score")), "found")
    seen = search.page_results(found, 1, 9).select("query_id", "tier", "score", "id")
    return search.results_after(found.join(seen.select("query_id"), "query_id", "left_semi"), seen, 20).select("query_id", "id")


@query("fx_products fx_searches", f"SELECT s.id, s.user_id, s.query, coalesce(n, 0) AS result_count FROM fx_searches s JOIN ({ASKED}) a ON a.group_id = s.group_id AND a.query = s.query LEFT JOIN (SELECT query_id, count(*) AS n FROM ({LIKE}) GROUP BY 1) r ON r.query_id = a.query_id")
def q6_log_searches(t):
    s = t("fx_searches")
    found = search.partial_search(*stored(t))
    results = s.join(asked(t), ["group_id", "query"]).join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").select("id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    return usage.log_searches(None, s, results).select("id", "user_id", "query", "result_count")


# --- Whole jobs and streams --------------------------------------------------------------------------------------


@query()
def ingest_lists(t):
    """Products of every upload, from its best extraction."""
    return extract.ingest_files(t("fx_lines"), page_words(t), t("fx_grid"))


KEPT = "SELECT *, row_number() OVER (PARTITION BY upload_id, coalesce(lower(species), ''), coalesce(lower(thickness), ''), coalesce(lower(grade), ''), quantity_numeric, coalesce(lower(color), '') ORDER BY confidence DESC, CASE WHEN confidence >= 0.7e0 THEN 0 ELSE 1 END, source_row, id) AS k FROM {} WHERE confidence >= 0.4e0"


@query("fx_products", f"SELECT id FROM ({KEPT.format('fx_products')}) WHERE k = 1")
def u1_accepted_rows(t):
    return extract.combine_accepted(t("fx_products")).select("id")


CHOSEN = """, m AS (SELECT p.*, CASE source_row % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'columns' ELSE 'table' END AS method FROM fx_products p),
c AS (SELECT upload_id, method, row_number() OVER (PARTITION BY upload_id ORDER BY count(*) FILTER (confidence >= 0.4e0) DESC, CASE method WHEN 'table' THEN 0 WHEN 'columns' THEN 1 ELSE 2 END) AS r FROM m GROUP BY 1, 2 HAVING count(*) >= CASE method WHEN 'text' THEN 3 ELSE 5 END),
b AS (SELECT m.* FROM m SEMI JOIN (SELECT * FROM c WHERE r = 1) c USING (upload_id, method)),
"""
REPORT = f"""{CHOSEN}k AS (SELECT upload_id, count(*) AS n, round(sum(CAST(id % 101 AS BIGINT)) / 100e0 / count(*), 3) AS c FROM ({KEPT.format('b')}) WHERE k = 1 GROUP BY 1),
w AS (SELECT upload_id, min(method) AS method, concat_ws('; ', CASE WHEN count(*) FILTER (confidence < 0.4e0) > 0 THEN concat(count(*) FILTER (confidence < 0.4e0), ' rows rejected as non-inventory (contact info, addresses, junk text, etc.)') END, CASE WHEN count(*) FILTER (confidence >= 0.4e0 AND confidence < 0.7e0) > 0 THEN concat(count(*) FILTER (confidence >= 0.4e0 AND confidence < 0.7e0), ' rows flagged for manual review (low confidence)') END) AS warnings FROM b GROUP BY 1)
SELECT u.id, CASE WHEN n > 0 THEN 'parsed' ELSE 'failed' END AS status, coalesce(method, 'text') AS method, coalesce(n, 0) AS row_count, coalesce(c, 0e0) AS confidence, CASE WHEN method IS NULL THEN 'Could not auto-parse structure. Try AI parsing.' END AS error, coalesce(warnings, '') AS warnings, CASE WHEN n > 0 THEN {NOW_SQL} END AS parsed_at
FROM fx_uploads u LEFT JOIN w ON w.upload_id = u.id LEFT JOIN k ON k.upload_id = u.id"""


@query("fx_products fx_uploads", REPORT)
def io7_upload_report(t):
    p = t("fx_products")
    method = p.sparkSession.sql(METHODS, fx_products=p).select("id", "method")
    found = materialize(p.join(method, "id"), "extracted")
    return extract.upload_report(t("fx_uploads"), found, now()).withColumn("warnings", F.array_join("warnings", "; "))


@query()
def st2_rate_limit(t):
    a = t("fx_attempts").select("id", "ip", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"), "failed")
    return jobs.rate_limit(a)


def _stream(df: DataFrame, batches: int = 3) -> tuple[DataFrame, str]:
    """`df` as a stream of files that come in some batches, as Spark wrote them, and a folder of its own."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{dt.datetime.now().timestamp()}"
    df.write.parquet(f"{base}/in")
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(f"{base}/in"), base


@query()
def st1_stream_ingest(t):
    """Lines as they lie in their table, so that uploads come in parts; some uploads come twice, changed."""
    lines_ = t("fx_lines")
    again = lines_.join(t("fx_uploads").where("status = 'failed'").select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
    again = again.select("upload_id", F.lit(1).alias("delivery"), "line_no", F.replace("text", F.lit("4/4"), F.lit("8/4")).alias("text"))
    stream, base = _stream(lines_.select("upload_id", F.lit(0).alias("delivery"), "line_no", "text").unionByName(again))
    ingest.stream_ingest(stream, f"{base}/out", f"{base}/state", now()).awaitTermination()
    return ingest.latest_rows(lines_.sparkSession, f"{base}/out")


@query("fx_activity", "SELECT CAST(created_at AS DATE) AS day, action, count(*) AS n FROM fx_activity GROUP BY 1, 2")
def st3_stream_daily_counts(t):
    rows = t("fx_activity").select("action", F.col("created_at").cast("timestamp").alias("created_at"))
    spark = rows.sparkSession
    stream, base = _stream(rows)
    counts = jobs.stream_daily_counts(stream, "created_at", late="60 days")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("day", "action").agg(F.max_by("n", "batch").alias("n"))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: stock lists to scored products, and their most common species; of the tables that the session names, else
    the smallest."""
    sf_dir = spark.conf.get("spark.boardfoot.data", "/root/testdata/sf0.001")
    return catalog.top_values(QUERIES["ingest_lists"](spark, sf_dir), "species")
