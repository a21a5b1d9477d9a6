"""Text lines to product rows: section headers carry their species down to the lines below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.functions import vocabulary as V
from boardfoot.functions.normalize import normalize_grade, normalize_species, normalize_thickness, product_string
from boardfoot.functions.text import filled, found, let, strip, title
from boardfoot.operators.cleaning import is_noise, is_shouted, may_be_stock
from boardfoot.operators.scoring import classify, dedupe_rows, is_candidate, row_score
from boardfoot.plans.shared import materialize, once_each

PARTS = ("thickness", "grade", "quantity", "quantity_numeric", "description", "length", "surface", "color", "cut_type", "treatment")


def header_text(x: Column) -> Column:
    """A header without what dresses it: stars, dashes, colons."""
    return F.regexp_replace(F.regexp_replace(strip(x), ":+$", ""), r"^[*\- ]+|[*\- ]+$", "")


def is_species_header(x: Column) -> Column:
    names = "|".join(n.replace("&", r"\&") for n in V.HEADER_NAMES)

    def known(t: Column) -> Column:
        words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        short = let(words, lambda w: (F.size(w) <= 5) & F.arrays_overlap(w, F.array(*[F.lit(h) for h in V.HEADER_WORDS])))
        return (t != "") & (F.lower(t).isin(*V.SPECIES) | t.rlike(f"^(?:{names})(?: |:|$)") | ((F.length(t) < 50) & ~t.rlike(r"\d") & short))

    return F.coalesce(let(F.upper(header_text(x)), known), F.lit(False))


def split_multicolumn(x: Column) -> Column:
    """The parts of a line that holds several products side by side; else the line."""
    several = F.regexp_count(x, F.lit(V.ANY_FRACTION)) >= 2
    parts = F.filter(F.transform(F.split(x, r"\s{3,}"), strip), lambda s: F.length(s) > 3)
    return let(parts, lambda p: F.when(several & (F.size(p) >= 2), p).otherwise(F.array(x)))


def pieces(x: Column) -> Column:
    """The pieces of a line."""
    parts = F.filter(F.transform(F.split(x, r"\s{3,}"), strip), lambda s: s != "")
    heads = let(parts, lambda p: F.when(F.forall(p, is_species_header) & (F.size(p) > 0), F.slice(p, 1, 1)))
    return F.coalesce(heads, F.when(is_species_header(x), F.array(x)), split_multicolumn(x))


def segments(lines: DataFrame) -> DataFrame:
    """(upload_id, line_no, seg, text, header): pieces of each line. A line of headers only is its first header."""
    out = lines.select("upload_id", "line_no", F.posexplode(pieces(F.col("text"))).alias("seg", "text"))
    return out.withColumn("header", F.when(is_species_header(F.col("text")), normalize_species(header_text(F.col("text")))))


def carry_species(rows: DataFrame, *order: str, by: tuple[str, ...] = ("upload_id",)) -> DataFrame:
    """Rows with the last header above them as species."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("species", F.last("header", ignorenulls=True).over(w))


def without(x: Column, value: Column) -> Column:
    """`x` without a found value, in any letter case."""
    return F.regexp_replace(x, F.coalesce(F.concat(F.lit(r"(?iu)\Q"), value, F.lit(r"\E")), F.lit("$^")), F.lit(""))


def with_grade_parts(df: DataFrame, text: str) -> DataFrame:
    """`df` with length, surface, color, cut_type and treatment of column `text`, and as grade what is left of it."""
    x = F.col(text)
    df = df.withColumns({"length": strip(found(x, V.LENGTH_AT_END, 1)), "_body": F.when(x.rlike(V.LENGTH_AT_END), strip(F.regexp_replace(x, V.LENGTH_AT_END, ""))).otherwise(x)})
    body = F.col("_body")
    df = df.withColumns({"surface": strip(found(body, V.SURFACE, 1)), "color": title(strip(found(body, V.COLOR, 1))), "cut_type": title(strip(found(body, V.CUT, 1))), "treatment": strip(found(body, V.TREATMENT, 1))})
    rest = body
    for k in ("length", "color", "cut_type", "treatment"):
        rest = without(rest, F.col(k))
    for p in V.NOT_GRADE:
        rest = F.regexp_replace(rest, p, "")
    rest = strip(F.regexp_replace(strip(F.regexp_replace(rest, r"""[,"\s]+""", " ")), "^-+|-+$", ""))
    return df.withColumn("grade", normalize_grade(rest)).drop("_body")


def parse_product_line(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the fields of a product line, product and format (A, D, B, C, F: a fraction somewhere, G: a grade and a
    number; null if none): PARTS and product. The line's formats are tried in that order."""
    x = F.col(text)
    form = F.when(is_noise(x) | (F.length(x) < 3), None)
    for k, p in (("A", V.LINE_A), ("D", V.LINE_D), ("B", V.LINE_B), ("C", V.LINE_C), ("F", V.ANY_FRACTION)):
        form = form.when(x.rlike(p), k)
    form = form.when(x.rlike(V.GRADE_WITH_NUMBER) & x.rlike(r"\d"), "G")
    df = df.withColumn("format", form)
    f = F.col("format")
    get = lambda p, g: F.regexp_extract(x, p, g)
    df = df.withColumn("_tail", F.when(f == "C", strip(get(V.LINE_C, 2))))
    tail = F.col("_tail")
    df = df.withColumn("_end", F.regexp_replace(F.regexp_extract(tail, V.LAST_NUMBER, 1), ",", "").try_cast("double"))
    at_end = F.col("_end")
    number = F.when(f == "A", F.regexp_replace(get(V.LINE_A, 1), ",", "").try_cast("double")).when((f == "C") & (at_end > 10), at_end)
    rest = F.when(f == "A", strip(get(V.LINE_A, 3))).when(f == "D", strip(get(V.LINE_D, 3))).when(f == "B", strip(get(V.LINE_B, 3)))
    rest = rest.when(f == "C", F.when(at_end > 10, strip(F.regexp_replace(tail, V.LAST_NUMBER, ""))).otherwise(tail))
    thickness = F.when(f == "A", get(V.LINE_A, 2)).when(f == "D", get(V.LINE_D, 2)).when(f == "B", get(V.LINE_B, 2)).when(f == "C", get(V.LINE_C, 1)).when(f == "F", get(V.ANY_FRACTION, 1))
    df = df.withColumns({"quantity_numeric": number, "_rest": rest, "thickness": normalize_thickness(thickness)})
    df = df.withColumn("_rest", filled(F.col("_rest")))
    feet = F.concat(F.format_number(F.col("quantity_numeric").cast("long"), 0), F.lit(" BF"))
    quantity = F.when(F.col("quantity_numeric").isNotNull(), feet).when(f == "D", F.concat(get(V.LINE_D, 1), F.lit(" T/L"))).when(f == "B", F.replace(F.upper(get(V.LINE_B, 1)), F.lit("TL"), F.lit("T/L")))
    df = with_grade_parts(df.withColumn("quantity", quantity), "_rest")
    df = df.withColumns({"description": F.when(f.isin("F", "G"), x).otherwise(F.col("_rest")), "product": F.when(f.isNotNull(), x)})
    return df.drop("_rest", "_tail", "_end")


def text_facts(texts: DataFrame) -> DataFrame:
    """`texts` with header, the species that a text heads a section with, and likely, whether it looks like stock."""
    x = F.col("text")
    return texts.withColumns({"header": F.when(is_species_header(x), normalize_species(header_text(x))), "likely": is_candidate(x, 0.15)})


def scored_products(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Those `rows` (text, species) that are product lines, with their fields and confidence. What a text says is worked out once a
    different text; the texts are all in `of`. Of the species the score asks only whether there is one, so a text has both scores."""

    def said(texts: DataFrame) -> DataFrame:
        found = parse_product_line(texts).where(F.col("format").isNotNull())
        fields = {k: F.col(k) for k in PARTS} | {"raw_text": F.col("text")}
        return found.withColumns({"_named": row_score(fields | {"species": F.lit("x")}), "_bare": row_score(fields)})

    rows = once_each(rows, ["text"], said, of)
    confidence = F.when(filled(F.col("species")).isNotNull(), F.col("_named")).otherwise(F.col("_bare"))
    fields = {k: F.col(k) for k in (*PARTS, "species")}
    rows = rows.withColumns({"confidence": confidence, "product_normalized": product_string(fields, F.col("product"))}).drop("_named", "_bare", "likely")
    return rows.withColumn("class", classify(F.col("confidence")))


def parse_lists(lines: DataFrame) -> DataFrame:
    """Lines (upload_id, line_no, text) of stock lists to scored product rows, in one shuffle on upload_id.

    Lines are written once, and what depends on their text alone is worked out once a different text. Only headers and what looks
    like stock is shuffled.
    """
    lines = materialize(lines.select("upload_id", "line_no", "text"), "lines")
    x = F.col("text")
    kept = once_each(lines, ["text"], {"_kept": may_be_stock(x), "_shouted": is_shouted(x), "_pieces": pieces(x)})
    kept = kept.where(F.col("_kept") & ~((F.col("line_no") > 3) & F.col("_shouted"))).select("upload_id", "line_no", F.posexplode("_pieces").alias("seg", "text"))
    kept = once_each(kept, ["text"], text_facts).where(F.col("header").isNotNull() | F.col("likely"))
    rows = carry_species(kept.repartition("upload_id"), "line_no", "seg").where(F.col("header").isNull())
    rows = scored_products(rows, kept)
    order = Window.partitionBy("upload_id").orderBy("line_no", "seg")
    return rows.withColumn("source_row", (F.row_number().over(order) - 1).cast("int"))


def ingest(lines: DataFrame) -> DataFrame:
    """Scored rows without rejects and doubles."""
    rows = parse_lists(lines).where(F.col("class") != "reject")
    return dedupe_rows(rows.withColumn("id", F.col("line_no") * 100 + F.col("seg")))
