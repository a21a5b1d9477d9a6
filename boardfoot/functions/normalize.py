"""Thickness, grade, species and quantity in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.functions import vocabulary as V
from boardfoot.functions.text import filled, found, let, lookup, strip, title
from boardfoot.plans.shared import broadcast_if_small


def normalize_thickness(raw: Column) -> Column:
    def spelled(low: Column) -> Column:
        return F.when(low != "", F.coalesce(lookup(V.THICKNESS, low), found(low, r"^(\d+/\d+)", 1), F.upper(low)))

    return let(F.lower(strip(raw)), spelled)


def normalize_grade(raw: Column) -> Column:
    return let(strip(raw), lambda s: F.when(s != "", F.coalesce(lookup(V.GRADES, F.lower(s)), s)))


def normalize_species(raw: Column) -> Column:
    """Exact spelling, else the first known name that holds the text or is held by it, else title case. Blank is null."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in V.SPECIES.items()])

    def spelled(s: Column) -> Column:
        return let(F.regexp_replace(F.lower(s), ":+$", ""), lambda low: F.when(low != "", F.coalesce(lookup(V.SPECIES, low), near(low), title(s))))

    def near(low: Column) -> Column:
        return F.try_element_at(F.filter(known, lambda e: F.contains(low, e["k"]) | F.contains(e["k"], low)), F.lit(1))["v"]

    return let(strip(raw), spelled)


def with_species(df: DataFrame, raw: str, out: str, max_values: int = 100_000) -> DataFrame:
    """`df` with the normal spelling of column `raw`, worked out once a distinct value."""
    values = df.select(raw).where(F.col(raw).isNotNull()).distinct().withColumn(out, normalize_species(F.col(raw)))
    return df.join(broadcast_if_small(values, max_values), raw, "left")


def normalize_quantity(raw: Column) -> Column:
    """struct(numeric, text): the first number, and the text without commas and foot marks."""
    text = F.regexp_replace(strip(raw), "[,']", "")
    number = found(text, r"([\d.]+)", 1).try_cast("double")
    word = F.when(number.isNull() & F.upper(text).isin("CALL", "T/L", "TL"), F.upper(text)).otherwise(text)
    real = filled(raw).isNotNull()
    return F.struct(F.when(real, number).alias("numeric"), F.when(real, word).alias("text"))


def product_string(c: dict[str, Column], fallback: Column) -> Column:
    """The filled parts in their order, a space between; `fallback` if there is none."""
    parts = [filled(c[k]) for k in ("thickness", "species", "grade", "color", "cut_type", "surface", "treatment", "length") if k in c]
    return F.coalesce(filled(F.concat_ws(" ", *parts)), fallback)


def extract_thickness(text: Column) -> Column:
    return normalize_thickness(found(text, r"\b(\d{1,2}/\d)\b", 1))


def extract_quantity(text: Column) -> Column:
    """struct(numeric, text) of a number at the start, as board feet."""
    digits = F.regexp_replace(found(text, r"^([\d,]+)'?\s", 1), ",", "")
    number = digits.try_cast("double")
    return F.struct(number.alias("numeric"), F.when(number.isNotNull(), F.concat(digits, F.lit(" BF"))).alias("text"))


def slugify(name: Column) -> Column:
    """Small letters, words joined by single dashes."""
    s = F.regexp_replace(F.lower(strip(name)), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")
