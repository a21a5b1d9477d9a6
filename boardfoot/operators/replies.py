"""Stored replies of a language model to product rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.functions.normalize import normalize_grade, normalize_species, normalize_thickness
from boardfoot.functions.text import strip
from boardfoot.operators.cleaning import is_noise
from boardfoot.operators.scoring import classify, row_score

TEXTS = ("species", "thickness", "grade", "quantity", "quantity_numeric", "price", "length", "width", "surface", "color", "cut_type", "treatment", "notes", "description", "raw_text")
SCHEMA = "mill_name string, stock_date string, products array<struct<" + ", ".join(f"{t}: string" for t in TEXTS) + ">>"
# Texts that stand for nothing.
EMPTY = ("", "null", "none", "n/a", "na", "-")


def truncate_text(text: Column, most: int = 15_000) -> Column:
    """struct(text, cut): the first characters and a mark, and whether any were cut."""
    cut = F.length(text) > most
    return F.struct(F.when(cut, F.concat(F.substring(text, 1, most), F.lit("\n[TRUNCATED]"))).otherwise(text).alias("text"), F.coalesce(cut, F.lit(False)).cast("int").alias("cut"))


def repaired(reply: Column) -> Column:
    """The first balanced object of a reply, without commas before closing brackets; null if that is no JSON."""
    return F.pandas_udf(_first_objects, "string")(reply)


def _first_objects(replies: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        start = (text or "").find("{")
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text or "")) if start >= 0 else ():
            c = text[i]
            if quoted:
                quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
                continue
            quoted = c == '"'
            depth += (c == "{") - (c == "}")
            if depth == 0:
                body = re.sub(r",\s*([}\]])", r"\1", text[start : i + 1])
                try:
                    return json.dumps(json.loads(body))
                except ValueError:
                    return None
        return None

    return replies.map(one)


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """`df` with column parsed: the reply as JSON, else what a fence holds, else its first object, repaired."""
    whole = F.from_json(F.col(reply), SCHEMA)
    fenced = F.from_json(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), SCHEMA)
    df = df.withColumn("parsed", F.coalesce(F.when(whole["products"].isNotNull(), whole), F.when(fenced["products"].isNotNull(), fenced)))
    bad = df.where("parsed is null").withColumn("parsed", F.from_json(repaired(F.col(reply)), SCHEMA))
    return df.where("parsed is not null").unionByName(bad)


def clean_field(x: Column) -> Column:
    s = strip(x)
    return F.when(~F.lower(s).isin(*EMPTY), s)


def explode_replies(df: DataFrame) -> DataFrame:
    """(upload_id, source_row, fields, confidence, class) of the products in `parsed`; noise, empty and rejected rows go."""
    p = df.select("upload_id", F.posexplode("parsed.products").alias("source_row", "p")).select("upload_id", "source_row", *[clean_field(F.col("p")[t]).alias(t) for t in TEXTS])
    number = F.col("quantity_numeric").try_cast("double")
    p = p.withColumns({"species": normalize_species(F.col("species")), "thickness": normalize_thickness(F.col("thickness")), "grade": normalize_grade(F.col("grade")), "quantity_numeric": F.when(number > 0, number)})
    some = F.coalesce("species", "thickness", "grade", "quantity", F.col("quantity_numeric").cast("string")).isNotNull()
    p = p.where(~is_noise(F.col("raw_text")) & some)
    p = p.withColumn("confidence", row_score({t: F.col(t) for t in TEXTS}))
    return p.withColumn("class", classify(F.col("confidence"))).where("class <> 'reject'")
