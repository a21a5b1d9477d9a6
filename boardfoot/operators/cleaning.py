"""Document text to lines that may be stock, and what the head of a list tells of its mill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardfoot.functions import vocabulary as V
from boardfoot.functions.text import any_match, filled, found, strip, title


def document_lines(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line_no, text): trimmed lines that are not blank, with the number they had."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("line_no", "text"))
    return lines.select(id_col, F.col("line_no").cast("long").alias("line_no"), strip(F.col("text")).alias("text")).where("text <> ''")


def needs_ocr(text: Column, least: int = 50) -> Column:
    """A document with less text than this is a scan."""
    return F.length(strip(F.coalesce(text, F.lit("")))) < least


def is_junk_line(x: Column) -> Column:
    return any_match(x, V.JUNK)


def is_noise(x: Column) -> Column:
    t = strip(x)
    return x.isNull() | (F.length(t) < 2) | any_match(t, V.NOISE)


def has_species_word(x: Column) -> Column:
    return F.lower(x).rlike("|".join(V.SPECIES_WORDS))


def is_all_species(x: Column) -> Column:
    """Four in five of the parts between wide gaps hold a species word."""
    parts = F.split(strip(x), r"\s{2,}")
    return F.size(F.filter(parts, has_species_word)) >= F.size(parts) * 0.8


def may_be_stock(x: Column) -> Column:
    return ~is_junk_line(x) & (F.length(x) >= 4)


def is_shouted(x: Column) -> Column:
    """A long title in capitals."""
    return (x == F.upper(x)) & ~x.rlike(r"\d") & (F.length(x) > 30) & ~has_species_word(x)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_no, text) that may be stock: no junk, 4 characters, no long title in capitals below the head."""
    x = F.col("text")
    return lines.where(may_be_stock(x) & ~((F.col("line_no") > 3) & is_shouted(x)))


def is_bad_mill_name(x: Column) -> Column:
    n = F.lower(strip(x))
    words = F.filter(F.split(n, r"\s+"), lambda w: w != "")
    named = F.size(F.filter(words, lambda w: w.isin(*V.SPECIES_WORDS)))
    species = (named >= F.size(words) * 0.7) & (F.size(words) >= 2)
    return filled(x).isNull() | n.rlike(r"\.(com|net|org|io)\b") | F.contains(n, F.lit("@")) | (F.length(n) < 4) | species | n.rlike(r"\b(email|phone|fax|http|www)\b")


def is_valid_mill_name(x: Column) -> Column:
    """The check of names that a language model gives."""
    n = F.lower(strip(x))
    return F.coalesce((F.length(n) >= 3) & ~n.rlike(r"[@.](com|net|org|io)\b") & ~n.rlike(r"https?://"), F.lit(False))


def head_metadata(lines: DataFrame, id_col: str, head: int = 25) -> DataFrame:
    """(id, line_no, stock_date, email, phone, location, names) of the first lines; names: candidates with their rank."""
    x = F.col("text")
    name = F.regexp_replace(x, r"(?:https?://|www\.)\S+", "")
    name = F.regexp_replace(strip(name), r"(?i)\w+\.(com|net|org)\b\S*", "")
    name = strip(F.regexp_replace(strip(name), V.PHONE, ""))
    name = F.regexp_replace(name, r"[\s,]+$", "")
    named = F.when(x.rlike(V.MILL_WORD) & ~x.rlike(r"[\w.+-]+@") & (F.length(name) > 3), F.struct(F.col("line_no").alias("rank"), name.alias("name")))
    host = found(x, r"(?i)(?:https?://|www\.)([\w-]+)\.(?:com|net|org)", 1)
    spaced = strip(F.replace(F.regexp_replace(host, "([a-z])([A-Z])", "$1 $2"), F.lit("-"), F.lit(" ")))
    good = (F.length(spaced) > 3) & ~F.lower(spaced).isin("google", "facebook", "instagram")
    hosted = F.when(good, F.struct((F.col("line_no") + 100).alias("rank"), title(spaced).alias("name")))
    names = F.filter(F.array(named, hosted), lambda s: s.isNotNull())
    return lines.where(F.col("line_no") < head).select(id_col, "line_no", found(x, V.DATE, 1).alias("stock_date"), found(x, V.EMAIL).alias("email"), found(x, V.PHONE).alias("phone"), found(x, f"({V.CITY_STATE_ZIP})", 1).alias("location"), names.alias("names"))


def mill_from_filename(name: Column) -> Column:
    """What is left of a file name without its ending, list words and dates; null if that is too short or a hash."""
    drop = lambda x, p: F.regexp_replace(x, p, "")
    n = drop(name, r"(?i)\.[a-z]+$")
    n = drop(n, r"(?i)[\s_-]*(?:stock\s*(?:list|sheet)|send\s*out\s*inventory|inventory|kd|send\s*out|cam|stocklist)\b.*$")
    n = drop(n, r"[\s_-]*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s*$")
    n = drop(n, r"(?i)[\s_-]*(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s*\d{2,4}\s*$")
    n = drop(n, r"[\s_-]*\d{6,8}\s*$")
    n = strip(F.regexp_replace(F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " "))
    n = strip(F.regexp_replace(strip(drop(n, r"(?i)\b(Send Out|SendOut|Inventory|Stock)\b")), r"\s{2,}", " "))
    return F.when((F.length(n) > 3) & ~F.replace(n, F.lit(" "), F.lit("")).rlike("^[0-9a-f]{20,}$"), n)


def file_metadata(lines: DataFrame, files: DataFrame, id_col: str = "upload_id") -> DataFrame:
    """Per file: first date, e-mail, phone and location, and its mill: the best name of the head, else of the file's name."""
    m = head_metadata(lines, id_col)
    facts = m.groupBy(id_col).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in ("stock_date", "email", "phone", "location")])
    names = m.select(id_col, F.explode("names").alias("n")).select(id_col, "n.*")
    names = names.where(~is_all_species(F.col("name")) & (F.length("name") <= 80) & ~F.col("name").rlike(r"^\d"))
    best = names.groupBy(id_col).agg(F.min_by("name", "rank").alias("head_name"))
    out = files.select(F.col("id").alias(id_col), "original_filename").join(facts, id_col, "left").join(best, id_col, "left")
    mill = F.coalesce("head_name", mill_from_filename(F.col("original_filename")))
    return out.select(id_col, "stock_date", "email", "phone", "location", F.when(~is_bad_mill_name(mill), mill).alias("mill_name"))


def file_type(name: Column) -> Column:
    """pdf, excel, csv or unknown by the ending."""
    end = F.lower(found(name, r"\.([^.]+)$", 1))
    return F.when(end == "pdf", "pdf").when(end.isin("xlsx", "xls"), "excel").when(end == "csv", "csv").otherwise("unknown")
