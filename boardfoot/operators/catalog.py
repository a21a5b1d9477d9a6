"""Products, uploads and mills: listings, facets, counts and rewrites. A request for one tenant is a job over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardfoot.operators.search import containing
from boardfoot.plans.shared import materialize, numbered

SORTABLE = ("id", "species", "thickness", "grade", "mill_name", "quantity_numeric", "confidence", "created_at")


def newest(key: str, *ties: str) -> list[Column]:
    return [F.desc(key), *[F.desc(t) for t in ties]]


def list_products(products: DataFrame, group_id=None, upload_id=None, mill=None, species=None, grade=None, thickness=None, flagged=False, unreviewed=False, sort="id", descending=False, offset=0, limit=100) -> tuple[DataFrame, DataFrame]:
    """(page, total): products that meet all filters given, in the order asked for with id last. Sort columns are a fixed list."""
    tests = []
    for column, value in (("group_id", group_id), ("upload_id", upload_id), ("thickness", thickness)):
        if value is not None:
            tests.append(F.col(column) == value)
    for column, value in (("mill_name", mill), ("species", species), ("grade", grade)):
        if value:
            tests.append(F.contains(F.lower(column), F.lit(value.lower())))
    if flagged:
        tests.append(F.col("is_flagged") == 1)
    if unreviewed:
        tests.append(F.col("is_reviewed") == 0)
    for t in tests:
        products = products.where(t)
    return products.orderBy(*_order(sort, descending)).offset(offset).limit(limit), products.agg(F.count("*").alias("total"))


def _order(sort: str, descending: bool) -> list[Column]:
    """An order over a whitelisted column, ties by id."""
    column = sort if sort in SORTABLE else "id"
    return [F.desc_nulls_last(column) if descending else F.asc_nulls_first(column), F.asc("id")]


def products_after(products: DataFrame, last: dict | None, sort: str = "id", descending: bool = False, limit: int = 100) -> DataFrame:
    """The page behind the row `last` (its id and sort column; None: the first page). However deep, a page is a filter and the
    first `limit` of what it leaves: no rows before it are sorted, shuffled or counted."""
    column = sort if sort in SORTABLE else "id"
    if last is not None:
        x, v = F.col(column), F.lit(last[column])
        if last[column] is None:
            beyond = (x.isNull() & (F.col("id") > last["id"])) | (x.isNotNull() & F.lit(not descending))
        else:
            further = (x < v) | x.isNull() if descending else x > v
            beyond = further | ((x == v) & (F.col("id") > last["id"]))
        products = products.where(beyond)
    return products.orderBy(*_order(sort, descending)).limit(limit)


def placed_products(products: DataFrame, sort: str = "id", descending: bool = False) -> DataFrame:
    """All products with their place (from 0) in an order, written in that order: any page is a range of places, and the files
    outside it are skipped by their bounds."""
    return materialize(numbered(products, _order(sort, descending), "place").sortWithinPartitions("place"), "placed")


def page_at(placed: DataFrame, offset: int, limit: int = 100) -> DataFrame:
    return placed.where(F.col("place").between(offset, offset + limit - 1))


def review_queue(products: DataFrame, least: float = 0.5) -> DataFrame:
    """Products of low confidence, unreviewed or flagged, with why."""
    low, open_, flag = F.col("confidence") < least, F.col("is_reviewed") == 0, F.col("is_flagged") == 1
    return products.where(low | open_ | flag).select("id", "group_id", low.cast("int").alias("low"), open_.cast("int").alias("unreviewed"), flag.cast("int").alias("flagged"))


def catalog_stats(products: DataFrame) -> DataFrame:
    """Per group in one pass: products, uploads, mills, species, low-confidence and unreviewed rows."""
    return products.groupBy("group_id").agg(F.count("*").alias("products"), F.countDistinct("upload_id").alias("uploads"), F.countDistinct("mill_name").alias("mills"), F.countDistinct("species").alias("species"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence"), F.count_if(F.col("is_reviewed") == 0).alias("unreviewed"))


def top_values(products: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most common values, ties by value."""
    return products.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def facets(products: DataFrame, columns=("species", "thickness", "grade", "mill_name")) -> DataFrame:
    """Distinct values of each facet in each group."""
    long = products.unpivot(["group_id"], list(columns), "facet", "value")
    return long.where(F.col("value").isNotNull()).distinct()


def mills_with_counts(mills: DataFrame, products: DataFrame) -> DataFrame:
    """Each mill with its number of products. Products without a mill, a hot key, are dropped before counting."""
    counts = products.where(F.col("mill_id").isNotNull()).groupBy("mill_id").agg(F.count("*").alias("products"))
    return mills.join(counts, mills.id == counts.mill_id, "left").select("id", "group_id", "name", F.coalesce("products", F.lit(0)).alias("products"))


#: What is known of a mill besides its name.
CONTACT = ("location", "phone", "email", "contact_name")


def upsert_mills(mills: DataFrame, seen: DataFrame) -> DataFrame:
    """`mills` with a row for each (group, trimmed name) in `seen` that they lack; new ids follow the largest there is.

    `seen`: group_id, name, upload_id and what is known of CONTACT; names are cut at 100 characters and blank ones left out. A new
    mill has the contact fields of its first upload, null ones too, and its number by first upload, group and name; mills that are
    there stay as they are. Only distinct names are joined, and new mills are numbered without a task that sees all of them.
    """
    told = [c for c in CONTACT if c in seen.columns]
    name = F.substring(F.trim("name"), 1, 100)
    of_first = F.min(F.struct("upload_id", *told)).alias("first")
    new = seen.select("group_id", name.alias("name"), "upload_id", *told).where(F.col("name") != "").groupBy("group_id", "name").agg(of_first)
    new = new.join(mills.select("group_id", "name"), ["group_id", "name"], "left_anti").select("group_id", "name", "first.*")
    top = mills.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(new, ["upload_id", "group_id", "name"], "id", top + 1)
    columns = ["id", "group_id", "name", *told]
    return mills.select(*[c for c in columns if c in mills.columns]).unionByName(new.select(*columns), allowMissingColumns=True)


def accepted_changes(products: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes (id, group_id, action, mill) of groups all of whose ids are products (id, group_id) of theirs."""
    known = changes.join(products.select("id", "group_id"), ["id", "group_id"], "left_semi")
    asked = changes.groupBy("group_id").agg(F.count("*").alias("asked"))
    fine = known.groupBy("group_id").agg(F.count("*").alias("found")).join(asked, "group_id").where("found = asked").select("group_id")
    return known.join(fine, "group_id", "left_semi").select("id", "action", "mill")


def apply_changes(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Products after changes (id, action, mill): review, flag, unflag, delete or set_mill."""
    out = products.join(changes, "id", "left").where(F.coalesce(F.col("action") != "delete", F.lit(True)))
    reviewed = F.when(F.col("action") == "review", 1).otherwise(F.col("is_reviewed"))
    flagged = F.when(F.col("action") == "flag", 1).when(F.col("action") == "unflag", 0).otherwise(F.col("is_flagged"))
    mill = F.when(F.col("action") == "set_mill", F.col("mill")).otherwise(F.col("mill_name"))
    return out.withColumns({"is_reviewed": reviewed, "is_flagged": flagged, "mill_name": mill}).select(*products.columns)


def bulk_update(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Products after changes (id, group_id, action, mill): review, flag, unflag, delete or set_mill. A group's changes are refused
    whole if one of its ids is not in the group; one id has one change."""
    return apply_changes(products, accepted_changes(products, changes))


def delete_uploads(uploads: DataFrame, products: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads and products without those of the uploads (id, group_id) in `gone`."""
    gone = gone.join(uploads, ["id", "group_id"], "left_semi").select("id", "group_id")
    return uploads.join(gone, ["id", "group_id"], "left_anti"), products.join(gone.select(F.col("id").alias("upload_id")), "upload_id", "left_anti")


def correct_products(products: DataFrame, corrections: DataFrame, build) -> DataFrame:
    """Products with the corrected fields (id, species, thickness, grade; null: as it was) and their product text built again."""
    fields = ("species", "thickness", "grade")
    fixed = corrections.select("id", *[F.col(f).alias(f"new_{f}") for f in fields])
    out = products.join(fixed, "id", "left")
    changed = F.coalesce(*[F.col(f"new_{f}") for f in fields]).isNotNull()
    out = out.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields})
    return out.withColumn("product", F.when(changed, build).otherwise(F.col("product"))).select(*products.columns)


def rename_mill(products: DataFrame, names: DataFrame) -> DataFrame:
    """Products with the new mill name of their upload (upload_id, new_name)."""
    return products.join(names, "upload_id", "left").withColumn("mill_name", F.coalesce("new_name", "mill_name")).select(*products.columns)


def append_products(parsed: DataFrame, uploads: DataFrame, mills: DataFrame) -> DataFrame:
    """Parsed rows (upload_id, mill_name and fields) with their upload's group and their mill's id; a row without a mill is of 'Unknown Mill'."""
    name = F.coalesce(F.nullif("mill_name", F.lit("")), F.lit("Unknown Mill"))
    rows = parsed.withColumn("mill_name", name).join(uploads.select(F.col("id").alias("upload_id"), "group_id"), "upload_id")
    return rows.join(mills.select("group_id", F.col("name").alias("mill_name"), F.col("id").alias("mill_id")), ["group_id", "mill_name"], "left")


def replace_upload_rows(products: DataFrame, fresh: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """`products` with all rows of the uploads in `fresh` replaced by those there. The mill is the new name, else the old, else unknown.
    `uploads` (upload_id) names uploads parsed again, also those in which nothing was found now."""
    old = products.where(F.col("mill_name") != "Unknown Mill").groupBy("upload_id").agg(F.min("mill_name").alias("old_name"))
    rows = fresh.join(old, "upload_id", "left").withColumn("mill_name", F.coalesce("mill_name", "old_name", F.lit("Unknown Mill")))
    again = fresh.select("upload_id") if uploads is None else fresh.select("upload_id").unionByName(uploads.select("upload_id"))
    kept = products.join(again.distinct(), "upload_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(rows.select(*fresh.columns))


def upload_summary(uploads: DataFrame, rows: DataFrame) -> DataFrame:
    """Per upload: status, number of rows and mean confidence to 3 places."""
    per = rows.groupBy("upload_id").agg(F.count("*").alias("row_count"), F.round(F.avg(F.col("confidence").cast("decimal(10,3)")), 3).cast("double").alias("parsing_confidence"))
    out = uploads.join(per, uploads.id == per.upload_id, "left")
    return out.select("id", F.when(F.col("row_count") > 0, "parsed").otherwise("failed").alias("status"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("parsing_confidence", F.lit(0.0)).alias("parsing_confidence"))


def upload_products(products: DataFrame) -> DataFrame:
    """An upload's products numbered from 1 in the order of their source rows, ties by id."""
    return products.withColumn("place", F.row_number().over(Window.partitionBy("upload_id").orderBy("source_row", "id")))


def suggest(products: DataFrame, asked: DataFrame, n: int = 10) -> DataFrame:
    """For each query (id, query): the first `n` species, grades and thicknesses that hold its text, in order.

    Distinct values are few beside products, and are what the queries are compared with.
    """
    values = products.unpivot([], ["species", "grade", "thickness"], "facet", "value").select("value").where(F.col("value").isNotNull()).distinct()
    queries = asked.select("query", F.lower("query").alias("pattern")).distinct()
    hits = queries.join(containing(queries, values), "pattern").select("query", "value")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("value"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n)


def recent_per_key(events: DataFrame, key: str, when: str, n: int = 20) -> DataFrame:
    """The `n` latest rows of each key, ties by id."""
    return events.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when), F.desc("id")))).where(F.col("rank") <= n)
