"""Stock lists that arrive in parts: lines are kept by upload until all parts are there, and each batch parses again what it touched.

Everything lies below one folder, in a generation: ``lines``, ``rows`` and ``uploads``, each with a folder a batch. A batch writes
only its own folders, so one that runs again after a failure replaces what it wrote. ``uploads`` has a row for each upload that a
batch touched, also if nothing was found in it; the newest such row tells which batch's rows count. `compact` writes what counts into
a new generation and marks it when it is whole; from then on readers and batches use that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardfoot.operators.extract import SCHEMA, combine_accepted, extractions, upload_report
from boardfoot.plans.shared import broadcast_if_small, delete_folder, folder_exists, newest_generation

LINES = "upload_id long, delivery long, line_no long, text string, bucket int, batch long"
ROWS = ", ".join(f"{k} {kind}" for k, kind in SCHEMA) + ", batch long"
UPLOADS = "upload_id long, delivery long, lines long, status string, method string, row_count long, confidence double, error string, warnings array<string>, parsed_at timestamp_ntz, batch long"
#: Uploads touched by a batch, up to which they are broadcast to the kept lines (16 bytes each).
SMALL = 200_000
#: The batch number of what a compaction wrote: before all others.
BASE = -1


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).parquet(folder)


def newest_lines(lines: DataFrame) -> DataFrame:
    """Each upload's lines of its newest delivery. A line that came twice counts once, as it came last."""
    last = lines.groupBy("upload_id").agg(F.max("delivery").alias("delivery"))
    of_last = lines.join(last, ["upload_id", "delivery"])
    return of_last.groupBy("upload_id", "delivery", "line_no").agg(F.max_by("text", "batch").alias("text"), F.max("batch").alias("batch"))


def parse_uploads(lines: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, uploads) of lines (upload_id, delivery, line_no, text): the product rows and what came of each upload."""
    found = extractions(lines.select("upload_id", "line_no", "text"))
    touched = lines.groupBy("upload_id", "delivery").agg(F.count("*").alias("lines"))
    report = upload_report(touched.select(F.col("upload_id").alias("id")), found, now).withColumnRenamed("id", "upload_id")
    return combine_accepted(found), touched.join(report, "upload_id")


def stream_ingest(lines: DataFrame, out: str, checkpoint: str, now: Column | None = None, buckets: int = 64):
    """Start a query that parses arriving lines (upload_id, line_no, text and, if uploads can come again, delivery) into `out`.

    An upload's lines may come in any number of batches and in any order; those of one delivery belong together, a larger delivery
    replaces all before it, and a smaller one that comes late changes nothing. A batch reads again only the buckets of the uploads
    it touched. `now` is the time that parsed uploads get (by default the clock's).
    """
    now = F.localtimestamp() if now is None else now

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = f"{out}/gen={newest_generation(spark, out)}"
        delivery = F.col("delivery") if "delivery" in batch.columns else F.lit(0)
        kept = batch.select("upload_id", delivery.cast("long").alias("delivery"), "line_no", "text", F.pmod(F.hash("upload_id"), F.lit(buckets)).alias("bucket"))
        kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/lines/batch={number}")
        everything = _read(spark, f"{base}/lines", LINES).where(F.col("batch") <= number)
        touched = broadcast_if_small(everything.where(F.col("batch") == number).select("bucket", "upload_id").distinct(), SMALL)
        rows, uploads = parse_uploads(newest_lines(everything.join(touched, ["bucket", "upload_id"], "left_semi")), now)
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        uploads.write.mode("overwrite").parquet(f"{base}/uploads/batch={number}")

    return lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upload_summary(spark: SparkSession, out: str) -> DataFrame:
    """What came of each upload, as of the last batch that touched it."""
    uploads = _read(spark, f"{out}/gen={newest_generation(spark, out)}/uploads", UPLOADS)
    last = uploads.groupBy("upload_id").agg(F.max("batch").alias("batch"))
    return uploads.join(last, ["upload_id", "batch"])


def latest_rows(spark: SparkSession, out: str) -> DataFrame:
    """Each upload's rows as of the last batch that touched it; an upload in which nothing was found has none."""
    rows = _read(spark, f"{out}/gen={newest_generation(spark, out)}/rows", ROWS)
    return rows.join(upload_summary(spark, out).select("upload_id", "batch"), ["upload_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, out: str, buckets: int = 64, keep_old: bool = False) -> None:
    """Write what counts into a new generation, mark it and delete the one before, if asked. No batch may run meanwhile.

    A failure before the mark leaves the old generation in use, and the next call writes the new one again. `buckets` is as in
    `stream_ingest`.
    """
    g = newest_generation(spark, out)
    old, new = f"{out}/gen={g}", f"{out}/gen={g + 1}"
    lines = newest_lines(_read(spark, f"{old}/lines", LINES)).withColumn("bucket", F.pmod(F.hash("upload_id"), F.lit(buckets))).drop("batch")
    lines.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{new}/lines/batch={BASE}")
    latest_rows(spark, out).write.mode("overwrite").parquet(f"{new}/rows/batch={BASE}")
    upload_summary(spark, out).drop("batch").write.mode("overwrite").parquet(f"{new}/uploads/batch={BASE}")
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{new}/whole")
    if not keep_old:
        delete_folder(spark, old)
