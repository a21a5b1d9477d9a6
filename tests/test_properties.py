"""What must hold whatever the rows."""

from pyspark.sql import functions as F

from boardfoot.operators import lines, scoring
from boardfoot.sources.views import view
from boardfoot.streaming import ingest, jobs

DIR = "/root/testdata/sf0.001"


def test_scores_and_classes(spark):
    rows = lines.parse_lists(view(spark, DIR, "fx_lines"))
    bad = rows.where(~F.col("confidence").between(0, 1) | F.col("class").isNull()).count()
    report = scoring.parse_report(rows).agg(F.sum(F.col("raw") - F.col("accept") - F.col("review") - F.col("reject"))).first()[0]
    assert (bad, report) == (0, 0)


def test_dedupe_is_idempotent_and_order_does_not_matter(spark):
    p = view(spark, DIR, "fx_products")
    once = scoring.dedupe_rows(p)
    again = scoring.dedupe_rows(once.repartition(7))
    assert once.select("id").exceptAll(again.select("id")).isEmpty() and once.count() == again.count()


def test_ingest_plan_has_one_shuffle_on_upload(spark):
    lines_df = spark.createDataFrame([(1, 0, "OAK"), (1, 1, "T/L 4/4 FAS")], "upload_id long, line_no long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = lines.ingest(lines_df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(upload_id") == 1 and "Python" not in plan


def test_redelivered_upload_replaces_its_rows(spark, tmp_path):
    schema = "upload_id long, line_no long, text string"
    inside = str(tmp_path / "in")
    more = [(k, f"T/L {k}/4 FAS") for k in (5, 6)]  # a file's text counts from three rows on
    first, second = [(0, "CHERRY"), (1, "T/L 4/4 FAS"), *more], [(0, "WALNUT"), (1, "T/L 8/4 FAS"), *more]
    for batch in ([(1, *r) for r in first], [(1, *r) for r in second] + [(2, 0, "RED ELM"), (2, 1, "T/L 4/4 FAS"), *[(2, *r) for r in more]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(inside)
        stream = spark.readStream.schema(schema).parquet(inside)
        ingest.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = ingest.latest_rows(spark, str(tmp_path / "out")).where("source_row = 0").select("upload_id", "species", "thickness").collect()
    assert sorted(map(tuple, got)) == [(1, "Walnut", "8/4"), (2, "Red Elm", "4/4")]


def test_rate_limit_stream_is_the_batch(spark, tmp_path):
    rows = [(i, f"10.0.0.{i % 2}", float(7 * i), i % 3 and 1 or 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ip string, t double, failed int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_rate_limit(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out = []
    stream.writeStream.outputMode("append").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == sorted(map(tuple, jobs.rate_limit(df).collect()))
