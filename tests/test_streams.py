"""Uploads that arrive in parts give what one batch gives; an address's attempts are judged in many tasks as in one."""

import random

import pytest
from pyspark.sql import functions as F

from boardfoot.operators import extract
from boardfoot.streaming import ingest, jobs

LINES = "upload_id long, delivery long, line_no long, text string"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def product(k):
    return f"{k}/4 FAS {100 * k}'"


#: Upload 1 comes in three batches; 2 whole; 3 comes again, shorter; 4 again, with nothing in it; 5 has a line twice; of 6 an old
#: delivery comes late.
BATCHES = [
    [(1, 0, 0, "CHERRY"), (1, 0, 4, product(4)), (2, 0, 0, "ASH"), *[(2, 0, n, product(n)) for n in (1, 2, 3, 4)], *[(3, 0, n, product(n)) for n in (1, 2, 3, 4)], *[(4, 0, n, product(n)) for n in (5, 6, 7)], *[(6, 2, n, product(n)) for n in (3, 5, 7)]],
    [(1, 0, 1, product(1)), (1, 0, 2, product(2)), (3, 1, 0, "WALNUT"), *[(3, 1, n, product(n)) for n in (6, 8, 9)], *[(5, 0, n, product(n)) for n in (1, 2, 3)], *[(6, 1, n, product(n)) for n in (1, 2, 3, 4)]],
    [(1, 0, 3, product(3)), (4, 1, 0, "see you next week"), (5, 0, 2, product(2))],
]


def collected(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def run(spark, at, batches, compact_after=None):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{at}/in")
        ingest.stream_ingest(spark.readStream.schema(LINES).parquet(f"{at}/in"), f"{at}/out", f"{at}/state", now(), buckets=4).awaitTermination()
        if k == compact_after:
            ingest.compact(spark, f"{at}/out", buckets=4)


@pytest.mark.parametrize("compact_after", [None, 1])
def test_parts_give_what_a_batch_gives(spark, tmp_path, compact_after):
    at = str(tmp_path)
    run(spark, at, BATCHES, compact_after)
    every = spark.createDataFrame([r for b in BATCHES for r in b], LINES).withColumn("batch", F.lit(0).cast("long"))
    rows, uploads = ingest.parse_uploads(ingest.newest_lines(every), now())
    got = ingest.latest_rows(spark, f"{at}/out")
    names = [k for k, _ in extract.SCHEMA]
    assert collected(got.select(*names)) == collected(rows.select(*names))
    summary = ingest.upload_summary(spark, f"{at}/out")
    assert collected(summary.select(*uploads.columns)) == collected(uploads)
    told = {r["upload_id"]: (r["delivery"], r["lines"], r["status"], r["row_count"]) for r in summary.collect()}
    assert told == {1: (0, 5, "parsed", 4), 2: (0, 5, "parsed", 4), 3: (1, 4, "parsed", 3), 4: (1, 1, "failed", 0), 5: (0, 3, "parsed", 3), 6: (2, 3, "parsed", 3)}


def test_batch_that_runs_again(spark, tmp_path):
    """The last batch is lost between its writes and Spark's note of it, also when a compaction came between."""
    at = str(tmp_path)
    run(spark, at, BATCHES)
    before = collected(ingest.latest_rows(spark, f"{at}/out"))
    for compacted in (False, True):
        if compacted:
            ingest.compact(spark, f"{at}/out", buckets=4)
        (tmp_path / "state" / "commits" / "2").unlink()
        (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
        ingest.stream_ingest(spark.readStream.schema(LINES).parquet(f"{at}/in"), f"{at}/out", f"{at}/state", now(), buckets=4).awaitTermination()
        assert collected(ingest.latest_rows(spark, f"{at}/out")) == before


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    at = str(tmp_path)
    run(spark, at, BATCHES[:1])
    kept = ingest._read(spark, f"{at}/out/gen=0/lines", ingest.LINES)
    touched = F.broadcast(kept.where("upload_id = 2").select("bucket", "upload_id").distinct())
    plan = kept.join(touched, ["bucket", "upload_id"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def replayed(rows):
    """Each address's attempts one after another."""
    out, state = [], {}
    for i, ip, t, failed in sorted(rows, key=lambda r: (r[2], r[0])):
        allowed, wait, state[ip] = jobs.decide(state.get(ip, []), t, bool(failed))
        out.append((i, ip, int(allowed), wait))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_attempts_of_one_address(spark, seed):
    """Bursts with gaps around the window's length, ties in time, and addresses that are null."""
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(1500):
        t += rng.choice([0, 0, 1, 7, 30, 90, 299, 300, 301, 640]) if i % 40 else 5000
        rows.append((i, rng.choice(["a", "a", "a", None]), t, int(rng.random() < 0.8)))
    df = spark.createDataFrame(rows, "id long, ip string, t double, failed int").repartition(3)
    assert sorted(map(tuple, jobs.rate_limit(df).collect()), key=str) == replayed(rows)
    stretches = jobs.quiet_stretches(df).groupBy("ip").agg(F.count_distinct("since").alias("n"), F.count("*").alias("rows")).where("ip = 'a'").first()
    assert stretches["n"] > 100
