"""Likeness against every pair; the index after changes against a new one."""

import random

from pyspark.sql import functions as F

from boardfoot.operators import index, search

COLUMNS = ("species", "product")
PRODUCTS = "group_id long, id long, species string, product string"


def some_products(seed=0, n=120):
    rng = random.Random(seed)
    words = ["red", "oak", "oaks", "maple", "4/4", "FAS", "fas/sel", "#1c", "x", "kiln", "dried", "walnut", "Walnuts"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(rng.randrange(k))) or None
    return [(rng.randrange(3), i, text(3), text(7)) for i in range(n)]


QUERIES = [(1, 0, "red oak"), (2, 1, "Walnut kiln"), (3, 2, "4/4 fas"), (4, 0, "zzz"), (5, 1, "mapel"), (6, 2, ""), (7, 2, "a very long query that is like nothing at all but holds oak")]


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, group_id long, query string")


def test_likeness_is_that_of_all_pairs(spark):
    rows = some_products()
    products = spark.createDataFrame(rows, PRODUCTS).repartition(3)
    want = {}
    import pandas as pd

    for q, g, text in QUERIES:
        for group, i, *values in rows:
            for v in values:
                if group == g and v is not None:
                    score = search._ratios(pd.Series([text.lower()]), pd.Series([v.lower()])).iloc[0]
                    if score >= search.LEAST_LIKENESS:
                        want[q, i] = max(score, want.get((q, i), 0))
    got = {(r["query_id"], r["id"]): r["score"] for r in search.fuzzy_search(asked(spark), products).collect()}
    assert got == want and len(got) > 20


def test_candidates_are_the_pairs_that_can_reach_it(spark):
    """Those that only their lengths let through are left out: here nearly half of all pairs near enough in length."""
    texts = spark.createDataFrame(some_products(1, 400), PRODUCTS).select("group_id", F.explode(F.array("species", "product")).alias("value")).where("value is not null").select("group_id", F.lower("value").alias("value")).distinct()
    q = asked(spark).select("group_id", F.lower("query").alias("query"))
    la, lb = F.length("query"), F.length("value")
    before = texts.join(q, "group_id").where(2 * F.least(la, lb) >= 0.4 * (la + lb)).select("query", "value").distinct().count()
    found = search.like_candidates(q, texts)
    assert 0 < found.count() < 0.6 * before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "[group_id" + "]" not in plan


def counts(df):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy("group_id", "id", "col", "pos", "token").count().collect()}


def test_index_after_changes_is_a_new_index(spark, tmp_path):
    """New, changed, emptied and deleted products, one deleted and added again, a batch that runs again, before and after compaction."""
    rows = some_products(2)
    path = str(tmp_path)
    index.update_index(path, 0, spark.createDataFrame(rows[:90], PRODUCTS), COLUMNS, buckets=4)
    state = {r[1]: r for r in rows[:90]}
    new = [(*r[:2], "teak", r[3]) for r in rows[10:20]] + [(*r[:2], None, None) for r in rows[20:25]] + rows[90:]
    gone = rows[30:40]
    for _ in range(2):
        index.update_index(path, 1, spark.createDataFrame(new, PRODUCTS), COLUMNS, spark.createDataFrame(gone, PRODUCTS), buckets=4)
    state |= {r[1]: r for r in new}
    state = {i: r for i, r in state.items() if r not in gone}
    index.update_index(path, 2, spark.createDataFrame(rows[30:32], PRODUCTS), COLUMNS, buckets=4)
    state |= {r[1]: r for r in rows[30:32]}
    now = spark.createDataFrame(sorted(state.values()), PRODUCTS)
    rebuilt = counts(search.build_postings(now, COLUMNS))
    scores = {(r["query_id"], r["id"]): round(r["score"], 9) for r in search.bm25_search(asked(spark), now, COLUMNS).collect()}
    assert rebuilt and scores
    for compacted in (False, True):
        if compacted:
            index.compact_index(spark, path, buckets=4)
        assert counts(index.live_postings(spark, path)) == rebuilt
        found = index.indexed_search(asked(spark), path, buckets=4)
        assert {(r["query_id"], r["id"]): round(r["score"], 9) for r in found.collect()} == scores
    index.update_index(path, 3, now.limit(0), COLUMNS, now, buckets=4)
    assert counts(index.live_postings(spark, path)) == {} and index.indexed_search(asked(spark), path, buckets=4).count() == 0


def test_pages_of_results(spark):
    found = spark.createDataFrame([(q, i, 1 + i % 2, (i * 7 % 5) / 10) for q in (1, 2) for i in range(30)], "query_id long, id long, tier int, score double")
    pages, last = [], found.limit(0)
    for _ in range(4):
        page = search.results_after(found, last, 8).orderBy("query_id", "tier", F.desc("score"), "id").collect()
        pages.append([(r["query_id"], r["id"]) for r in page])
        last = spark.createDataFrame([max((r for r in page if r["query_id"] == q), key=lambda r: (r["tier"], -r["score"], r["id"])) for q in (1, 2)])
    whole = search.page_results(found, 100).orderBy("query_id", "rank").collect()
    assert sorted(x for p in pages for x in p) == sorted((r["query_id"], r["id"]) for r in whole)
    assert pages[1] == [(r["query_id"], r["id"]) for r in whole if 9 <= r["rank"] <= 16]
