import random
import re

import pytest

from boardfoot.llm.near_duplicates import near_duplicates

SPACE = r"[^\x20\x09-\x0D]+"


def brute(rows, k, num, den):
    """Component of each id by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    low = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                x, y = sets[a], sets[b]
                if x and y and den * len(x & y) >= num * len(x | y):
                    m = min(low[rows[a][0]], low[rows[b][0]])
                    changed |= low[rows[a][0]] != m or low[rows[b][0]] != m
                    low[rows[a][0]] = low[rows[b][0]] = m
    return {i: (len(s), low[i]) for (i, _), s in zip(rows, sets)}


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, num):
    r = random.Random(k)
    base = [[f"w{r.randrange(500)}" for _ in range(r.choice([1, 2, 4, 30, 120]))] for _ in range(25)]
    docs = []
    for b in base:
        for _ in range(6):
            c = list(b)
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = f"x{r.randrange(500)}"
            docs.append(" ".join(c).upper() if r.random() < 0.3 else "\n".join(c))
    rows = [*enumerate(docs), (900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE  two")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, c long"), k=k, num=num).collect()}
    want = brute(rows, k, num, 100)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.01 * len(rows), wrong  # trees find a pair with a chance below 1


def test_repeated_rows_and_a_large_group(spark):
    """Hundreds of different near copies hang together; repeated rows and null ids do no harm."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = [(7, "a b c d e f")] * 3 + [(None, "a b c d e f")]
    for i in range(300):
        c = list(base)
        c[r.randrange(100)] = f"x{i}"
        rows.append((1000 + i, " ".join(c)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {x["component_id"] for x in got if x["doc_id"] and x["doc_id"] >= 1000} == {1000}
    assert [(x["component_id"], x["kept"]) for x in got if x["doc_id"] == 7] == [(7, True)] * 3
    assert [(x["component_id"], x["kept"]) for x in got if x["doc_id"] is None] == [(None, False)]


def test_a_hub_and_its_variants(spark):
    """Variants that link with one original each, but not with each other, are one group."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base))]
    places = r.sample([(a, b) for a in range(3, 93, 3) for b in range(3, a, 3)], 150)
    for i, (a, b) in enumerate(places):  # each of the two costs 3 of 98 shingles, the first word one
        c = list(base)
        c[0], c[a], c[b] = f"x{i}", f"y{i}", f"z{i}"
        rows.append((2 + i, " ".join(c)))
    want = brute(rows, 3, 85, 100)
    assert {x for _, x in want.values()} == {1}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85).collect()
    assert {x["component_id"] for x in got} == {1}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def joined_by_node(spark, since):
    """Rows that joins on `node` made in the executions after `since`, and the last execution."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, rows = store.executionsList(), 0
    ids = [runs.apply(i).executionId() for i in range(runs.size())]
    for run in (i for i in ids if i > since):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if re.search(r"Join \[node#\d+L?\], \[node#\d+L?\], \w+", node.desc()):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                rows += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return rows, max(ids, default=-1)


def triples(n):
    """Texts in threes that are alike enough to be compared and too unlike to link, and in threes that link."""
    r = random.Random(n)
    rows = []
    for i in range(n):
        base = [f"w{i}-{j}" for j in range(100)]
        for v in range(3):
            c = list(base)
            for p in r.sample(range(3, 97, 4), 4 if i % 2 else 1):
                c[p] = f"x{v}"
            rows.append((3 * i + v, " ".join(c)))
    return rows


def crowd(n):
    """Variants of one text, no two of which are alike enough to link."""
    r = random.Random(n)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        c = list(base)
        for p in r.sample(range(3, 197), 5):
            c[p] = f"x{i}"
        rows.append((i, " ".join(c)))
    return rows


@pytest.mark.parametrize("rows, most", [(triples(80), 2.8), (crowd(240), 74)])
def test_nodes_are_joined_once(spark, rows, most):
    """Small nodes are not joined again once they have been compared, large ones only in passes whose rows a document do not grow with the group."""
    since = joined_by_node(spark, -1)[1]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85).collect()
    made = joined_by_node(spark, since)[0] / len(rows)
    want = brute(rows, 3, 85, 100)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    assert 0 < made <= most, made
