import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardfoot.llm.repeats import remove_repeats


def brute(texts, span):
    count = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé ") for _ in range(n))
    shared = [word(260), word(205), "x" * 300, word(199)]
    docs = [word(50) + r.choice(shared) + word(r.randrange(120)) + r.choice(shared)[:r.randrange(190, 260)] for _ in range(40)]
    return [None, "", "short", *docs, docs[0], docs[0], "x" * 900]


@pytest.mark.parametrize("most", [20_000, 1])
def test_equals_brute_force(spark, most):
    """`most` of 1 with 1,000 contexts at least still takes the index; the window path is tested below."""
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")
    got = remove_repeats(df, most=most).select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("g"), F.size("spans").alias("k"), F.sha2("kept", 256).alias("h"))
    got = {r["doc_id"]: (r["n_bytes"], r["g"], r["k"], r["h"]) for r in got.collect()}
    want = brute([(t or "").encode() for _, t in rows], 200)
    assert [got[i] for i, _ in rows] == want


def test_hot_anchor_is_settled_by_windows(spark):
    """One passage in 1,300 texts with different surroundings: more contexts of one anchor than a task holds."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = word(210)
    docs = [word(40) + passage + word(40) for _ in range(1300)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = remove_repeats(df, most=10).select("doc_id", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("g")).collect()
    want = brute([d.encode() for d in docs], 200)
    assert {x["doc_id"]: x["g"] for x in got} == {i: w[1] for i, w in enumerate(want)}


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
