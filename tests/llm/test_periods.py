"""Periodic runs against every diagonal of every text."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boardfoot.llm.periods import digest_runs, find_runs, periodic_runs, planted_period


def brute(w, repeats=4, least=6):
    n, out = len(w), {}
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                out.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def numbers(texts):
    return np.array([x for w in texts for x in w], np.int64), np.cumsum([0, *map(len, texts)])


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=5).map(lambda b: [x for w, k in b for x in w * k])


@settings(max_examples=300, deadline=None)
@given(st.lists(blocks, max_size=4), st.sampled_from([(4, 6), (3, 6), (2, 2), (5, 1)]))
def test_runs(texts, rule):
    assert find_runs(*numbers(texts), *rule) == [brute(w, *rule) for w in texts]


def test_long_periods_and_nested_runs():
    rng = random.Random(3)
    inner = [1, 2] * 6 + [rng.randrange(50) for _ in range(700)]
    texts = [inner * 5 + [9] * 40, [0] * 3000, [rng.randrange(1000) for _ in range(4000)]]
    assert find_runs(*numbers(texts)) == [brute(w) for w in texts] and find_runs(*numbers(texts))[0]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(i, text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    n, h = len(w), zlib.crc32(str(i).encode())
    if i is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = brute(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (i, len(runs), *best, milli, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_rows(spark):
    """Null and empty texts, separators of all kinds and signs that are none, repeated and null ids, a long text, clashing names."""
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b " * 9, "ha ha\tha\nha\x0bha\x0cha ha", "x y x y", "é\x1cü " * 7, "w\x00 " * 6, "ab " * 3_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)] + [(5, texts[5], 2, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, id string").repartition(3)
    got = digest_runs(periodic_runs(df, edit=planted_period)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t) for i, t, *_ in rows), key=str)


def test_no_rows(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
