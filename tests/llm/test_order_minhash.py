"""Fingerprints against a plain version from the definition, and what they are sensitive to."""

import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from boardfoot.llm.order_minhash import against_next, fingerprint, fingerprints, likeness, signature


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*parts):
    """Spark's xxhash64 of several values: the hash of each is the seed of the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p, seed).intdigest()
    return signed(seed)


def plain(text, k=3, slots=64):
    """Each slot from its definition: all items, sorted anew from the slot's start."""
    w = [x for x in (text or "").encode().split()]
    if not w:
        return []
    hs = [chain(*w[i : i + k]) for i in range(max(len(w) - k + 1, 1))]
    places = 1 << (len(hs) - 1).bit_length()
    items, seen = [], {}
    for i, h in enumerate(hs):
        kind = h & -places
        number = seen[kind] = seen.get(kind, -1) + 1
        v = h if number == 0 else chain(struct.pack("<q", h), struct.pack("<i", number))
        items.append((v & -places | i, i, h))
    out, width = [], (1 << 64) // slots
    for b in range(slots):
        turned = sorted(items, key=lambda x: (x[0] - (b - slots // 2) * width) % (1 << 64))
        two = sorted((turned[0], turned[1 % len(turned)]), key=lambda x: x[1])
        out.append(chain(*(struct.pack("<q", x[2]) for x in two)) >> 32)
    return out


def texts():
    rng = random.Random(7)
    few = [" ".join(rng.choice(["a", "b", "é", "dd"]) for _ in range(n)) for n in (1, 2, 3, 4, 5, 17, 64, 300)]
    return few + ["", " \n", "one", "ha " * 500, " ".join(f"w{rng.randrange(900)}" for _ in range(1500)), "x y z\x1cq", "\ttabs and\x0bmore "]


def test_signature_is_the_definition(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", signature(F.col("text")).alias("s")).collect()}
    assert {i: got[i] for i in got} == {i: plain(t) for i, t in enumerate(texts())}


def test_equal_texts_and_moved_words(spark):
    base = [f"w{i}" for i in range(400)]
    half = base[200:] + base[:200]
    rows = [(1, " ".join(base)), (2, "  ".join(base)), (3, " ".join(half)), (4, " ".join(base[:390])), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and len(got[1]["fingerprint"]) == 512
    assert got[5]["fingerprint"] == got[6]["fingerprint"] == ""
    near = lambda a, b: sum(x == y for x, y in zip(got[a]["signature"], got[b]["signature"])) / 64
    # Two halves that change places share all but two k-mers; half of the pairs change their order.
    assert 0.25 < near(1, 3) < 0.75 < near(1, 4) < 1


def edited(text, other):
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string, signature string, file int, n int").repartition(parts)
    sign = lambda c: F.col(c)
    out = against_next(df).select("doc_id", "n_chars", "edited", fingerprint(sign("signature")).alias("own"), fingerprint(sign("edited_signature")).alias("new"), likeness(sign("signature"), sign("edited_signature")).alias("a"), likeness(sign("signature"), sign("next_signature")).alias("b"))
    return out.collect()


def test_next_documents(spark):
    rows = [(7 * i, t, "x", 1, 2) for i, t in enumerate(texts() + ["日本語 テキスト" * 9, "😀 b" * 50])]
    by = sorted(rows, reverse=True)
    want = {}
    for r, n in zip(by, by[1:] + by[:1]):
        new = edited(r[1], n[1])
        s, e, t = plain(r[1]), plain(new), plain(n[1])
        like = lambda x, y: 1.0 if not x and not y else 0.0 if not x or not y else sum(p == q for p, q in zip(x, y)) / 64
        text = lambda x: "".join(f"{v & 0xFFFFFFFF:08x}" for v in x)
        want[r[0]] = (r[0], len(r[1]), new, text(s), text(e), like(s, e), like(s, t))
    assert {r["doc_id"]: tuple(r) for r in check(spark, rows)} == want


def test_odd_rows(spark):
    """Null ids and texts, repeated ids and rows: each row has a next one, and none is lost."""
    rows = [(i, t, "x", 1, 2) for i, t in ((None, "a b c d"), (None, None), (3, "e f"), (3, "e f"), (3, "g"), (1, None))]
    got = check(spark, rows)
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t or "")) for i, t, *_ in rows)
    alone = check(spark, [(1, "a b c d", "x", 1, 2)], 1)[0]
    assert (alone["edited"], alone["b"]) == ("a b a b", 1.0)
    assert check(spark, []) == []


def test_no_words_are_alike(spark):
    df = spark.createDataFrame([([], [], 1.0), ([], [1], 0.0), ([1, 2], [1, 3], 0.5)], "a array<int>, b array<int>, want double")
    assert all(r["got"] == pytest.approx(r["want"]) for r in df.withColumn("got", likeness(F.col("a"), F.col("b"))).collect())
