"""Mixing, quality, toxicity, licences, surrogates and tokens."""

import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boardfoot.llm.bpe import WordBpe, encode_decode
from boardfoot.llm.licenses import PHRASES, TEMPLATES, license_report
from boardfoot.llm.mixing import mix_sources
from boardfoot.llm.quality import kth_largest, resample
from boardfoot.llm.toxicity import score_toxicity

DIR = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def targets(sizes, total=1.5, cap=2.0):
    """Share by weight, stop at the cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    got, open_, left = {s: 0.0 for s in names}, set(names), total * sum(sizes.values())
    while open_ and left > 1e-9:
        unit, left = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            got[s] += unit * weight[s]
            if got[s] >= cap * sizes[s]:
                left += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
    return got


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.choice([0, 1, 5, 40, 300]), r.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(600)] + [(7, None, "b"), (None, "x y", "a"), (8, "w w", "a"), (8, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = df.select("doc_id", "source").distinct()
    out = mix_sources(df)
    assert out.count() == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    by = {r["source_size"]: r for r in out.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    for s, n in sizes.items():
        assert by[n]["t"] == pytest.approx(want[s])
        assert abs(by[n]["k"] - want[s]) <= max(5, 0.01 * want[s]) and by[n]["over"] <= 0
    assert out.exceptAll(mix_sources(df.repartition(3))).isEmpty()
    assert got.count() > 0 and mix_sources(df.limit(0)).count() == 0


def test_resample(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    out = resample(docs, labels)
    share = out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r["quality"]: r["k"] for r in share.collect()}
    assert share[1] > 0.9 and share[0] < 0.05
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "good text here")], "doc_id long, text string")
    assert {r["doc_id"]: r["log_weight"] for r in resample(odd, labels.limit(0)).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
    assert resample(odd.limit(0), labels).count() == 0


def test_kth_largest(spark):
    values = [float(x % 97) for x in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [kth_largest(df, "v", k, least=10) for k in (1, 52, 2500, 5000, 5001)] == [sorted(values, reverse=True)[k - 1] if k <= 5000 else None for k in (1, 52, 2500, 5000, 5001)]


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.05
    odd = spark.createDataFrame([(None, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(odd, labels.limit(0)).collect())


def test_licences(spark):
    rows = [(1, "The MIT license, mit LICENSE; général public license. General\npublic-license"), (2, None), (3, ""), (4, TEMPLATES["bsd"][2].replace("holder", "big holder").upper())]
    got = {r["doc_id"]: r for r in license_report(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        at = sorted((k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert g["base_labels"] == ",".join(sorted({x for _, x in at}))
    assert got[4]["labels"] == "bsd" and 0.8 <= got[4]["score"] <= 1


LIBRARY = Tokenizer.from_file(VOCABULARY)
SPEC = open(VOCABULARY, encoding="utf-8").read()
SMALL = WordBpe(SPEC, leaf=5)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehintrsl'vdm019!?.-_ \n\té ñßÉİΣς́漢½<|>"), max_size=120), st.integers(1, 40))
def test_bpe_is_the_library(text, piece):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert SMALL.encode(text, piece) == ids
    assert SMALL.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_decode(spark):
    r = random.Random(4)
    long = "".join(r.choice("then art's 12!é<|endoftext|> ") for _ in range(3000)) + "ab" * 500
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (4, long), (4, long), (5, " <|endoftext|> ")]
    got = encode_decode(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int"), VOCABULARY, piece=64, spread=500).collect()
    want = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted((g["doc_id"], list(g["ids"])) for g in got) == sorted(want)
    assert all(g["decoded"] == LIBRARY.decode(list(g["ids"]), skip_special_tokens=False) for g in got)
