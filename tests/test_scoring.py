"""Scores of lines made of pieces that the patterns look for, against the patterns one by one."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardfoot.functions import vocabulary as V
from boardfoot.operators import scoring

PIECES = ["4/4", "FAS", "T/L", "tl", "1,200'", "300 BF", "oak", "8-10'", "8–9", "$4.50", "12.75", "2 x 4", '6" & W', "6×4", "a@b.com", "www.mill.com", "https://x", "mill.net", "(555) 123-4567", "12 Oak Street", "Springfield, PA 12345", "Contact us", "call us", "FSC certified", "without  notice", "Instagram", " ", "  ", "x", "1", "é"]


def plain(text):
    """The score from the patterns alone."""
    t = text.strip(" \t\n\x0b\f\r")
    score = 0.0
    for weight, patterns in V.CANDIDATE_SIGNALS:
        score += weight if any(re.search(p, t.lower() if p == V.SPECIES_WORD else t, re.ASCII) for p in patterns) else 0.0
    score += -0.20 if len(t) < 8 and score <= 0 else 0.0
    return max(0.0, min(1.0, score)) if len(t) >= 3 else 0.0


def test_scores_are_those_of_all_patterns(spark):
    lines = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=5).map(" ".join))
    def collect(line):
        lines.append(line)

    collect()
    lines = sorted(set(lines))
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", scoring.candidate_score(F.col("x")).alias("s")).collect()
    assert {r["x"]: round(r["s"], 9) for r in got} == {x: round(plain(x), 9) for x in lines}
