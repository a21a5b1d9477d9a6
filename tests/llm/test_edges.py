"""Edge cases of labels and of components near the limits of a double."""

import pytest

from boardfoot.llm.nearest import nearest
from boardfoot.llm.toxicity import score_toxicity


@pytest.mark.parametrize("labels", [[(901, 1), (902, 1)], [(1, 1), (2, 1), (3, 1), (4, 1)], [(1, None)]])
def test_toxicity_of_odd_labels(spark, labels):
    """Labels of absent documents, labels that are all toxic, and null labels: scores stay between 0 and 1."""
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in ((1, "bad words"), (2, "bad day"), (3, ""), (4, None), (4, "good"))], "doc_id long, text string, score double, u int")
    got = score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_nearest_of_huge_and_tiny_components(spark):
    rows = [(0, [1e170, 1e170]), (1, [2e170, 2e170]), (2, [1e-200, 0.0]), (3, [-1.0, -1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], pytest.approx(r["score"])) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, 0.5**0.5), (3, -1.0)]
