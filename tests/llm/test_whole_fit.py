"""The quality model sees every labelled row."""

import random

import numpy as np
import pytest

from marginalia.llm import quality


def test_all_labelled_rows_are_fitted(spark):
    draw = random.Random(5)
    texts = {}
    for key in range(9000):
        words = draw.choices(["Alpha", "beta", "12", "|", "gamma!", "of"], [1, 5, 1 + key % 2, 1 + key % 2, 1, 3], k=draw.randint(1, 30))
        texts[key] = " ".join(words)
    labels = {key: key % 2 for key in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    model = quality.learn(docs, marked, modulus=1, rest=1)
    rows = [np.array([quality.features(texts[k]) for k in sorted(texts) if labels[k] == value]) for value in (1, 0)]
    whole = quality.fit(*rows, 0.5)
    assert model.mean == pytest.approx(whole.mean) and model.spread == pytest.approx(whole.spread)
    assert model.weights == pytest.approx(whole.weights, abs=1e-6) and model.cut == pytest.approx(whole.cut, abs=1e-6)
