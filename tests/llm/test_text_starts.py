"""Starts of texts use their bigrams and learned weights."""

import random

from courtflux.llm import interpolate


def test_empty_texts_after_the_start(spark):
    rng = random.Random(2)
    rows = [(i, "" if i % 2 else " ".join(rng.choice("abcdefgh") for _ in range(50))) for i in range(300)]
    got = interpolate.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Half of the texts end at their start, though one token in 26 is an end.
    empty = [r.score for r in got if r.n_tokens == 1]
    assert len(empty) == 150 and all(-0.6 < x < -0.2 for x in empty)
