"""The classifiers against enumeration, finite differences, and themselves on other cuts of a table."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from textveil.llm import quality_mil, toxicity
from textveil.llm.sampling import fitted, labelled_sample
from textveil.llm.textblock import blocks

SF = "/root/testdata/sf0.001"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    lengths = [1, 2, 3, 5, 8, 1]
    begin = np.cumsum([0, *lengths[:-1]])
    for _ in range(20):
        s, moves = rng.normal(0, 2, sum(lengths)), rng.normal(0, 2, (2, 2))
        forward, backward = toxicity.log_odds(s, begin, np.array(lengths), moves)
        got = 1 / (1 + np.exp(-(forward + backward)))
        for a, n in zip(begin, lengths, strict=True):
            weight, hot = 0.0, np.zeros(n)
            for states in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(s[a + i] * x for i, x in enumerate(states)) + sum(moves[x, z] for x, z in itertools.pairwise(states)))
                weight, hot = weight + w, hot + w * np.array(states)
            assert np.allclose(got[a : a + n], hot / weight)


def test_attention_gradients_equal_finite_differences():
    rng = np.random.default_rng(5)
    shapes = {"W": (7, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": ()}
    p = {k: rng.normal(0, 0.7, v) for k, v in shapes.items()}
    x, bag, slope = rng.normal(0, 1, (9, 7)), np.array([0, 1, 4, 9]), rng.normal(0, 1, 3)
    value, kept = quality_mil.forward(x, bag, p)
    found = quality_mil.backward(x, kept, p, slope)
    for k, v in p.items():
        for at in np.ndindex(v.shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = v.copy()
                moved[at] += step
                ends.append(slope @ quality_mil.forward(x, bag, p | {k: moved})[0])
            assert abs((ends[0] - ends[1]) / 2e-6 - found[k][at]) < 1e-6
    assert np.isfinite(value).all()


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("module, fitting", [(quality_mil, quality_mil.fit_bags), (toxicity, toxicity.fit_field)])
def test_scores_depend_on_the_text_alone(tables, module, fitting):
    docs, labels = tables
    model = fitting(docs, labels)
    texts = [r.text or "" for r in docs.collect()] + ["", " ", "a", "x " * 70000]

    def scores(chosen):
        parts = [module.score_block(b, model) for b in blocks(pa.array(chosen, pa.string()))]
        return [float(x) for p in parts for x in (p[0] if isinstance(p, tuple) else p)]

    whole = scores(texts)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    assert [whole[i] for i in order] == scores([texts[i] for i in order])
    assert whole == [scores([t])[0] for t in texts]
    assert model.constant is None and len(set(whole)) > 100


def test_the_logits_of_scoring_are_those_of_training(tables):
    docs, labels = tables
    model = quality_mil.fit_bags(docs, labels)
    for block in blocks(pa.array([r.text for r in docs.limit(100).collect()], pa.string())):
        x, bag = quality_mil.encode(block, model.settings)
        assert np.abs(quality_mil.logits(x, bag, model) - quality_mil.forward((x - model.mean) / model.spread, bag, model.layers)[0]).max() < 0.05


def test_a_sample_holds_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 40}") for i in range(4000)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 1)], "doc_id long, quality int, toxic int")
    got = fitted(labelled_sample(docs, labels, "quality", {0: 9, 1: 9}, 100), lambda sample: sample)
    assert got == sorted(got, key=lambda x: int(x[0].split()[1])) and fitted(labelled_sample(docs, labels.limit(0), "quality", {0: 9}, 100), len) == 0
    assert len(got) == len({t for t, _ in got}) <= 18 and all(int(t.split()[1]) % 2 == k for t, k in got)
