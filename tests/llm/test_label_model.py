"""The label model against a plain one, and on votes whose correlations are known."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import toxicity as t

VOTERS = 5


def drawn(seed=2, n=6000):
    """Voter 1 repeats voter 0 nine times in ten, the others vote by the label alone; 0 and 1 are right less often."""
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        y = rnd.random() < 0.25
        first = t.TOXIC if rnd.random() < (0.5 if y else 0.08) else t.NOTHING
        second = first if rnd.random() < 0.9 else t.TOXIC if rnd.random() < (0.5 if y else 0.08) else t.NOTHING
        rest = [t.TOXIC if rnd.random() < (0.6 if y else 0.03) else t.NOTHING for _ in range(2)]
        rows.append((bytes([first, second, *rest, t.CLEAN if set(rest) == {t.NOTHING} else t.NOTHING]), int(y), rnd.random() < 0.15))
    return rows


def patterns(spark, rows):
    n, clean, toxic = Counter(), Counter(), Counter()
    for votes, y, known in rows:
        n[votes] += 1
        if known:
            (toxic if y else clean)[votes] += 1
    return [(v, float(n[v]), float(clean[v]), float(toxic[v])) for v in n]


def plain(rows, before, prior, steps):
    """Expectation-maximisation, one vote after the other."""

    def tables(weights):
        out = np.zeros((VOTERS, 2, 3, 3))
        for (votes, *_), by_label in zip(rows, weights):
            for i, v in enumerate(votes):
                for label, w in enumerate(by_label):
                    out[i, label, votes[before[i]], v] += w
        for i in range(VOTERS):
            for label in (0, 1):
                alone = out[i, label].sum(0) + 0.5
                alone = alone / alone.sum()
                for b in range(3):
                    row = alone if before[i] == i else (out[i, label, b] + 2 * alone) / (out[i, label, b].sum() + 2)
                    out[i, label, b] = row
        return out

    def posterior(table, votes):
        odds = math.log(prior / (1 - prior))
        for i, v in enumerate(votes):
            if v != t.NOTHING:
                odds += math.log(table[i, 1, votes[before[i]], v] / table[i, 0, votes[before[i]], v])
        return 1 / (1 + math.exp(-odds))

    table = tables([(c, x) for _, _, c, x in rows])
    for _ in range(steps):
        table = tables([(c + n * (1 - (p := posterior(table, v))), x + n * p) for v, n, c, x in rows])
    return table, [posterior(table, v) for v, *_ in rows]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = drawn()
    told = patterns(spark, rows)
    df = spark.createDataFrame([(bytearray(v), *x) for v, *x in told], "votes binary, n double, clean double, toxic double").repartition(3)
    return rows, told, t.fit_label_model(df, VOTERS, 0.25)


def test_voters_that_repeat_each_other_are_neighbours(fitted):
    _, _, model = fitted
    assert model.before[1] == 0 or model.before[0] == 1
    both, one = (model.posterior(np.array([v], np.uint8))[0] for v in ([1, 1, 2, 2, 2], [1, 2, 2, 2, 2]))
    free = t.LabelModel(model.table, np.arange(VOTERS), 0.25)
    assert both < 0.9 and both - one < 0.25, (both, one, free)


def test_accuracies_are_found(fitted):
    rows, _, model = fitted
    p = model.posterior(np.array([list(v) for v, *_ in rows], np.uint8))
    y = np.array([y for _, y, _ in rows])
    assert abs(p.mean() - y.mean()) < 0.08
    assert ((p >= 0.5) == y).mean() > 0.85


def test_estimates_are_those_of_a_plain_loop(spark, fitted):
    _, told, model = fitted
    before = np.arange(VOTERS)
    df = spark.createDataFrame([(bytearray(v), *x) for v, *x in told], "votes binary, n double, clean double, toxic double")
    free, steps = plain(told, before.tolist(), 0.25, 1), 40
    # The same tree, and as many steps as the model took at most: both are near the fixed point.
    table, posterior = plain(told, model.before.tolist(), 0.25, steps)
    got = t.fit_label_model(df, VOTERS, 0.25, steps)
    assert (got.before == model.before).all()
    assert np.abs(got.posterior(np.array([list(v) for v, *_ in told], np.uint8)) - posterior).max() < 0.02
    assert free[0].shape == table.shape


def test_forest_of_unrelated_voters_is_empty():
    ones = np.array([[30.0, 20.0, 10.0], [40.0, 40.0, 40.0]])
    totals = np.array([100.0, 80.0])
    pairs = np.stack([np.outer(o, o) / n for o, n in zip(ones, totals)])
    for p, o in zip(pairs, ones):
        np.fill_diagonal(p, o)
    assert t.tree(ones, pairs, totals).tolist() == [0, 1, 2]
