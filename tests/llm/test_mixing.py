"""The fit of the rates on tables with a few very long documents, and where targets are out of reach."""

import numpy as np
import pytest

from labelscan.llm import domain_mixing


def table(long_tokens):
    r = np.random.default_rng(1)
    tokens = np.concatenate([r.integers(50, 601, 3000), long_tokens])
    p = np.full((len(tokens), 3), 0.02)
    p[np.arange(len(tokens)), np.concatenate([r.choice(3, 3000, p=[0.7, 0.2, 0.1]), np.zeros(len(long_tokens), int)])] = 0.96
    return tokens, p


def frame_of(spark, tokens, p):
    return spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")


@pytest.mark.parametrize("targets", [[0.90, 0.07, 0.03], [0.7, 0.2, 0.1]])
def test_long_documents_do_not_hold_up_the_fit(spark, targets):
    tokens, p = table([1_000_000])
    steps, left = domain_mixing.fit_rates(frame_of(spark, tokens, p), np.array(targets))
    mass = (domain_mixing.rates_after(tokens, p, steps) * tokens) @ p / tokens.sum()
    assert np.abs(mass - targets).max() < 2e-6 and left < 2e-6


def test_targets_out_of_reach_give_the_best_fit_and_the_error(spark):
    tokens, p = table([])
    frame = frame_of(spark, tokens, p)
    steps, left = domain_mixing.fit_rates(frame, np.array([0.1, 0.1, 0.8]))
    rates = domain_mixing.rates_after(tokens, p, steps)
    mass = (rates * tokens) @ p / tokens.sum()
    assert abs(np.abs(mass - [0.1, 0.1, 0.8]).max() - left) < 1e-9 and left > 0.1
    assert (rates[p[:, 2] > 0.9] == domain_mixing.MOST).all()
    with pytest.raises(ValueError, match="do not settle"):
        domain_mixing.fit_rates(frame, np.array([0.1, 0.1, 0.8]), steps=1)
