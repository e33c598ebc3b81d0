"""The first step of the toxicity fit against finite differences of the non-negative PU risk."""

import numpy as np
import pytest

from graphloom.llm import toxicity

BITS = 5


def risk(w, bias, rows, positive, prior):
    """What the step lowers: the whole risk, or, where its bracket is below zero, the bracket's negative."""
    z = np.array([w[r].sum() + bias for r in rows])
    zp, zu = z[positive], z[~positive]
    bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * np.logaddexp(0, -zp).mean() + bracket if bracket >= 0 else -bracket


@pytest.mark.parametrize("prior", [0.05, 0.6, 0.95])
def test_first_step_goes_down_the_risk(monkeypatch, prior):
    rng = np.random.default_rng(int(prior * 100))
    rows = [np.unique(rng.integers(0, 1 << BITS, 6)).astype(np.int32) for _ in range(60)]
    positive = np.arange(60) < 20
    monkeypatch.setattr(toxicity, "_telling", lambda rows, positive, size: np.ones(size, bool))
    start = np.log(prior / (1 - prior))
    once = {(bool(y), r.tobytes()): i for i, (r, y) in reversed(list(enumerate(zip(rows, positive, strict=True))))}
    used = sorted(once.values())
    own, marks = [rows[i] for i in used], positive[used]
    model = toxicity.fit_nnpu(rows, positive, prior, BITS, epochs=1, rate=0.05, shrink=0.0)
    zero, eps = np.zeros(1 << BITS), 1e-6
    for j in range(1 << BITS):
        up, down = zero.copy(), zero.copy()
        up[j], down[j] = eps, -eps
        slope = (risk(up, start, own, marks, prior) - risk(down, start, own, marks, prior)) / (2 * eps)
        if abs(slope) > 1e-6:
            # Adam's first step is the rate against the sign of the gradient.
            assert abs(model.weight[j] + 0.05 * np.sign(slope)) < 1e-4, j
    slope = (risk(zero, start + eps, own, marks, prior) - risk(zero, start - eps, own, marks, prior)) / (2 * eps)
    assert abs(slope) < 1e-6 or abs(model.bias - start + 0.05 * np.sign(slope)) < 1e-4


def test_a_negative_bracket_turns_the_step(monkeypatch):
    """Where the positives look more negative than all unlabelled rows, the step is that of the bracket alone."""
    monkeypatch.setattr(toxicity, "_telling", lambda rows, positive, size: np.ones(size, bool))
    rows = [np.array([0], np.int32)] + [np.array([1 + i], np.int32) for i in range(9)]
    positive = np.arange(10) < 1
    two = toxicity.fit_nnpu(rows, positive, 0.9, 4, epochs=40, rate=0.5, shrink=0.0)
    z = two.weight[:10] + two.bias
    assert np.isfinite(z).all() and z[0] > z[1:].max()
