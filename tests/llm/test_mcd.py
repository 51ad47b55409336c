"""The distributed minimum-covariance-determinant search against one with exact subsets and many random starts."""

import math

import numpy as np
import pytest

from verilume.llm import quality_rules as q

D = len(q.DIMS)


def whole(cov):
    return cov + np.diag(np.square(q.FLOORS))


def steps(x, mean, cov):
    """Concentration steps with exact subsets, until the subset stands still; logdet, mean, covariance."""
    h = math.ceil(q.COVERAGE * len(x))
    before = None
    while True:
        off = x - mean
        near = np.sort(np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(whole(cov)), off), kind="stable")[:h])
        if before is not None and (near == before).all():
            return np.linalg.slogdet(whole(cov))[1], mean, cov
        before, mean = near, x[near].mean(axis=0)
        cov = q.consistency(h / len(x)) * np.cov(x[near].T, bias=True)


def brute_force(x, starts=300):
    rng = np.random.default_rng(1)
    picked = [x[rng.choice(len(x), D + 1, replace=False)] for _ in range(starts)]
    return min((steps(x, p.mean(axis=0), np.cov(p.T, bias=True)) for p in picked), key=lambda r: r[0])


def sample(n, seed, bad):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(D, D)) * 0.4 + np.eye(D)
    x = rng.normal(size=(n, D)) @ a
    x[: int(bad * n)] = rng.normal(size=(int(bad * n), D)) * 0.3 + rng.normal(size=D) * 6 + 6
    return np.round(x, 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_models_equal_brute_force(spark, seed):
    groups = {"a": sample(200, seed, 0.2), "b": sample(300, seed + 10, 0.1), "c": sample(80, seed + 20, 0.0), "ties": np.tile([3.0, 0.0, 0.0, 0.0], (60, 1)), "few": sample(20, 5, 0)}
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    fit = spark.createDataFrame(rows, "g string, row long, " + ", ".join(f"x{i} double" for i in range(D)))
    got = {r.g: (np.array(r.mean), np.array(r.inv).reshape(D, D)) for r in q.models(fit).collect()}
    assert set(got) == set(groups) - {"few"}
    cut = q.chi2_quantile(q.CUTOFF, D)
    for g, (mean, inv) in got.items():
        x = groups[g]
        logdet, want_mean, want_cov = brute_force(x)
        assert -np.linalg.slogdet(inv)[1] <= logdet + 0.03, g
        far = [np.einsum("ij,jk,ik->i", x - m, i, x - m) for m, i in ((mean, inv), (want_mean, np.linalg.inv(whole(want_cov))))]
        assert np.abs(mean - want_mean).max() < 0.25 and ((far[0] > cut) == (far[1] > cut)).mean() > 0.99, g
        assert g not in "ab" or (far[0] > cut)[: int((0.2 if g == "a" else 0.1) * len(x))].all()


def test_no_rows(spark):
    fit = spark.createDataFrame([], "g string, row long, " + ", ".join(f"x{i} double" for i in range(D)))
    assert q.models(fit).count() == 0
