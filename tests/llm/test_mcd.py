"""The robust moments beside a brute-force search for the share of least determinant."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.llm.quality_rules import _FLOORS, STATISTICS, _fitted, _inverse, _with_distance, chi2_point, robust_moments

from .test_models_and_joins import clean

D = len(STATISTICS)


def scatter(x):
    return np.cov(x.T, bias=True) + np.diag(np.array(_FLOORS) ** 2)


def frame(spark, groups):
    rows = [(name, k % 64, *map(float, r)) for name, x in groups.items() for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "group string, salt int, " + ", ".join(f"{c} double" for c in STATISTICS))


def test_inverse_and_distance(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(D, D))
    a = a @ a.T + np.eye(D)
    got = spark.range(1).select(_inverse(F.array(*[F.lit(float(v)) for v in a.ravel()])).alias("q")).first()["q"]
    assert np.allclose(-np.array(got["a"]).reshape(D, D), np.linalg.inv(a)) and np.isclose(got["logdet"], np.linalg.slogdet(a)[1])
    x = rng.normal(size=(40, D))
    moments = [len(x), *x.sum(0), *[(x[:, i] * x[:, j]).sum() for i in range(D) for j in range(i + 1)]]
    fits = _fitted(spark.createDataFrame([("g", [float(v) for v in moments])], "group string, s array<double>"), "group")
    d2 = [r["d2"] for r in _with_distance(frame(spark, {"g": x}).join(fits, "group")).orderBy("salt").collect()]
    z = x - x.mean(0)
    assert np.allclose(d2, np.einsum("ij,jk,ik->i", z, np.linalg.inv(scatter(x)), z))
    assert chi2_point(0.95) == pytest.approx(12.5916, abs=1e-3)


def test_least_determinant(spark):
    """On small groups every subset is tried; the search comes close to the best and never takes an outlier in."""
    rng = np.random.default_rng(3)
    groups = {}
    for g in range(4):
        x = rng.normal(size=(16, D)) * 0.3
        x[:3] += 4 + g
        groups[f"g{g}"] = x
    got = {r["group"]: np.array(r["s"]) for r in robust_moments(frame(spark, groups)).collect()}
    for name, x in groups.items():
        h = int(np.ceil(len(x) * 0.75))
        best = min(np.linalg.slogdet(scatter(x[list(c)]))[1] for c in itertools.combinations(range(len(x)), h))
        s = got[name]
        assert h <= s[0] <= h + 1
        m = s[1 : 1 + D] / s[0]
        own = np.zeros((D, D))
        for k, (i, j) in enumerate((i, j) for i in range(D) for j in range(i + 1)):
            own[i, j] = own[j, i] = s[1 + D + k] / s[0] - m[i] * m[j]
        assert np.linalg.slogdet(own + np.diag(np.array(_FLOORS) ** 2))[1] <= best + 1.5
        assert np.abs(m).max() < 1.0


def test_small_groups_lean_on_their_parents(spark, make_docs):
    from logtide.llm.quality_rules import quality_rules

    rng = random.Random(4)
    rows = [(i, clean(rng, 12), f"s{i % 40}", "en") for i in range(160)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(make_docs(rows)).collect()}
    assert all(got.values())
