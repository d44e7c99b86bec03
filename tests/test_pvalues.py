from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from lakeprofile.functions import pvalues as pv


def test_shapiro_known_sample():
    weights = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    w, p = pv.shapiro_wilk(weights)
    assert w == pytest.approx(0.78881, abs=1e-5)
    assert p == pytest.approx(0.006704, abs=1e-6)


def test_shapiro_tells_normal_from_exponential():
    rng = np.random.default_rng(0)
    assert pv.shapiro_wilk(rng.normal(size=500))[1] > 0.01
    assert pv.shapiro_wilk(rng.exponential(size=500))[1] < 1e-10


def test_chi_square_against_closed_forms():
    for x in (0.1, 1.0, 3.0, 10.0, 50.0):
        assert pv.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert pv.chi2_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert pv.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)


def test_f_and_t_against_closed_forms():
    for f, d2 in ((0.5, 7), (2.0, 30), (9.0, 400)):
        assert pv.f_tail(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-10)
    assert pv.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert pv.t_two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), rel=1e-10)


def test_tails_agree_with_commons_math(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for x, dof in ((3.2, 7), (40.0, 25), (0.01, 3)):
        expected = 1 - jvm.ChiSquaredDistribution(float(dof)).cumulativeProbability(x)
        assert pv.chi2_tail(x, dof) == pytest.approx(expected, abs=1e-10)
    for t, dof in ((0.7, 11), (2.5, 200)):
        expected = 2 * (1 - jvm.TDistribution(float(dof)).cumulativeProbability(t))
        assert pv.t_two_sided(t, dof) == pytest.approx(expected, abs=1e-10)
    for f, d1, d2 in ((1.5, 3, 17), (4.0, 9, 1000)):
        expected = 1 - jvm.FDistribution(float(d1), float(d2)).cumulativeProbability(f)
        assert pv.f_tail(f, d1, d2) == pytest.approx(expected, abs=1e-10)


@pytest.mark.parametrize(("n1", "n2"), [(3, 5), (5, 5), (4, 7)])
def test_ks_exact_counts_every_order(n1, n2):
    gaps = []
    for chosen in itertools.combinations(range(n1 + n2), n1):
        i = j = 0
        top = 0.0
        for k in range(n1 + n2):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            top = max(top, abs(i / n1 - j / n2))
        gaps.append(top)
    for d in sorted(set(gaps)):
        expected = np.mean([g >= d - 1e-12 for g in gaps])
        assert pv.ks_two_sample(d, n1, n2, exact=True) == pytest.approx(expected, abs=1e-12)


def test_ks_exact_meets_the_limit():
    exact = pv.ks_two_sample(0.02, 10_000, 10_000, exact=True)
    limit = pv.ks_two_sample(0.02, 10_000, 10_000)
    assert exact == pytest.approx(limit, rel=0.02)


def test_normality_of_a_normal_shape():
    assert pv.normality_k2(10_000, 0.0, 0.0)[1] > 0.9
    assert pv.normality_k2(10_000, 2.0, 6.0)[1] < 1e-10
