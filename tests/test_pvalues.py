"""Tail probabilities against published table values and identities."""

import math

import pytest

from venuelens.functions.pvalues import chi2_tail, f_tail, t_two_sided


@pytest.mark.parametrize("stat,dof,p", [(3.841459, 1, .05), (15.507313, 8, .05), (6.634897, 1, .01), (124.342113, 100, .05), (0.0, 3, 1.0)])
def test_chi2(stat, dof, p):
    assert math.isclose(chi2_tail(stat, dof), p, rel_tol=1e-5)


@pytest.mark.parametrize("stat,d1,d2,p", [(4.964603, 1, 10, .05), (2.866081, 4, 20, .05), (3.3541, 2, 27, .05)])
def test_f(stat, d1, d2, p):
    assert math.isclose(f_tail(stat, d1, d2), p, rel_tol=1e-4)


@pytest.mark.parametrize("stat,dof,p", [(2.228139, 10, .05), (-2.228139, 10, .05), (12.706205, 1, .05), (1.959964, 1e9, .05), (0.0, 5, 1.0)])
def test_t(stat, dof, p):
    assert math.isclose(t_two_sided(stat, dof), p, rel_tol=1e-5)


def test_closed_forms():
    for x in (0.1, 1.0, 7.0, 40.0, 300.0):
        assert math.isclose(chi2_tail(x, 2), math.exp(-x / 2), rel_tol=1e-9)
        assert math.isclose(f_tail(x, 2, 50), (50 / (50 + 2 * x)) ** 25, rel_tol=1e-9)
    assert 0 <= t_two_sided(45, 1e6) < 1e-300
