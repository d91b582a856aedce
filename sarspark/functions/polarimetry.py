"""Quad-pol covariance, coherency and eigen-decomposition as column expressions."""

from __future__ import annotations

from ..plans.stages import Stages

S2 = "sqrt(2e0)"
#: The six covariance products; off-diagonal ones are complex.
COVARIANCE: Stages = [
    {
        "hhhh": "hh_re*hh_re + hh_im*hh_im", "hvhv": "hv_re*hv_re + hv_im*hv_im", "vvvv": "vv_re*vv_re + vv_im*vv_im",
        "hhhv_re": "hh_re*hv_re + hh_im*hv_im", "hhhv_im": "hh_im*hv_re - hh_re*hv_im",
        "hvvv_re": "hv_re*vv_re + hv_im*vv_im", "hvvv_im": "hv_im*vv_re - hv_re*vv_im",
        "hhvv_re": "hh_re*vv_re + hh_im*vv_im", "hhvv_im": "hh_im*vv_re - hh_re*vv_im",
    }
]
PRODUCTS = list(COVARIANCE[0])
#: C3 is (hhhh, sqrt2 hhhv, hhvv; 2 hvhv, sqrt2 hvvv; vvvv); T3 is its Pauli form, conjugate to the usual one.
T3: Stages = [
    {
        "t11": "(hhhh + vvvv + 2*hhvv_re)/2", "t22": "(hhhh + vvvv - 2*hhvv_re)/2", "t33": "2*hvhv",
        "t12_re": "(hhhh - vvvv)/2", "t12_im": "hhvv_im",
        "t13_re": "hhhv_re + hvvv_re", "t13_im": "hvvv_im - hhhv_im",
        "t23_re": "hhhv_re - hvvv_re", "t23_im": "-(hhhv_im + hvvv_im)",
    }
]
#: Eigenvalues of the 3x3 Hermitian matrix by the trigonometric form, t1 >= t2 >= t3.
EIGEN: Stages = [
    {"q3": "(t11 + t22 + t33)/3", "o2": "t12_re*t12_re + t12_im*t12_im + t13_re*t13_re + t13_im*t13_im + t23_re*t23_re + t23_im*t23_im"},
    {"p3": "sqrt(((t11-q3)*(t11-q3) + (t22-q3)*(t22-q3) + (t33-q3)*(t33-q3) + 2*o2)/6)"},
    {
        "d3": "(t11-q3)*(t22-q3)*(t33-q3) + 2*((t12_re*t23_re - t12_im*t23_im)*t13_re + (t12_re*t23_im + t12_im*t23_re)*t13_im)"
        " - (t11-q3)*(t23_re*t23_re + t23_im*t23_im) - (t22-q3)*(t13_re*t13_re + t13_im*t13_im) - (t33-q3)*(t12_re*t12_re + t12_im*t12_im)"
    },
    {"f3": "CASE WHEN p3 > 0 THEN acos(least(1e0, greatest(-1e0, d3/(2*p3*p3*p3))))/3 ELSE 0e0 END"},
    {"t1": "q3 + 2*p3*cos(f3)", "t3": "q3 + 2*p3*cos(f3 + 2*pi()/3)"},
    {"t2": "3*q3 - t1 - t3"},
]
_SUM = "(t1 + t2 + t3)"


def _plogp(t: str) -> str:
    return f"CASE WHEN {_SUM} > 0 AND {t} > 0 THEN {t}/{_SUM}*ln({t}/{_SUM})/ln(3e0) ELSE 0e0 END"


ENTROPY = f"least(1e0, greatest(0e0, -({_plogp('t1')} + {_plogp('t2')} + {_plogp('t3')})))"
ANISOTROPY = "CASE WHEN t2 + t3 > 0 THEN least(1e0, greatest(0e0, (t2 - t3)/(t2 + t3))) ELSE 0e0 END"
#: Eigenvalues m1, m2 of the lower 2x2 block give each eigenvector's first component.
MINOR: Stages = [
    {"mh": "(t22 + t33)/2", "md": "sqrt((t22 - t33)*(t22 - t33)/4 + t23_re*t23_re + t23_im*t23_im)"},
    {"m1": "mh + md", "m2": "mh - md"},
]


def alpha_of(i: int) -> str:
    """The alpha angle of eigenvector i in degrees; an undefined component counts as 0, an infinite one as 1."""
    a, b, c = f"t{i}", *[f"t{k}" for k in (1, 2, 3) if k != i]
    top, under = f"(({a} - m1)*({a} - m2))", f"(({a} - {b})*({a} - {c}))"
    part = f"CASE WHEN {under} <> 0 THEN {top}/{under} WHEN {top} > 0 THEN 1e0 ELSE 0e0 END"
    return f"degrees(acos(sqrt(least(1e0, greatest(0e0, {part})))))"


ALPHA = alpha_of(1)
MEAN_ALPHA = f"CASE WHEN {_SUM} > 0 THEN (t1*{alpha_of(1)} + t2*{alpha_of(2)} + t3*{alpha_of(3)})/{_SUM} ELSE 0e0 END"
#: A single look has rank one: alpha follows from the Pauli vector alone.
SINGLE_LOOK_ALPHA = "CASE WHEN t11 + t22 + t33 > 0 THEN degrees(acos(sqrt(least(1e0, greatest(0e0, t11/(t11 + t22 + t33)))))) ELSE 90e0 END"
