"""Student's t distribution as Spark column expressions, at the same cost for any degrees of freedom.

With ``D = sqrt(df + t^2)`` and ``c = |t| / D`` the two tails are the density at ``t`` times

    2 D * integral over z > 0 of (1 + 2 c z + z^2) ^ (-(df + 1) / 2)

The tail itself is integrated, so a small p value keeps all its digits, and everything else is
kept as a logarithm. The integral takes a fixed number of exp-sinh nodes, whose range covers
both slow (few degrees of freedom) and fast decay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_STEP = 1 / 16
_NODES = [
    (s, _STEP * math.pi / 2 * math.cosh(k * _STEP) * s)
    for k in range(-68, 69)
    for s in [math.exp(math.pi / 2 * math.sinh(k * _STEP))]
]
# The argument of the gamma ratio is raised by so much before its asymptotic series is used.
_RAISED = 16
# Coefficients of 1/a, 1/a^3, ... in log(Gamma(a + 1/2) / Gamma(a)) - log(a) / 2.
_GAMMA_RATIO = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432)
# Newton steps on the logarithms; the curve is concave, so they cannot diverge.
_NEWTON = 30


def _log_gamma_ratio(a: Column) -> Column:
    """log(Gamma(a + 1/2) / Gamma(a)) for a > 0."""
    raised = a + F.lit(float(_RAISED))
    lowered = F.aggregate(
        F.array(*[F.lit(float(k)) for k in range(_RAISED)]),
        F.lit(0.0),
        lambda total, k: total + F.log1p(F.lit(-0.5) / (a + k + F.lit(0.5))),
    )
    series = F.lit(0.0)
    for coefficient in reversed(_GAMMA_RATIO):
        series = series / (raised * raised) + F.lit(coefficient)
    return F.log(raised) / F.lit(2.0) + series / raised + lowered


def _log_density(t: Column, df: Column) -> Column:
    """Logarithm of the density at t >= 0."""
    ratio = t / F.sqrt(df)
    spread = F.when(ratio > F.lit(1e8), F.log(ratio) * F.lit(2.0)).otherwise(F.log1p(ratio * ratio))
    front = _log_gamma_ratio(df / F.lit(2.0)) - F.log(df * F.lit(math.pi)) / F.lit(2.0)
    return front - (df + F.lit(1.0)) / F.lit(2.0) * spread


def _log_tails_over_density(t: Column, df: Column) -> Column:
    """log(P(|T| >= t) / density(t)) for t >= 0."""
    root = F.hypot(t, F.sqrt(df))
    more = df + F.lit(1.0)
    cosine = t / root
    nodes = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in _NODES])
    seed = F.struct(
        cosine.alias("c"),
        (F.lit(1.0) / (cosine * more + F.sqrt(more))).alias("scale"),
        (more / F.lit(2.0)).alias("power"),
        F.lit(0.0).alias("total"),
    )

    def add(state: Column, node: Column) -> Column:
        z = state["scale"] * node["s"]
        part = node["w"] * F.exp(-state["power"] * F.log1p(z * (F.lit(2.0) * state["c"] + z)))
        return F.struct(
            state["c"].alias("c"), state["scale"].alias("scale"), state["power"].alias("power"),
            (state["total"] + part).alias("total"),
        )

    integral = F.aggregate(nodes, seed, add, lambda state: state["total"] * state["scale"])
    return F.log(integral) + F.log(root) + F.lit(math.log(2.0))


def log_two_sided_p(t: Column, df: Column) -> Column:
    """log P(|T| >= |t|), also where the p value itself is too small for a double.

    Null for df < 1 or a null statistic; an infinite statistic has log p = -infinity.
    """
    df, size = df.cast("double"), F.abs(t.cast("double"))
    found = F.least(F.lit(0.0), _log_density(size, df) + _log_tails_over_density(size, df))
    found = F.when(size == F.lit(0.0), F.lit(0.0)).when(size == F.lit(math.inf), F.lit(-math.inf)).otherwise(found)
    return F.when((df >= F.lit(1.0)) & size.isNotNull(), found)


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for ``df`` degrees of freedom; null for df < 1 or a null statistic."""
    return F.exp(log_two_sided_p(t, df))


def critical_value(df: Column, confidence: float = 0.95) -> Column:
    """t with P(|T| >= t) = 1 - confidence; null for df < 1."""
    if not 0.0 < confidence < 1.0:
        raise ValueError(f"confidence must lie between 0 and 1: {confidence}")
    wide = F.when(df >= F.lit(1), df.cast("double"))
    target = F.lit(math.log1p(-confidence))

    def nearer(state: Column, _step: Column) -> Column:
        # d log p / d log t = -2 t density / p
        t = F.exp(state)
        over = _log_tails_over_density(t, wide)
        excess = _log_density(t, wide) + over - target
        return state + excess * F.exp(over - state) / F.lit(2.0)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), F.lit(math.log(2.0)), nearer)
    return F.when(wide.isNotNull(), F.exp(found))
