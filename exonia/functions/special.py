"""Special functions: gamma and beta functions and the distributions made of them, as plain functions and as columns.

The plain functions work on floats; column() makes a pandas UDF of any of them, with null for null and for arguments
outside the domain."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, CLOSE, STEPS = 1e-300, 1e-15, 10_000


def gammln(x: float) -> float:
    return math.lgamma(x)


def factln(n: float) -> float:
    return math.lgamma(n + 1)


def factorial(n: float) -> float:
    return math.exp(factln(n)) if n > 20 else float(math.factorial(int(n)))


#: The coefficients of Stirling's series for ln gamma, of 1 / z to the powers 1, 3, 5 and so on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
LIFT = 8


def gammln_column(x: Column) -> Column:
    """ln gamma of a positive double as an expression: Stirling's series at x + 8, from which the recurrence leads back. Null for
    null and for x <= 0."""
    z = x + LIFT
    series = sum(((F.lit(c) / F.pow(z, F.lit(2 * k + 1))) for k, c in enumerate(STIRLING)), F.lit(0.0))
    back = x
    for k in range(1, LIFT):
        back = back * (x + k)
    return F.when(x > 0, (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(back))


def factln_column(n: Column) -> Column:
    return gammln_column(n.cast("double") + 1)


def poisson_ln_column(rate: Column, k: Column) -> Column:
    return k * F.ln(rate) - rate - factln_column(k)


def bicoln(n: float, k: float) -> float:
    """ln of n over k."""
    return factln(n) - factln(k) - factln(n - k)


def powers(x: float, n: int) -> list[float]:
    """x to the powers 0 to n."""
    out = [1.0]
    for _ in range(n):
        out.append(out[-1] * x)
    return out


def continued(b0: float, terms: Callable[[int], tuple[float, float]]) -> float:
    """b0 + a1 / (b1 + a2 / (b2 + ...)) by the modified method of Lentz; terms(k) is (a_k, b_k)."""
    value = c = b0 or TINY
    d = 0.0
    for k in range(1, STEPS):
        a, b = terms(k)
        d = 1 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        value *= c * d
        if abs(c * d - 1) < CLOSE:
            break
    return value


def gser(a: float, x: float) -> float:
    """The lower regularized gamma function as a series; for x < a + 1."""
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * CLOSE / 10:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def gcf(a: float, x: float) -> float:
    """The upper regularized gamma function as a continued fraction; for x >= a + 1."""
    tail = continued(x + 1 - a, lambda k: (-k * (k - a), x + 2 * k + 1 - a))
    return math.exp(a * math.log(x) - x - math.lgamma(a)) / tail


def gammp(a: float, x: float) -> float:
    return gser(a, x) if x < a + 1 else 1 - gcf(a, x)


def gammq(a: float, x: float) -> float:
    return 1 - gser(a, x) if x < a + 1 else gcf(a, x)


def betacf(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""

    def term(k: int) -> tuple[float, float]:
        if k == 1:
            return 1.0, 1.0
        m, odd = divmod(k - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return continued(0.0, term)


def betai(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * betacf(b, a, 1 - x) / b


def student_t(t: float, df: float) -> float:
    """The probability that |T| is at least |t|."""
    return betai(df / 2, 0.5, df / (df + t * t))


def erfcc(x: float) -> float:
    return math.erfc(x)


def log_erfcc(x: float) -> float:
    """ln erfc(x), also where erfc(x) is too small for a float."""
    if x < 25:
        return math.log(math.erfc(x))
    return -x * x - math.log(continued(x, lambda k: (k / 2, x))) - 0.5 * math.log(math.pi)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def log_normal_cdf(x: float) -> float:
    return log_erfcc(-x / math.sqrt(2)) - math.log(2)


def poisson_ln(rate: float, k: float) -> float:
    return k * math.log(rate) - rate - factln(k)


def poisson_cumulative(rate: float, k: float) -> float:
    """The probability of fewer than k."""
    return gammq(k, rate) if k > 0 else 0.0


def poisson_tail(rate: float, k: float) -> float:
    """The probability of k or more."""
    return gammp(k, rate) if k > 0 else 1.0


def chi_square_tail(df: float, x: float) -> float:
    return gammq(df / 2, x / 2)


def minimum(f: Callable[[float], float], low: float, middle: float, high: float, tolerance: float = 1e-7, steps: int = 200) -> tuple[float, float]:
    """(x, f(x)) at a minimum of f between low and high, by Brent's method: parabolas through the three best points where they
    converge, golden sections elsewhere."""
    golden = (3 - math.sqrt(5)) / 2
    a, b = min(low, high), max(low, high)
    best = second = third = middle
    f_best = f_second = f_third = f(middle)
    move = before = 0.0
    for _ in range(steps):
        center = (a + b) / 2
        tol = tolerance * abs(best) + 1e-12
        if abs(best - center) <= 2 * tol - (b - a) / 2:
            break
        use = False
        if abs(before) > tol:
            r, q = (best - second) * (f_best - f_third), (best - third) * (f_best - f_second)
            p, q = (best - third) * q - (best - second) * r, 2 * (q - r)
            p, q = (-p if q > 0 else p), abs(q)
            if q and abs(p) < abs(0.5 * q * before) and q * (a - best) < p < q * (b - best):
                before, move, use = move, p / q, True
                if min(best + move - a, b - best - move) < 2 * tol:
                    move = math.copysign(tol, center - best)
        if not use:
            before = (a if best >= center else b) - best
            move = golden * before
        x = best + (move if abs(move) >= tol else math.copysign(tol, move))
        fx = f(x)
        if fx <= f_best:
            a, b = (best, b) if x >= best else (a, best)
            third, second, best = second, best, x
            f_third, f_second, f_best = f_second, f_best, fx
        else:
            a, b = (x, b) if x < best else (a, x)
            if fx <= f_second or second == best:
                third, second, f_third, f_second = second, x, f_second, fx
            elif fx <= f_third or third in (best, second):
                third, f_third = x, fx
    return best, f_best


def column(function: Callable[..., float], *args: Column | str) -> Column:
    """A function of this module on columns of doubles."""

    def one(*row) -> float | None:
        if any(v is None or v != v for v in row):
            return None
        try:
            return float(function(*row))
        except (ValueError, OverflowError, ZeroDivisionError):
            return None

    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*series, strict=True)], dtype=object).astype("Float64")

    udf = {1: lambda a: apply(a), 2: lambda a, b: apply(a, b), 3: lambda a, b, c: apply(a, b, c)}[len(args)]
    udf.__annotations__ = {k: pd.Series for k in ("a", "b", "c")[: len(args)]} | {"return": pd.Series}
    return F.pandas_udf(udf, "double")(*(F.col(c) if isinstance(c, str) else c for c in args))
