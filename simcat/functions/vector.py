"""Row expressions on vectors and scores (higher-order functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L2_EPS = 1e-12
# Scores equal to this many decimals are ties, broken by id ascending. Float noise
# (summation order of a dot product) lives around 1e-16 and must not decide ranks.
TIE_DECIMALS = 12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """P-10: dot product in double (cosine for unit vectors)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_normalize(v, eps: float = L2_EPS) -> Column:
    """E-3: v / max(||v||, eps) as float32; a zero vector stays zero.

    The norm is computed once, in the finish step of ``aggregate``."""
    vc = _c(v)
    return F.aggregate(
        vc,
        F.lit(0.0).cast("double"),
        lambda s, x: s + x.cast("double") * x.cast("double"),
        lambda s: F.transform(vc, lambda x: (x.cast("double") / F.greatest(F.sqrt(s), F.lit(eps))).cast("float")),
    )


def _split(a: Column) -> tuple[Column, Column]:
    # Veltkamp split of a double into two 26-bit halves (a = hi + lo exactly).
    c = F.lit(134217729.0) * a
    hi = c - (c - a)
    return hi, a - hi


def py_round(x, decimals: int) -> Column:
    """Python ``round(x, n)`` on doubles: the exact binary value rounded half to even.

    ``bround`` rounds the shortest decimal form instead (0.00015 -> 0.0002, where
    Python gives 0.0001 because the double is 0.000149999...). Here p = x * 10^n
    is computed with its exact rounding error (Dekker's two-product): only when p
    lands exactly on k + 0.5 can the error change the result, and its sign then
    decides; an exact tie goes to even (``rint``). The integer is divided back by
    10^n, correctly rounded, as Python does."""
    xc = _c(x)
    scale = float(10 ** decimals)
    b = F.lit(scale)
    p = xc * b
    ah, al = _split(xc)
    bh, bl = _split(b)
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    fl = F.floor(p).cast("double")
    tie = (p - fl) == F.lit(0.5)
    r = (F.when(tie & (err > 0), fl + 1).when(tie & (err < 0), fl).otherwise(F.rint(p)))
    return F.when(F.isnan(xc) | (F.abs(p) >= F.lit(2.0 ** 52)), xc).otherwise(r / b)


def round_score(s, decimals: int) -> Column:
    """P-12 then P-11: Python ``round`` (half to even), then clamp into [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), py_round(s, decimals)))


def tie_key(s) -> Column:
    return F.round(_c(s), TIE_DECIMALS)

