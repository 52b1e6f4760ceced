"""Scalar and array column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- text -> number

def leading_number(col, stops: str = "-+") -> Column:
    """Number before the first stop character ("1950-1955" -> 1950, "100+" -> 100).

    No match gives '' which ``try_cast`` turns into NULL, like R's NA.
    """
    pattern = "^(.+?)[" + "".join("\\" + ch for ch in stops) + "]"
    return F.regexp_extract(_c(col), pattern, 1).try_cast("double")


def to_number(col) -> Column:
    """Text to double; bad text becomes NULL (never raises under ANSI)."""
    return _c(col).cast("string").try_cast("double")


# ---------------------------------------------------------------- binning

def bin_lower_edge(x, edges, closed_last: bool = True) -> Column:
    """Label of the half-open bin [e_i, e_i+1) containing ``x``.

    ``edges`` is a sorted array column (or a Python list) of bin edges; the
    label is the lower edge. Values below the first edge, or above the last
    one, get NULL. With ``closed_last`` a value equal to the last edge falls
    in the last bin (R's ``include.lowest`` with ``right = FALSE``).
    """
    e = F.array(*[F.lit(float(v)) for v in edges]) if isinstance(edges, (list, tuple)) else _c(edges)
    xv = _c(x).cast("double")
    lowers = F.slice(e, 1, F.size(e) - 1)
    label = F.try_element_at(F.filter(lowers, lambda v: v <= xv), F.lit(-1))
    last = F.element_at(e, -1)
    inside = (xv <= last) if closed_last else (xv < last)
    return F.when(inside, label)


# ---------------------------------------------------------------- link functions

# Coefficients of Lanczos' approximation with g = 7 and nine
# terms, as published; relative error below 1e-14 for x >= 0.5.
LANCZOS_G = 7
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x) -> Column:
    """Natural logarithm of the gamma function for x > 0; Infinity at 0, NULL below.

    Below one half Gamma(x) = Gamma(x + 1) / x is used, which needs no
    reflection for positive arguments.
    """
    x = _c(x).cast("double")
    up = F.when(x < 0.5, x + 1.0).otherwise(x)
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (up + float(i))
    t = up + (LANCZOS_G - 0.5)
    value = F.lit(0.91893853320467274178) + (up - 0.5) * F.ln(t) - t + F.ln(series)
    return F.when(x == 0, F.lit(float("inf"))).when(x > 0, value - F.when(x < 0.5, F.ln(x)).otherwise(F.lit(0.0)))


def once(df, **computed: Column):
    """``df`` with ``computed`` columns that are evaluated once a row.

    They come out of a generator, so the optimizer copies no costly array
    expression into the lambdas or filters that use its result.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))))


def log0(x) -> Column:
    """Natural logarithm with log 0 = -Infinity (Spark's ``ln`` gives NULL)."""
    x = _c(x)
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def logit(p) -> Column:
    """log(p / (1 - p)), -Infinity at 0 and Infinity at 1; NULL outside [0, 1]."""
    p = _c(p)
    return F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).otherwise(
        F.ln(F.try_divide(p, F.lit(1.0) - p)))


def inv_logit(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def arr_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + v)


def arr_dot(a, b) -> Column:
    return arr_sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used inside.

    A column expression used in a lambda is evaluated again for every
    element; bound as a lambda's own variable it is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(arr) -> Column:
    """Numerically stable softmax of an array<double> (max-shifted)."""
    return let(_c(arr), lambda a: let(F.array_max(a), lambda m: normalise(F.transform(a, lambda v: F.exp(v - m)))))


def normalise(arr) -> Column:
    return let(_c(arr), lambda a: let(arr_sum(a), lambda total: F.transform(a, lambda v: v / total)))


def zeros(n) -> Column:
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.array_repeat(F.lit(0.0), n)


def floor_at(arr, lo: float = 0.001) -> Column:
    """Elementwise max(x, lo) (R's ``pmax``), e.g. to allow log-ratios of 0 counts."""
    return F.transform(_c(arr), lambda v: F.greatest(v, F.lit(float(lo))))


def nullable_array(arr) -> Column:
    """Same values, element type declared nullable.

    ``aggregate`` takes its accumulator type from the initial value; with
    non-nullable elements (e.g. ``array_repeat(0.0, k)``) a NULL produced in
    a later step would be stored as 0.0. ``try_add(x, 0.0)`` is always
    nullable and is not simplified away by the optimizer.
    """
    return F.transform(_c(arr), lambda v: F.try_add(v, F.lit(0.0)))


# ---------------------------------------------------------------- inverse normal CDF
# Coefficients of Wichura's algorithm AS 241 (PPND16),
# Applied Statistics 37(3), 1988 — published constants, in published order.
AS241_A = [3.387132872796366608, 133.14166789178437745, 1971.5909503065514427,
           13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
           33430.575583588128105, 2509.0809287301226727]
AS241_B = [1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077,
           21213.794301586595867, 39307.89580009271061, 28729.085735721942674,
           5226.495278852545925]
AS241_C = [1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055,
           3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177,
           0.0227238449892691845833, 7.7454501427834140764e-4]
AS241_D = [1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455,
           0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4,
           1.05075007164441684324e-9]
AS241_E = [6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358,
           0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386,
           2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525,
           7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7,
           2.04426310338993978564e-15]


def _dlit(c: float) -> str:
    # exponent form parses as DOUBLE (not DECIMAL) in Spark SQL and DuckDB
    return format(float(c), ".17e")


def _horner_sql(coefs: Sequence[float], r: str) -> str:
    expr = _dlit(coefs[-1])
    for c in reversed(coefs[:-1]):
        expr = f"(({expr}) * {r} + {_dlit(c)})"
    return expr


def norm_ppf_sql(p: str) -> str:
    """Inverse standard normal CDF of SQL expression ``p`` as SQL text.

    Plain CASE/ln/sqrt arithmetic, valid in Spark SQL and DuckDB alike.
    NULL outside (0, 1).
    """
    q = f"(({p}) - 5.0e-1)"
    r1 = f"(1.80625e-1 - {q} * {q})"
    central = f"({q} * {_horner_sql(AS241_A, r1)} / {_horner_sql(AS241_B, r1)})"
    rt = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1.0e0 - ({p}) END))"
    r2 = f"({rt} - 1.6e0)"
    r3 = f"({rt} - 5.0e0)"
    mid = f"({_horner_sql(AS241_C, r2)} / {_horner_sql(AS241_D, r2)})"
    far = f"({_horner_sql(AS241_E, r3)} / {_horner_sql(AS241_F, r3)})"
    tail = f"(CASE WHEN {rt} <= 5.0e0 THEN {mid} ELSE {far} END)"
    return (f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL "
            f"WHEN abs({q}) <= 4.25e-1 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def norm_ppf(col: str) -> Column:
    """Column form of :func:`norm_ppf_sql` for a column name."""
    return F.expr(norm_ppf_sql(f"`{col}`"))
