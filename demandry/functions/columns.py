"""Column expressions shared by the operators."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandry import schema as S

_BLANKS = " \t\n\r\x0b\x0c"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(col(c).cast("string"), F.lit(_BLANKS))


def to_number(c: str | Column) -> Column:
    """Text to double: blanks dropped, comma as decimal point, anything else null.

    One character mapping and one cast, because this runs on every numeric field of every row read. The letters
    are mapped to a mark no number has: the cast alone would take number suffixes, hexadecimal floats and
    the words for infinity and not-a-number.
    """
    return F.translate(col(c).cast("string"), ",dDfFxXnNiI ", ".##########").try_cast("double")


def to_day(c: str | Column) -> Column:
    """Text to date, ISO or day/month/year, with or without leading zeros."""
    s = strip(c)
    return F.when(s.contains("/"), F.try_to_date(s, "d/M/yyyy")).otherwise(F.try_to_date(s, "yyyy-M-d"))


def to_int(c: str | Column) -> Column:
    """Text to a whole number; null where it is none or does not fit."""
    return to_number(c).try_cast("int")


def month_of(c: str | Column) -> Column:
    return F.trunc(col(c), "month")


def month_from_parts(year: str | Column, month: str | Column) -> Column:
    """First day of a month from two loose numbers; year defaults to 2024, month to 1 and is kept in 1..12.

    Null where the year is none that a date can have."""
    given = col(year).cast("string").try_cast("double")
    y = F.when(given.isNull(), F.lit(2024)).otherwise(given.try_cast("int"))
    m = F.coalesce(col(month).cast("string").try_cast("double"), F.lit(1.0))
    m = F.least(F.greatest(m, F.lit(1.0)), F.lit(12.0)).cast("int")
    fits = y.between(1, 9999)
    return F.when(fits, F.make_date(F.when(fits, y), m, F.lit(1)))


def month_name(c: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in S.MONTH_NAMES]), F.month(col(c)))


def expected_balance() -> Column:
    """Balance that follows from the movement; null for other kinds."""
    sign = F.when(F.col("kind") == S.SALE, -1.0).when(F.col("kind") == S.PRODUCTION, 1.0)
    return F.col("stock_before") + sign * F.col("qty")


def balance_broken(tolerance: float = S.STOCK_TOLERANCE) -> Column:
    """True where the stated balance is off by more than ``tolerance``; false for nulls and other kinds.

    A stated balance of -1 makes the relative error infinite unless the balance is exactly right, in
    which case it is undefined and the row stays.
    """
    gap = F.abs(expected_balance() - F.col("stock_after"))
    off = F.try_divide(gap, F.abs(F.col("stock_after") + 1)) > tolerance
    return F.coalesce(off, F.coalesce(gap > 0, F.lit(False)) & (F.col("stock_after") == -1), F.lit(False))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or ``default`` unless b > 0."""
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(default))


def service_level(abc: str | Column) -> Column:
    c = F.upper(strip(F.coalesce(col(abc), F.lit("C"))))
    out = F.lit(S.SERVICE_LEVEL_OTHER)
    for label, level in S.SERVICE_LEVEL.items():
        out = F.when(c == label, F.lit(level)).otherwise(out)
    return out


def z_of_service_level(level: str | Column) -> Column:
    """Z of the nearest tabulated level; the first one on a tie."""
    best = None
    lv = col(level)
    for tab, z in S.Z_BY_SERVICE_LEVEL:
        gap = F.abs(F.lit(tab) - lv)
        if best is None:
            best = (gap, F.lit(z))
        else:
            closer = gap < best[0]
            best = (F.when(closer, gap).otherwise(best[0]), F.when(closer, F.lit(z)).otherwise(best[1]))
    return best[1]


def newsvendor_z(cost_stockout: float, cost_inventory: float) -> float:
    """Z of the critical ratio for two given unit costs."""
    total = float(cost_stockout) + float(cost_inventory)
    if total <= 0:
        return S.Z_DEFAULT
    return statistics.NormalDist().inv_cdf(min(0.999, max(0.001, cost_stockout / total)))


# Coefficients of Acklam's rational approximation of the normal quantile.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def _rational_quantile(p: Column) -> Column:
    """Inverse normal distribution as a plain expression (relative error below 1.2e-9)."""
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    return (
        F.when(p < 0.02425, _poly(_C, low) / (_poly(_D, low) * low + 1))
        .when(p > 1 - 0.02425, -_poly(_C, high) / (_poly(_D, high) * high + 1))
        .otherwise(_poly(_A, r) * q / (_poly(_B, r) * r + 1))
    )


def _refined(z: Column, p: Column) -> Column:
    """One Newton step for the quantile, with the distribution function by its series: z^(2k+1) / (1 * 3 * ... * (2k+1))."""
    add = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(z.alias("term"), z.alias("sum")), add, lambda s: s["sum"])
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return z - (F.lit(0.5) + density * series - p) / density


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution as a plain expression: to about 15 digits up to four deviations, to 9 beyond."""
    both = F.struct(_rational_quantile(p).alias("z"), p.alias("p"))
    exact = F.transform(F.array(both), lambda s: F.when(F.abs(s["z"]) < 4, _refined(s["z"], s["p"])).otherwise(s["z"]))
    return F.get(exact, F.lit(0))


def newsvendor_z_of(cost_stockout: str | Column, cost_inventory: str | Column) -> Column:
    """Row-wise :func:`newsvendor_z` for costs held in columns."""
    cs, ci = col(cost_stockout).cast("double"), col(cost_inventory).cast("double")
    p = F.least(F.greatest(F.try_divide(cs, cs + ci), F.lit(0.001)), F.lit(0.999))
    return F.when(cs + ci > 0, normal_quantile(p)).otherwise(F.lit(S.Z_DEFAULT))
