"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def entity() -> WindowSpec:
    """The time axis of an entity."""
    return Window.partitionBy("code").orderBy("date")


def period() -> WindowSpec:
    """The cross-section of a period."""
    return Window.partitionBy("date")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_not_finite(c: Column | str) -> Column:
    """NaN and infinity count as missing everywhere."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def correlation(a: str, b: str) -> Column:
    """Of the rows that have both; null where one of them does not vary (``corr`` divides by zero there)."""
    spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
    return ratio(F.covar_pop(a, b), spread)


def rint2(c: Column | str) -> Column:
    """To two decimals, halves to even on the scaled value."""
    return F.rint(col(c) * 100) / 100


def frame(n: int, past: bool = False) -> WindowSpec:
    """The last ``n`` rows with this one, or (``past``) before it."""
    return entity().rowsBetween(-n, -1) if past else entity().rowsBetween(-(n - 1), 0)


def rolling(agg: Callable, c: Column | str, n: int, at_least: int | None = None, past: bool = False) -> Column:
    """An aggregate over ``n`` rows, null with fewer than ``at_least`` values (all, by default)."""
    w = frame(n, past)
    return F.when(F.count(col(c)).over(w) >= (n if at_least is None else at_least), agg(col(c)).over(w))


def rolling_median(c: Column | str, n: int, past: bool = False) -> Column:
    """The median of ``n`` rows, null with fewer values: sorted as an array, as a percentile over a moving frame builds a table of counts for every row."""
    w = frame(n, past)
    x = F.sort_array(F.collect_list(col(c)).over(w))
    return F.when(F.count(col(c)).over(w) >= n, (F.get(x, F.lit((n - 1) // 2)) + F.get(x, F.lit(n // 2))) / 2)


def lag(c: Column | str, k: int = 1) -> Column:
    return F.lag(col(c), k).over(entity())


def lead(c: Column | str, k: int = 1) -> Column:
    return F.lead(col(c), k).over(entity())


def change(c: Column | str, k: int) -> Column:
    """Relative change over ``k`` rows."""
    return ratio(c, lag(c, k)) - 1


def median(c: Column) -> Column:
    return F.percentile(c, 0.5)


def rank_pct(c: Column | str, by: list[str]) -> Column:
    """Average rank over count, 0 < p <= 1, among the non-null values of a group.

    Rank, ties (the peers of a row) and count share one partitioning, so any number of ranks costs one shuffle.
    """
    x = col(c)
    group = Window.partitionBy(*by)
    ordered = group.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(x).over(group))


def bins(p: Column, n: int = 10) -> Column:
    """Bins 1..n of a percentile; an exact edge goes up."""
    return (F.least(F.floor(p * n), F.lit(n - 1)) + 1).cast("int")


def streak(flag: Column) -> Column:
    """Length of the run of true rows that ends here."""
    order = entity()
    # the position of the last row that is not true ends the run before
    at = F.row_number().over(order)
    broken = F.max(F.when(~F.coalesce(flag, F.lit(False)), at)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (at - F.coalesce(broken, F.lit(0))).cast("int")


def ewm(c: str, span: int) -> Column:
    """Exponential mean with weight 2 / (span + 1), started at the first value; needs one row per (code, date) and no gaps.

    A running sum of the values, each scaled by the inverse of its weight, gives the mean within a block of rows; the last
    mean of the block before is carried in, and what is older has a weight below 1e-17, which does not change a double.
    """
    alpha = 2.0 / (span + 1)
    block = int(-40 / _log(1 - alpha)) + 1
    at = F.row_number().over(entity()) - 1
    pos, fade = at % block, F.lit(1 - alpha)
    scaled = F.col(c) * F.when(at == 0, 1.0).otherwise(alpha) * F.pow(fade, -pos)
    inside = Window.partitionBy("code", F.floor(at / block)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    here = F.sum(scaled).over(inside) * F.pow(fade, pos)
    carried = F.last(F.when(pos == block - 1, here), ignorenulls=True).over(entity().rowsBetween(Window.unboundedPreceding, -1))
    return here + F.coalesce(carried * F.pow(fade, pos + 1), F.lit(0.0))


def _log(x: float) -> float:
    import math

    return math.log(x)
