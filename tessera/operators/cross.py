"""The cross-section of a period: ranks, groups, markets, regimes, information coefficients and excess returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bins, change, correlation, period, rank_pct, ratio, rolling, rolling_median

COST = 0.003  # of a round trip
YEAR = 252  # periods
#: Market variants: name, smallest and largest size group.
INDICES = (("all", None, None), ("small50", 0, 4), ("small30", 0, 2), ("small20", 0, 1), ("small10", 0, 0), ("big50", 5, 9))
MARKET_MA = (20, 60, 120)


def size_groups(df: DataFrame, by: str = "amt20_lag", n: int = 10) -> DataFrame:
    """size_grp 0..n-1 from lagged turnover."""
    out = df.withColumn("amt20_lag", rolling(F.avg, "turnover", 20, past=True)) if by == "amt20_lag" and by not in df.columns else df
    return out.withColumn("size_grp", bins(rank_pct(by, ["date"]), n) - 1)


def market_returns(df: DataFrame, ret: str = "ret") -> DataFrame:
    """Equal-weight mean, rising share and count by day; one row a period."""
    return df.groupBy("day", "date").agg(F.avg(ret).alias("mkt_ret"), F.avg(F.when(F.col(ret).isNotNull(), (F.col(ret) > 0).cast("double"))).alias("breadth"), F.count(ret).alias("n"))


def group_returns(df: DataFrame, by: list[str], spans: tuple[int, ...] = (5, 10, 20, 60), name: str = "grp") -> DataFrame:
    """Mean return of a group by day, its value, and returns over several days of the group's own rows."""
    w = Window.partitionBy(*by).orderBy("date")
    means = df.groupBy("date", *by).agg(F.avg("ret").alias(f"{name}_ret1"))
    means = means.withColumn("nav", F.product(1 + F.coalesce(f"{name}_ret1", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return means.withColumns({f"{name}_ret{k}": F.col("nav") / F.lag("nav", k).over(w) - 1 for k in spans}).drop("nav")


def market_states(df: DataFrame, ret: str = "ret", indices: tuple = INDICES) -> DataFrame:
    """By index variant, average length and day: value, average, distance, bull flag, volatility and its full-sample median.

    ``df``: code rows with day, size_grp (where a variant asks for it) and returns. A value without an average yet is not a
    bull day. All variants come from one aggregation by day; the result has three rows for each variant and period.
    """
    variants = []
    for name, low, high in indices:
        inside = F.lit(True) if low is None else F.col("size_grp").between(low, high)
        rising = F.when(inside & F.col(ret).isNotNull(), (F.col(ret) > 0).cast("double"))
        variants.append(F.struct(F.lit(name).alias("index"), F.avg(F.when(inside, F.col(ret))).alias("r"), F.avg(rising).alias("breadth"), F.count(F.when(inside, 1)).alias("rows")))
    daily = df.groupBy("day", "date").agg(F.array(*variants).alias("v")).select("day", "date", F.inline("v")).where("rows > 0").drop("rows")
    w = Window.partitionBy("index").orderBy("day")
    r = F.coalesce("r", F.lit(0.0))
    daily = daily.withColumn("nav", F.product(1 + r).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hv = F.when(F.count(r).over(w.rowsBetween(-19, 0)) >= 20, F.stddev_samp(r).over(w.rowsBetween(-19, 0)) * YEAR**0.5)
    daily = daily.withColumn("hv20", hv).withColumn("hv_med", F.percentile("hv20", 0.5).over(Window.partitionBy("index")))
    daily = daily.withColumns({f"_ma{m}": F.when(F.count("nav").over(w.rowsBetween(-(m - 1), 0)) >= m, F.avg("nav").over(w.rowsBetween(-(m - 1), 0))) for m in MARKET_MA})
    out = daily.select("*", F.explode(F.array(*(F.struct(F.lit(m).alias("ma_len"), F.col(f"_ma{m}").alias("ma")) for m in MARKET_MA))).alias("m")).select("index", "day", "date", "nav", "breadth", "hv20", "hv_med", "m.ma_len", "m.ma")
    return out.withColumns({"dist": F.col("nav") / F.col("ma") - 1, "bull": F.coalesce(F.col("nav") > F.col("ma"), F.lit(False))})


def forward_chain(market: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20, 40, 60), ret: str = "mkt_ret") -> DataFrame:
    """Market return of the H days after the next, chained from log returns; null where the days run out. One row a period."""
    w = Window.orderBy("day")
    out = market.withColumn("cs", F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumns({f"chain{h}": F.expm1(F.lead("cs", h + 1).over(w) - F.lead("cs", 1).over(w)) for h in horizons}).drop("cs")


def excess_t(df: DataFrame, value: str, by: list[str] | None = None, least_rows: int = 40, least_days: int = 5) -> DataFrame:
    """Mean and t of daily mean excess returns, with a 95 % interval: days count alike, whatever their rows."""
    by = by or []
    days = df.where(F.col(value).isNotNull()).groupBy(*by, "day").agg(F.avg(value).alias("m"), F.count("*").alias("rows"))
    out = days.groupBy(*by).agg(F.sum("rows").alias("n"), F.count("*").alias("days"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    se = ratio("sd", F.sqrt(F.col("days").cast("double")))
    return out.where((F.col("n") >= least_rows) & (F.col("days") >= least_days)).withColumns({"t": ratio("mean", se), "lo": F.col("mean") - 1.96 * se, "hi": F.col("mean") + 1.96 * se}).drop("sd")


def ranked_pairs(df: DataFrame, factors: list[str], target: str, by: str, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per row and factor that both have a value: factor, x, y, rx, ry, with ``by`` and ``more``.

    The ranks of all factors, and of the target among the rows that have the factor too, lie side by side over one
    shuffle by period; rows are multiplied only behind it, so what is grouped by period next is not dealt out again.
    """
    y = F.col(target).cast("double")
    some = df.select(by, *more, y.alias("_y"), *(F.col(f).cast("double").alias(f) for f in factors)).where("_y IS NOT NULL")
    own = {f: F.when(F.col(f).isNotNull(), F.col("_y")) for f in factors}
    ranked = some.withColumns({f"_x_{f}": rank_pct(f, [by]) for f in factors} | {f"_y_{f}": rank_pct(own[f], [by]) for f in factors})
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("x"), F.col(f"_x_{f}").alias("rx"), F.col(f"_y_{f}").alias("ry")) for f in factors))).alias("s")
    return ranked.select(by, *more, F.col("_y").alias("y"), each).select(by, *more, "y", "s.*").where("x IS NOT NULL")


def daily_ic(df: DataFrame, factors: list[str], target: str, least: int = 30) -> DataFrame:
    """By factor and day, the rank correlation with the target among rows that have both."""
    return ranked_pairs(df, factors, target, "day").groupBy("factor", "day").agg(correlation("rx", "ry").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, spread, information ratio, t, share above 0 and mean size of daily coefficients."""
    out = ic.where("ic IS NOT NULL AND NOT isnan(ic)").groupBy("factor").agg(F.count("*").alias("days"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("pos_rate"), F.avg(F.abs("ic")).alias("mean_abs"))
    return out.withColumns({"ir": ratio("mean_ic", "sd_ic"), "t": ratio(F.col("mean_ic") * F.sqrt(F.col("days").cast("double")), "sd_ic")})


def factor_days(df: DataFrame, factors: tuple[str, ...], q: int = 5, least: int = 30) -> DataFrame:
    """By factor, day and market: rank correlation ``ic`` with ``y``, rows ``k``, and sums s0.. and counts c0.. of ``y`` in ``q`` first-come groups.

    ``df``: day, code, bull, y and the factors. Ranks are those of the day's rows that have the factor, on days with
    ``least`` of them. A day's rows meet once, narrow and not multiplied by factor, and one factor's values are sorted at
    a time. A day has one market in most uses; where it has two, each has its own line.
    """
    kinds = ["factor string", "bull boolean", "day long", "ic double", "k long", *(f"s{i} double" for i in range(q)), *(f"c{i} long" for i in range(q))]

    def mean_ranks(v: np.ndarray) -> np.ndarray:
        _, own, k = np.unique(v, return_inverse=True, return_counts=True)
        return ((np.cumsum(k) - k + 1 + (k - 1) / 2) / len(v))[own]

    def of_day(table: pa.Table) -> pa.Table:
        code, bull, y = (table[c].to_numpy() for c in ("code", "bull", "y"))
        found: list[tuple] = []
        for f in factors:
            has = table[f].is_valid().to_numpy()
            n = int(has.sum())
            if n < least:
                continue
            x, v, b = table[f].to_numpy()[has], y[has], bull[has].astype(bool)
            at = np.empty(n)
            at[np.lexsort((code[has], x))] = np.arange(n)
            group, rx, ry = np.minimum(q - 1, np.floor(at * float(q) / n)).astype(int), mean_ranks(x), mean_ranks(v)
            for market in np.unique(b):
                on = b == market
                dx, dy = rx[on] - rx[on].mean(), ry[on] - ry[on].mean()
                varies = np.ptp(rx[on]) > 0 and np.ptp(ry[on]) > 0
                ic = float((dx * dy).sum() / np.sqrt((dx * dx).sum() * (dy * dy).sum())) if varies else None
                found.append((f, bool(market), int(table["day"][0].as_py()), ic, int(on.sum()), *np.bincount(group[on], v[on], q).tolist(), *np.bincount(group[on], minlength=q).tolist()))
        schema = pa.schema([(k.split()[0], {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}[k.split()[1]]) for k in kinds])
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True) if found else [[]] * len(kinds), schema, strict=True)], schema=schema)

    some = df.where("y IS NOT NULL AND bull IS NOT NULL").select(F.col("day").cast("long").alias("day"), "code", "bull", "y", *factors)
    return some.groupBy("day").applyInArrow(of_day, ", ".join(kinds))


def bull_runs(states: DataFrame, least: int = 20) -> DataFrame:
    """Runs of bull days, and whether a day lies in one of ``least`` days or more. The length of a run looks ahead."""
    w = Window.partitionBy("index", "ma_len").orderBy("day")
    out = states.withColumn("_new", F.when(F.col("bull") != F.coalesce(F.lag("bull").over(w), ~F.col("bull")), 1).otherwise(0))
    out = out.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("run_len", F.count("*").over(Window.partitionBy("index", "ma_len", "run")))
    return out.withColumn("bull_run", F.col("bull") & (F.col("run_len") >= least)).drop("_new")


def quantile_groups(df: DataFrame, factor: str, target: str, q: int = 5) -> DataFrame:
    """Mean target by quantile of a factor: first-come ranks cut at whole multiples of n / q, on days with at least 5 q rows."""
    some = df.where(F.col(factor).isNotNull() & F.col(target).isNotNull())
    n, rank = F.count("*").over(period()), F.row_number().over(period().orderBy(factor, "code"))
    some = some.withColumns({"_n": n, "_rank": rank}).where(F.col("_n") >= 5 * q)
    group = F.least(F.floor((F.col("_rank") - 1) / (F.col("_n") / q)), F.lit(q - 1)).cast("int")
    return some.withColumn("q", group).groupBy("q").agg(F.avg(target).alias("mean"), F.avg((F.col(target) > 0).cast("double")).alias("win"), F.count("*").alias("n"))


def welch(days: DataFrame, value: str, flag: str, horizon: int, least: int = 30) -> DataFrame:
    """Difference of bear-day and bull-day means, its t, and the t deflated for overlapping horizons."""
    agg = lambda f, on: f(F.when(F.col(flag) == on, F.col(value)))
    out = days.agg(agg(F.avg, False).alias("bear"), agg(F.avg, True).alias("bull"), agg(F.var_samp, False).alias("v0"), agg(F.var_samp, True).alias("v1"), agg(F.count, False).alias("n0"), agg(F.count, True).alias("n1"))
    t = ratio(F.col("bear") - F.col("bull"), F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")))
    return out.where((F.col("n0") >= least) & (F.col("n1") >= least)).select("bear", "bull", (F.col("bear") - F.col("bull")).alias("diff"), t.alias("t"), (t / horizon**0.5).alias("t_deflated"), "n0", "n1")


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))


def features(df: DataFrame) -> DataFrame:
    """The factors that queries select on, over clean rows with day and row."""
    out = df.withColumns({
        **{f"ret{k}": change("close", k) for k in (5, 10, 20, 40, 60)},
        **{f"px_ma{n}_pct": ratio("close", rolling(F.avg, "close", n)) - 1 for n in (20, 60, 120)},
        **{f"ma{n}": rolling(F.avg, "close", n) for n in (5, 10, 20)},
        "rvol20": ratio("volume", rolling_median("volume", 20, past=True)), "vt_5_20": ratio(rolling(F.avg, "volume", 5), rolling(F.avg, "volume", 20)),
        "hv20": rolling(F.stddev_samp, "ret", 20) * YEAR**0.5, "amt20_lag": rolling(F.avg, "turnover", 20, past=True),
    })
    return out.withColumns({c: F.round(c, 9) for c in ("ret5", "ret10", "ret20", "ret40", "ret60", "px_ma20_pct", "px_ma60_pct", "px_ma120_pct", "rvol20", "vt_5_20", "hv20", "ma5", "ma10", "ma20")} | {"amt20_lag": F.round("amt20_lag", 4)})


DECILED = ("ret5", "ret10", "ret20", "ret40", "ret60", "px_ma20_pct", "px_ma60_pct", "px_ma120_pct", "hv20", "rvol20", "turnover")


def bin_cuts(df: DataFrame, columns: tuple[str, ...], n: int = 10) -> DataFrame:
    """By date, ``cut_<column>``: the smallest value in bin 2, 3 .. n or above, infinity where there is none; a row a period.

    A bin follows from the value, so these bounds say all that ``bins(rank_pct(c))`` does. Only the ranked columns are
    dealt out by period, a period's values of one column are sorted at a time, and the wide rows stay where they are.
    """

    def cuts(table: pa.Table) -> pa.Table:
        out = {"date": table["date"][:1]}
        for c in columns:
            x, k = np.unique(table[c].drop_null().to_numpy(), return_counts=True)
            p = (np.cumsum(k) - k + 1 + (k - 1) / 2) / max(k.sum(), 1)
            own = np.minimum(np.floor(p * n), n - 1) + 1
            out[f"cut_{c}"] = pa.array([np.append(x, np.inf)[np.searchsorted(own, np.arange(2, n + 1))]], pa.list_(pa.float64()))
        return pa.table(out)

    narrow = df.select("date", *(F.col(c).cast("double").alias(c) for c in columns))
    return narrow.groupBy("date").applyInArrow(cuts, ", ".join(["date date", *(f"cut_{c} array<double>" for c in columns)]))


def binned(c: str, n: int = 10) -> Column:
    """The bin of a row that has ``bin_cuts``; a row without a value is in the last one, as with ``bins``."""
    above = reduce(add, ((F.col(c) >= F.get(f"cut_{c}", F.lit(i))).cast("int") for i in range(n - 1)), F.lit(1))
    return F.when(F.col(c).isNotNull(), above).otherwise(n)


def with_deciles(df: DataFrame, columns: tuple[str, ...] = DECILED, cuts: DataFrame | None = None) -> DataFrame:
    """d_* and size_grp; ``cuts``: those of ``bin_cuts`` for the columns and amt20_lag, worked out if they are not given."""
    known = bin_cuts(df, (*columns, "amt20_lag")) if cuts is None else cuts
    known = F.broadcast(known.select(F.col("date").alias("_date"), *(f"cut_{c}" for c in (*columns, "amt20_lag"))))  # a row a period
    out = df.join(known, F.col("date").eqNullSafe(F.col("_date")), "left")
    return out.select(*df.columns, *(binned(c).alias(f"d_{c}") for c in columns), (binned("amt20_lag") - 1).alias("size_grp"))


def fama_macbeth(df: DataFrame, factors: list[str], target: str, least: int = 30) -> DataFrame:
    """Daily regressions of the target on z-scored factors; mean coefficients and their t.

    A day is aggregated to its correlations, so none of its rows are gathered; the small systems are solved a batch of
    days at a time. Days with fewer rows, or with a factor that does not vary, are left out.
    """
    k = len(factors)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    some = df.select("day", F.col(target).alias("_y"), *factors).dropna()
    days = some.groupBy("day").agg(
        F.count("*").alias("rows"), F.array(*(correlation(factors[i], factors[j]) for i, j in pairs)).alias("r"), F.array(*(correlation(f, "_y") * F.stddev_samp("_y") for f in factors)).alias("c"), F.least(*(F.stddev_samp(f) for f in factors), F.lit(1.0)).alias("sd"),
    )
    days = days.where((F.col("rows") >= least) & (F.col("sd") > 0)).select("r", "c")

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            gram = np.tile(np.eye(k), (len(b), 1, 1))
            if pairs:
                rows, columns = map(list, zip(*pairs, strict=True))
                gram[:, rows, columns] = gram[:, columns, rows] = np.stack(b["r"].to_list())
            c = np.nan_to_num(np.stack(b["c"].to_list()).astype(float))  # a target that does not vary
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(gram, hermitian=True), c)
            yield pd.DataFrame({"factor": np.tile(np.array(factors, dtype=object), len(b)), "beta": beta.ravel()})

    betas = days.mapInPandas(solved, "factor string, beta double")
    out = betas.groupBy("factor").agg(F.count("*").alias("days"), F.avg("beta").alias("mean_beta"), F.stddev_samp("beta").alias("sd"))
    return out.select("factor", "days", "mean_beta", ratio(F.col("mean_beta") * F.sqrt(F.col("days").cast("double")), "sd").alias("t"))


def pooled_rank(df: DataFrame, c: str, slices: int = 200) -> DataFrame:
    """By distinct value of ``c`` in all rows: its average rank over their number, 0 < p <= 1.

    Counts by value first; running counts in two levels, by slice of the value range and within it, so no task sees all values.
    """
    values = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_k")).withColumn("_s", F.floor(F.col(c) * slices))
    whole = values.groupBy("_s").agg(F.sum("_k").alias("_m"))  # a row a slice
    whole = whole.withColumns({"_before": F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), "_all": F.sum("_m").over(Window.partitionBy())})
    below = F.coalesce("_before", F.lit(0)) + F.coalesce(F.sum("_k").over(Window.partitionBy("_s").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return values.join(whole.select("_s", "_before", "_all"), "_s").select(c, ((below + 1 + (F.col("_k") - 1) / 2) / F.col("_all")).alias("p"))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], slices: int = 1000) -> DataFrame:
    """``by`` and the exact interpolated percentiles of ``value``, as ``percentile`` gives them; a row for each group with a value.

    Counts by value first; running counts by slice of the value range tell which slices hold the ranks asked for, and only
    their values are ordered. So no task gathers the values of a group.
    """
    values = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0), *by).alias("_g"), F.col(value).cast("double").alias("_v")).groupBy("_g", "_v").agg(F.count("*").alias("_k")).withColumn("_s", F.floor(F.col("_v") * slices))
    w = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = values.groupBy("_g", "_s").agg(F.sum("_k").alias("_m"))  # a row a slice
    whole = whole.withColumns({"_before": F.coalesce(F.sum("_m").over(w), F.lit(0)), "_n": F.sum("_m").over(Window.partitionBy("_g"))})
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), ((F.col("_n") - 1) * F.lit(p)).alias("pos")) for k, p in at.items()))).alias("_p")
    wanted = whole.select("*", asked).where((F.floor("_p.pos") < F.col("_before") + F.col("_m")) & (F.ceil("_p.pos") >= F.col("_before")))
    wanted = wanted.groupBy("_g", "_s", "_before").agg(F.collect_list("_p").alias("_ps"))  # two slices a percentile at most
    inside = values.join(F.broadcast(wanted), ["_g", "_s"])
    start = F.col("_before") + F.coalesce(F.sum("_k").over(Window.partitionBy("_g", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = inside.withColumn("_from", start).select("_g", "_v", "_k", "_from", F.explode("_ps").alias("_p")).where((F.col("_from") <= F.ceil("_p.pos")) & (F.col("_from") + F.col("_k") > F.floor("_p.pos")))
    ends = picked.groupBy("_g", "_p").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    pos = F.col("_p.pos")
    ends = ends.withColumn("_x", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil(pos) - pos) * F.col("_a") + (pos - F.floor(pos)) * F.col("_b")))
    out = ends.groupBy("_g").agg(*(F.max(F.when(F.col("_p.name") == k, F.col("_x"))).alias(k) for k in at))
    return out.select(*(F.col("_g").getField(c).alias(c) for c in by), *at)


def with_quantiles(stats: DataFrame, df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``stats``, a row for each group of ``df``, with percentiles of its values; null where a group has none."""
    found = quantiles(df, by, value, at).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return stats.join(found, same, "left").drop(*(f"_by_{c}" for c in by))
