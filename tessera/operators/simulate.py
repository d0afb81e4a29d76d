"""From signals to trades, portfolios and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import entity, lead, ratio
from ..sources.files import staged
from .cross import COST, YEAR, with_quantiles
from .indicators import first_sellable_open

#: Edges of the histogram of net returns.
EDGES = (-1.0, -0.5, -0.3, -0.2, -0.1, -0.05, 0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)


def with_fills(df: DataFrame, hold: int) -> DataFrame:
    """For a signal on each row: the open to buy at, the first possible open to sell at after ``hold`` rows, and their days."""
    out = df.withColumn("_sell", first_sellable_open(df))
    out = out.withColumns({
        "buy_px": lead(F.when(F.col("can_buy"), F.col("open"))), "sell_px": lead("_sell", 1 + hold), "entry_day": lead("day"), "due_day": lead("day", 1 + hold),
        "has_entry": lead("open").isNotNull(), "has_exit": lead("open", 1 + hold).isNotNull(),
    })
    return out.withColumn("r", F.col("sell_px") / F.col("buy_px") - 1).drop("_sell")


def trades(signals: DataFrame, cost: float = COST) -> DataFrame:
    """Signals with both fills, and their net return."""
    return signals.where("r IS NOT NULL").withColumn("net", F.col("r") - cost)


def open_state() -> Column:
    """Why a signal has no trade: not bought, still held, or past its time and not sold."""
    return F.when(F.col("r").isNotNull(), "closed").when(F.col("has_entry") & F.col("buy_px").isNull(), "nobuy").when(~F.col("has_entry"), "pending").when(F.col("has_exit"), "stuck").otherwise("holding")


def trade_stats(df: DataFrame, by: list[str] | None = None, value: str = "net", least: int = 20) -> DataFrame:
    """Count, mean, median, win rate, payoff, profit factor and tails; losses are below 0."""
    v, by = F.col(value), by or []
    win, loss = F.when(v > 0, v), F.when(v < 0, v)
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.avg((v > 0).cast("double")).alias("win"), F.avg(win).alias("_w"), F.avg(loss).alias("_l"), F.sum(win).alias("_sw"), F.sum(loss).alias("_sl"))
    out = with_quantiles(out.where(F.col("n") >= least), df, by, value, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return out.withColumns({"payoff": ratio("_w", -F.col("_l")), "pf": ratio("_sw", -F.col("_sl"))}).drop("_w", "_l", "_sw", "_sl")


def trade_summary(df: DataFrame, value: str = "net", excess: str = "excess") -> DataFrame:
    """The longer summary; here what does not win has lost, zeros too."""
    v = F.col(value)
    out = df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("best"), F.min(v).alias("worst"),
        ratio(F.sum(F.when(v > 0, v)), -F.sum(F.when(v <= 0, v))).alias("pf"), F.avg(excess).alias("avg_excess"), F.avg((F.col(excess) > 0).cast("double")).alias("excess_win"), F.countDistinct("code").alias("n_stock"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
    return with_quantiles(out, df, [], value, {"p25": 0.25, "p75": 0.75})


def histogram(df: DataFrame, value: str = "net", edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Counts between fixed edges; values outside are dropped, the last bin holds its right edge."""
    v, bin_ = F.col(value), F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bin_ = F.when((v >= edges[i]) & ((v <= edges[i + 1]) if i == len(edges) - 2 else (v < edges[i + 1])), i).otherwise(bin_)
    return df.select(bin_.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


def filtered_trades(df: DataFrame, win: bool | None = None, year: int | None = None, code: int | str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Trades won or lost, entered in a year, of a code, with a net return from ``least`` to ``most``."""
    tests = [] if win is None else [(F.col("net") > 0) == win]
    tests += [F.year("entry_date") == year] if year else []
    tests += [F.col("code") == code] if code else []
    tests += [] if least is None else [F.col("net") >= least]
    tests += [] if most is None else [F.col("net") <= most]
    for test in tests:
        df = df.where(test)
    return df


def trade_page(df: DataFrame, sort: str = "exit_date", order: str = "desc", page: int = 1, size: int = 50) -> DataFrame:
    """A page of trades: 1 to 500 a page, the last page for numbers beyond, exit dates for keys that are no plain column of the listing.

    A missing key stands first when falling and last when rising; ties follow code and signal. The listing is written
    once, and both its size and the page are read from there.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    listing, size = staged(df, "trade-listing"), max(1, min(size, 500))
    last = max(1, -(-listing.count() // size))
    key = F.col(sort if sort in plain else "exit_date")
    ordered = listing.orderBy(key.asc_nulls_last() if order.lower() == "asc" else key.desc_nulls_first(), "code", "date")
    return ordered.offset((min(max(1, page), last) - 1) * size).limit(size)


def slots(signals: DataFrame, rows: DataFrame, hold: int, *more: str) -> DataFrame:
    """Days and returns of each position: the j-th row after the signal counts for the j-th day after it.

    Only rows in reach of a signal are kept: ``signals`` (code, row, day and ``more``) are joined to ``rows`` (code, row, oret_sig).
    """
    steps = signals.select("code", "row", "day", *more, F.explode(F.sequence(F.lit(0), F.lit(hold - 1))).alias("_j"))
    steps = steps.select("code", (F.col("row") + F.col("_j")).alias("row"), (F.col("day") + F.col("_j")).alias("day"), *more)
    return steps.join(rows.where("oret_sig IS NOT NULL").select("code", "row", F.col("oret_sig").alias("ret")), ["code", "row"]).select("day", "ret", *more)


def portfolio(rows: DataFrame, days: DataFrame, hold: int, cost: float = COST) -> DataFrame:
    """Net daily return and value of overlapping tranches of the rows with a signal, all positions of a day alike; idle days earn nothing."""
    daily = slots(rows.where("signal"), rows, hold).groupBy("day").agg(F.avg("ret").alias("gross"), F.count("*").alias("n"))
    return _value(days.select("day", "date").join(daily, "day", "left").withColumn("ret", F.coalesce(F.col("gross") - cost / hold, F.lit(0.0))))


def state_portfolio(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Gross value of holding, each day, all rows of that day."""
    daily = rows.groupBy("day").agg(F.avg("oret_sig").alias("gross"), F.count("oret_sig").alias("n"))
    return _value(days.select("day", "date").join(daily, "day", "left").withColumn("ret", F.coalesce("gross", F.lit(0.0))))


def _value(daily: DataFrame) -> DataFrame:
    """A row per period: the running product in one task."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).withColumn("nav", F.product(1 + F.col("ret")).over(w)).select("day", "date", "n", "ret", "nav")


def annual_stats(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """CAGR, deepest fall, Sharpe ratio, arithmetic return and volatility of a daily series."""
    by = by or []
    base = daily.withColumn("_k", F.lit(1))
    w = Window.partitionBy(*(by or ["_k"])).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    fall = F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1
    out = base.withColumn("_fall", fall).groupBy(*(by or ["_k"])).agg(F.count("*").alias("days"), F.max_by("nav", "day").alias("end"), F.min("_fall").alias("mdd"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    return out.select(*by, "days", F.when(F.col("end") > 0, F.pow("end", YEAR / F.col("days")) - 1).otherwise(-1.0).alias("cagr"), "mdd", ratio(F.col("_m") * YEAR**0.5, "_s").alias("sharpe"), (F.col("_m") * YEAR).alias("ann_arith"), (F.col("_s") * YEAR**0.5).alias("vol"))


def yearly(daily: DataFrame, least: int = 20) -> DataFrame:
    """Return and deepest fall by year, each year from 1."""
    w = Window.partitionBy("year").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("year", F.year("date")).withColumn("_v", F.product(1 + F.col("ret")).over(w))
    out = out.withColumn("_f", F.col("_v") / F.greatest(F.max("_v").over(w), F.lit(1.0)) - 1)
    return out.groupBy("year").agg(F.count("*").alias("days"), (F.max_by("_v", "day") - 1).alias("ret"), F.min("_f").alias("mdd")).where(F.col("days") >= least)


def segments(daily: DataFrame, cuts: dict[str, tuple[int, int]]) -> DataFrame:
    """Compound return of spans of years."""
    y = F.year("date")
    return daily.agg(*(F.product(F.when(y.between(a, b), 1 + F.col("ret"))).alias(k) for k, (a, b) in cuts.items())).select(*((F.coalesce(k, F.lit(1.0)) - 1).alias(k) for k in cuts))


# ---- stops ------------------------------------------------------------------------------------------------------------


def with_bars(df: DataFrame, hold: int, columns: tuple[str, ...] = ("open", "high", "low", "close"), which: str = "true") -> DataFrame:
    """Of the rows ``which``, with ``bars``: prices (or other columns) of the rows after each, as far as a position of ``hold`` rows needs them; null without any.

    Only those rows are joined to the ones that follow them, by code and row.
    """
    own = df.where(which)
    steps = own.select("code", "row", F.explode(F.sequence(F.lit(1), F.lit(hold + 2))).alias("_j")).withColumn("_at", F.col("row") + F.col("_j"))
    cells = steps.join(df.select("code", F.col("row").alias("_at"), *columns), ["code", "_at"])
    bars = cells.groupBy("code", "row").agg(F.array_sort(F.collect_list(F.struct("_j", F.struct(*columns).alias("bar")))).alias("_b"))
    return own.join(bars, ["code", "row"], "left").withColumn("bars", F.transform("_b", lambda x: x["bar"])).drop("_b")


def stop_return(hold: int, stop: float, trigger: str = "close") -> Column:
    """Return of a position opened at the next open that ends when it has lost ``stop``, or after ``hold`` rows.

    ``close``: a close below the line sells at the next open. ``intraday``: an open below the line sells there, a low below
    it sells at the line. Null without the bars for it.
    """
    entry = F.col("bars")[0]["open"]
    line = entry * (1 - stop)
    reached = line * (1 + 1e-9)  # a touch counts, whatever the last bit
    path = F.slice("bars", 1, hold)
    below = "close" if trigger == "close" else "low"
    hit = F.array_position(F.transform(path, lambda b: b[below] <= reached), True)
    at = F.when(hit > 0, hit).otherwise(hold + (0 if trigger == "close" else 1))
    if trigger == "close":
        out = F.get("bars", at.cast("int"))["open"]
    else:
        bar = F.get("bars", (at - 1).cast("int"))
        out = F.when(hit > 0, F.when(bar["open"] <= reached, bar["open"]).otherwise(line)).otherwise(bar["open"])
    return F.when(F.size("bars") > hold, out / entry - 1)


def _leaving(hold: int, leaves: Callable[[Column, Column], Column]) -> Column:
    """The first bar that ``leaves`` (bar, best close so far) holds for, from 1; 0 if there is none. One pass carries the best close."""
    first = F.struct(F.col("bars")[0]["open"].alias("top"), F.lit(0).alias("hit"), F.lit(1).alias("k"))

    def step(seen: Column, bar: Column) -> Column:
        top = F.greatest(seen["top"], bar["close"])
        out = (seen["hit"] == 0) & F.coalesce(leaves(bar, top), F.lit(False))
        return F.struct(top.alias("top"), F.when(out, seen["k"]).otherwise(seen["hit"]).alias("hit"), (seen["k"] + 1).alias("k"))

    return F.aggregate(F.slice("bars", 1, hold), first, step, lambda seen: seen["hit"])


def exit_return(hold: int, leaves: Callable[[Column, Column], Column]) -> Column:
    """Return of a position opened at the next open and sold at the open after the bar that it leaves at, or after ``hold`` rows."""
    hit = _leaving(hold, leaves)
    return F.get("bars", F.when(hit > 0, hit).otherwise(hold).cast("int"))["open"] / F.col("bars")[0]["open"] - 1


def left_early(hold: int, leaves: Callable[[Column, Column], Column]) -> Column:
    return _leaving(hold, leaves) > 0
