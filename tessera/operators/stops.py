"""Positions that end when they have lost enough: when each of them ends, what it earned, and what a portfolio of them earned by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import entity, ratio
from .cross import COST
from .indicators import first_sellable_open

#: A touch counts, whatever the last bit.
TOUCH = 1 + 1e-9


def stop_cells(rows: DataFrame, hold: int, stops: list[tuple[str, float]]) -> DataFrame:
    """A row per settled position and held bar: code, row, day, j, ret, ends (bars held in full, by stop), gross (by stop), part (the ended bar's return, by stop).

    A position is bought at the open after its signal. ``close``: the first close at or below the line ends it at the
    next open that can be sold at. ``intraday``: the first bar that opens at or below the line ends it there, one that
    only touches it ends it at the line. ``rows``: code, row, date, day, open, low, close, can_sell, oret_sig, signal, r;
    positions are joined to the bars that they hold, so no row outside their reach is gathered.
    """
    bars = rows.withColumns({"so": first_sellable_open(rows), "ret": F.lag("oret_sig").over(entity())})
    bars = bars.select("code", F.col("row").alias("bar"), "open", "low", "close", "so", "ret")
    held = rows.where("signal AND r IS NOT NULL").select("code", "row", "day", "r", F.explode(F.sequence(F.lit(0), F.lit(hold - 1))).alias("j")).withColumn("bar", F.col("row") + 1 + F.col("j"))
    own = Window.partitionBy("code", "row")
    cells = held.join(bars, ["code", "bar"]).withColumn("entry", F.max(F.when(F.col("j") == 0, F.col("open"))).over(own))

    def line(level: float) -> Column:
        return F.col("entry") * (1 - level)

    def hit(kind: str, level: float) -> Column:
        reached = line(level) * TOUCH
        return F.col("close") <= reached if kind == "close" else (F.col("open") <= reached) | (F.col("low") <= reached)

    cells = cells.withColumn("hits", F.array(*(F.min(F.when(hit(*s), F.col("j"))).over(own) for s in stops)))
    fill = lambda level: F.when(F.col("open") <= line(level) * TOUCH, F.col("open")).otherwise(line(level))
    ends, sold, part = [], [], []
    for i, (kind, level) in enumerate(stops):
        at = F.get("hits", F.lit(i))
        end = F.coalesce(at + 1 if kind == "close" else at, F.lit(hold))
        ends.append(end)
        out = F.when(F.col("j") == end, F.col("so") if kind == "close" else fill(level))
        sold.append(F.coalesce(F.max(out).over(own) / F.col("entry") - 1, F.when(end == hold, F.col("r"))))
        part.append(F.when((F.col("j") == at) & F.lit(kind == "intraday"), fill(level) / F.col("open") - 1))
    return cells.select("code", "row", "day", "j", "ret", F.array(*ends).alias("ends"), F.array(*sold).alias("gross"), F.array(*part).alias("part"), "hits")


def stop_trades(cells: DataFrame, stops: list[tuple[str, float]], cost: float = COST) -> DataFrame:
    """By stop: positions, the share of them that it ended, and their net results."""
    one = cells.where("j = 0").select(F.posexplode(F.arrays_zip("gross", "hits")).alias("i", "x"))
    net = F.col("x.gross") - cost
    out = one.groupBy("i").agg(F.count("*").alias("n_trade"), F.avg(F.col("x.hits").isNotNull().cast("double")).alias("stopped"), F.avg(net).alias("mean"), F.avg((net > 0).cast("double")).alias("win"), ratio(F.sum(F.when(net > 0, net)), -F.sum(F.when(net < 0, net))).alias("pf"))
    return _named(out, stops)


def _named(df: DataFrame, stops: list[tuple[str, float]]) -> DataFrame:
    pick = F.get(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(float(v)).alias("level")) for k, v in stops)), F.col("i"))
    return df.withColumn("s", pick).select("s.*", *(c for c in df.columns if c != "i"))


def stop_daily(cells: DataFrame, days: DataFrame, hold: int, stops: list[tuple[str, float]], cost: float = COST) -> DataFrame:
    """By stop and day: positions still open, ``ret`` (their mean) and ``fixed`` (over the positions that would be open without a stop: ended ones lie idle).

    One aggregation by day for all stops; each held bar carries its share of the costs.
    """
    each = [(F.when(F.col("j") < F.get("ends", F.lit(i)), F.col("ret")).otherwise(F.get("part", F.lit(i)))) for i in range(len(stops))]
    sums = [F.struct(F.sum(x).alias("s"), F.count(x).alias("n")).alias(f"x{i}") for i, x in enumerate(each)]
    daily = cells.withColumn("at", F.col("day") + F.col("j")).groupBy("at").agg(F.count("ret").alias("all"), *sums)
    daily = daily.select("at", "all", F.posexplode(F.array(*(f"x{i}" for i in range(len(stops))))).alias("i", "x"))
    grid = days.select("day", "date", F.explode(F.sequence(F.lit(0), F.lit(len(stops) - 1))).alias("i"))
    earned = F.col("x.s") - F.col("x.n") * (cost / hold)
    out = grid.join(daily.withColumnRenamed("at", "day"), ["day", "i"], "left").select("i", "day", "date", F.coalesce("x.n", F.lit(0)).alias("n"), F.coalesce(ratio(earned, "x.n"), F.lit(0.0)).alias("ret"), F.coalesce(ratio(earned, "all"), F.lit(0.0)).alias("fixed"))
    return _named(out, stops)
