"""Joins along time: as-of, corporate actions, disclosures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, right_on: str, strict: bool = False) -> DataFrame:
    """Each left row with the columns of the latest right row at or before it (before it, if ``strict``).

    Both sides meet in one shuffle by key and one sort by time; no pair is formed that is not the answer.
    """
    cols = [c for c in right.columns if c not in (by, right_on)]
    lefts = left.select(F.col(by).alias("_k"), F.col(on).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(right_on, *cols).alias("r")).schema["r"].dataType).alias("_r"))
    rights = right.select(F.col(by).alias("_k"), F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(lefts.schema["_l"].dataType).alias("_l"), F.struct(right_on, *cols).alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = lefts.unionByName(rights).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    return out.select("_l.*", F.col(f"_r.{right_on}").alias(right_on), *(F.col(f"_r.{c}").alias(c) for c in cols))


def action_ratios(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Price ratio of each corporate action against the last close before it; actions outside the bars, or with a ratio outside (0, 5), count for nothing."""
    out = asof_join(actions, bars.select("code", F.col("date").alias("bar_date"), "close"), "code", "ex_date", "bar_date", strict=True)
    end = bars.groupBy("code").agg(F.max("date").alias("end"))
    before = F.col("close")
    out = out.join(end, "code").withColumn("ratio", ratio(before - F.col("dividend") + F.col("allotment") * F.col("allotment_px"), before * (1 + F.col("bonus") + F.col("allotment"))))
    return out.where("close IS NOT NULL AND ex_date <= end AND ratio > 0 AND ratio < 5").select("code", "ex_date", "ratio")


def adjusted(bars: DataFrame, ratios: DataFrame) -> DataFrame:
    """Bars with prices times, and volume over, the product of the ratios of all later actions; turnover stays."""
    w = Window.partitionBy("code").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    b = bars.select("*", F.col("date").alias("_t"), F.lit(0).alias("_side"), F.lit(1.0).alias("ratio"))
    e = ratios.select("code", F.col("ex_date").alias("_t"), F.lit(1).alias("_side"), "ratio")
    out = b.unionByName(e, allowMissingColumns=True).withColumn("adj_factor", F.product("ratio").over(w)).where("date IS NOT NULL").drop("_t", "_side", "ratio")
    return out.withColumns({c: F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") / F.col("adj_factor")})


def with_publish(rows: DataFrame, announced: DataFrame) -> DataFrame:
    """Reports with their publication: as announced, or the legal deadline where nothing, or something before the report's end, was."""
    out = rows.join(announced.select("code", "report_end", F.col("publish_date").alias("_p")), ["code", "report_end"], "left")
    good = F.col("_p").isNotNull() & (F.col("_p") >= F.col("report_end"))
    year, month = F.year("report_end"), F.month("report_end")
    legal = F.when(month == 3, F.make_date(year, F.lit(4), F.lit(30))).when(month == 6, F.make_date(year, F.lit(8), F.lit(31))).when(month == 9, F.make_date(year, F.lit(10), F.lit(31))).otherwise(F.make_date(year + 1, F.lit(4), F.lit(30)))
    return out.withColumns({"publish_date": F.when(good, F.col("_p")).otherwise(legal), "src": F.when(good, "actual").otherwise("legal")}).drop("_p")


def with_growth(fin: DataFrame, columns: tuple[str, ...] = ("rev", "np")) -> DataFrame:
    """Growth over the same quarter a year before (if it is there and above 1 in size), and the year's rate of a year-to-date figure."""
    w = Window.partitionBy("code", "q").orderBy("report_end")
    year_before = F.year("report_end") - F.year(F.lag("report_end").over(w)) == 1
    out = fin
    for c in columns:
        before = F.lag(c).over(w)
        out = out.withColumn(f"{c}_yoy", F.when(year_before & (F.abs(before) > 1), (F.col(c) - before) / F.abs(before)))
    return out.withColumns({f"ann_{c}": F.col(c) * 4 / F.col("q") for c in columns})


def with_annual(fin: DataFrame, c: str = "np") -> DataFrame:
    """The last annual figure known with each report, and the one before; two losses in a row."""
    w = Window.partitionBy("code").orderBy("report_end").rowsBetween(Window.unboundedPreceding, 0)
    annual = F.when(F.col("q") == 4, F.col(c))
    prev = F.when(F.col("q") == 4, F.lag(c, 1).over(Window.partitionBy("code", "q").orderBy("report_end")))
    out = fin.withColumns({f"{c}_y1": F.last(annual, ignorenulls=True).over(w), f"{c}_y2": F.last(prev, ignorenulls=True).over(w)})
    return out.withColumn("two_losses", F.coalesce((F.col(f"{c}_y1") < 0) & (F.col(f"{c}_y2") < 0), F.lit(False)))
