"""Indicators along an entity's time axis: averages, MACD, crosses, streaks, locations, divergence, limits.

Each function adds columns. All windows of one call share partitioning and order, so they cost one shuffle and one sort
by entity; a frame wider than its data gives null as long as too few values are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import entity, ewm, frame, lag, lead, median, ratio, rint2, rolling, streak

MA = (5, 10, 20, 30, 60, 120)
VOLUME_MA = (5, 10, 20, 60)
LIMITS = (0.05, 0.10, 0.20, 0.30)


def moving_averages(df: DataFrame) -> DataFrame:
    """ma*, vol*: means that need half a window at least; ratios of the latest values to their means."""
    out = df.withColumns({f"ma{n}": rolling(F.avg, "close", n, max(2, n // 2)) for n in MA} | {f"vol{n}": rolling(F.avg, "volume", n, max(2, n // 2)) for n in VOLUME_MA})
    return out.withColumns({f"vol_ratio{n}": ratio("volume", f"vol{n}") for n in VOLUME_MA})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """dif, dea and hist = 2 (dif - dea)."""
    out = df.withColumn("dif", ewm("close", fast) - ewm("close", slow))
    out = out.withColumn("dea", ewm("dif", signal))
    return out.withColumn("hist", 2 * (F.col("dif") - F.col("dea")))


def macd_events(df: DataFrame) -> DataFrame:
    """Crosses (strict now, not strict before), slopes, distance, and the run of rising histograms."""
    up = lambda a, b: F.coalesce((F.col(a) > F.col(b)) & (lag(a) <= lag(b)), F.lit(False))
    out = df.withColumns({"hist_prev": lag("hist"), "golden_cross": up("dif", "dea"), "death_cross": up("dea", "dif")})
    out = out.withColumns({
        "hist_slope": F.col("hist") - F.col("hist_prev"),
        "hist_cross_up": F.coalesce((F.col("hist") > 0) & (F.col("hist_prev") <= 0), F.lit(False)),
        "hist_cross_dn": F.coalesce((F.col("hist") < 0) & (F.col("hist_prev") >= 0), F.lit(False)),
        "dif_dea_dist_pct": ratio(F.col("dif") - F.col("dea"), F.nullif(F.col("close"), F.lit(0.0))),
        "gc_above": F.col("golden_cross") & (F.col("dif") > 0),
        "gc_below": F.col("golden_cross") & (F.col("dif") <= 0),
    })
    return out.withColumns({"hist_slope_prev": lag("hist_slope"), "hist_up_streak": streak(F.col("hist_slope") > 0)})


def price_location(df: DataFrame) -> DataFrame:
    """Where the price stands against its averages, its range and its earlier highs (these leave today out)."""
    out = df.withColumns({f"high{n}": rolling(F.max, "high", n, max(2, n // 2)) for n in (20, 60)} | {f"low{n}": rolling(F.min, "low", n, max(2, n // 2)) for n in (20, 60)} | {f"high{n}_prev": rolling(F.max, "high", n, past=True) for n in (20, 60, 120)} | {f"m{n}": rolling(F.avg, "close", n) for n in (20, 60, 120)})
    return out.withColumns({f"px_ma{n}_pct": ratio("close", f"m{n}") - 1 for n in (20, 60, 120)} | {"ma20_ma60": ratio("m20", "m60") - 1, "ma60_ma120": ratio("m60", "m120") - 1} | {f"dist_high{n}": ratio("close", f"high{n}") - 1 for n in (20, 60)} | {f"dist_low{n}": ratio("close", f"low{n}") - 1 for n in (20, 60)} | {f"px_h{n}": ratio("close", f"high{n}_prev") - 1 for n in (20, 60, 120)})


def returns(df: DataFrame, back: tuple[int, ...] = (3, 5, 10, 20, 40, 60), ahead: tuple[int, ...] = (1, 5, 10, 20, 40, 60)) -> DataFrame:
    """Past returns, forward close returns, tradable forward returns (open after the signal to open H later), and the daily ones."""
    return df.withColumns(
        {f"ret{k}": ratio("close", lag("close", k)) - 1 for k in back}
        | {f"fwd_ret{h}": ratio(lead("close", h), "close") - 1 for h in ahead if h != 40}
        | {f"fwd{h}": ratio(lead("open", h + 1), lead("open", 1)) - 1 for h in ahead}
        | {"oret": ratio(lead("open"), "open") - 1, "oret_sig": ratio(lead("open", 2), lead("open")) - 1, "cret": ratio("close", lag("close")) - 1, "next_ret_oc": ratio(lead("close"), lead("open")) - 1}
    )


def divergence(df: DataFrame, window: int = 60, reach: int = 90) -> DataFrame:
    """Bullish: a new low below the one before, on a higher dif; bearish: a new high above, on a lower dif.

    Only rows at a new extreme take part in the second window, and their flags come back by a join on the key.
    """
    at = F.row_number().over(entity())
    out = df.withColumns({"_at": at, "_low": rolling(F.min, "low", window), "_high": rolling(F.max, "high", window)})

    def flagged(extreme: Column, price: str, hit, name: str) -> DataFrame:  # noqa: ANN001
        some = out.where(extreme).select("code", "date", "_at", price, "dif")
        near = F.col("_at") - lag("_at") <= reach
        return some.withColumn(name, F.coalesce(near & hit(F.col(price), lag(price)) & ((F.col("dif") > lag("dif")) if name == "dv_bull" else (F.col("dif") < lag("dif"))), F.lit(False))).where(name).select("code", "date", name)

    bull = flagged(F.col("low") <= F.col("_low") * 1.0001, "low", lambda p, q: p < q * 0.999, "dv_bull")
    bear = flagged(F.col("high") >= F.col("_high") * 0.9999, "high", lambda p, q: p > q * 1.001, "dv_bear")
    out = out.join(bull, ["code", "date"], "left").join(bear, ["code", "date"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("dv_bull", "dv_bear")}).drop("_at", "_low", "_high")


def recent(flag: str, n: int = 10) -> Column:
    """Was it so in any of the last ``n`` rows?"""
    return F.coalesce(F.max(F.col(flag)).over(frame(n)), F.lit(False))


def relative_volume(df: DataFrame) -> DataFrame:
    """Volume against the median and the mean of the rows before."""
    return df.withColumns({f"rvol{n}": ratio("volume", rolling(median, "volume", n, past=True)) for n in (10, 20, 60)} | {f"vr{n}": ratio("volume", rolling(F.avg, "volume", n, past=True)) for n in (10, 20, 60)})


def volume_trend(df: DataFrame) -> DataFrame:
    """Ratios of volume averages and their changes; changes of volume; its z-score against the rows before, in five bins."""
    out = df.withColumns({f"v{n}": rolling(F.avg, "volume", n) for n in (5, 10, 20, 60)} | {f"vchg{k}": ratio("volume", lag("volume", k)) - 1 for k in (1, 3, 5)})
    out = out.withColumns({"vt_5_20": ratio("v5", "v20"), "vt_10_20": ratio("v10", "v20"), "vt_20_60": ratio("v20", "v60"), "dvt5": ratio("v5", lag("v5", 5)) - 1, "dvt10": ratio("v10", lag("v10", 10)) - 1})
    out = out.withColumns({"vt_up1": F.col("vt_5_20") > lag("vt_5_20"), "volz20": ratio(F.col("volume") - rolling(F.avg, "volume", 20, past=True), F.nullif(rolling(F.stddev_samp, "volume", 20, past=True), F.lit(0.0)))})
    z = F.round("volz20", 12)  # a score that is exactly an edge is not put below or above it by its last bit
    return out.withColumns({"vt_up3": F.col("vt_up1") & lag("vt_up1"), "volz_bin": F.when(z < -1, 0).when(z < 0, 1).when(z < 1, 2).when(z < 2, 3).when(z.isNotNull(), 4)})


def up_down_volume(df: DataFrame) -> DataFrame:
    """Shares of volume on rising and falling days, and the ratio of their means."""
    out = df
    for n in (5, 10, 20):
        full = F.count("ret").over(frame(n)) == n
        up, down = (F.sum(F.when(c, F.col("volume")).otherwise(0.0)).over(frame(n)) for c in (F.col("ret") > 0, F.col("ret") < 0))
        n_up, n_down = (F.sum(F.when(c, 1).otherwise(0)).over(frame(n)) for c in (F.col("ret") > 0, F.col("ret") < 0))
        total = F.sum("volume").over(frame(n))
        out = out.withColumns({f"upvol_r{n}": F.when(full, ratio(up, total)), f"dnvol_r{n}": F.when(full, ratio(down, total)), f"ud_vol{n}": F.when(full, ratio(ratio(up, n_up), F.nullif(ratio(down, n_down), F.lit(0.0))))})
    return out


def volume_structure(df: DataFrame) -> DataFrame:
    """Four states of price and volume (A up on less, B up on more, C down on less, D down on more) and their counts."""
    more = F.col("volume") > rolling(F.avg, "volume", 20, past=True)
    state = F.when((F.col("ret") == 0) | F.col("ret").isNull() | more.isNull(), None).when((F.col("ret") > 0) & ~more, "A").when(F.col("ret") > 0, "B").when(~more, "C").otherwise("D")
    out = df.withColumn("vol_state", state)
    return out.withColumns({f"st{s}{n}": F.when(F.count("vol_state").over(frame(n)) == n, F.count(F.when(F.col("vol_state") == s, 1)).over(frame(n))) for s in "ABCD" for n in (1, 5, 10, 20)})


def macd_scores(df: DataFrame) -> DataFrame:
    """Changes of the histogram, their z-scores, three states, and counts of rising days (no run: holes are allowed)."""
    out = df.withColumns({f"dhist{k}": F.col("hist") - lag("hist", k) for k in (1, 3, 5)})
    out = out.withColumns({"hist_acc": F.col("dhist1") - lag("dhist1"), **{f"{c}_z": ratio(c, F.nullif(rolling(F.stddev_samp, c, 60), F.lit(0.0))) for c in ("hist", "dhist1", "dhist3")}, "hist_upstreak": rolling(F.sum, (F.col("dhist1") > 0).cast("int"), 5)})
    return out.withColumns({
        "st_slowimp": F.coalesce((F.col("hist") < 0) & (F.col("dhist1") > 0) & (F.col("dhist3") > 0) & (F.col("dhist1_z") < 1), F.lit(False)),
        "st_fastflip": F.coalesce((F.col("hist") > 0) & (lag("hist") <= 0) & (F.col("dhist1_z") > 1), F.lit(False)),
        "st_decay": F.coalesce((F.col("hist") > 0) & (F.col("dhist1") < 0) & (F.col("hist") > 0.5 * rolling(F.max, "hist", 20)), F.lit(False)),
        "hist_up3": F.col("hist_upstreak") >= 3, "hist_up5": F.col("hist_upstreak") >= 5,
    })


def ranges(df: DataFrame) -> DataFrame:
    """True range (none on the first row), its averages, and historical volatility."""
    before = lag("close")
    true = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    out = df.withColumn("tr", true)
    return out.withColumns({"atr14": rolling(F.avg, "tr", 14), "atr20": rolling(F.avg, "tr", 20), "atr_pct": ratio(rolling(F.avg, "tr", 14), "close"), **{f"hv{n}": rolling(F.stddev_samp, "ret", n) * 252**0.5 for n in (20, 60)}})


def limit_regime(df: DataFrame, default: Column, window: int = 120, at_least: int = 60) -> DataFrame:
    """The daily price limit in force: the one that prices touched most often of late; ties and no touch at all give the first.

    Adds limit_pct, limit_up_px, limit_dn_px, can_buy_open, can_sell_open, has_next_bar.
    """
    before = lag("close")
    out = df.withColumn("_before", before)
    for i, x in enumerate(LIMITS):
        up, down = rint2(F.col("_before") * (1 + x)), rint2(F.col("_before") * (1 - x))
        near = lambda a, b: F.abs(a - b) <= 0.005 + 1e-5 * F.abs(b)
        out = out.withColumn(f"_hit{i}", F.when(F.col("_before").isNotNull(), (near(F.col("high"), up) | near(F.col("low"), down)).cast("int")))
    out = out.withColumns({f"_sum{i}": rolling(F.sum, f"_hit{i}", window, at_least) for i in range(len(LIMITS))})
    best = F.greatest(*(F.coalesce(f"_sum{i}", F.lit(-1)) for i in range(len(LIMITS))))
    chosen = F.lit(None).cast("double")
    for i in reversed(range(len(LIMITS))):  # the first of equal ones is asked last
        chosen = F.when(F.col(f"_sum{i}") == best, LIMITS[i]).otherwise(chosen)
    out = out.withColumn("limit_pct", F.coalesce(chosen, default)).withColumns({"limit_up_px": rint2(F.col("_before") * (1 + F.col("limit_pct"))), "limit_dn_px": rint2(F.col("_before") * (1 - F.col("limit_pct")))})
    return out.withColumns({"can_buy_open": F.coalesce(F.col("open") < F.col("limit_up_px") - 1e-6, F.lit(False)), "can_sell_open": F.coalesce(F.col("open") > F.col("limit_dn_px") + 1e-6, F.lit(False)), "has_next_bar": lead("close").isNotNull()}).drop("_before", *(f"_{k}{i}" for k in ("hit", "sum") for i in range(len(LIMITS))))


def first_sellable_open(df: DataFrame) -> Column:
    """The first open at or after a row at which the holder may sell."""
    return F.first(F.when(F.col("can_sell"), F.col("open")), ignorenulls=True).over(entity().rowsBetween(0, Window.unboundedFollowing))


def last_two(df: DataFrame, price: str = "close") -> DataFrame:
    """The latest two valid prices of each entity, and the days between."""
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    some = df.where(F.col(price).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    out = some.groupBy("code").agg(F.max(F.when(F.col("_n") == 1, F.col("date"))).alias("date"), F.max(F.when(F.col("_n") == 1, F.col(price))).alias("price"), F.max(F.when(F.col("_n") == 2, F.col(price))).alias("prev_price"))
    return out.withColumn("change", ratio("price", "prev_price") - 1)
