"""Plans under a capacity: which signals get a place, day by day, and what an account with so many places earned."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .cross import COST


@dataclass(frozen=True)
class Rhythm:
    """How positions are opened: so many ``places`` at most, so many ``new`` ones a day (0: no bound), or the steps of a ladder."""

    places: int = 0
    new: int = 0
    ladder: tuple[int, ...] | None = None

    @property
    def steps(self) -> tuple[int, ...]:
        return tuple(accumulate(self.ladder or ()))

    @property
    def room(self) -> int:
        """Positions held at most; 0: no bound."""
        return self.steps[-1] if self.ladder else self.places

    @property
    def daily(self) -> int:
        """Positions opened a day at most; 0: no bound."""
        return max(self.ladder) if self.ladder else self.new or self.places

    @property
    def weight(self) -> float:
        """A position's share of the account, 1 where nothing bounds the places."""
        return 1.0 / self.room if self.room else 1.0

    def wanted(self, held: int) -> int | None:
        """Positions to open beside ``held`` ones; None: all."""
        if self.ladder:
            return next((s for s in self.steps if s > held), held) - held
        bounds = [max(self.places - held, 0)] if self.places else []
        bounds += [self.new] if self.new else []
        return min(bounds) if bounds else None

    def considered(self, hold: int) -> int:
        """So many first candidates of a day decide it: those that are opened, and held ones to pass over. 0: all."""
        if not self.daily:
            return 0
        held = self.daily * (hold + 1)
        return (min(held, self.room) if self.room else held) + self.daily


HOLDS = "scenario string, entry_day long, exit_day long, code long, day long, row long, weight double"
_HOLDS = pa.schema([("scenario", pa.string()), ("entry_day", pa.int64()), ("exit_day", pa.int64()), ("code", pa.int64()), ("day", pa.int64()), ("row", pa.int64()), ("weight", pa.float64())])


def _planned(hold: int, rhythms: list[Rhythm]):
    """Over candidates in order, the held set is all that is carried from row to row, and so from one batch of periods to the next."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = today = rhythm = want = None
        held: dict[int, int] = {}  # code: exit day; as many as there are places
        for b in batches:
            taken: list[tuple] = []
            for scenario, own, day, code, row, which in zip(*(b.column(c).to_pylist() for c in ("scenario", "lane", "day", "code", "row", "rhythm")), strict=True):
                if (scenario, own) != lane:
                    lane, today, rhythm, held = (scenario, own), None, rhythms[which], {}
                if day != today:
                    today, held = day, {c: x for c, x in held.items() if x > day}
                    want = rhythm.wanted(len(held))
                if want == 0 or code in held:
                    continue
                held[code] = day + 1 + hold
                want = None if want is None else want - 1
                taken.append((scenario, day + 1, day + 1 + hold, code, day, row, rhythm.weight))
            if taken:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*taken, strict=True), _HOLDS, strict=True)], schema=_HOLDS)

    return step


def plan(candidates: DataFrame, hold: int, rhythms: Rhythm | list[Rhythm]) -> DataFrame:
    """Which candidates get a place in each scenario.

    A day first frees the places that end by then, leaves out entities already held, and takes the rest in order of
    ``key`` (null last, then code) as far as the rhythm goes; what finds no place is not bought later. ``candidates``:
    scenario, code, day, row, key, and with several rhythms the ``rhythm`` (its number) of the scenario.

    The choice of a day depends on all days before, so a scenario is one ordered stream; of each day only the first
    candidates, as many as can matter, reach it, and it carries only what is held. Without any bound, entities do not
    depend on each other, and each is a stream of its own.
    """
    many = [rhythms] if isinstance(rhythms, Rhythm) else list(rhythms)
    key, own = F.col("key").cast("double"), F.col("rhythm") if "rhythm" in candidates.columns else F.lit(0)
    rows = candidates.select("scenario", F.col("code").cast("long").alias("code"), F.col("day").cast("long").alias("day"), F.col("row").cast("long").alias("row"), F.when(~F.isnan(key), key).alias("key"), own.cast("int").alias("rhythm"))
    first = F.get(F.array(*(F.lit(r.considered(hold)) for r in many)), F.col("rhythm"))
    by_key = [F.asc_nulls_last("key"), F.asc("code")]
    if any(r.daily for r in many):
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("scenario", "day").orderBy(*by_key))).where((first == 0) | (F.col("_k") <= first)).drop("_k")
    rows = rows.withColumn("lane", F.when(first == 0, F.col("code")))
    ordered = rows.repartition("scenario", "lane").sortWithinPartitions("scenario", "lane", "day", *by_key)
    return ordered.mapInArrow(_planned(hold, many), HOLDS)


def offered(candidates: DataFrame, holds: DataFrame) -> DataFrame:
    """By scenario: signals, positions, signals dropped, those of them dropped as their entity was held, and both as shares."""
    taken = holds.select("scenario", "code", "day", "exit_day")
    each = candidates.select("scenario", F.col("code").cast("long").alias("code"), F.col("day").cast("long").alias("day")).join(taken, ["scenario", "code", "day"], "left")
    before = Window.partitionBy("scenario", "code").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.max("exit_day").over(before) > F.col("day"), F.lit(False))
    out = each.withColumn("again", held).groupBy("scenario").agg(F.count("*").alias("n_signal"), F.count("exit_day").alias("n_hold"), F.count_if("again").alias("n_drop_dup"))
    out = out.withColumn("n_drop", F.col("n_signal") - F.col("n_hold"))
    return out.withColumns({"fill_pct": ratio("n_hold", "n_signal"), "drop_pct": ratio("n_drop", "n_signal")})


def _grid(holds: DataFrame, days: DataFrame) -> DataFrame:
    return holds.select("scenario").distinct().crossJoin(F.broadcast(days.select("day", "date")))  # a row per period


def daily_returns(holds: DataFrame, rows: DataFrame, days: DataFrame, hold: int, cost: float = COST) -> DataFrame:
    """By scenario and day: positions with a price, ``invested`` (the return of what is invested) and ``capital`` (that of the account, idle places earn nothing).

    The j-th row after the signal counts for the j-th day after it. ``rows``: code, row, oret_sig; only those in reach of a position are kept.
    """
    steps = holds.select("scenario", "code", "day", "row", "weight", F.explode(F.sequence(F.lit(0), F.lit(hold - 1))).alias("j"))
    steps = steps.select("scenario", "code", "weight", (F.col("day") + F.col("j")).alias("day"), (F.col("row") + F.col("j")).alias("row"))
    cells = steps.join(rows.where("oret_sig IS NOT NULL").select("code", "row", "oret_sig"), ["code", "row"])
    w = F.col("weight")
    daily = cells.groupBy("scenario", "day").agg(F.sum(w * (F.col("oret_sig") - cost / hold)).alias("earned"), F.sum(w).alias("share"), F.count("*").alias("n"))
    out = _grid(holds, days).join(daily, ["scenario", "day"], "left")
    return out.select("scenario", "day", "date", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("earned") / F.col("share"), F.lit(0.0)).alias("invested"), F.coalesce("earned", F.lit(0.0)).alias("capital"))


def with_value(daily: DataFrame, ret: str, by: list[str] | None = None) -> DataFrame:
    """``nav``: the running product of a return."""
    w = Window.partitionBy(*(by or ["scenario"])).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("nav", F.product(1 + F.col(ret)).over(w))


def by_basis(daily: DataFrame) -> DataFrame:
    """Returns and values on both bases, one under the other."""
    each = daily.select("scenario", "day", "date", "n", F.explode(F.array(*(F.struct(F.lit(b).alias("basis"), F.col(b).alias("ret")) for b in ("invested", "capital")))).alias("b")).select("scenario", "day", "date", "n", "b.basis", "b.ret")
    return with_value(each, "ret", ["scenario", "basis"])


def occupied(holds: DataFrame, days: DataFrame, hold: int) -> DataFrame:
    """By scenario and day: positions and the share of the account in them, as a running sum of what opens and what ends."""
    event = lambda at, sign: F.struct(at.alias("day"), F.lit(sign).alias("held"), (sign * F.col("weight")).alias("share"))
    moves = holds.select("scenario", F.explode(F.array(event(F.col("day"), 1), event(F.col("day") + hold, -1))).alias("e")).select("scenario", "e.*")
    net = moves.groupBy("scenario", "day").agg(F.sum("held").alias("held"), F.sum("share").alias("share"))
    so_far = Window.partitionBy("scenario").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    return _grid(holds, days).join(net, ["scenario", "day"], "left").select("scenario", "day", "date", running("held").cast("long").alias("held"), F.round(running("share"), 9).alias("share"))


def occupancy(days: DataFrame, count: str = "held", share: str = "share") -> DataFrame:
    """How full a portfolio was: means over the days with a position, peaks, and the shares of empty, active and full days."""
    n, s = F.col(count), F.col(share)
    part = lambda c: F.avg(c.cast("double"))
    return days.groupBy("scenario").agg(
        F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0)).alias("avg_pos"), F.max(n).alias("max_pos"), part(n == 0).alias("empty_pct"), part(n > 0).alias("active_pct"),
        F.coalesce(F.avg(F.when(s > 1e-9, s)), F.lit(0.0)).alias("avg_invested"), part(s >= 1 - 1e-9).alias("full_pct"), F.max(s).alias("max_invested"),
    )


def random_control(stats: DataFrame, name: str, value: str = "cagr") -> DataFrame:
    """Where one scenario stands among the others: their mean, spread, tails, and its percentile and z."""
    one = stats.where(F.col("scenario") == name).select(F.col(value).alias("own"))
    rest = stats.where(F.col("scenario") != name).crossJoin(F.broadcast(one))  # one row
    out = rest.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.percentile(value, 0.05).alias("p05"), F.percentile(value, 0.95).alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg((F.col(value) < F.col("own")).cast("double")).alias("beaten"), F.max("own").alias("own"))
    return out.withColumn("z", ratio(F.col("own") - F.col("mean"), "sd"))
