"""Declarative selections: parameters and pools, compiled to predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors that take a decile range, by parameter name.
RANGED = ("ret5", "ret10", "ret20", "ret40", "ret60", "px_ma20_pct", "px_ma60_pct", "px_ma120_pct", "hv20", "rvol20")
CONFIRM = {
    "ma5": lambda: F.col("close") > F.col("ma5"), "ma10": lambda: F.col("close") > F.col("ma10"), "ma20": lambda: F.col("close") > F.col("ma20"),
    # looks one bar ahead, as the rule it stands for does
    "up2": lambda: F.col("oret") > 0, "volup": lambda: F.col("rvol20") > 1.2,
    "ma5up": lambda: F.col("ma5") > F.col("ma5_prev"), "histpos": lambda: F.col("hist") > 0, "difdea": lambda: F.col("dif") > F.col("dea"), "histup3": lambda: F.col("hist_upstreak") >= 3,
}
#: Figures of the latest published report that take a range.
FIGURES = ("rev", "np", "rev_yoy", "np_yoy")
BOARDS = {"BJ": "BJ", "STAR": "STAR", "CHINEXT": "CHINEXT", "MAIN": "MAIN", "北交所": "BJ", "科创板": "STAR", "创业板": "CHINEXT", "主板": "MAIN"}


@dataclass(frozen=True)
class Params:
    """What a signal is. Ranges are (low, high) deciles, None for no condition."""

    ranges: dict[str, tuple[int | None, int | None]] = field(default_factory=lambda: {"px_ma60_pct": (1, 1)})
    size: tuple[float, float] = (0, 2)
    market: str = "bear"  # bear, bull or any
    volatility: str = "any"  # high, low or any
    index: str = "all"
    ma: int = 60
    breadth: tuple[float | None, float | None] = (None, None)
    deep: bool = False
    confirm: tuple[str, ...] = ()
    #: ranges of FIGURES, both ends included, None for no bound; and the quarter that the latest report must be of
    finance: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    quarter: int | None = None
    #: what is left out: "financial" (a yearly loss with revenue below the floor), "loss2y" (two yearly losses), "penny" (closes below par)
    delist: tuple[str, ...] = ()
    rev_floor: float = 1e8
    board_floors: dict[str, float] = field(default_factory=dict)  # floors of single boards
    penny_days: int = 20
    hold: int = 20
    max_pos: int = 0
    max_new: int = 3
    pick: str = "deep"
    ladder: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Pool:
    codes: str = ""
    industries: tuple[int, ...] = ()
    boards: tuple[str, ...] = ()
    exchanges: tuple[str, ...] = ()


def size_band(low: float | None, high: float | None) -> tuple[int, int] | None:
    """Whole bounds within 0..9, swapped if reversed; None where they exclude nothing."""
    a, b = (d if x is None else max(0, min(9, int(round(x)))) for x, d in ((low, 0), (high, 9)))
    a, b = min(a, b), max(a, b)
    return None if (a, b) == (0, 9) else (a, b)


def ladder_steps(text: str | list | tuple | None, most: int = 50) -> tuple[int, ...] | None:
    """Positions to open at each step; None if any is below 1 or nothing is there."""
    if text is None:
        return None
    parts = re.split(r"[\s,;/|、，；-]+", text.strip()) if isinstance(text, str) else text
    try:
        steps = tuple(int(round(float(p))) for p in parts if str(p) != "")[:most]
    except ValueError:
        return None
    return steps if steps and all(s >= 1 for s in steps) else None


def even_stride(combinations: list, most: int) -> list:
    """At most so many, spread evenly over the whole list."""
    n = len(combinations)
    return combinations if n <= most else [combinations[i * n // most] for i in range(most)]


def code_list(text: str) -> list[str]:
    """Codes of a free text; six bare digits stand for either main exchange."""
    out: list[str] = []
    for part in re.split(r"[\s,，;；]+", text.upper().strip()):
        if re.fullmatch(r"\d{6}", part):
            out += [f"{part}.SH", f"{part}.SZ"]
        elif part:
            out.append(part)
    if not out:
        raise ValueError("no code given")
    return list(dict.fromkeys(out))


#: Codes of a pool up to which they are handed to every executor.
BROADCAST_CODES = 100_000


def text_codes(texts: DataFrame, text: str = "text") -> DataFrame:
    """The codes of free texts, a row each: upper-case words; six bare digits stand for themselves and for either main exchange."""
    words = texts.select(F.explode(F.split(F.upper(F.col(text)), r"[\s,，;；]+")).alias("w")).where("w <> ''")
    both = F.when(F.col("w").rlike(r"^\d{6}$"), F.array(F.col("w"), F.concat("w", F.lit(".SH")), F.concat("w", F.lit(".SZ")))).otherwise(F.array("w"))
    return words.select(F.explode(both).alias("code")).distinct()


def in_text_pool(df: DataFrame, texts: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code the texts name. An error if they name none, or none that is there; broadcast only below a checked size."""
    codes = text_codes(texts).withColumnRenamed("code", code)
    n = codes.count()
    if not n:
        raise ValueError("no code given")
    out = df.join(F.broadcast(codes) if n <= BROADCAST_CODES else codes, code, "left_semi")
    if out.isEmpty():
        raise ValueError(f"none of {n} codes is there")
    return out


def six_digits(c: Column) -> Column:
    return F.regexp_extract(F.upper(F.trim(c)), r"\d{6}", 0)


def board_of(code: Column) -> Column:
    """Board by suffix and prefix."""
    head = F.substring(code, 1, 3)
    return F.when(code.endswith(".BJ"), "BJ").when(head.isin("688", "689"), "STAR").when(head.isin("300", "301"), "CHINEXT").otherwise("MAIN")


def board_or_default(board: Column, code: Column) -> Column:
    """A board by any of its names, else by the code."""
    named = F.lit(None).cast("string")
    for k, v in BOARDS.items():
        named = F.when(F.upper(board) == k, v).otherwise(named)
    return F.coalesce(named, board_of(code))


def exchange_of(exchange: Column, code: Column) -> Column:
    suffix = F.when(code.endswith(".SH"), "SH").when(code.endswith(".BJ"), "BJ").otherwise("SZ")
    return F.coalesce(F.nullif(exchange, F.lit("")), suffix)


def default_limit(board: Column) -> Column:
    return F.when(board == "BJ", 0.3).when(board.isin("STAR", "CHINEXT"), 0.2).otherwise(0.1)


def digitise(c: Column, edges: tuple[float, ...] = (-1.0, 0.0, 1.0, 2.0)) -> Column:
    """Bin 0..len(edges), edges to the right; null stays null."""
    out = F.when(c.isNotNull(), len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(c < e, i).otherwise(out)
    return out


def _at_risk(p: Params, name: str) -> Column:
    """What speaks for a delisting by what is known on the row's day; unknown figures do not."""
    if name == "financial":
        floor = F.lit(p.rev_floor)
        for board, other in p.board_floors.items():
            floor = F.when(F.col("board") == board, other).otherwise(floor)
        return (F.col("ann_np") < 0) & (F.col("ann_rev") < floor)
    if name == "loss2y":
        return (F.col("np_y1") < 0) & (F.col("np_y2") < 0)
    if name == "penny":
        return F.col("below_par") >= min(p.penny_days, 20)
    raise ValueError(f"unknown risk {name}")


def predicate(p: Params) -> tuple[Column, list[str]]:
    """The conjunction of all active conditions over decile columns and the market's state, and their labels."""
    parts: list[tuple[str, Column]] = []
    for name, (lo, hi) in p.ranges.items():
        if name not in RANGED:
            raise ValueError(f"unknown factor {name}")
        if lo or hi:
            parts.append((f"{name} {lo or 1}..{hi or 10}", F.col(f"d_{name}").between(lo or 1, hi or 10)))
    if p.deep:
        known = F.col("d_ret40").isNotNull() & F.col("d_ret60").isNotNull() & F.col("d_px_ma60_pct").isNotNull()
        parts.append(("deep", known & ((F.col("d_ret40") == 1) | (F.col("d_ret60") == 1) | (F.col("d_px_ma60_pct") == 1))))
    if band := size_band(*p.size):
        parts.append((f"size {band[0]}..{band[1]}", F.col("size_grp").between(*band)))
    if p.market in ("bear", "bull"):
        parts.append((p.market, F.col("bull") if p.market == "bull" else ~F.col("bull")))
    if p.volatility in ("high", "low"):
        parts.append((f"volatility {p.volatility}", (F.col("mkt_hv20") > F.col("hv_med")) if p.volatility == "high" else (F.col("mkt_hv20") <= F.col("hv_med"))))
    for bound, name, test in ((p.breadth[0], "breadth from", lambda c, b: c >= b), (p.breadth[1], "breadth to", lambda c, b: c <= b)):
        if bound is not None:
            parts.append((f"{name} {bound}", test(F.col("breadth"), bound)))
    parts += [(f"confirm {c}", CONFIRM[c]()) for c in p.confirm]
    if p.quarter:
        parts.append((f"report of quarter {p.quarter}", F.col("q") == p.quarter))
    for name, (low, high) in p.finance.items():
        if name not in FIGURES:
            raise ValueError(f"unknown figure {name}")
        for bound, word, test in ((low, "from", lambda c, b: c >= b), (high, "to", lambda c, b: c <= b)):
            if bound is not None:
                parts.append((f"{name} {word} {bound:g}", test(F.col(name), F.lit(bound))))
    parts += [(f"without {name}", ~F.coalesce(_at_risk(p, name), F.lit(False))) for name in p.delist]
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for _, c in parts], F.lit(True)), [n for n, _ in parts]


def in_pool(pool: Pool, code: Column, industry: Column, board: Column, exchange: Column | None = None) -> Column:
    """Membership in a pool; an empty list does not limit."""
    out = F.lit(True)
    if pool.codes:
        out = out & code.isin(*code_list(pool.codes))
    if pool.industries:
        out = out & industry.isin(*pool.industries)
    if pool.boards:
        out = out & board.isin(*pool.boards)
    if pool.exchanges and exchange is not None:
        out = out & exchange.isin(*pool.exchanges)
    return F.coalesce(out, F.lit(False))


def score() -> Column:
    """Order of candidates: deep, small and fallen ones first; an unknown term counts 0."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))
    return z((11 - F.col("d_ret60")) * 6.0) + z((11 - F.col("d_ret40")) * 3.0) + z((10 - F.col("size_grp")) * 4.0) - z(clip("px_ma60_pct") * 10) - z(clip("ret40") * 5)


#: Keys of the daily choice, smallest first.
PICKS = {"deep": lambda: F.col("px_ma60_pct"), "amount": lambda: -F.col("turnover"), "small": lambda: F.col("size_grp").cast("double"), "big": lambda: -F.col("size_grp").cast("double"), "drop60": lambda: F.col("ret60"), "none": lambda: F.col("code").cast("double"),
         "rand": lambda: F.conv(F.substring(F.md5(F.concat_ws("|", "code", "day", F.lit("7"))), 1, 12), 16, 10).cast("double")}
