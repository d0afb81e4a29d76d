"""SQL texts that the oracle queries build on."""

PANEL = """
cells AS (
    SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS turnover,
        sum(round(l_discount * 100)) AS d, sum(round(l_tax * 100)) AS t, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned
    FROM lineitem GROUP BY 1, 2
), priced AS (
    SELECT *, 100 * product(1 + (d / n - 5) / 100) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS close, (t / n - 4) / 400 AS g FROM cells
), opened AS (
    SELECT *, coalesce(lag(close) OVER (PARTITION BY code ORDER BY date), 100) * (1 + g) AS open FROM priced
), panel AS MATERIALIZED (
    SELECT code, date, open, greatest(open, close) * (1 + abs(g)) AS high, least(open, close) * (1 - abs(g)) AS low, close, volume, turnover,
        s_nationkey AS ind_code, n_name AS ind_name, r_name AS board, code % 37 = 0 AS is_st, returned * 4 <= n * 3 AS can_buy, t * 2 <= n * 13 AS can_sell
    FROM opened JOIN supplier ON s_suppkey = code JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
)"""
CLEAN = (
    PANEL
    + """, listed AS (
    SELECT *, min(date) OVER (PARTITION BY code) AS list_date, round(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 10) AS ret FROM panel
), aged AS (
    SELECT *, CASE WHEN list_date = (SELECT min(date) FROM panel) THEN 1000000 ELSE date - list_date END AS days_since_list FROM listed
), clean AS (
    SELECT * FROM aged WHERE NOT is_st AND days_since_list >= 120 AND ret IS NOT NULL
), cal AS (
    SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM clean)
), base AS MATERIALIZED (
    SELECT clean.*, day, row_number() OVER (PARTITION BY code ORDER BY date) AS row FROM clean JOIN cal USING (date)
)"""
)
E_ = "PARTITION BY code ORDER BY date"


def frame(n: int, past: bool = False) -> str:
    return f"({E_} ROWS BETWEEN {n if past else n - 1} PRECEDING AND {'1 PRECEDING' if past else 'CURRENT ROW'})"


def rolling(agg: str, c: str, n: int, at_least: int | None = None, past: bool = False) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n, past)} >= {n if at_least is None else at_least} THEN {agg} OVER {frame(n, past)} END"


def mean(c: str, n: int, at_least: int | None = None, past: bool = False) -> str:
    return rolling(f"avg({c})", c, n, at_least, past)


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({E_})"


def lead(c: str, k: int = 1) -> str:
    return f"lead({c}, {k}) OVER ({E_})"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif({b}, 0))"


def rank_pct(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


def decile(p: str, n: int = 10) -> str:
    return f"(least(floor(({p}) * {n}), {n - 1}) + 1)::INTEGER"


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


def with_(base: str, select: str) -> str:
    return f"WITH RECURSIVE {base} {select}"


def ewm(source: str, c: str, span: int, name: str) -> str:
    """A table of code, row, value: the exponential mean as a fold over each entity's ordered values."""
    a = 2.0 / (span + 1)
    return f"SELECT code, date, list_reduce(list({c}) OVER ({E_} ROWS UNBOUNDED PRECEDING), lambda s, x: s * {1 - a!r} + x * {a!r}) AS {name} FROM {source}"


#: Added before a value is rounded to six places, here and in Spark: values that lie exactly between two decimals, as
#: many here do, then fall on the same side whatever the last bit of a sum is.
NUDGE = 3.14159265e-8


def nudged(sql: str) -> str:
    """All ``round(x, 6)`` of a query with the nudge."""
    out, at = "", 0
    while (begin := sql.find("round(", at)) >= 0:
        depth, end = 1, begin + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = nudged(sql[begin + 6 : end - 1])
        if inner.endswith(", 6"):
            inner = f"{inner[:-3]} + {NUDGE}, 6"
        out += sql[at:begin] + "round(" + inner + ")"
        at = end
    return out + sql[at:]
