"""DuckDB twins of the named queries: windows where the query has windows, recursive common
table expressions where it scans. Bars and market are exact in both engines, later steps
are rounded as the queries round them."""

from __future__ import annotations

from ..schema import FAMILIES, RISK
from ..sources.genomes import FIXED
from ..sources.synthetic import INSTRUMENTS

_X = """
x AS MATERIALIZED (SELECT {symbol} AS symbol, {date} AS date, CAST(sum(CAST({price} AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS x, count(*) AS volume
  FROM {table} GROUP BY 1, 2),
cal AS (SELECT date FROM x GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM x)),
walk AS (SELECT *, avg(x) OVER (PARTITION BY symbol) AS m, max(x) OVER (PARTITION BY symbol) AS top, min(x) OVER (PARTITION BY symbol) AS bottom,
  CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS t FROM x WHERE date IN (SELECT date FROM cal)),
closed AS (SELECT *, round(100 * product(1 + round(greatest(-0.05, least(0.05, 0.02 * (x / m - 1))), 10)) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 4) AS close FROM walk),
opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY t), 100.0) AS open FROM closed),
bars AS MATERIALIZED (SELECT symbol, t, date, open, round(greatest(open, close) * (1 + 0.01 * (top - x) / top), 4) AS high,
  round(least(open, close) * (1 - 0.01 * (x - bottom) / x), 4) AS low, close, CAST(volume AS DOUBLE) AS volume FROM opened)"""
_DAILY = _X.format(symbol="l_returnflag", date="CAST(l_shipdate AS DATE)", price="l_extendedprice", table="lineitem")
_WEEKLY = _X.format(symbol="o_orderpriority", date="CAST(date_trunc('week', o_orderdate) AS DATE)", price="o_totalprice", table="orders")
_RET = """,
rets AS MATERIALIZED (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1, 0.0) AS ret FROM bars)"""
_MARKET = """,
day AS (SELECT t, date, round(avg(ret), 12) AS ret, avg(ret) AS raw FROM rets GROUP BY t, date),
market AS MATERIALIZED (SELECT t, date, 100 * product(1 + raw) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS level, ret FROM day)"""
_BASE = "WITH RECURSIVE " + _DAILY + _RET + _MARKET


def _r(x: str, digits: int = 8) -> str:
    return f"round({x}, {digits}) + 0.0"


def _over(w: int, part: str = "PARTITION BY symbol ") -> str:
    return f"({part}ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, w: int, part: str = "PARTITION BY symbol ") -> str:
    return f"CASE WHEN row_number() OVER ({part}ORDER BY t) >= {w} THEN {x} END"


def _kernel(x: str, digits: int = 8, source: str = "rets") -> str:
    return f"{_BASE} SELECT symbol, t, {_r(x, digits)} AS value FROM {source}"


_SD = lambda x, w, p="PARTITION BY symbol ": _full(f"stddev_samp({x}) OVER {_over(w, p)}", w, p)
_MA = lambda x, w, p="PARTITION BY symbol ": _full(f"avg({x}) OVER {_over(w, p)}", w, p)
_TR = "CASE WHEN t = 0 THEN high - low ELSE greatest(high - low, abs(high - before), abs(low - before)) END"
_RANKED = """(SELECT *, list({x}) OVER {o} AS held, count({x}) OVER {o} AS n, row_number() OVER ({p}ORDER BY t) AS k FROM {source})"""


def _rank(x: str, w: int, source: str, p: str = "PARTITION BY symbol ") -> tuple[str, str]:
    """(value, from) of the rolling percentile of x."""
    value = f"CASE WHEN k >= {w} AND {x} IS NOT NULL AND n > 1 THEN (len(list_filter(held, lambda y: y <= {x})) - 1)::DOUBLE / (n - 1) END"
    return value, _RANKED.format(x=x, o=_over(w, p), p=p, source=source)


# --- recursive kernels for all symbols -----------------------------------------------


def _wilder(name: str, source: str, w: int, first: int, cols: dict[str, str]) -> str:
    """CTE of (symbol, t, cols): mean of w values from row `first`, then Wilder's average. source has n<col> inputs."""
    seed = ", ".join(f"sum({x}) / {w} AS {c}" for c, x in cols.items())
    step = ", ".join(f"({name}.{c} * {w - 1} + s.{x}) / {w} AS {c}" for c, x in cols.items())
    return f""",
{name} AS (SELECT symbol, {first + w - 1} AS t, {seed} FROM {source} WHERE t BETWEEN {first} AND {first + w - 1} GROUP BY symbol HAVING count(*) = {w}
  UNION ALL SELECT {name}.symbol, s.t, {step} FROM {name} JOIN {source} s ON s.symbol = {name}.symbol AND s.t = {name}.t + 1)"""


_DIFF = """,
diffs AS MATERIALIZED (SELECT symbol, t, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM (SELECT symbol, t, close - lag(close) OVER (PARTITION BY symbol ORDER BY t) AS d FROM bars) WHERE d IS NOT NULL)"""
_RANGES = f""",
ranges AS MATERIALIZED (SELECT symbol, t, {_TR} AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS before FROM bars))"""
_RSI = "CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END"


def _rsi_cte(w: int) -> str:
    return _wilder(f"rsi{w}", "diffs", w, 1, {"up": "up", "down": "down"})


_ATR14 = _wilder("atr14", "ranges", 14, 0, {"atr": "tr"})
_EMA = """,
ema AS (SELECT symbol, 19 AS t, sum(close) / 20 AS v FROM bars WHERE t < 20 GROUP BY symbol HAVING count(*) = 20
  UNION ALL SELECT ema.symbol, b.t, b.close * (2.0 / 21) + ema.v * (1 - 2.0 / 21) FROM ema JOIN bars b ON b.symbol = ema.symbol AND b.t = ema.t + 1)"""


def _left(cte: str, value: str, name: str) -> str:
    return f"{_BASE}{cte} SELECT symbol, t, {_r(value)} AS value FROM bars LEFT JOIN {name} USING (symbol, t)"


# --- signals of the fixed genomes ----------------------------------------------------------


def _latch(g: str, symbol: str, source: str, up: str, down: str, leave_up: str, leave_down: str, off: str, scale: str = "1.0") -> str:
    ok = lambda c: f"coalesce({c}, false)"
    return f"""SELECT '{g}' AS g, t, {ok(up)} AS up, {ok(down)} AS down, {ok(leave_up)} AS lu, {ok(leave_down)} AS ld, {off} AS off, {scale} AS scale
  FROM ({source}) WHERE symbol = '{symbol}'"""


def _signal_ctes() -> str:
    latches, plain, rsis = [], [], set()
    p_ = "PARTITION BY symbol "
    for g, family, symbol, _, p, _ in FIXED:
        if family == "trend":
            spread = f"{_MA('close', p['fast'])} AS f, {_MA('close', p['slow'])} AS s, close / lag(close, {p['confirm']}) OVER ({p_}ORDER BY t) - 1 AS way"
            plain.append(f"""SELECT '{g}' AS g, t, CASE WHEN f / s - 1 > {p['band']} AND way > 0 THEN 1.0 WHEN f / s - 1 < -{p['band']} AND way < 0 THEN -1.0 ELSE 0.0 END AS v
  FROM (SELECT symbol, t, {spread} FROM bars) WHERE symbol = '{symbol}'""")
        elif family == "volatility":
            lo, hi, flip = p["lowPct"], p["highPct"], -1.0 if p["mode"] == 1 else 1.0
            rv = f"(SELECT *, {_SD('ret', p['volWindow'])} * sqrt(252.0) AS rv FROM rets)"
            value, source = _rank("rv", p["pctWindow"], rv)
            plain.append(f"""SELECT '{g}' AS g, t, CASE WHEN p <= {lo} THEN {flip} * least(1, ({lo} - p) / greatest(0.05, {lo}) + 0.4)
  WHEN p >= {hi} THEN -({flip}) * least(1, (p - {hi}) / greatest(0.05, 1 - {hi}) + 0.4) ELSE 0.0 END AS v FROM (SELECT symbol, t, {value} AS p FROM {source}) WHERE symbol = '{symbol}'""")
        elif family == "breakout":
            a, b, w = p["entry"], p["exit"], p["volWindow"]
            rv = f"(SELECT *, {_SD('ret', w)} * sqrt(252.0) AS rv FROM rets)"
            value, source = _rank("rv", max(60, 4 * w), rv)
            level = {n: _full(f"{f} OVER {_over(k)}", k) for n, f, k in (("ha", "max(high)", a), ("la", "min(low)", a), ("hb", "max(high)", b), ("lb", "min(low)", b))}
            inner = f"SELECT symbol, t, close, {value} AS p, " + ", ".join(f"{x} AS {n}" for n, x in level.items()) + f" FROM {source}"
            lagged = "SELECT symbol, t, close, p, " + ", ".join(f"lag({n}) OVER ({p_}ORDER BY t) AS {n}" for n in level) + f" FROM ({inner})"
            calm = f"(p IS NULL OR p <= {p['volCeil']})"
            latches.append(_latch(g, symbol, lagged, f"{calm} AND close > ha", f"{calm} AND close < la", "close < lb", "close > hb", "t = 0"))
        elif family == "meanReversion":
            w, k = p["zWindow"], p["rsiWindow"]
            rsis.add(k)
            z = f"CASE WHEN {_SD('close', w)} > 0 THEN (close - {_MA('close', w)}) / {_SD('close', w)} END"
            source = f"SELECT b.symbol, b.t, z, r FROM (SELECT symbol, t, {z} AS z FROM bars) b LEFT JOIN (SELECT symbol, t, {_RSI} AS r FROM rsi{k}) USING (symbol, t)"
            near = f"abs(z) <= {p['exitZ']}"
            latches.append(_latch(g, symbol, source, f"z <= -{p['entryZ']} AND r <= {p['rsiBand']}", f"z >= {p['entryZ']} AND r >= {100 - p['rsiBand']}", near, near, "z IS NULL OR r IS NULL"))
        else:
            w, k, limit = p["lookback"], p["smooth"], p["threshold"]
            spread = "(SELECT r.symbol, r.t, r.ret - m.ret AS s FROM rets r JOIN market m USING (t))"
            ir = f"(SELECT symbol, t, CASE WHEN {_SD('s', w)} > 0 THEN {_MA('s', w)} / {_SD('s', w)} * sqrt(252.0) END AS i FROM {spread})"
            v = f"SELECT symbol, t, CASE WHEN count(i) OVER {_over(k)} >= {max(1, -(-k // 2))} THEN avg(i) OVER {_over(k)} END AS v FROM {ir}"
            scale = f"least(1, coalesce(abs(v), 0) / {max(0.1, 2 * limit)})"
            latches.append(_latch(g, symbol, v, f"v > {limit}", f"v < -{limit}", f"v < {limit * p['decay']}", f"v > -{limit * p['decay']}", "v IS NULL", scale))
    sides = ", ".join(f"('{g}', '{f}', '{s}', '{side}')" for g, f, s, side, _, _ in FIXED)
    ctes = _DIFF + "".join(_rsi_cte(k) for k in sorted(rsis))
    return f"""{ctes},
sides AS (SELECT * FROM (VALUES {sides}) AS v(g, family, symbol, side)),
latches AS MATERIALIZED ({' UNION ALL '.join(latches)}),
state AS (SELECT g, t, CASE WHEN off THEN 0 WHEN up THEN 1 WHEN down THEN -1 ELSE 0 END AS s FROM latches WHERE t = 0
  UNION ALL SELECT n.g, n.t, CASE WHEN n.off THEN 0
    WHEN state.s = 1 AND NOT n.lu THEN 1 WHEN state.s = -1 AND NOT n.ld THEN -1
    WHEN n.up THEN 1 WHEN n.down THEN -1 ELSE 0 END
  FROM state JOIN latches n ON n.g = state.g AND n.t = state.t + 1),
raw AS (SELECT g, t, s * scale AS v FROM state JOIN latches USING (g, t) UNION ALL {' UNION ALL '.join(plain)}),
signals AS MATERIALIZED (SELECT g, t, CASE WHEN (side = 'long' AND v < 0) OR (side = 'short' AND v > 0) THEN 0.0 ELSE v END AS v, family FROM raw JOIN sides USING (g))"""


_SIGNALS = _BASE + _signal_ctes()

# --- the backtest -----------------------------------------------------------------------------


def _bt_ctes() -> str:
    risk = ", ".join(f"('{g}', '{s}', {', '.join(str(float(v)) for v in r)})" for g, _, s, _, _, r in FIXED)
    return f"""{_RANGES}{_ATR14},
risk AS (SELECT g, symbol, vt::DOUBLE AS vt, lev::DOUBLE AS lev, sa::DOUBLE AS sa, ta::DOUBLE AS ta, mh::DOUBLE AS mh, cd::DOUBLE AS cd FROM (VALUES {risk}) AS v(g, symbol, vt, lev, sa, ta, mh, cd)),
vols AS (SELECT symbol, t, round({_SD('ret', 20)} * sqrt(252.0), 10) AS vol FROM rets),
inp AS MATERIALIZED (SELECT s.g, s.t, round(s.v, 10) AS aim, b.high, b.low, b.close, lag(b.close) OVER (PARTITION BY s.g ORDER BY s.t) AS before,
    CASE WHEN vol IS NULL OR vol <= 1e-6 THEN 0.0 ELSE greatest(0.0, least(lev, vt / vol)) END AS size, round(atr, 10) AS atr, sa, ta, mh, cd
  FROM signals s JOIN risk USING (g) JOIN bars b ON b.symbol = risk.symbol AND b.t = s.t JOIN vols v ON v.symbol = risk.symbol AND v.t = s.t
  LEFT JOIN atr14 a ON a.symbol = risk.symbol AND a.t = s.t),
bt AS (
  SELECT g, 0::BIGINT AS t, 0::DOUBLE AS ret, 0::DOUBLE AS carried, 0::DOUBLE AS pos, 1::DOUBLE AS equity, 1 AS dir, 0::DOUBLE AS stop, 0::DOUBLE AS target, 0 AS held, 0::DOUBLE AS cool, -1::BIGINT AS entry,
    1::DOUBLE AS growth, 0::DOUBLE AS moved, -1::BIGINT AS x1_entry, 0::DOUBLE AS x1_growth, '' AS x1_reason, -1::BIGINT AS x2_entry, 0::DOUBLE AS x2_growth, 1 AS x_dir FROM inp WHERE t = 0
  UNION ALL
  SELECT g, t, ret, pos AS carried, nxt AS pos, equity * (1 + ret) AS equity, ndir AS dir,
    CASE WHEN opens THEN CASE WHEN sa > 0 AND atr IS NOT NULL THEN greatest(0.0, close - ndir * sa * atr) ELSE 0.0 END WHEN nxt = 0 THEN 0.0 ELSE stop END,
    CASE WHEN opens THEN CASE WHEN ta > 0 AND atr IS NOT NULL THEN greatest(0.0, close + ndir * ta * atr) ELSE 0.0 END WHEN nxt = 0 THEN 0.0 ELSE target END,
    CASE WHEN opens OR nxt = 0 THEN 0 ELSE nheld END,
    CASE WHEN ncool > 0 THEN ncool - 1 ELSE ncool END,
    CASE WHEN opens THEN t WHEN nxt = 0 THEN -1 ELSE entry END,
    CASE WHEN opens THEN CASE WHEN ended = '' THEN 1 + ret ELSE 1.0 END WHEN nxt = 0 THEN 1.0 ELSE growth * (1 + ret) END,
    moved + CASE WHEN ended <> '' THEN abs(pos) ELSE 0 END + CASE WHEN delta > 1e-9 THEN delta ELSE 0 END,
    CASE WHEN ended <> '' THEN entry ELSE -1 END, growth * (1 + bar1), ended,
    CASE WHEN ended = '' AND start <> 0 AND nxt = 0 THEN entry ELSE -1 END, growth * (1 + ret), dir
  FROM (SELECT *, bar1 - CASE WHEN delta > 1e-9 THEN delta * 0.0005 ELSE 0 END AS ret, (start = 0 AND nxt <> 0) AS opens FROM (
    SELECT *, abs(nxt - start) AS delta FROM (
      SELECT *, CASE
          WHEN start <> 0 THEN CASE WHEN aim = 0 OR sign(aim) <> dir THEN 0.0 WHEN abs(size * dir * abs(aim) - start) > 0.2 * abs(start) THEN size * dir * abs(aim) ELSE start END
          WHEN aim <> 0 AND ncool <= 0 THEN CASE WHEN abs(size * abs(aim)) < 1e-4 THEN 0.0 ELSE size * ndir * abs(aim) END ELSE 0.0 END AS nxt
      FROM (SELECT *, CASE WHEN start = 0 AND aim <> 0 AND ncool <= 0 THEN CAST(sign(aim) AS INTEGER) ELSE dir END AS ndir FROM (
        SELECT *, CASE WHEN ended <> '' THEN 0.0 ELSE pos END AS start, CASE WHEN ended <> '' THEN cd ELSE cool END AS ncool,
          raw1 - CASE WHEN ended <> '' THEN abs(pos) * 0.0005 ELSE 0 END AS bar1
        FROM (SELECT *, CASE WHEN pos = 0 THEN '' WHEN hit_s THEN 'stop' WHEN hit_t THEN 'target' WHEN mh > 0 AND nheld >= mh THEN 'timeout' ELSE '' END AS ended,
            CASE WHEN pos = 0 THEN 0.0 ELSE pos * (CASE WHEN hit_s THEN stop WHEN hit_t THEN target ELSE close END / before - 1) END AS raw1
          FROM (SELECT i.g, i.t, i.aim, i.high, i.low, i.close, i.before, i.size, i.atr, i.sa, i.ta, i.mh, i.cd, bt.pos, bt.equity, bt.dir, bt.stop, bt.target, bt.cool, bt.entry, bt.growth, bt.moved,
              bt.pos <> 0 AND bt.stop > 0 AND CASE WHEN bt.dir = 1 THEN i.low <= bt.stop ELSE i.high >= bt.stop END AS hit_s,
              bt.pos <> 0 AND bt.target > 0 AND CASE WHEN bt.dir = 1 THEN i.high >= bt.target ELSE i.low <= bt.target END AS hit_t,
              CASE WHEN bt.pos = 0 THEN bt.held ELSE bt.held + 1 END AS nheld
            FROM bt JOIN inp i ON i.g = bt.g AND i.t = bt.t + 1)))))))
),
final AS MATERIALIZED (SELECT * FROM bt),
trades AS MATERIALIZED (
  SELECT g, x1_entry AS entry_t, t AS exit_t, x_dir AS direction, x1_growth - 1 AS return_pct, greatest(1, t - x1_entry) AS bars, x1_reason AS exit_reason FROM final WHERE x1_entry >= 0
  UNION ALL SELECT g, x2_entry, t, x_dir, x2_growth - 1, greatest(1, t - x2_entry), 'signal' FROM final WHERE x2_entry >= 0
  UNION ALL SELECT g, entry, t, dir, growth - 1, greatest(1, t - entry), 'end' FROM final WHERE pos <> 0 AND entry >= 0 AND t = (SELECT max(t) FROM final))"""


_BT = _SIGNALS + _bt_ctes()
_N, _END = "(SELECT count(*) FROM market)", "(SELECT greatest(460, CAST(floor(count(*) * 0.62) AS BIGINT)) FROM market)"


def _metric_ctes(slices: str) -> str:
    """slices: SELECT slice, a, b."""
    years = "greatest(n / 252.0, 1e-6)"
    return f""",
slices AS MATERIALIZED ({slices}),
srows AS MATERIALIZED (SELECT f.g, slice, f.t, f.ret, f.carried AS position, m.ret AS bench, m.date,
    product(1 + f.ret) OVER w AS eq, abs(f.carried - lag(f.carried) OVER w) AS move FROM final f JOIN market m USING (t) JOIN slices ON f.t >= a AND f.t < b WINDOW w AS (PARTITION BY f.g, slice ORDER BY f.t ROWS UNBOUNDED PRECEDING)),
drows AS MATERIALIZED (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY g, slice ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM srows),
base AS (SELECT g, slice, count(*) AS n, avg(ret) AS mu, coalesce(stddev_samp(ret), 0) AS sd, sum(ret * ret) FILTER (ret < 0) AS loss2, count(*) FILTER (ret < 0) AS losses,
    min(dd) AS mdd, avg(dd * dd) AS dd2, arg_max(eq, t) AS final, avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0.0 END) AS exposure, coalesce(sum(move), 0) AS moved,
    CASE WHEN count(*) >= 3 AND stddev_samp(ret) > 0 THEN skewness(ret) ELSE 0 END AS skew,
    CASE WHEN count(*) >= 4 AND stddev_samp(ret) > 0 THEN (kurtosis_pop(ret) + 3) * pow((count(*) - 1.0) / count(*), 2) - 3 ELSE 0 END AS kurt,
    quantile_cont(ret, 0.95) AS p95, quantile_cont(ret, 0.05) AS p05,
    CASE WHEN stddev_samp(ret) > 0 AND stddev_samp(bench) > 0 THEN covar_samp(ret, bench) / (stddev_samp(ret) * stddev_samp(bench)) ELSE 0 END AS corr FROM drows GROUP BY g, slice),
months AS (SELECT g, slice, max(r) AS best, min(r) AS worst FROM (SELECT g, slice, strftime(date, '%Y-%m') AS m, product(1 + ret) - 1 AS r FROM srows GROUP BY 1, 2, 3) GROUP BY 1, 2),
ledger AS (SELECT g, slice, count(*) AS k, count(*) FILTER (return_pct > 0) AS wins, coalesce(sum(return_pct) FILTER (return_pct > 0), 0) AS won,
    coalesce(sum(-return_pct) FILTER (return_pct <= 0), 0) AS lost, avg(bars) AS held FROM trades JOIN slices ON exit_t >= a AND exit_t < b GROUP BY 1, 2),
wide AS (SELECT *, CASE WHEN final > 0 THEN pow(final, 1 / {years}) - 1 ELSE -1.0 END AS growth, CASE WHEN losses > 1 THEN sqrt(loss2 / losses) END AS down
  FROM base LEFT JOIN months USING (g, slice) LEFT JOIN ledger USING (g, slice)),
metrics AS MATERIALIZED (SELECT g AS genome_id, slice, {', '.join(f'CASE WHEN n >= 20 THEN {x} ELSE 0 END AS {k}' for k, x in _METRICS.items())} FROM wide)"""


_METRICS = {
    "sharpe": "(CASE WHEN sd > 0 THEN mu / sd * sqrt(252.0) ELSE 0 END)",
    "sortino": "(CASE WHEN down > 0 THEN mu / down * sqrt(252.0) ELSE 0 END)",
    "calmar": "(CASE WHEN mdd <> 0 THEN growth / abs(mdd) ELSE 0 END)",
    "cagr": "growth",
    "vol": "(sd * sqrt(252.0))",
    "max_drawdown": "mdd",
    "ulcer": "sqrt(dd2)",
    "win_rate": "(CASE WHEN k > 0 THEN wins::DOUBLE / k ELSE 0 END)",
    "profit_factor": "(CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 4.0 ELSE 0 END)",
    "trades": "coalesce(k, 0)",
    "avg_hold": "coalesce(held, 0)",
    "exposure": "exposure",
    "turnover": "(moved / greatest(n / 252.0, 1e-6))",
    "skew": "skew",
    "kurtosis": "kurt",
    "tail_ratio": "(CASE WHEN p05 <> 0 THEN abs(p95 / p05) ELSE 0 END)",
    "bench_corr": "corr",
    "best_month": "greatest(0, coalesce(best, 0))",
    "worst_month": "least(0, coalesce(worst, 0))",
}
_SHOWN = ", ".join(f"CAST({k} AS BIGINT) AS trades" if k == "trades" else f"{_r(k, 6)} AS {k}" for k in _METRICS)
_IS_OOS = f"SELECT 'is' AS slice, 260 AS a, {_END} AS b UNION ALL SELECT 'oos', {_END}, {_N}"
_THIRD = f"(({_END} - 260) // 3)"
_FIT_SLICES = f"""SELECT 'is' AS slice, 260 AS a, {_END} AS b UNION ALL SELECT 'third1', 260, 260 + {_THIRD} UNION ALL SELECT 'third2', 260 + {_THIRD}, 260 + 2 * {_THIRD}
  UNION ALL SELECT 'third3', 260 + 2 * {_THIRD}, {_END}"""
_BLOCK = f"(({_N} - 260) // 6)"
_FOLD_SLICES = " UNION ALL ".join(
    f"SELECT '{k}' AS slice, 260 + {_BLOCK} * {k} AS a, {_N if k == 5 else f'260 + {_BLOCK} * {k + 1}'} AS b" for k in range(1, 6)
)
_FIT = f"{_BT}{_metric_ctes(_FIT_SLICES)}"
_FOLDS = f"{_BT}{_metric_ctes(_FOLD_SLICES)}"
_ALL_SLICES = " UNION ALL ".join([_IS_OOS, _FOLD_SLICES])
_ROBUST = "CASE WHEN count(*) >= 2 THEN greatest(-1, least(1, (avg(sharpe) - 0.5 * coalesce(stddev_samp(sharpe), 0)) / greatest(0.35, abs(avg(sharpe)) + 0.35))) ELSE 0 END"
_RANKED_CTE = f"""{_BT}{_metric_ctes(_ALL_SLICES)},
robust AS (SELECT genome_id, {_ROBUST} AS robustness FROM metrics WHERE slice NOT IN ('is', 'oos') GROUP BY genome_id),
ranked AS MATERIALIZED (SELECT o.genome_id, s.family, s.symbol, o.sharpe, o.cagr, o.max_drawdown, o.vol, o.avg_hold, o.bench_corr, i.sharpe AS is_sharpe, coalesce(robustness, 0) AS robustness,
    CAST(row_number() OVER (ORDER BY o.sharpe + 0.25 * coalesce(robustness, 0) DESC, o.genome_id) AS INTEGER) AS rank
  FROM metrics o JOIN metrics i ON o.genome_id = i.genome_id AND o.slice = 'oos' AND i.slice = 'is' JOIN sides s ON s.g = o.genome_id LEFT JOIN robust r ON r.genome_id = o.genome_id)"""

_OBS = """,
obs AS MATERIALIZED (SELECT t, date, ret, avg(ret) OVER a * 100 AS drift, avg(abs(ret)) OVER a * 100 AS size, avg(ret) OVER b * 100 AS trend,
    ln(greatest(1e-6, avg(abs(ret)) OVER a / greatest(1e-6, avg(abs(ret)) OVER b))) AS ratio
  FROM market WINDOW a AS (ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), b AS (ORDER BY t ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))"""
_PATH = _OBS + """,
path AS MATERIALIZED (SELECT t, date, ret, CASE WHEN size <= (SELECT quantile_cont(size, 1.0 / 3) FROM obs) THEN 0 WHEN size <= (SELECT quantile_cont(size, 2.0 / 3) FROM obs) THEN 1 ELSE 2 END AS state FROM obs),
runs AS (SELECT state, CAST(min(t) AS INTEGER) AS start, CAST(max(t) AS INTEGER) AS "end" FROM (SELECT *, t - row_number() OVER (PARTITION BY state ORDER BY t) AS island FROM path) GROUP BY state, island),
moments AS MATERIALIZED (SELECT state, count(*)::DOUBLE / (SELECT count(*) FROM path) AS share, avg(ret) * 252 AS mean_return, coalesce(stddev_samp(ret), 0) * sqrt(252.0) AS vol,
    (SELECT avg("end" - start + 1) FROM runs r WHERE r.state = p.state) AS avg_length FROM path p GROUP BY state)"""
_MASKED = _BT + _PATH + """,
masked AS MATERIALIZED (SELECT g AS genome_id, state, CASE WHEN count(*) >= 15 AND stddev_samp(f.ret) > 0 THEN avg(f.ret) / stddev_samp(f.ret) * sqrt(252.0) ELSE 0 END AS sharpe,
    count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g) AS share, avg(CASE WHEN carried <> 0 THEN 1.0 ELSE 0.0 END) AS exposure
  FROM final f JOIN path USING (t) WHERE t >= 260 GROUP BY g, state)"""
_MONTHLY = _BT + """,
monthly AS MATERIALIZED (SELECT g AS genome_id, strftime(date, '%Y-%m') AS month, product(1 + f.ret) - 1 AS ret FROM final f JOIN market m USING (t) WHERE t >= 260 GROUP BY 1, 2)"""
_EQ = _BT + """,
eqs AS (SELECT g AS genome_id, t, product(1 + ret) OVER (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM final WHERE t >= 260)"""
_VEC_ALL = "WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS genome_id, CAST(embedding AS DOUBLE[]) AS z, label AS cluster FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"

_CSV = """WITH raw AS (
  SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
    CASE WHEN o_orderkey % 13 = 0 THEN 'IMPORT' ELSE upper(o_orderpriority)[1:12] END AS symbol,
    CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 100.5 END AS open, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS close FROM orders
), good AS (SELECT * FROM raw WHERE date IS NOT NULL AND close > 0)"""


def _spans() -> dict[str, float]:
    return {f"{f}.{k}": (b[1] - b[0]) or 1 for f, (_, p) in FAMILIES.items() for k, b in p.items()}


def _distances() -> str:
    rows = [(g, f, s, side, r[0], k, float(v) / _spans()[f"{f}.{k}"]) for g, f, s, side, p, r in FIXED for k, v in p.items()]
    values = ", ".join(f"('{g}', '{f}', '{s}', '{side}', {vt}, '{k}', {v!r})" for g, f, s, side, vt, k, v in rows)
    return f"""WITH p AS (SELECT * FROM (VALUES {values}) AS v(g, family, symbol, side, vt, k, x))
SELECT a.g AS a, b.g AS b, {_r('least(1, greatest(0, (sum(abs(a.x - b.x)) + any_value(CASE WHEN a.symbol <> b.symbol THEN 1.0 ELSE 0.0 END + abs(a.vt - b.vt) / 0.37 + CASE WHEN a.side = b.side THEN 0.0 ELSE 0.5 END)) / (count(*) + 3)))')} AS distance
FROM p a JOIN p b ON a.family = b.family AND a.k = b.k AND a.g < b.g GROUP BY a.g, b.g"""


def _repair() -> str:
    rows = []
    for g, f, _, _, p, _ in FIXED:
        for k, v in p.items():
            rows.append((g, f, k, float(v) * 6 if k in ("exit", "exitZ", "smooth", "volWindow") else float(v)))
    values = ", ".join(f"('{g}', '{f}', '{k}', {v!r})" for g, f, k, v in rows)
    at = lambda k: f"(SELECT v FROM p q WHERE q.g = p.g AND q.k = '{k}')"
    return f"""WITH p AS (SELECT * FROM (VALUES {values}) AS v(g, family, k, v))
SELECT g AS genome_id, k AS key, {_r(f'''CASE
  WHEN family = 'trend' AND k = 'slow' THEN least(250.0, CASE WHEN v <= {at('fast')} THEN {at('fast')} + greatest(5.0, floor(0.8 * {at('fast')} + 0.5)) ELSE v END)
  WHEN family = 'breakout' AND k = 'exit' AND v >= {at('entry')} THEN greatest(5.0, floor(0.5 * {at('entry')} + 0.5))
  WHEN family = 'meanReversion' AND k = 'exitZ' AND v >= {at('entryZ')} THEN greatest(0.0, {at('entryZ')} - 0.4)
  WHEN family = 'carry' AND k = 'smooth' AND v >= {at('lookback')} THEN greatest(2.0, floor(0.25 * {at('lookback')} + 0.5))
  WHEN family = 'volatility' AND k = 'highPct' AND v <= {at('lowPct')} + 0.05 THEN least(0.98, {at('lowPct')} + 0.2)
  WHEN family = 'volatility' AND k = 'pctWindow' AND v <= 2 * {at('volWindow')} THEN 3 * {at('volWindow')} ELSE v END''')} AS value FROM p"""


def _coerce() -> str:
    spec = {(k, float(a), float(b), float(s)) for _, p in FAMILIES.values() for k, (a, b, s) in p.items()}
    spec |= {(f"risk.{k}", float(a), float(b), float(s)) for k, (a, b, s) in RISK.items()}
    values = ", ".join(f"('{k}', {a!r}, {b!r}, {s!r}, {len(repr(s).split('.')[1]) if s < 1 else 0})" for k, a, b, s in sorted(spec))
    value = "greatest(low, least(high, low + (high - low) * (k * 0.173::DOUBLE - 0.1::DOUBLE)))"
    return f"""SELECT key, low, high, CAST(k AS INTEGER) AS k, {_r(f'CASE WHEN step > 0 THEN round(floor({value} / step + 0.5) * step, digits) ELSE floor({value} + 0.5) END')} AS value
FROM (SELECT key, low::DOUBLE AS low, high::DOUBLE AS high, step::DOUBLE AS step, digits FROM (VALUES {values}) AS v(key, low, high, step, digits)), range(9) AS x(k)"""


def _names() -> str:
    """Names and plain text of the fixed genomes, put together in SQL from their numbers."""
    rows = []
    for g, f, s, side, p, r in FIXED:
        keys = [*p.values(), 0, 0][:5]
        rows.append(f"('{g}', '{f}', '{FAMILIES[f][0].replace(' ', '')}', '{s}', '{side}', {', '.join(f'{float(v)}::DOUBLE' for v in (*keys, *r))})")
    whole = lambda v: f"CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR)"
    fix = lambda v, d: f"printf('%.{d}f', {v})"
    short = lambda v: f"CASE WHEN {v} = floor({v}) THEN {whole(v)} ELSE {fix(v, 2)} END"
    text = f"""CASE family
  WHEN 'trend' THEN 'Long while the ' || {whole('p1')} || '-bar mean is over ' || {fix('p4 * 100', 1)} || '% above the ' || {whole('p2')} || '-bar mean and the ' || {whole('p3')} || '-bar change is positive; short on the mirror image; flat inside the band.'
  WHEN 'breakout' THEN 'Long above the ' || {whole('p1')} || '-bar high, short below the ' || {whole('p1')} || '-bar low; out through the ' || {whole('p2')} || '-bar channel; no entries while ' || {whole('p3')} || '-bar volatility ranks above ' || {fix('p4 * 100', 0)} || '%.'
  WHEN 'meanReversion' THEN 'Against moves of ' || {fix('p2', 2)} || ' deviations from the ' || {whole('p1')} || '-bar mean with the ' || {whole('p4')} || '-bar RSI beyond ' || {fix('p5', 0)} || ' or ' || {fix('100 - p5', 0)} || '; out inside ' || {fix('p3', 2)} || '.'
  WHEN 'carry' THEN 'With the ' || {whole('p1')} || '-bar information ratio over the market, smoothed over ' || {whole('p2')} || ' bars, beyond ' || {fix('p3', 2)} || '; out below ' || {fix('p3 * p4', 2)} || '.'
  ELSE 'By the rank of ' || {whole('p1')} || '-bar volatility in ' || {whole('p2')} || ' bars: ' || CASE WHEN p5 = 1 THEN 'short' ELSE 'long' END || ' below ' || {fix('p3 * 100', 0)} || '%, ' || CASE WHEN p5 = 1 THEN 'long' ELSE 'short' END || ' above ' || {fix('p4 * 100', 0)} || '%.' END"""
    risk = f"""CASE side WHEN 'long' THEN ' Long only.' WHEN 'short' THEN ' Short only.' ELSE ' Long and short.' END || ' Sized to ' || {fix('vt * 100', 0)} || '% a year, at most ' || {fix('lev', 2)} || 'x.'
  || CASE WHEN sa > 0 THEN ' Stop at ' || {fix('sa', 1)} || ' ATR.' ELSE '' END || CASE WHEN ta > 0 THEN ' Target at ' || {fix('ta', 1)} || ' ATR.' ELSE '' END
  || CASE WHEN mh > 0 THEN ' Out after ' || {whole('mh')} || ' bars.' ELSE '' END || CASE WHEN cd > 0 THEN ' Wait ' || {whole('cd')} || ' bars.' ELSE '' END"""
    return f"""SELECT g AS genome_id, label || '.' || symbol || '.' || {short('p1')} || '-' || {short('p2')} AS name, {text} || {risk} AS text
FROM (VALUES {', '.join(rows)}) AS v(g, family, label, symbol, side, p1, p2, p3, p4, p5, vt, lev, sa, ta, mh, cd)"""


def _display() -> str:
    v, ms = "(floor(close * 12345.678::DOUBLE - 1000000) + 0.25)", "(floor(close * 777) + 0.25)"
    minutes = f"floor({ms} / 1000 / 60)"
    whole = lambda x: f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    return f"""{_BASE} SELECT symbol, t, format('{{:,}}', CAST(floor(close * 1000 + 0.5) AS BIGINT)) AS integer,
  CASE WHEN abs({v}) >= 1e9 THEN printf('%.1fB', {v} / 1e9) WHEN abs({v}) >= 1e6 THEN printf('%.1fM', {v} / 1e6) WHEN abs({v}) >= 1e3 THEN printf('%.1fk', {v} / 1e3) ELSE printf('%.0f', {v}) END AS compact,
  strftime(date, '%d/%m/%y') AS short_date, strftime(date, '%b %Y') AS month,
  CASE WHEN {ms} < 1000 THEN {whole(f'floor({ms} + 0.5)')} || 'ms' WHEN {ms} / 1000 < 60 THEN printf('%.1fs', {ms} / 1000) ELSE {whole(minutes)} || 'm ' || {whole(f'floor({ms} / 1000 - {minutes} * 60 + 0.5)')} || 's' END AS duration FROM bars"""


def oracle_sql() -> dict[str, str]:
    from . import series_sql  # it builds on the expressions above

    hi40, lo40 = _full(f"max(high) OVER {_over(40)}", 40), _full(f"min(low) OVER {_over(40)}", 40)
    pct_value, pct_from = _rank("volume", 60, "rets")
    vp_value, vp_from = _rank("rv", 120, f"(SELECT *, {_SD('ret', 20)} * sqrt(252.0) AS rv FROM rets)")
    trend = f"""CASE WHEN f / s - 1 > 0.002 AND way > 0 THEN 1.0 WHEN f / s - 1 < -0.002 AND way < 0 THEN -1.0 ELSE 0.0 END"""
    trend_from = f"(SELECT symbol, t, {_MA('close', 20)} AS f, {_MA('close', 100)} AS s, close / lag(close, 40) OVER (PARTITION BY symbol ORDER BY t) - 1 AS way FROM bars)"
    ind = [("sma", 20, _MA("close", 20)), ("sma", 100, _MA("close", 100)), ("roc", 40, "close / lag(close, 40) OVER (PARTITION BY symbol ORDER BY t) - 1"), ("high", 40, hi40), ("low", 40, lo40)]
    ir = f"(SELECT symbol, t, CASE WHEN {_SD('s', 60)} > 0 THEN {_MA('s', 60)} / {_SD('s', 60)} * sqrt(252.0) END AS i FROM (SELECT r.symbol, r.t, r.ret - m.ret AS s FROM rets r JOIN market m USING (t)))"
    of = lambda *f: f"{_SIGNALS} SELECT g AS genome_id, CAST(t AS INTEGER) AS t, {_r('v')} AS signal FROM signals WHERE family IN ({', '.join(repr(x) for x in f)})"
    months = [f"{m:02d}" for m in range(1, 13)]
    families = ", ".join(f"('{f}')" for f in FAMILIES)
    ins, outs = "i", "o"
    lg = lambda x, hi: f"least({hi}, greatest(0, ln(1 + greatest(0, {x}))))"
    cl = lambda x, lo, hi: f"least({hi}, greatest({lo}, {x}))"
    feats = [
        cl("o.sharpe", -4, 4), cl("o.sortino", -6, 6), cl("o.cagr", -1, 2), cl("o.vol", 0, 1.2), cl("o.max_drawdown", -1, 0), cl("o.ulcer", 0, 1), cl("o.win_rate", 0, 1),
        lg("o.profit_factor", 3), lg("o.avg_hold", 6), cl("o.exposure", 0, 1), lg("o.turnover", 8), cl("o.skew", -3, 3), cl("o.tail_ratio", 0, 4), cl("o.bench_corr", -1, 1),
        "CASE WHEN i.sharpe = 0 THEN 0 ELSE " + cl("(i.sharpe - o.sharpe) / abs(i.sharpe)", -3, 3) + " END", lg("o.trades", 8),
    ]
    fit = f"""SELECT genome_id, {{raw}} AS raw, least(9, greatest(-9, {{raw}} - CASE WHEN trades < 12 THEN 1.5 + 0.25 * (12 - trades) ELSE 0 END - CASE WHEN exposure < 0.02 THEN 3 ELSE 0 END
  - CASE WHEN max_drawdown < -0.5 THEN (abs(max_drawdown) - 0.5) * 4 ELSE 0 END - CASE WHEN vol > 0.6 THEN (vol - 0.6) * 2 ELSE 0 END)) AS fitness FROM metrics WHERE slice = 'is'"""
    _behaviour = f"part AS (SELECT g, least(11, (t - {_END}) // (({_N} - {_END}) // 12)) AS k, product(1 + ret) - 1 AS r FROM final WHERE t >= {_END} GROUP BY 1, 2)"
    _buckets = [f"least(2, greatest(-1, coalesce(max(r) FILTER (k = {k}), 0)))" for k in range(12)]
    clustered = f"""{_RANKED_CTE},
{_behaviour}, feat AS (SELECT o.genome_id, [{", ".join(feats)}] AS f FROM metrics {outs} JOIN metrics {ins} ON o.genome_id = i.genome_id AND o.slice = 'oos' AND i.slice = 'is'),
whole AS (SELECT genome_id, list_transform(list_concat(f, b), lambda x: CAST(x AS DOUBLE)) AS x FROM feat JOIN (SELECT g AS genome_id, [{", ".join(f"0.6 * {x}" for x in _buckets)}] AS b FROM part GROUP BY g) USING (genome_id)),
deal AS (SELECT genome_id, k, x[k] AS x FROM whole, range(1, 29) AS q(k)),
zs AS (SELECT genome_id, list(z ORDER BY k) AS z FROM (SELECT genome_id, k, least(6, greatest(-6, (x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w > 0 THEN stddev_samp(x) OVER w ELSE 1 END)) AS z FROM deal WINDOW w AS (PARTITION BY k)) GROUP BY genome_id),
member AS MATERIALIZED (SELECT r.*, CASE WHEN symbol = 'A' THEN 0 ELSE 1 END AS cluster, z FROM ranked r JOIN zs USING (genome_id)),
centre AS (SELECT cluster, list(x ORDER BY k) AS c FROM (SELECT cluster, k, avg(z[k]) AS x FROM member, range(1, 29) AS q(k) GROUP BY cluster, k) GROUP BY cluster),
medoid AS (SELECT cluster, arg_min(genome_id, struct_pack(d := {_DIST.format(a='z', b='c')}, g := genome_id)) AS medoid_id FROM member JOIN centre USING (cluster) GROUP BY cluster),
lead AS (SELECT cluster, family, n FROM (SELECT cluster, family, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, family) AS k FROM member GROUP BY 1, 2) WHERE k = 1),
info AS (SELECT cluster, count(*) AS size, avg(sharpe) AS sharpe, avg(cagr) AS cagr, avg(max_drawdown) AS max_drawdown, avg(vol) AS vol, avg(avg_hold) AS hold, avg(abs(max_drawdown)) AS depth, abs(avg(bench_corr)) AS corr FROM member GROUP BY cluster)"""
    label_of = "CASE family " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, (t, _) in FAMILIES.items()) + " END"
    out = {
        "bars_daily": f"WITH {_DAILY} SELECT * FROM bars",
        "bars_weekly": f"WITH {_WEEKLY} SELECT * FROM bars",
        "windowed_bars": "SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2",
        "bars_intraday": """WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 3 HOUR, ts) AS w, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
c AS (SELECT w FROM b GROUP BY w HAVING count(*) = (SELECT count(DISTINCT symbol) FROM b))
SELECT symbol, strftime(w, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume, CAST(row_number() OVER (PARTITION BY symbol ORDER BY w) - 1 AS INTEGER) AS t FROM b WHERE w IN (SELECT w FROM c)""",
        "calendar_intersection": f"WITH {_DAILY} SELECT date FROM cal",
        "business_calendar": "SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS t, d AS date FROM (SELECT CAST(x AS DATE) AS d FROM generate_series(DATE '2013-01-02', DATE '2025-12-31', INTERVAL 1 DAY) AS s(x)) WHERE isodow(d) < 6 ORDER BY d LIMIT 3024",
        "packed_series": f"WITH {_DAILY} SELECT symbol, count(*) AS n, max(t) AS last_t, {_r('sum(close)', 4)} AS closes FROM bars GROUP BY symbol",
        "csv_clean_rows": f"{_CSV}, last AS (SELECT symbol, date, arg_max(open, line_no) AS open, arg_max(close, line_no) AS close FROM good GROUP BY 1, 2) SELECT symbol, date, open, greatest(open, close) AS high, close AS low, close, 0.0::DOUBLE AS volume FROM last",
        "csv_report": f"{_CSV} SELECT (SELECT count(*) FROM raw) AS rows_read, (SELECT count(*) FROM good) AS rows_kept, (SELECT count(DISTINCT symbol) FROM good) AS symbols",
        "simple_returns": _kernel("ret", 10),
        "log_returns": _kernel("coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)), 0)", 10),
        "sma": _kernel(_MA("close", 20)),
        "rolling_stdev": _kernel(_SD("close", 20)),
        "roc": _kernel("close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY t) - 1"),
        "true_range": _kernel(_TR, source="(SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS before FROM bars)"),
        "zscore": _kernel(f"CASE WHEN {_SD('close', 30)} > 0 THEN (close - {_MA('close', 30)}) / {_SD('close', 30)} END", 6),
        "realized_vol": _kernel(f"{_SD('ret', 20)} * sqrt(252.0)"),
        "rolling_percentile": _kernel(pct_value, source=pct_from),
        "rolling_extremes": f"{_BASE} SELECT symbol, t, {_full(f'max(close) OVER {_over(25)}', 25)} AS highest, {_full(f'min(close) OVER {_over(25)}', 25)} AS lowest FROM bars",
        "donchian": f"{_BASE} SELECT symbol, t, {hi40} AS channel_high, {lo40} AS channel_low FROM bars",
        "vol_percentile": _kernel(vp_value, source=vp_from),
        "smooth_ignore_null": _kernel(f"CASE WHEN count(x) OVER {_over(8)} >= 4 THEN avg(x) OVER {_over(8)} END", source="(SELECT *, CASE WHEN volume % 3 <> 0 THEN close END AS x FROM bars)"),
        "carry_ir": _kernel(f"CASE WHEN count(i) OVER {_over(10)} >= 5 THEN avg(i) OVER {_over(10)} END", 6, ir),
        "equal_weight_index": f"{_BASE} SELECT t, date, {_r('level')} AS level, {_r('ret', 12)} AS ret FROM market",
        "ema": _left(_EMA, "v", "ema"),
        "ema_fold": _left(_EMA, "v", "ema"),
        "rsi": _left(_DIFF + _rsi_cte(14), _RSI, "rsi14"),
        "atr": _left(_RANGES + _ATR14, "atr", "atr14"),
        "indicator_table": _BASE + " " + " UNION ALL ".join(f"SELECT symbol, t, '{k}' AS kernel, {w} AS w, {_r(x)} AS value FROM bars" for k, w, x in ind),
        "signal_trend": f"{_BASE} SELECT symbol, t, {trend}::DOUBLE AS signal FROM {trend_from}",
        "signal_volatility": f"{_BASE} SELECT symbol, t, {_r('CASE WHEN p <= 0.3 THEN least(1, (0.3 - p) / 0.3 + 0.4) WHEN p >= 0.8 THEN -least(1, (p - 0.8) / (1 - 0.8::DOUBLE) + 0.4) ELSE 0 END')} AS signal FROM (SELECT symbol, t, {vp_value} AS p FROM {vp_from})",
        "signal_side_mask": f"{_BASE} SELECT symbol, t, greatest(v, 0.0) AS long, least(v, 0.0) AS short, v AS both FROM (SELECT symbol, t, {trend}::DOUBLE AS v FROM {trend_from})",
        "signal_breakout": of("breakout"),
        "signal_mean_reversion": of("meanReversion"),
        "signal_carry": of("carry"),
        "signal_all": f"{_SIGNALS} SELECT g AS genome_id, count(*) FILTER (v > 0) AS long_bars, count(*) FILTER (v < 0) AS short_bars, {_r('sum(round(v, 8))', 5)} AS total FROM signals GROUP BY g",
        "position_sizing": f"{_BASE} SELECT symbol, t, {_r('CASE WHEN v IS NULL OR v <= 1e-6 THEN 0 ELSE greatest(0, least(2, 0.12 / v)) END')} AS size FROM (SELECT symbol, t, {_SD('ret', 20)} * sqrt(252.0) AS v FROM rets)",
        "backtest_bars": f"{_BT} SELECT g AS genome_id, CAST(t AS INTEGER) AS t, {_r('ret', 7)} AS ret, {_r('carried', 7)} AS position, {_r('equity', 7)} AS equity FROM final",
        "backtest_trades": f"{_BT} SELECT g AS genome_id, CAST(entry_t AS INTEGER) AS entry_t, CAST(exit_t AS INTEGER) AS exit_t, CAST(direction AS INTEGER) AS direction, {_r('return_pct')} AS return_pct, CAST(bars AS INTEGER) AS bars, exit_reason FROM trades",
        "backtest_turnover": f"{_BT} SELECT g AS genome_id, {_r('max(moved)', 6)} AS turnover FROM final GROUP BY g",
        "unknown_symbols": "SELECT 'g05' AS genome_id, '??' AS symbol",
        "equity_curve": f"{_EQ} SELECT genome_id, CAST(t AS INTEGER) AS t, {_r('eq')} AS equity FROM eqs",
        "drawdown_curve": f"{_EQ} SELECT genome_id, CAST(t AS INTEGER) AS t, {_r('eq / greatest(1.0, max(eq) OVER (PARTITION BY genome_id ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1')} AS drawdown FROM eqs",
        "metrics_full": _BT + _metric_ctes(f"SELECT 'all' AS slice, 260 AS a, {_N} AS b") + f" SELECT genome_id, slice, {_SHOWN} FROM metrics",
        "metrics_is_oos": _BT + _metric_ctes(_IS_OOS) + f" SELECT genome_id, slice, {_SHOWN} FROM metrics",
        "monthly_returns": f"{_MONTHLY} SELECT genome_id, month, {_r('ret')} AS ret FROM monthly",
        "monthly_grid": f"{_MONTHLY} SELECT genome_id, CAST(month[1:4] AS INTEGER) AS year, " + ", ".join(f"{_r(f'max(ret) FILTER (month[6:7] = {m!r})')} AS m{m}" for m in months) + f", {_r('product(1 + ret) - 1')} AS year_total FROM monthly GROUP BY 1, 2",
        "year_totals": f"{_MONTHLY} SELECT genome_id, month[1:4] AS year, {_r('product(1 + ret) - 1')} AS ret FROM monthly GROUP BY 1, 2",
        "exit_mix": f"{_BT} SELECT g AS genome_id, exit_reason, count(*) AS n FROM trades GROUP BY 1, 2",
        "recent_trades": f"{_BT} SELECT g AS genome_id, CAST(entry_t AS INTEGER) AS entry_t, CAST(exit_t AS INTEGER) AS exit_t, CAST(direction AS INTEGER) AS direction, {_r('return_pct')} AS return_pct, CAST(bars AS INTEGER) AS bars, exit_reason, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY exit_t DESC, entry_t DESC) AS k FROM trades) WHERE k <= 160",
        "objective_scores": f"{_FIT} SELECT genome_id, {_r('avg(sharpe) - 0.55 * stddev_samp(sharpe)', 6)} AS raw FROM metrics WHERE slice <> 'is' GROUP BY genome_id",
        "fitness_penalised": f"{_FIT} SELECT genome_id, {_r('raw', 6)} AS raw, {_r('fitness', 6)} AS fitness FROM ({fit.format(raw='sharpe')})",
        "walk_forward_folds": f"{_FOLDS} SELECT genome_id, CAST(slice AS INTEGER) AS fold, 260 AS train_start, CAST(a AS INTEGER) AS train_end, CAST(a AS INTEGER) AS test_start, CAST(b AS INTEGER) AS test_end, {_r('sharpe', 6)} AS sharpe, {_r('cagr', 6)} AS cagr, {_r('max_drawdown', 6)} AS max_drawdown FROM metrics JOIN slices USING (slice)",
        "robustness": f"{_FOLDS} SELECT genome_id, {_r(_ROBUST, 6)} AS robustness FROM metrics GROUP BY genome_id",
        "final_ranking": f"{_RANKED_CTE} SELECT genome_id, family, {_r('sharpe', 6)} AS sharpe, {_r('is_sharpe', 6)} AS is_sharpe, {_r('robustness', 6)} AS robustness, rank FROM ranked",
        "family_stats": f"{_RANKED_CTE} SELECT f.family, count(r.genome_id) AS count, {_r('coalesce(list_sort(list(sharpe))[CAST(floor(count(r.genome_id) / 2) AS BIGINT) + 1], 0)', 6)} AS median_sharpe, {_r('coalesce(max(sharpe), 0)', 6)} AS best_sharpe FROM (VALUES {families}) AS f(family) LEFT JOIN ranked r USING (family) GROUP BY f.family",
        "leaderboard_filtered": f"{_RANKED_CTE} SELECT genome_id, rank, {_r('sharpe', 6)} AS sharpe FROM ranked WHERE sharpe > 0",
        "overview_kpis": f"{_RANKED_CTE} SELECT {_r('avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END)', 6)} AS hit_rate, {_r('median(sharpe)', 6)} AS median_out, {_r('median(is_sharpe)', 6)} AS median_in, {_r('CASE WHEN median(is_sharpe) <> 0 THEN 1 - median(sharpe) / median(is_sharpe) ELSE 0 END', 6)} AS decay FROM ranked",
        "top_k_hall": "SELECT generation, genome_id, fitness, CAST(k AS INTEGER) AS k FROM (SELECT o_orderpriority AS generation, CAST(o_orderkey AS VARCHAR) AS genome_id, o_totalprice AS fitness, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS k FROM orders) WHERE k <= 20",
        "downsample_curve": f"{_BASE} SELECT CAST(k AS INTEGER) AS k, CAST(t AS INTEGER) AS i, {_r('level')} AS level FROM range(420) AS q(k) JOIN market ON t = CAST(floor(k * {_N} / 420.0) AS BIGINT)",
        "resample_nearest": f"{_BASE} SELECT CAST(k AS INTEGER) AS k, {_r('level')} AS v FROM range(333) AS q(k) JOIN market ON t = CAST(floor(k / 332.0::DOUBLE * ({_N} - 1) + 0.5) AS BIGINT)",
        "normalised_index": f"{_BASE} SELECT symbol, t, {_r('close / first_value(close) OVER (PARTITION BY symbol ORDER BY t)')} AS value FROM bars WHERE t >= 260",
        "regime_observations": f"{_BASE}{_OBS} SELECT t, date, {', '.join(f'{_r(c)} AS {c}' for c in ('drift', 'size', 'trend', 'ratio'))} FROM obs",
        "regime_segments": f"{_BASE}{_PATH} SELECT CAST(state AS INTEGER) AS state, start, \"end\", CAST(\"end\" - start + 1 AS INTEGER) AS length FROM runs",
        "regime_moments": f"{_BASE}{_PATH} SELECT CAST(state AS INTEGER) AS state, {', '.join(f'{_r(c, 6)} AS {c}' for c in ('share', 'mean_return', 'vol', 'avg_length'))} FROM moments",
        "regime_labels": f"""{_BASE}{_PATH}, ranks AS (SELECT *, row_number() OVER (ORDER BY mean_return DESC, state) - 1 AS place, (SELECT list_sort(list(vol))[CAST(floor(count(*) / 2) AS BIGINT) + 1] FROM moments) AS mid FROM moments),
named AS (SELECT state, vol > 1.1 * mid AS wild, mean_return < 0 AS falling, place < 1 AS high, place >= 2 AS low FROM ranks),
labelled AS (SELECT state, CASE WHEN high THEN CASE WHEN wild THEN 'Momentum Surge' ELSE 'Calm Uptrend' END WHEN low AND falling THEN CASE WHEN wild THEN 'Stress Selloff' ELSE 'Grinding Bear' END WHEN low THEN CASE WHEN wild THEN 'Volatile Fade' ELSE 'Slow Drift' END ELSE CASE WHEN wild THEN 'Choppy / High Vol' ELSE 'Quiet Grind' END END AS label,
  CASE WHEN high THEN 'bull' WHEN low AND falling THEN CASE WHEN wild THEN 'stress' ELSE 'bear' END ELSE CASE WHEN wild THEN 'chop' ELSE 'calm' END END AS tone FROM named)
SELECT CAST(state AS INTEGER) AS state, label || CASE WHEN row_number() OVER (PARTITION BY label ORDER BY state) > 1 THEN ' ' || row_number() OVER (PARTITION BY label ORDER BY state) ELSE '' END AS label, tone FROM labelled""",
        "regime_dominant": f"{_BASE}{_PATH} SELECT CAST((SELECT state FROM moments ORDER BY share DESC, state LIMIT 1) AS INTEGER) AS dominant, CAST((SELECT state FROM moments ORDER BY mean_return, state LIMIT 1) AS INTEGER) AS worst",
        "regime_bands": f"{_BASE}{_PATH} SELECT CAST(state AS INTEGER) AS state, greatest(start, 260) AS start, least(\"end\", 400) AS \"end\", {_r('(greatest(start, 260) - 260) / 140.0', 6)} AS x0, {_r('(least(\"end\", 400) - 260) / 140.0', 6)} AS x1 FROM runs WHERE \"end\" >= 260 AND start <= 400",
        "masked_sharpe": f"{_MASKED} SELECT genome_id, CAST(state AS INTEGER) AS state, {_r('sharpe', 6)} AS sharpe, {_r('share', 6)} AS share, {_r('exposure', 6)} AS exposure FROM masked",
        "regime_atlas_strategy": f"{_MASKED} SELECT genome_id, " + ", ".join(f"{_r(f'max(sharpe) FILTER (state = {s})', 6)} AS state_{s}" for s in range(3)) + " FROM masked GROUP BY genome_id",
        "regime_atlas_family": f"{_MASKED} SELECT family, " + ", ".join(f"{_r(f'median(sharpe) FILTER (state = {s})', 6)} AS state_{s}" for s in range(3)) + " FROM masked JOIN sides ON g = genome_id GROUP BY family",
        "genome_distance": _distances(),
        "genome_repair": _repair(),
        "genome_coerce": _coerce(),
        "metric_features": _BT + _metric_ctes(_IS_OOS) + " SELECT o.genome_id, " + ", ".join(f"{_r(x, 6)} AS f{k}" for k, x in enumerate(feats)) + f" FROM metrics {outs} JOIN metrics {ins} ON o.genome_id = i.genome_id AND o.slice = 'oos' AND i.slice = 'is'",
        "behaviour_signature": _BT + f", part AS (SELECT g, least(11, (t - {_END}) // (({_N} - {_END}) // 12)) AS k, product(1 + ret) - 1 AS r FROM final WHERE t >= {_END} GROUP BY 1, 2) SELECT g AS genome_id, " + ", ".join(f"{_r(f'least(2, greatest(-1, coalesce(max(r) FILTER (k = {k}), 0)))', 6)} AS b{k}" for k in range(12)) + " FROM part GROUP BY g",
        "feature_standardise_all": f"{_VEC_ALL} SELECT genome_id, CAST(k - 1 AS INTEGER) AS k, {_r('least(6, greatest(-6, (z[k] - avg(z[k]) OVER w) / CASE WHEN stddev_samp(z[k]) OVER w > 0 THEN stddev_samp(z[k]) OVER w ELSE 1 END))')} AS z FROM v, range(1, 65) AS q(k) WINDOW w AS (PARTITION BY k)",
        "nearest_centroid_all": f"{_VEC_ALL}, c AS (SELECT cluster, list(x ORDER BY k) AS c FROM (SELECT cluster, k, avg(z[k]) AS x FROM v, range(1, 65) AS q(k) GROUP BY 1, 2) GROUP BY 1), d AS (SELECT genome_id, c.cluster, {_DIST.format(a='z', b='c')} AS distance FROM v, c) SELECT genome_id, cluster, {_r('distance', 6)} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY distance, cluster) AS k FROM d) WHERE k = 1",
        "silhouette_all": f"{_VEC_ALL}, d AS (SELECT a.genome_id, a.cluster, b.cluster AS c, avg({_DIST.format(a='a.z', b='b.z')}) AS d FROM v a JOIN v b ON a.genome_id <> b.genome_id GROUP BY 1, 2, 3), s AS (SELECT genome_id, max(d) FILTER (c = cluster) AS own, min(d) FILTER (c <> cluster) AS nxt FROM d GROUP BY genome_id) SELECT {_r('avg(CASE WHEN own IS NOT NULL AND nxt IS NOT NULL THEN (nxt - own) / greatest(own, nxt) ELSE 0 END)', 6)} AS silhouette FROM s",
        "cluster_summary": f"{clustered} SELECT CAST(cluster AS INTEGER) AS cluster, size, {', '.join(f'{_r(c, 6)} AS {c}' for c in ('sharpe', 'cagr', 'max_drawdown', 'vol'))}, medoid_id FROM info JOIN medoid USING (cluster)",
        "cluster_labels": f"""{clustered}, named AS (SELECT *, CASE WHEN n / size > 0.7 THEN {label_of} ELSE {label_of} || '-led mix' END || ' · ' || CASE WHEN hold > 40 THEN 'slow' WHEN hold > 12 THEN 'swing' ELSE 'fast' END || ' · ' || CASE WHEN depth > 0.3 THEN 'high risk' WHEN depth > 0.15 THEN 'moderate' ELSE 'contained' END AS base FROM info JOIN lead USING (cluster))
SELECT CAST(cluster AS INTEGER) AS cluster, base || CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN ' · ' || CASE WHEN corr > 0.45 THEN 'market-linked' WHEN corr < 0.2 THEN 'market-neutral' ELSE 'partly linked' END || ' · ' || CASE WHEN sharpe > 0.15 THEN 'positive edge' WHEN sharpe < -0.15 THEN 'negative edge' ELSE 'flat' END ELSE '' END AS label FROM named""",
        "cluster_blobs_all": f"{_VEC_ALL} SELECT cluster, {_r('avg(z[1] * 100)', 6)} AS x, {_r('avg(z[2] * 100)', 6)} AS y, {_r('least(240, greatest(34, 1.5 * sqrt(var_pop(z[1] * 100) + var_pop(z[2] * 100))))', 6)} AS radius FROM v GROUP BY cluster",
        "instrument_stats": f"{_BASE} SELECT symbol, {_r('arg_max(close, t)')} AS last_close, {_r('arg_max(close, t) / arg_min(close, t) - 1')} AS total_return, {_r('stddev_samp(ret) * sqrt(252.0)')} AS vol, {_r('min(dd)')} AS max_drawdown FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rets) GROUP BY symbol",
        "extents": f"{_BASE} SELECT symbol, {_r('CASE WHEN min(close) = max(close) THEN min(close) - 1 ELSE min(close) END', 6)} AS low, {_r('CASE WHEN min(close) = max(close) THEN max(close) + 1 ELSE max(close) END', 6)} AS high FROM bars GROUP BY symbol",
        "moments_of_returns": f"""{_BASE} SELECT symbol, {_r('avg(ret)', 10)} AS mean, {_r('var_samp(ret)', 10)} AS variance, {_r('stddev_samp(ret)', 10)} AS stdev, {_r('skewness(ret)', 6)} AS skew,
  {_r('(kurtosis_pop(ret) + 3) * pow((count(*) - 1.0) / count(*), 2) - 3', 6)} AS kurtosis, {_r('quantile_cont(ret, 0.95)', 10)} AS p95, {_r('median(ret)', 10)} AS median, {_r('list_sort(list(ret))[CAST(floor(count(*) / 2) AS BIGINT) + 1]', 10)} AS upper_median,
  {_r('list_reverse_sort(list(ret))[CAST(floor(count(*) / 2) AS BIGINT) + 1]', 10)} AS lower_median, {_r('corr(ret, volume)', 6)} AS corr FROM rets GROUP BY symbol""",
        "genome_names": _names(),
        "display_text": _display(),
        "instrument_catalog": "SELECT * FROM (VALUES " + ", ".join(f"('{i.symbol}', '{i.label}', '{i.asset_class}')" for i in INSTRUMENTS) + ") AS v(symbol, label, asset_class)",
        "flagship": f"""{_BASE}, sig AS (SELECT symbol, t, ret, CASE WHEN f / s - 1 > 0.002 AND way > 0 THEN 1.0 WHEN f / s - 1 < -0.002 AND way < 0 THEN -1.0 ELSE 0.0 END AS v FROM
  (SELECT symbol, t, ret, {_MA('close', 20)} AS f, {_MA('close', 60)} AS s, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY t) - 1 AS way FROM rets)),
held AS (SELECT symbol, t, ret * pos AS ret, pos FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY t), 0) AS pos FROM sig)),
eqs AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM held),
dds AS (SELECT *, eq / greatest(1.0, max(eq) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM eqs)
SELECT symbol, count(*) AS bars, {_r('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0) ELSE 0 END', 6)} AS sharpe, {_r('stddev_samp(ret) * sqrt(252.0)', 6)} AS vol, {_r('arg_max(eq, t)', 6)} AS final,
  {_r('min(dd)', 6)} AS max_drawdown, {_r('avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END)', 6)} AS exposure FROM dds GROUP BY symbol""",
    }
    one = lambda name, genome: f"SELECT * FROM ({out[name]}) WHERE genome_id = '{genome}'"
    scored = f"({_N} - 260)"
    curve = lambda points: f"(SELECT CAST(k AS INTEGER) AS k, m.date, m.level / (SELECT level FROM market WHERE t = 260) AS level FROM range({points}) AS q(k) JOIN market m ON m.t - 260 = CAST(floor(k * {scored} / {points}.0) AS BIGINT))"

    def curves(genome: str, symbol: str, points: int, cols: str) -> str:
        return f"""{_EQ}, dds AS (SELECT genome_id, t, eq / greatest(1.0, max(eq) OVER (PARTITION BY genome_id ORDER BY t ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM eqs),
w AS (SELECT f.g AS genome_id, f.t - 260 AS i, m.date, f.equity / (SELECT equity FROM final z WHERE z.g = f.g AND z.t = 260) AS equity, d.dd AS drawdown,
    m.level / (SELECT level FROM market WHERE t = 260) AS benchmark, f.carried AS position, c.close / (SELECT close FROM bars z WHERE z.symbol = '{symbol}' AND z.t = 260) AS price
  FROM final f JOIN market m USING (t) JOIN dds d ON d.genome_id = f.g AND d.t = f.t JOIN bars c ON c.symbol = '{symbol}' AND c.t = f.t WHERE f.g = '{genome}' AND f.t >= 260)
SELECT genome_id, CAST(k AS INTEGER) AS k, date, {', '.join(f'{_r(c, 6)} AS {c}' for c in cols.split())} FROM range({points}) AS q(k) JOIN w ON i = CAST(floor(k * {scored} / {points}.0) AS BIGINT)"""

    for n in ("feature_standardise", "nearest_centroid", "silhouette", "cluster_blobs"):
        out[n] = out[n + "_all"]
    return out | {
        "combined_features": f"{clustered.replace('x[k] AS x FROM', 'round(x[k], 8) AS x FROM')} SELECT genome_id, CAST(k - 1 AS INTEGER) AS k, {_r('z[k]', 5)} AS z FROM zs, range(1, 29) AS q(k)",
        "cluster_members": f"{_RANKED_CTE} SELECT genome_id, 1 AS cluster, rank FROM ranked WHERE symbol <> 'A' ORDER BY rank LIMIT 60",
        "benchmark_curve": f"{_BASE} SELECT k, date, {_r('level')} AS level FROM {curve(420)}",
        "split_labels": f"{_BASE} SELECT CAST({_END} AS INTEGER) AS is_end, CAST({_N} AS INTEGER) AS total, strftime((SELECT date FROM market WHERE t = 260), '%Y-%m-%d') || ' to ' || strftime((SELECT date FROM market WHERE t = {_END} - 1), '%Y-%m-%d') AS is_label, strftime((SELECT date FROM market WHERE t = {_END}), '%Y-%m-%d') || ' to ' || strftime((SELECT max(date) FROM market), '%Y-%m-%d') AS oos_label",
        "split_marker": f"{_BASE} SELECT CAST(floor(({_END} - 260)::DOUBLE / greatest(1, {scored}) * 699 + 0.5) AS INTEGER) AS marker",
        "benchmark_tail": f"""{_BASE}, sizes AS MATERIALIZED (SELECT count(*) AS n, greatest(460, CAST(floor(count(*) * 0.62) AS BIGINT)) AS e FROM market),
p AS MATERIALIZED (SELECT n - 260 AS scored, greatest(0, 420 - CAST(floor((n - e)::DOUBLE / greatest(1, n - 260) * 420 + 0.5) AS BIGINT)) AS cut FROM sizes),
pts AS MATERIALIZED (SELECT q.k, 260 + CAST(floor(q.k * scored / 420.0) AS BIGINT) AS t, cut FROM range(420) AS q(k), p),
c AS MATERIALIZED (SELECT k - cut AS i, 420 - cut AS m, level FROM pts JOIN market USING (t) WHERE k >= cut),
want AS MATERIALIZED (SELECT CAST(q.k AS INTEGER) AS k, least(m - 1, CAST(floor(q.k / 419.0 * (m - 1) + 0.5) AS BIGINT)) AS i FROM range(420) AS q(k), (SELECT 420 - cut AS m FROM p))
SELECT k, {_r('level / first_level')} AS v FROM want JOIN c USING (i), (SELECT level AS first_level FROM c WHERE i = 0)""",
        "visible_series": f"{_BASE} SELECT symbol, count(*) AS n, {_r('sum(close)', 4)} AS closes FROM bars WHERE symbol IN ('A', 'R') GROUP BY symbol",
        "custom_universe": f"{_BASE} SELECT symbol, count(*) AS n, min(date) AS first, max(date) AS last FROM bars GROUP BY symbol",
        "inspect_curves": curves("g03", "N", 700, "equity drawdown benchmark position price"),
        "inspect_metrics": one("metrics_full", "g03"),
        "inspect_trades": one("recent_trades", "g03").replace(_r("return_pct"), _r("return_pct", 6)),
        "inspect_monthly": one("monthly_returns", "g03").replace(_r("ret"), _r("ret", 6)),
        "manual_metrics": one("metrics_is_oos", "g05"),
        "manual_folds": one("walk_forward_folds", "g05"),
        "manual_curves": curves("g05", "R", 520, "equity drawdown"),
        "preview_index": f"{_BASE} SELECT CAST(t AS INTEGER) AS t, date, {_r('level / 100')} AS level FROM market",
        "preview_instruments": out["instrument_stats"],
        "signal_function": out["signal_all"],
    } | series_sql.oracle_sql()
