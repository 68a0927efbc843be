"""DuckDB twins of series.py: ASOF joins, range joins, recursions over bars and unrolled rounds of k-means."""

from __future__ import annotations

from .oracle import _BASE, _BT, _PATH, _full, _over, _r, _rank

_STATES = (1, 2, 3)
_MOVE = lambda i, j: "0.9" if i == j else "0.05"
_DENSITY = "greatest(1e-300, exp(-0.5 * (ln(2 * pi() * v1) + pow(drift - m1, 2) / v1 + ln(2 * pi() * v2) + pow(size - m2, 2) / v2)))"
_SPREAD = lambda x: f"greatest(1e-8, CASE WHEN var_samp({x}) > 0 THEN var_samp({x}) ELSE 1.0 END)"
_CHAIN = f"""{_BASE},
seen AS MATERIALIZED (SELECT symbol, t, avg(ret) OVER w * 100 AS drift, avg(abs(ret)) OVER w * 100 AS size FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
cuts AS (SELECT symbol, quantile_cont(size, 1.0 / 3) AS a, quantile_cont(size, 2.0 / 3) AS b FROM seen GROUP BY symbol),
model AS (SELECT symbol, s, avg(drift) AS m1, avg(size) AS m2, {_SPREAD('drift')} AS v1, {_SPREAD('size')} AS v2
  FROM (SELECT seen.*, CASE WHEN size > b THEN 3 WHEN size > a THEN 2 ELSE 1 END AS s FROM seen JOIN cuts USING (symbol)) GROUP BY symbol, s),
emit AS MATERIALIZED (SELECT symbol, CAST(t AS INTEGER) AS t, list({_DENSITY} ORDER BY s) AS b FROM seen JOIN model USING (symbol) GROUP BY symbol, t),
ends AS (SELECT symbol, max(t) AS t FROM emit GROUP BY symbol)"""


def _normal(items: list[str]) -> str:
    return f"list_transform([{', '.join(items)}], lambda x: x / ({' + '.join(items)}))"


def _shares() -> str:
    ahead = [f"({' + '.join(f'a[{i}] * {_MOVE(i, j)}' for i in _STATES)}) * b[{j}]" for j in _STATES]
    back = [f"({' + '.join(f'{_MOVE(i, j)} * b[{j}] * w[{j}]' for j in _STATES)})" for i in _STATES]
    share = _normal([f"a[{i}] * w[{i}]" for i in _STATES])
    return f"""{_CHAIN},
fw AS (SELECT symbol, t, {_normal(['b[1]', 'b[2]', 'b[3]'])} AS a FROM emit WHERE t = 0
  UNION ALL SELECT e.symbol, e.t, {_normal(ahead)} FROM fw JOIN emit e ON e.symbol = fw.symbol AND e.t = fw.t + 1),
bw AS (SELECT symbol, t, [1.0::DOUBLE, 1.0, 1.0] AS w FROM ends
  UNION ALL SELECT e.symbol, e.t - 1, {_normal(back)} FROM bw JOIN emit e ON e.symbol = bw.symbol AND e.t = bw.t WHERE e.t > 0)
SELECT symbol, t, {', '.join(f'{_r(f"p[{i}]", 6)} AS p{i - 1}' for i in _STATES)} FROM (SELECT symbol, t, {share} AS p FROM fw JOIN bw USING (symbol, t))"""


def _best_path() -> str:
    step = lambda j: [f"s[{i}] + ln({_MOVE(i, j)})" for i in _STATES]
    which = lambda x: f"CASE WHEN {x[0]} >= {x[1]} AND {x[0]} >= {x[2]} THEN 1 WHEN {x[1]} >= {x[2]} THEN 2 ELSE 3 END"
    best = ", ".join(f"greatest({', '.join(step(j))}) + ln(b[{j}])" for j in _STATES)
    came = ", ".join(which(step(j)) for j in _STATES)
    return f"""{_CHAIN},
go AS (SELECT symbol, t, [ln(1.0 / 3) + ln(b[1]), ln(1.0 / 3) + ln(b[2]), ln(1.0 / 3) + ln(b[3])] AS s, [0, 0, 0] AS came FROM emit WHERE t = 0
  UNION ALL SELECT e.symbol, e.t, [{best}], [{came}] FROM go JOIN emit e ON e.symbol = go.symbol AND e.t = go.t + 1),
went AS MATERIALIZED (SELECT * FROM go),
trace AS (SELECT symbol, t, {which(['s[1]', 's[2]', 's[3]'])} AS state, came FROM went JOIN ends USING (symbol, t)
  UNION ALL SELECT w.symbol, w.t, trace.came[trace.state], w.came FROM trace JOIN went w ON w.symbol = trace.symbol AND w.t = trace.t - 1)
SELECT symbol, t, CAST(state - 1 AS INTEGER) AS state FROM trace"""


_FAR = "list_sum(list_transform(list_zip(v.z, c.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _kmeans(rounds: int) -> str:
    out = """WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z, label FROM embeddings),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY label) - 1 AS c, z FROM (SELECT label, arg_min(z, vec_id) AS z FROM v GROUP BY label))"""
    for k in range(rounds + 1):
        out += f""",
a{k} AS MATERIALIZED (SELECT * FROM (SELECT v.vec_id, v.z, c.c, {_FAR} AS d FROM v, c{k} c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        if k < rounds:
            out += f""",
c{k + 1} AS MATERIALIZED (SELECT c, list(x ORDER BY k) AS z FROM (SELECT c, k, avg(z[k]) AS x FROM a{k}, range(1, 65) AS q(k) GROUP BY c, k) GROUP BY c)"""
    return f"{out} SELECT vec_id, CAST(c AS INTEGER) AS cluster, {_r('d', 6)} AS distance FROM a{rounds}"


def _channel(entry: int, leave: int, idle: str) -> str:
    w = lambda f, n: f"CASE WHEN i > {n} THEN {f} OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    stays = "CASE WHEN k.silent OR CASE WHEN g.side > 0 THEN k.leave_up ELSE k.leave_down END THEN 0 ELSE g.side END"
    return f"""WITH RECURSIVE raw AS (SELECT event_type AS symbol, time_bucket(INTERVAL 3 HOUR, ts) AS ts, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM raw),
k AS MATERIALIZED (SELECT symbol, ts, close, i, coalesce(ts - lag(ts) OVER o > INTERVAL {idle}, false) AS silent, lag(ts) OVER o AS last_ts, lag(close) OVER o AS last_close,
  coalesce(close > {w('max(high)', entry)}, false) AS up, coalesce(close < {w('min(low)', entry)}, false) AS down,
  coalesce(close < {w('min(low)', leave)}, false) AS leave_up, coalesce(close > {w('max(high)', leave)}, false) AS leave_down FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, i, 0 AS side, 0 AS was, NULL::TIMESTAMP AS opened, NULL::DOUBLE AS price, NULL::TIMESTAMP AS was_opened, NULL::DOUBLE AS was_price, false AS closes FROM k WHERE i = 1
  UNION ALL SELECT symbol, i, CASE WHEN stay <> 0 THEN stay ELSE new END, side, CASE WHEN stay <> 0 THEN opened WHEN new <> 0 THEN ts END, CASE WHEN stay <> 0 THEN price WHEN new <> 0 THEN close END,
    opened, price, side <> 0 AND stay = 0
  FROM (SELECT k.symbol, k.i, k.ts, k.close, g.side, g.opened, g.price, CASE WHEN g.side = 0 THEN 0 ELSE {stays} END AS stay, CASE WHEN k.up THEN 1 WHEN k.down THEN -1 ELSE 0 END AS new
    FROM g JOIN k ON k.symbol = g.symbol AND k.i = g.i + 1))
SELECT symbol, CAST(was AS INTEGER) AS direction, strftime(was_opened, '%Y-%m-%d %H:%M:%S') AS opened, strftime(CASE WHEN silent THEN last_ts + INTERVAL {idle} ELSE ts END, '%Y-%m-%d %H:%M:%S') AS closed,
  was_price AS entry_price, CASE WHEN silent THEN last_close ELSE close END AS exit_price, CASE WHEN silent THEN 'expired' ELSE 'signal' END AS reason
FROM g JOIN k USING (symbol, i) WHERE closes"""


def oracle_sql() -> dict[str, str]:
    pct_value, pct_from = _rank("volume", 500, "rets")
    return {
        "ohlcv_files": f"{_BASE} SELECT symbol, count(*) AS n, min(date) AS first, max(date) AS last, {_r('sum(close)', 4)} AS closes, {_r('sum(volume)', 4)} AS volumes FROM bars WHERE symbol IN ('A', 'R') AND date >= DATE '1995-01-01' GROUP BY symbol",
        "event_sessions": f"""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS events, {_r('sum(value)', 4)} AS total FROM s GROUP BY user_id, k""",
        "channel_trades": _channel(8, 4, "6 HOUR"),
        "sliding_extremes": f"{_BASE} SELECT symbol, t, {_full(f'max(close) OVER {_over(250)}', 250)} AS highest, {_full(f'min(close) OVER {_over(250)}', 250)} AS lowest FROM bars",
        "sliding_percentile": f"{_BASE} SELECT symbol, t, {_r(pct_value)} AS value FROM {pct_from}",
        "asof_join": f"""WITH bars AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS ended, arg_max(value, ts) AS close FROM events GROUP BY 1, 2),
found AS (SELECT event_id, event_type AS symbol, close, epoch_us(ts) - epoch_us(ended) AS age FROM events e ASOF LEFT JOIN bars b ON e.event_type = b.symbol AND e.ts >= b.ended)
SELECT event_id, symbol, CASE WHEN age <= 7200000000 THEN close END AS prior_close, CASE WHEN age <= 7200000000 THEN {_r('age / 1e6', 3)} END AS age FROM found""",
        "interval_join": f"""{_BT}{_PATH} SELECT g AS genome_id, CAST(entry_t AS INTEGER) AS entry_t, CAST(exit_t AS INTEGER) AS exit_t, CAST(state AS INTEGER) AS state, start AS segment_start,
  CAST(greatest(entry_t, start) AS BIGINT) AS first, CAST(least(exit_t, "end") AS BIGINT) AS last, CAST(least(exit_t, "end") - greatest(entry_t, start) + 1 AS BIGINT) AS shared
FROM trades JOIN runs ON entry_t <= "end" AND start <= exit_t""",
        "symbol_regime_shares": _shares(),
        "symbol_regime_path": _best_path(),
        "kmeans_rounds": _kmeans(3),
        "greedy_apart": """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS z, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
near AS MATERIALIZED (SELECT a.k, coalesce(list(b.k) FILTER (b.k < a.k AND list_distance(a.z, b.z) < 0.9), []) AS before FROM v a, v b GROUP BY a.k),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
  UNION ALL SELECT n.k, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, n.k) END FROM walk JOIN near n ON n.k = walk.k + 1),
chosen AS (SELECT unnest(kept) AS k FROM walk WHERE k = (SELECT count(*) FROM v))
SELECT vec_id, k IN (SELECT k FROM chosen) AS kept FROM v""",
    }
