"""The same questions in SQL, written independently of the operators (step-by-step
recursion instead of running sums, self-joins instead of arrays)."""

from __future__ import annotations


def nudge(digits: int) -> float:
    """Offset added before rounding, so that a value on a decimal midpoint rounds the same
    way whatever its last bits are."""
    return float(f"3.7e-{digits + 2}")


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr} + {nudge(digits)!r}, {digits}) + 0.0 AS {name or expr}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names.split())


def bars_cte(by_brand: bool = False, days: str = "true", name: str = "bars") -> str:
    ticker = "p_brand" if by_brand else "l_returnflag || l_linestatus"
    join = "JOIN part ON l_partkey = p_partkey" if by_brand else ""
    return f"""
trades AS (SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity,
  100 * (1 - l_discount) * (1 + l_tax) AS price,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
  FROM lineitem {join}),
daily AS (SELECT ticker, date, arg_min(price, place) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, place) AS close, sum(quantity) AS volume FROM trades WHERE {days} GROUP BY ticker, date),
idx AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 10000 AS vix_close FROM orders GROUP BY 1),
{name} AS MATERIALIZED (SELECT d.*, vix_close, row_number() OVER w AS rn,
  last_value(vix_close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix_filled
  FROM daily d LEFT JOIN idx USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} = {n} THEN {fn}({col}) OVER {frame(n)} END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER (PARTITION BY ticker ORDER BY rn)"


ROLLING = f"""
r1 AS (SELECT *, (high + low + close) / 3 AS hlc3, {lag('close')} AS prev, ln(close / {lag('close')}) AS log_returns FROM bars),
r2 AS MATERIALIZED (SELECT *,
  {roll('stddev_samp', 'close', 20)} AS volatility_20, {roll('stddev_samp', 'close', 5)} AS volatility_5,
  {roll('avg', 'volume', 20)} AS volume_ma_20, {roll('avg', 'close', 20)} AS sma20, {roll('avg', 'close', 50)} AS sma50,
  {roll('avg', 'close', 100)} AS sma_100, {roll('avg', 'close', 200)} AS ma_200,
  {roll('max', 'high', 252)} AS high_52w, {roll('min', 'low', 252)} AS low_52w,
  {roll('stddev_pop', 'close', 20)} AS std20, {roll('min', 'low', 14)} AS low14, {roll('max', 'high', 14)} AS high14,
  100 * (close / {lag('close', 10)} - 1) AS roc_10, 100 * (close / {lag('close', 20)} - 1) AS roc_20,
  100 * (volume / {lag('volume', 10)} - 1) AS volume_roc_10, close / {lag('close', 10)} - 1 AS price_momentum_10d,
  vix_filled / {lag('vix_filled')} - 1 AS vix_change,
  CASE WHEN hlc3 > {lag('hlc3')} THEN hlc3 * volume ELSE 0 END AS flow_in,
  CASE WHEN hlc3 < {lag('hlc3')} THEN hlc3 * volume ELSE 0 END AS flow_out,
  (high - low) / close AS high_low_ratio, (close - open) / open AS close_open_ratio, close / vix_close AS close_vix_ratio,
  CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(prev - low)) END AS true_range
  FROM r1),
r3 AS (SELECT *, volume / nullif(volume_ma_20, 0) AS volume_ratio, volume / (volume_ma_20 + 1e-8) AS volume_ma_ratio,
  close / sma20 AS price_to_sma20, close / sma50 AS price_to_sma50, close / high_52w AS price_to_52w_high,
  close / low_52w AS price_to_52w_low, (close - ma_200) / close AS distance_to_ma200,
  (volatility_20 - {roll('avg', 'volatility_20', 252)}) / ({roll('stddev_samp', 'volatility_20', 252)} + 1e-8) AS rolling_volatility_zscore,
  sma20 AS bb_mid, sma20 - 2 * std20 AS bb_lower, sma20 + 2 * std20 AS bb_upper,
  CASE WHEN high14 = low14 THEN 0 ELSE 100 * (close - low14) / nullif(high14 - low14, 0) END AS stoch,
  {roll('sum', 'flow_in', 14)} AS in14, {roll('sum', 'flow_out', 14)} AS out14 FROM r2),
r4 AS (SELECT *, 100 * (bb_upper - bb_lower) / bb_mid AS bb_width, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_percent,
  {roll('avg', 'stoch', 3)} AS stoch_k, 100 * in14 / nullif(in14 + out14, 0) AS mfi,
  CAST(2 * CASE WHEN rolling_volatility_zscore > 1 THEN 1 WHEN rolling_volatility_zscore < -1 THEN -1 ELSE 0 END
    + CASE WHEN distance_to_ma200 >= 0 THEN 1 ELSE -1 END AS INTEGER) AS regime_state FROM r3),
rolling AS MATERIALIZED (SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d,
  CAST(coalesce(regime_state <> {lag('regime_state')}, true) AS INTEGER) AS regime_change FROM r4)"""

MAXFRAME = "OVER (PARTITION BY ticker ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)"

# One row at a time: each step takes the state of the row before.
STATES = f"""
s0 AS (SELECT ticker, date, rn, close, high, low, {lag('close')} AS prev, {lag('high')} AS ph, {lag('low')} AS pl,
  avg(close) OVER {frame(12)} AS m12, avg(close) OVER {frame(26)} AS m26, avg(close) OVER {frame(20)} AS m20,
  avg(close) OVER {frame(50)} AS m50 FROM bars),
s1 AS (SELECT *, ln(close / prev) AS lr, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(prev - low)) END AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn FROM s0),
s2 AS MATERIALIZED (SELECT *, {lag('lr')} AS plr, avg(tr) OVER {frame(20)} AS mtr,
  CASE WHEN count(CASE WHEN rn BETWEEN 2 AND 21 THEN lr END) {MAXFRAME} = 20
    THEN stddev_pop(CASE WHEN rn BETWEEN 2 AND 21 THEN lr END) {MAXFRAME} END AS early FROM s1),
st AS (
  SELECT ticker, rn, CAST(0 AS DOUBLE) AS e12, CAST(0 AS DOUBLE) AS e26, CAST(0 AS DOUBLE) AS e20, CAST(0 AS DOUBLE) AS e50,
    CAST(0 AS DOUBLE) AS etr, CAST(0 AS DOUBLE) AS w14, CAST(0 AS DOUBLE) AS w21, CAST(0 AS DOUBLE) AS g14, CAST(0 AS DOUBLE) AS l14,
    CAST(0 AS DOUBLE) AS g21, CAST(0 AS DOUBLE) AS l21, CAST(0 AS DOUBLE) AS atr_s, CAST(0 AS DOUBLE) AS du, CAST(0 AS DOUBLE) AS dd, CAST(0 AS DOUBLE) AS gv
  FROM s2 WHERE rn = 1
  UNION ALL
  SELECT b.ticker, b.rn,
    CASE WHEN b.rn < 12 THEN 0 WHEN b.rn = 12 THEN m12 ELSE e12 + (close - e12) * 2 / 13 END,
    CASE WHEN b.rn < 26 THEN 0 WHEN b.rn = 26 THEN m26 ELSE e26 + (close - e26) * 2 / 27 END,
    CASE WHEN b.rn < 20 THEN 0 WHEN b.rn = 20 THEN m20 ELSE e20 + (close - e20) * 2 / 21 END,
    CASE WHEN b.rn < 50 THEN 0 WHEN b.rn = 50 THEN m50 ELSE e50 + (close - e50) * 2 / 51 END,
    CASE WHEN b.rn < 20 THEN 0 WHEN b.rn = 20 THEN mtr ELSE etr + (tr - etr) * 2 / 21 END,
    w14 * 13 / 14 + 1, w21 * 20 / 21 + 1,
    g14 * 13 / 14 + greatest(close - prev, 0), l14 * 13 / 14 + greatest(prev - close, 0),
    g21 * 20 / 21 + greatest(close - prev, 0), l21 * 20 / 21 + greatest(prev - close, 0),
    atr_s * 13 / 14 + tr, du * 13 / 14 + up, dd * 13 / 14 + dn,
    CASE WHEN b.rn > 21 THEN 0.1 * plr * plr + 0.85 * gv ELSE 0 END
  FROM st JOIN s2 b ON b.ticker = st.ticker AND b.rn = st.rn + 1),
s3 AS MATERIALIZED (SELECT b.ticker, b.date, b.rn, b.close, CASE WHEN b.rn >= 15 THEN 100 * g14 / nullif(g14 + l14, 0) END AS rsi_14,
  CASE WHEN b.rn >= 22 THEN 100 * g21 / nullif(g21 + l21, 0) END AS rsi_21, CASE WHEN b.rn >= 15 THEN atr_s / w14 END AS atr,
  CASE WHEN b.rn >= 15 THEN 100 * (du / w14) / nullif(atr_s / w14, 0) END AS "DMP_14",
  CASE WHEN b.rn >= 15 THEN 100 * (dd / w14) / nullif(atr_s / w14, 0) END AS "DMN_14",
  CASE WHEN b.rn >= 20 THEN e20 END AS ema_short, CASE WHEN b.rn >= 50 THEN e50 END AS ema_long,
  CASE WHEN b.rn >= 26 THEN e12 - e26 END AS macd, CASE WHEN b.rn >= 20 THEN e20 - 2 * etr END AS kc_lower,
  CASE WHEN b.rn >= 20 THEN e20 + 2 * etr END AS kc_upper,
  CASE WHEN b.rn > 21 THEN sqrt(gv) WHEN b.rn >= 2 THEN early END AS garch_volatility
  FROM s2 b JOIN st USING (ticker, rn)),
s4 AS MATERIALIZED (SELECT *, 100 * abs("DMP_14" - "DMN_14") / nullif("DMP_14" + "DMN_14", 0) AS dx, avg(macd) OVER {frame(9)} AS mmacd FROM s3),
st2 AS (
  SELECT ticker, rn, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS ax, CAST(0 AS DOUBLE) AS sg FROM s4 WHERE rn = 1
  UNION ALL
  SELECT b.ticker, b.rn, w * 13 / 14 + CASE WHEN dx IS NULL THEN 0 ELSE 1 END, ax * 13 / 14 + coalesce(dx, 0),
    CASE WHEN b.rn < 34 THEN 0 WHEN b.rn = 34 THEN mmacd ELSE sg + (macd - sg) * 2 / 10 END
  FROM st2 JOIN s4 b ON b.ticker = st2.ticker AND b.rn = st2.rn + 1),
states AS MATERIALIZED (SELECT b.*, CASE WHEN b.rn >= 28 THEN ax / nullif(w, 0) END AS "ADX_14", CASE WHEN b.rn >= 34 THEN sg END AS macds,
  CASE WHEN b.rn >= 34 THEN macd - sg END AS macdh FROM s4 b JOIN st2 USING (ticker, rn))"""


def barrier_cte(source: str = "rolling", vol: str = "volatility_20") -> str:
    return f"""
v0 AS (SELECT *, coalesce(last_value({vol} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY rn ROWS UNBOUNDED PRECEDING),
  first_value({vol} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS vol,
  count(*) OVER (PARTITION BY ticker) AS total FROM {source}),
v1 AS (SELECT *, close + 2.0 * vol AS barrier_up, close - 1.5 * vol AS barrier_down FROM v0),
v2 AS (SELECT a.ticker, a.rn, min(CASE WHEN b.high >= a.barrier_up THEN b.rn END) AS fu, min(CASE WHEN b.low <= a.barrier_down THEN b.rn END) AS fd
  FROM v1 a JOIN bars b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn + 1 AND a.rn + 20 GROUP BY a.ticker, a.rn),
barriers AS MATERIALIZED (SELECT v1.*, CASE WHEN v1.rn > total - 20 OR (fu IS NULL AND fd IS NULL) THEN NULL
  WHEN fd IS NULL OR fu < fd THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM v1 LEFT JOIN v2 USING (ticker, rn))"""


LABELLED = """
labelled AS MATERIALIZED (SELECT ticker, date, rn AS bar_rn, row_number() OVER (PARTITION BY ticker ORDER BY rn) AS rn, close, target,
  volatility_20, price_to_sma20, distance_to_ma200, ma_200, rolling_volatility_zscore, atr, count(*) OVER (PARTITION BY ticker) AS total
  FROM barriers JOIN (SELECT ticker, rn, atr FROM states) USING (ticker, rn) WHERE volatility_20 IS NOT NULL AND price_to_sma20 IS NOT NULL AND distance_to_ma200 IS NOT NULL AND target IS NOT NULL)"""

FOLDS = """
ranges AS (SELECT ticker, CAST(i + 1 AS INTEGER) AS fold, i * 120 AS train_lo, i * 120 + 400 AS train_hi, i * 120 + 400 AS test_lo,
  least(total, i * 120 + 520) AS test_hi FROM (SELECT ticker, total, unnest(range(total // 120 + 1)) AS i FROM (SELECT DISTINCT ticker, total FROM labelled))
  WHERE least(total, i * 120 + 520) - (i * 120 + 400) >= 60),
members AS MATERIALIZED (SELECT l.*, fold, CASE WHEN l.rn - 1 < train_hi THEN 'train' ELSE 'val' END AS role
  FROM labelled l JOIN ranges g ON l.ticker = g.ticker AND l.rn - 1 >= train_lo AND l.rn - 1 < test_hi)"""

PURGED = """
ranges AS (SELECT ticker, CAST(i AS INTEGER) AS fold, 0 AS train_lo, i * 120 + 232 AS train_hi, i * 120 + 252 AS test_lo,
  least(total, i * 120 + 372) AS test_hi FROM (SELECT ticker, total, unnest(range(total // 120 + 1)) AS i FROM (SELECT DISTINCT ticker, total FROM labelled))
  WHERE least(total, i * 120 + 372) > i * 120 + 252 AND i * 120 + 232 >= 252),
members AS MATERIALIZED (SELECT l.*, fold, CASE WHEN l.rn - 1 < train_hi THEN 'train' ELSE 'val' END AS role
  FROM labelled l JOIN ranges g ON l.ticker = g.ticker
  WHERE (l.rn - 1 < train_hi - 20) OR (l.rn - 1 >= test_lo AND l.rn - 1 < test_hi))"""

TRAIN = "CASE WHEN role = 'train' THEN {} END"
SCORES = """
fits AS (SELECT ticker, fold, quantile_cont(CASE WHEN role = 'train' THEN price_to_sma20 END, [0.25, 0.5, 0.75]) AS qs,
  quantile_cont(CASE WHEN role = 'train' THEN distance_to_ma200 END, [0.25, 0.5, 0.75]) AS qd,
  avg(CASE WHEN role = 'train' THEN volatility_20 END) AS tvm, stddev_pop(CASE WHEN role = 'train' THEN volatility_20 END) AS tvs,
  count(*) FILTER (role = 'train') AS n_train FROM members GROUP BY ticker, fold
  HAVING count(*) FILTER (role = 'train') >= 252 AND count(*) FILTER (role = 'val') >= 60 AND count(DISTINCT CASE WHEN role = 'val' THEN target END) = 2),
scaled AS MATERIALIZED (SELECT m.*, (price_to_sma20 - qs[2]) / (qs[3] - qs[1]) AS s1, (distance_to_ma200 - qd[2]) / (qd[3] - qd[1]) AS s2,
  tvm, tvs, n_train FROM members m JOIN fits USING (ticker, fold)),
preds AS MATERIALIZED (SELECT *, coalesce(lead(close) OVER (PARTITION BY ticker, fold ORDER BY rn) / close - 1, 0) AS ret,
  round(1 / (1 + exp(-(0.6 * s2 - 1.0 * s1))), 6) AS p_raw FROM scaled WHERE role = 'val')"""


def signals_cte(source: str = "preds", extra: str = "", th_min: str = "0.60", th_max: str = "0.64", floor: str = "0.09",
                coverage: str = "0.16", percent: str = "0.70", digits: int | None = None) -> str:
    """Threshold search to sized positions; ``extra`` adds key columns such as ``candidate_id, ``."""
    k = f"{extra}ticker, fold"
    p = "least(greatest(p_raw / least(greatest(1 + (volatility_20 - avg(volatility_20) OVER g) / (stddev_pop(volatility_20) OVER g + 1e-8), 0.5), 2.5), 0), 1)"
    p = p if digits is None else f"round({p}, {digits})"
    return f"""
adj AS MATERIALIZED (SELECT *, {p} AS p
  FROM {source} WINDOW g AS (PARTITION BY {k})),
cand AS (SELECT {k}, unnest(list_distinct(quantile_cont(p, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]))) AS th FROM adj GROUP BY {k}),
pos AS (SELECT a.*, th, CASE WHEN p >= th THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ps FROM adj a JOIN cand USING ({k.replace('fold', 'fold')})),
turn AS (SELECT *, abs(ps - coalesce(lag(ps) OVER (PARTITION BY {k}, th ORDER BY rn), 0)) AS tn FROM pos),
tried AS (SELECT {k}, th, count(*) AS n, sum(ps) AS trades, avg(ret * ps - tn * 0.0025) AS m, stddev_pop(ret * ps - tn * 0.0025) AS sd, sum(tn) AS turnover,
  count(*) FILTER (ps > 0 AND ret * ps - tn * 0.0025 > 0) AS wins, avg(CASE WHEN ps > 0 THEN ret * ps - tn * 0.0025 END) AS avg_return,
  any_value({floor}) AS fl, any_value({coverage}) AS cv FROM turn GROUP BY {k}, th),
scored AS (SELECT *, trades / n AS trade_ratio, CASE WHEN trades > 0 AND sd > 0 THEN m / sd * sqrt(252) ELSE 0 END AS sharpe, abs(trades / n - cv) AS coverage_penalty FROM tried),
obj AS (SELECT *, sharpe - 0.15 * turnover - 1.2 * coverage_penalty AS objective_score FROM scored
  WHERE trades >= greatest(floor(n * 0.08), 10) AND trade_ratio >= fl AND trade_ratio <= 0.22),
best AS (SELECT * FROM obj QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY round(objective_score, 12) DESC, th) = 1),
regime AS (SELECT {k}, avg((volatility_20 - tvm) / (tvs + 1e-8)) AS vol_z, avg(CASE WHEN distance_to_ma200 < -0.02 THEN 1.0 ELSE 0.0 END) AS bear_ratio,
  any_value({th_min}) AS th_min, any_value({th_max}) AS th_max FROM adj GROUP BY {k}),
adaptive AS (SELECT g.*, coalesce(b.th, 0.65) AS threshold_buy, b.sharpe, b.objective_score, b.trades, b.trade_ratio, b.turnover, b.wins, b.avg_return, b.coverage_penalty,
  least(greatest(coalesce(b.th, 0.65) + tanh(least(greatest(vol_z, -2.5), 2.5) / 1.5) * 0.04, 0.50), 0.85) AS adaptive_buy,
  least(greatest(0.35 - tanh(least(greatest(vol_z, -2.5), 2.5) / 1.5) * 0.04, 0.15), 0.45) AS adaptive_sell
  FROM regime g LEFT JOIN best b USING ({k})),
smooth AS (SELECT *, 0.35 * adaptive_buy + 0.65 * 0.65 AS smooth_buy FROM adaptive WHERE fold = 1
  UNION ALL SELECT a.*, 0.35 * a.adaptive_buy + 0.65 * s.smooth_buy FROM smooth s JOIN adaptive a
  ON {' AND '.join(f'a.{c.strip()} = s.{c.strip()}' for c in (extra + 'ticker').split(','))} AND a.fold = s.fold + 1),
thresholds AS MATERIALIZED (SELECT *, 0.35 * adaptive_sell + 0.65 * 0.35 AS smooth_sell, least(greatest(smooth_buy, th_min), th_max) AS final_buy FROM smooth),
j0 AS (SELECT a.*, t.vol_z, t.bear_ratio, t.final_buy AS t0, greatest(t.th_min, t.final_buy - 0.02) AS t1,
  greatest(t.th_min, greatest(t.th_min, t.final_buy - 0.02) - 0.01) AS t2, greatest({floor}, 0.08) AS ratio_floor,
  t.trades AS at_trades, t.trade_ratio AS at_ratio FROM adj a JOIN thresholds t USING ({k})),
tech AS (SELECT {k}, quantile_cont(volatility_20, 0.1) AS v10, quantile_cont(atr, 0.1) AS a10,
  {', '.join(f"quantile_cont(CASE WHEN p >= t{i} THEN p END, [0.70, 0.72, 0.74]) AS c{i}" for i in range(3))} FROM j0 GROUP BY {k}),
j1 AS (SELECT j0.*, volatility_20 >= v10 AND atr >= a10 AND distance_to_ma200 > -0.02 AS sound,
  {', '.join(f"p >= t{i} AS h{i}, coalesce(p >= c{i}[CASE {percent} WHEN 0.70 THEN 1 WHEN 0.72 THEN 2 ELSE 3 END], false) AS q{i}" for i in range(3))} FROM j0 JOIN tech USING ({k})),
j2 AS (SELECT *, avg(CASE WHEN h0 AND q0 AND sound THEN 1.0 ELSE 0.0 END) OVER g AS r0, avg(CASE WHEN h1 AND q1 AND sound THEN 1.0 ELSE 0.0 END) OVER g AS r1,
  count(*) OVER g AS n_val FROM j1 WINDOW g AS (PARTITION BY {k})),
j3 AS (SELECT *, CASE WHEN r0 < ratio_floor AND t1 < t0 THEN CASE WHEN r1 < ratio_floor AND t2 < t1 THEN 2 ELSE 1 END ELSE 0 END AS relaxed FROM j2),
j4 AS (SELECT *, CASE relaxed WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END AS hi, CASE relaxed WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END AS qi,
  CASE relaxed WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END AS used_buy, vol_z >= 1.8 AND bear_ratio >= 0.6 AS gated FROM j3),
j5 AS (SELECT *, CASE WHEN NOT hi THEN 'threshold' WHEN NOT qi THEN 'percentile' WHEN NOT sound THEN 'technical' END AS rejected,
  hi AND qi AND sound AND gated AS gate_cut, hi AND qi AND sound AND NOT gated AS sg FROM j4),
j6 AS (SELECT *, sg AND row_number() OVER (PARTITION BY {k}, sg ORDER BY p DESC, rn DESC) > greatest(1, floor(n_val * 0.22)) AS cap_cut FROM j5),
j7 AS (SELECT *, CASE WHEN sg AND NOT cap_cut THEN 1 ELSE 0 END AS signal FROM j6),
sized AS MATERIALIZED (SELECT *, CASE WHEN signal = 1 AND abs(p - 0.5) >= 0.12 AND p >= 0.62
  THEN least(greatest((p - used_buy) / (1 - used_buy + 1e-9), 0), 1) * least(greatest(1 - 0.35 * 1.25 * greatest(0, vol_z) / 2, 0.25), 1) ELSE 0 END AS size,
  signal = 1 AND abs(p - 0.5) < 0.12 AS unc, signal = 1 AND p < 0.62 AS low FROM j7)"""


def results_cte(extra: str = "") -> str:
    k = f"{extra}ticker, fold"
    return f"""
c1 AS (SELECT *, abs(size - coalesce(lag(size) OVER (PARTITION BY {k} ORDER BY rn), 0)) AS tn, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred,
  stddev_pop(ret) OVER (PARTITION BY {k}) AS unit FROM sized),
c2 AS (SELECT *, ret * size AS gross, ret * size - tn * 0.0025 AS net, product(1 + ret * size) OVER (PARTITION BY {k} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS val,
  p * least(greatest(unit * 2.5, 0), 0.25) - (1 - p) * least(greatest(unit * 1.25, 0), 0.25) - 0.0025 AS ev FROM c1),
costs AS MATERIALIZED (SELECT *, val / max(val) OVER (PARTITION BY {k} ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c2),
au AS (SELECT {k}, (sum(CASE WHEN target = 1 THEN rk END) - sum(target) * (sum(target) + 1) / 2) / nullif(sum(target) * sum(1 - target), 0) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY {k} ORDER BY p) + (count(*) OVER (PARTITION BY {k}, p) - 1) / 2.0 AS rk FROM costs) GROUP BY {k}),
ap AS (SELECT {k}, avg(pr) FILTER (target = 1) AS aucpr FROM (
  SELECT *, sum(target) OVER w / count(*) OVER w AS pr FROM costs WINDOW w AS (PARTITION BY {k} ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) GROUP BY {k}),
res0 AS (SELECT {k}, count(*) AS n_val, any_value(n_train) AS n_train, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(CASE WHEN signal = target THEN 1.0 ELSE 0.0 END) AS accuracy_thresholded,
  CASE WHEN sum(pred) >= 3 AND stddev_pop(ret * pred) >= 1e-10 THEN (avg(ret * pred) - 0.02 / 252) / stddev_pop(ret * pred) * sqrt(252) END AS sharpe,
  CASE WHEN count(*) FILTER (size > 0) >= 3 AND stddev_pop(gross) >= 1e-10 THEN (avg(gross) - 0.02 / 252) / stddev_pop(gross) * sqrt(252) END AS sharpe_thresholded,
  CASE WHEN count(*) FILTER (size > 0) >= 3 THEN least(min(dd), 0) END AS max_drawdown,
  count(*) FILTER (signal = 1 AND target = 1) / (count(*) FILTER (signal = 1) + 1e-6) AS precision,
  count(*) FILTER (signal = 1 AND target = 1) / (count(*) FILTER (target = 1) + 1e-6) AS recall,
  any_value(used_buy) AS threshold_buy, sum(gross) AS fold_total_return, sum(net) AS net_return,
  CASE WHEN stddev_pop(net) >= 1e-10 THEN (avg(net) - 0.02 / 252) / stddev_pop(net) * sqrt(252) END AS net_sharpe, sum(tn) AS turnover,
  coalesce(count(*) FILTER (net > 0) / nullif(count(*) FILTER (size > 0), 0), 0) AS fold_win_rate,
  count(*) FILTER (gross > 0) AS winning_days, count(*) FILTER (size > 0 AND target = 1) AS wins, count(*) FILTER (size > 0 AND target = 0) AS losses,
  count(*) FILTER (signal = 0 AND target = 0) AS avoided_losses, count(*) FILTER (size > 0) AS fold_trades,
  avg(CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END) AS trade_coverage,
  CASE WHEN count(*) FILTER (size > 0) > 0 THEN avg(CASE WHEN signal = 1 THEN ev END) ELSE avg(ev) END AS ev_mean_fold,
  count(*) FILTER (rejected = 'threshold') AS threshold_rejected, count(*) FILTER (rejected = 'percentile') AS percentile_rejected,
  count(*) FILTER (rejected = 'technical') AS technical_rejected, count(*) FILTER (p >= used_buy) AS raw_buy_candidates,
  count(*) FILTER (gate_cut) + count(*) FILTER (cap_cut) AS regime_gate_rejected, count(*) FILTER (unc) + count(*) FILTER (low) AS confidence_rejected,
  count(*) FILTER (signal = 1) AS post_filters_buy_signals, any_value(relaxed) AS threshold_relaxed,
  coalesce(any_value(at_trades)::BIGINT, count(*) FILTER (size > 0)) AS n_trades_at_threshold,
  coalesce(any_value(at_ratio), avg(CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END)) AS trade_ratio_at_threshold
  FROM costs GROUP BY {k}),
results AS MATERIALIZED (SELECT *, 2 * precision * recall / (precision + recall + 1e-6) AS f1, CASE WHEN fold_trades < 3 THEN 'insufficient_trades' END AS reason
  FROM res0 JOIN au USING ({k}) JOIN ap USING ({k}))"""


def cross_cte(extra: str = "") -> str:
    k = f"{extra}ticker"
    averages = {
        "accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1", "auc": "auc", "aucpr": "auc_pr",
        "sharpe_thresholded": "sharpe_thresholded_mean", "threshold_buy": "threshold_buy_mean", "sharpe": "sharpe_ratio",
        "net_sharpe": "net_sharpe", "max_drawdown": "max_drawdown", "trade_coverage": "trade_coverage", "ev_mean_fold": "ev_mean_fold",
    }
    spreads = {"accuracy": "accuracy_std", "auc": "auc_std", "aucpr": "auc_pr_std", "sharpe_thresholded": "sharpe_thresholded_std"}
    parts = [f"avg({c}) AS {n}" for c, n in averages.items()] + [f"stddev_samp({c}) AS {n}" for c, n in spreads.items()]
    return f"""
configured AS (SELECT {k}, count(*) AS n_folds_configured FROM results GROUP BY {k}),
runs AS MATERIALIZED (SELECT {k}, count(fold) AS n_folds_valid, any_value(n_folds_configured) AS n_folds_configured,
  any_value(n_folds_configured) - count(fold) AS n_folds_skipped, count(fold) / any_value(n_folds_configured) AS coverage_ratio, {', '.join(parts)},
  sum(fold_total_return) AS total_return, sum(net_return) AS net_return, sum(turnover) AS turnover,
  sum(raw_buy_candidates)::BIGINT AS n_long_signals_raw, sum(fold_trades)::BIGINT AS n_long_signals_post_filters, sum(n_val)::BIGINT AS test_size,
  min(fold_trades) AS min_fold_trades, median(fold_trades) AS median_fold_trades, min(auc) AS worst_fold_auc, min(aucpr) AS worst_fold_aucpr,
  max(n_train) AS train_size, coalesce(sum(winning_days) / nullif(sum(fold_trades), 0), 0) AS win_rate
  FROM configured LEFT JOIN (SELECT * FROM results WHERE reason IS NULL) USING ({k}) GROUP BY {k}{' HAVING count(fold) > 0' if extra else ''})"""


def sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select
