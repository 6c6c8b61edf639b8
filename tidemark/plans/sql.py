"""SQL fragments (common table expressions) that the oracle queries are put together from."""

BARS = """
bars AS (
  SELECT instrument, session, CASE WHEN CAST(regexp_extract(instrument, '([0-9]+)$', 1) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS market,
         arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT p_brand AS instrument, CAST(l_shipdate AS DATE) AS session, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity, l_orderkey * 100 + l_linenumber AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY 1, 2
)"""

W = "PARTITION BY instrument ORDER BY session"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def before(n: int) -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {last(n)} = {n} THEN {agg}({c}) OVER {last(n)} END"


CHANGE = f"""
changed AS (
  SELECT *, coalesce((close / nullif(lag(close) OVER ({W}), 0) - 1) * 100, 0) AS change_pct, lag(close) OVER ({W}) AS prev_close FROM bars
)"""

AVERAGES = f"""
averaged AS (
  SELECT *, ma20 + 2 * std20 AS upper_band, ma20 - 2 * std20 AS lower_band,
         (close - (ma20 - 2 * std20)) / ((ma20 + 2 * std20) - (ma20 - 2 * std20) + 1e-9) AS bb_perc
  FROM (SELECT *, {full('avg', 'close', 5)} AS ma5, {full('avg', 'close', 10)} AS ma10, {full('avg', 'close', 20)} AS ma20, {full('stddev_samp', 'close', 20)} AS std20 FROM changed)
)"""

TRUE_RANGE = """
ranged AS (
  SELECT *, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS tr FROM changed
)"""

WEEK = "CAST(session AS DATE) + CAST((5 - isodow(session) + 7) % 7 AS INT)"

ANY_DROP = f"""
gated AS (
  SELECT *, coalesce(change_pct >= 3.3 AND min(change_pct) OVER {before(7)} <= -3.0
             AND min(CAST(ma5 < ma20 AS INT)) OVER {before(7)} = 1
             AND count(CASE WHEN change_pct IS NOT NULL AND ma5 IS NOT NULL AND ma20 IS NOT NULL THEN 1 END) OVER {before(7)} = 7, false) AS fires,
         row_number() OVER ({W}) AS idx
  FROM averaged
)"""


def rate(x: str, base: str) -> str:
    return f"((({x}) - ({base})) / nullif({base}, 0) * 100)"


def rnd(x: str, n: int = 3) -> str:
    return f"(round({x}, {n}) + 0.0)"


WEEKS = f"""
weeks AS (
  SELECT instrument, wk, arg_max(close, session) AS wclose, row_number() OVER (PARTITION BY instrument ORDER BY wk) AS wn
  FROM (SELECT *, {WEEK} AS wk FROM bars) GROUP BY instrument, wk
),
weekly_changes AS (
  SELECT b.instrument, b.session, round((b.close / nullif(p1.wclose, 0) - 1) * 100, 3) AS pct_vs_lastweek,
         round((b.close / nullif(p4.wclose, 0) - 1) * 100, 3) AS pct_vs_last4week,
         (b.close / nullif(p1.wclose, 0) - 1) < -0.01 AS is_drop_more_than_minus1pct
  FROM (SELECT *, {WEEK} AS wk FROM bars) b
  JOIN weeks w0 ON b.instrument = w0.instrument AND b.wk = w0.wk
  LEFT JOIN weeks p1 ON p1.instrument = b.instrument AND p1.wn = w0.wn - 1
  LEFT JOIN weeks p4 ON p4.instrument = b.instrument AND p4.wn = w0.wn - 4
)"""

_FEATURES = {
    "vol5": full("stddev_samp", "change_pct", 5),
    "vol15": full("stddev_samp", "change_pct", 15),
    "max_drop_7d": f"min(change_pct) OVER {before(7)}",
    "rebound_from_7d_low": f"(close / nullif(min(low) OVER {before(7)}, 0) - 1) * 100",
    "dist_to_ma5": rate("close", "ma5"),
    "dist_to_ma20": rate("close", "ma20"),
    "ma5_chg_rate": rate("ma5", f"lag(ma5) OVER ({W})"),
    "tr_value_ratio_5d": f"CASE WHEN avg(value) OVER {before(5)} > 0 THEN value / (avg(value) OVER {before(5)} + 1e-9) WHEN avg(value) OVER {before(5)} IS NOT NULL THEN 0.0 END",
    "today_tr_val_eok": "value / 1e8",
    "gap_pct": f"(open / nullif(lag(close) OVER ({W}), 0) - 1) * 100",
    "intraday_return": "(close / nullif(open, 0) - 1) * 100",
    "upper_wick_ratio": "(high - greatest(open, close)) / (high - low + 1e-9)",
    "lower_wick_ratio": "(least(open, close) - low) / (high - low + 1e-9)",
    "body_ratio": "abs(close - open) / (high - low + 1e-9)",
    "room_to_20d_high": f"(max(high) OVER {last(20)} / nullif(close, 0) - 1) * 100",
    "room_to_60d_high": f"(max(high) OVER {last(60)} / nullif(close, 0) - 1) * 100",
}
_RATE = lambda c, k: f"((lead({c}, {k}) OVER ({W}) - close) / nullif(close, 0) * 100)"
_FIRST = lambda c, op, level: "CASE " + " ".join(f"WHEN {c}{k} {op} {level} THEN {k}" for k in range(1, 8)) + " ELSE 0 END"


def labels(targets: tuple[int, int, int], stop: float = -6.0) -> str:
    low, mid, high = targets
    flags = []
    for t in (mid, high):
        won = f"(day_to_{t} > 0 AND (stop_day = 0 OR day_to_{t} < stop_day))"
        flags += [
            f"{won} AS target_before_stop_{t}", f"(stop_day > 0 AND (day_to_{t} = 0 OR stop_day < day_to_{t})) AS stop_before_target_{t}",
            f"(day_to_{t} > 0 AND day_to_{t} = stop_day) AS target_stop_same_day_{t}", f"(day_to_{t} = 0 AND stop_day = 0) AS no_target_no_stop_{t}",
            f"({won} AND day_to_{t} <= 4) AS fast_success_{t}", f"({won} AND day_to_{t} > 4) AS slow_success_{t}", f"NOT {won} AS fail_success_{t}",
        ]
    best = "greatest(" + ", ".join(f"h{k}" for k in range(1, 8)) + ")"
    return f"""
rated AS (
  SELECT *, {', '.join(f"{_RATE(c, k)} AS {c[0]}{k}" for c in ('high', 'low', 'close') for k in range(1, 8))},
         count(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS ahead
  FROM gated
),
touched AS (
  SELECT *, {', '.join(f"{_FIRST('h', '>=', t)} AS day_to_{t}" for t in targets)}, {_FIRST('l', '<=', stop)} AS stop_day, {best} AS best FROM rated
),
labelled AS (
  SELECT *, {', '.join(flags)},
         CASE WHEN best < {low} THEN 0 WHEN best < {mid} THEN 1 WHEN best < {high} THEN 2 WHEN best IS NOT NULL THEN 3 END AS target_class,
         {rnd('best')} AS validation_high_rate_max, {rnd('least(' + ', '.join(f'l{k}' for k in range(1, 8)) + ')')} AS validation_low_rate_min, {rnd('c7')} AS validation_close_rate7,
         strftime(session, '%Y-%m') AS month, session AS today
  FROM touched
)"""


SIGNALS = (
    ",".join([BARS, CHANGE, AVERAGES, ANY_DROP, labels((5, 10, 15)), WEEKS])
    + f""",
raw AS (
  SELECT instrument, session, {', '.join(f'{e} AS {c}' for c, e in _FEATURES.items())}
  FROM (SELECT *, round(close * volume, 2) AS value FROM averaged)
),
featured AS (
  SELECT instrument, session, {', '.join(f'{rnd(c)} AS {c}' for c in _FEATURES)},
         {rnd('round(vol5 / (vol15 + 1e-9), 3)')} AS vol_ratio_5_15, {rnd('rebound_from_7d_low / (abs(max_drop_7d) + 1e-9)')} AS rebound_vs_prior_drop
  FROM raw
),
signals AS (
  SELECT l.*, {', '.join(f'f.{c}' for c in [*_FEATURES, 'vol_ratio_5_15', 'rebound_vs_prior_drop'])}, w.pct_vs_lastweek, {rnd('l.bb_perc')} AS bb,
         CASE WHEN no_target_no_stop_10 THEN least(greatest(coalesce(validation_close_rate7, 0), -6.0), 10.0) WHEN target_stop_same_day_10 THEN -6.0
              WHEN stop_before_target_10 THEN -6.0 WHEN target_before_stop_10 THEN 10.0 ELSE 0 END AS ret
  FROM labelled l JOIN featured f USING (instrument, session) JOIN weekly_changes w USING (instrument, session)
  WHERE l.fires AND l.idx >= 70 AND l.ahead = 7
)"""
)
FEATURE_NAMES = [*_FEATURES, "vol_ratio_5_15", "rebound_vs_prior_drop"]


def wilson(p: str, n: str, z: float = 1.96) -> str:
    q, m = f"(({p}) * 1.0 / nullif({n}, 0))", f"nullif({n}, 0)"
    return f"(({q} + {z * z} / (2 * {m}) - {z} * sqrt(({q} * (1 - {q}) + {z * z} / (4 * {m})) / {m})) / (1 + {z * z} / {m}))"


def fold(series: str, alpha: float) -> str:
    """Exponential smoothing of a column that has no nulls after its first value."""
    return f"list_reduce(list({series}) FILTER (WHERE {series} IS NOT NULL) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: a * {1 - alpha!r} + x * {alpha!r})"


def gap_fold(series: str, alpha: float) -> str:
    """Exponential smoothing that carries the level over nulls, after which the next value weighs more."""
    step = f"""CASE WHEN x.v IS NULL THEN {{'v': a.v, 'w': a.w * {1 - alpha!r}::DOUBLE}} WHEN a.v IS NULL THEN {{'v': x.v, 'w': 1.0::DOUBLE}}
      ELSE {{'v': (a.w * {1 - alpha!r}::DOUBLE * a.v + {alpha!r}::DOUBLE * x.v) / (a.w * {1 - alpha!r}::DOUBLE + {alpha!r}::DOUBLE), 'w': 1.0::DOUBLE}} END"""
    return f"(list_reduce(list({{'v': ({series})::DOUBLE, 'w': 1.0::DOUBLE}}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: {step})).v"
