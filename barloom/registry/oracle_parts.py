"""Building blocks of the DuckDB oracles: sequential definitions as recursive CTEs."""

from __future__ import annotations

from barloom.registry.fixtures import with_sql  # noqa: F401  (re-exported)


def r6(expr: str) -> str:
    return f"CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END"


def dbl(value: float) -> str:
    return f"({value!r}::DOUBLE)"


def numbered(tf: str, source: str | None = None) -> dict:
    return {
        f"bars_{tf}": None,
        "b": f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn,
         count(*) OVER (PARTITION BY symbol) AS n_bars,
         last(close ORDER BY ts) OVER (PARTITION BY symbol) AS last_close FROM {source or f'bars_{tf}'}""",
    }


def diffs() -> dict:
    return {
        "d": """SELECT *, close - lag(close) OVER s AS diff, high - lag(high) OVER s AS up, lag(low) OVER s - low AS dn,
         greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr
         FROM b WINDOW s AS (PARTITION BY symbol ORDER BY rn)"""
    }


def atr(tf: str) -> dict:
    """Bars with atr_14 in CTE ``a``."""
    return {
        **numbered(tf),
        **diffs(),
        "r_atr": f"""SELECT symbol, rn, tr AS y FROM d WHERE rn = 0
         UNION ALL SELECT d.symbol, d.rn, r.y * {dbl(13 / 14)} + d.tr / 14
         FROM r_atr r JOIN d ON d.symbol = r.symbol AND d.rn = r.rn + 1""",
        "a": """SELECT b.*, CASE WHEN b.rn >= 13 THEN r.y END AS atr_14
         FROM b JOIN r_atr r ON r.symbol = b.symbol AND r.rn = b.rn""",
    }


def ema(name: str, source: str, x: str, n: int, first: int = 0) -> dict:
    """Recursive EMA ``name(symbol, rn, y)`` seeded with the mean of its first values."""
    alpha = 2 / (n + 1)
    seed = first + n - 1
    return {
        name: f"""SELECT symbol, {seed}::BIGINT AS rn, avg({x}) AS y FROM {source}
         WHERE rn BETWEEN {first} AND {seed} GROUP BY symbol HAVING count(*) = {n}
         UNION ALL SELECT s.symbol, s.rn, r.y * {dbl(1 - alpha)} + s.{x} * {dbl(alpha)}
         FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1"""
    }


def rma(name: str, source: str, x: str, n: int, first: int) -> dict:
    return {
        name: f"""SELECT symbol, rn, {x} AS y FROM {source} WHERE rn = {first}
         UNION ALL SELECT s.symbol, s.rn, r.y * {dbl((n - 1) / n)} + s.{x} / {n}
         FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1"""
    }


BOUNDED = """SELECT *,
  CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS mid,
  CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS dev,
  CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END AS vol_sma_20,
  CASE WHEN count(close) OVER w14 = 14 THEN
    100.0::DOUBLE * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END AS raw_k,
  greatest(diff, 0) AS gain, greatest(-diff, 0) AS loss,
  CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm,
  sum(coalesce(sign(diff), 1) * volume) OVER (PARTITION BY symbol ORDER BY rn) AS obv
  FROM d WINDOW w20 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  w14 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""


def features(tf: str) -> dict:
    """All technical indicators of the bars in CTE ``feat``."""
    join = " ".join(
        f"LEFT JOIN {r} ON {r}.symbol = w.symbol AND {r}.rn = w.rn"
        for r in ("r_e12", "r_e26", "r_e50", "r_gain", "r_loss", "r_atr", "r_pdm", "r_mdm")
    )
    return {
        **atr(tf),
        "w": BOUNDED,
        **ema("r_e12", "w", "close", 12),
        **ema("r_e26", "w", "close", 26),
        **ema("r_e50", "w", "close", 50),
        **rma("r_gain", "w", "gain", 14, 1),
        **rma("r_loss", "w", "loss", 14, 1),
        **rma("r_pdm", "w", "pdm", 14, 1),
        **rma("r_mdm", "w", "mdm", 14, 1),
        "m": f"""SELECT w.*, r_e12.y - r_e26.y AS macd, r_e50.y AS ema_50, (w.close - r_e50.y) / r_e50.y AS dist_ema_50,
         CASE WHEN w.rn >= 14 THEN 100.0::DOUBLE * r_gain.y / nullif(r_gain.y + r_loss.y, 0) END AS rsi_14,
         CASE WHEN w.rn >= 13 THEN r_atr.y END AS atr_14,
         CASE WHEN w.rn >= 14 THEN
           coalesce(100.0::DOUBLE * abs(r_pdm.y - r_mdm.y) / nullif(r_pdm.y + r_mdm.y, 0), 0.0) END AS dx
         FROM w {join}""",
        **ema("r_sig", "m", "macd", 9, 25),
        **rma("r_adx", "m", "dx", 14, 14),
        "feat": """SELECT m.*, CASE WHEN m.rn >= 33 THEN m.macd - r_sig.y END AS macd_hist,
         CASE WHEN m.rn >= 27 THEN r_adx.y END AS adx_14,
         CASE WHEN count(raw_k) OVER w3 = 3 THEN avg(raw_k) OVER w3 END AS stoch_k,
         100.0::DOUBLE * (4 * dev) / nullif(mid, 0) AS bb_width, close / nullif(mid + 2 * dev, 0) AS bb_pos,
         volume / nullif(vol_sma_20, 0) AS rel_volume
         FROM m LEFT JOIN r_sig ON r_sig.symbol = m.symbol AND r_sig.rn = m.rn
         LEFT JOIN r_adx ON r_adx.symbol = m.symbol AND r_adx.rn = m.rn
         WINDOW w3 AS (PARTITION BY m.symbol ORDER BY m.rn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    }


SENTIMENT = {
    "fng_daily": None,
    "fng": """SELECT *, CASE WHEN count(fng_value) OVER s = 14 THEN avg(fng_value) OVER s END AS fng_sma_14,
     CASE WHEN count(fng_value) OVER s = 14 THEN stddev_samp(fng_value) OVER s END AS fng_vol_14
     FROM fng_daily WINDOW s AS (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
}


def with_sentiment(source: str = "feat", name: str = "fs") -> dict:
    return {
        **SENTIMENT,
        name: f"""SELECT x.*, f.fng_value, f.fng_sma_14, f.fng_vol_14
         FROM {source} x ASOF LEFT JOIN fng f ON x.ts >= f.ts""",
    }


def labels(source: str, swing: int = 10, tp: float = 1.5, sl: float = 1.0, name: str = "lab", extra: str = "") -> dict:
    """Barrier labels by a range self-join in CTE ``name``."""
    s = f"(x.close - x.atr_14 * {dbl(sl)})"
    t = f"(x.close + x.atr_14 * {dbl(tp)})"
    return {
        f"{name}_off": f"""SELECT x.symbol, x.rn, min(f.rn - x.rn) FILTER (f.low <= {s}) AS sl_off,
         min(f.rn - x.rn) FILTER (f.high >= {t}) AS tp_off
         FROM {source} x LEFT JOIN {source} f ON f.symbol = x.symbol AND f.rn BETWEEN x.rn + 1 AND x.rn + {swing}
         GROUP BY 1, 2""",
        f"{name}_t": f"""SELECT x.*, CASE WHEN o.sl_off IS NOT NULL AND o.sl_off <= coalesce(o.tp_off, 1000000) THEN -1
         WHEN o.tp_off IS NOT NULL THEN 1 ELSE 0 END AS target,
         coalesce(lead(x.close, {swing}) OVER (PARTITION BY x.symbol ORDER BY x.rn), x.last_close) AS exit_close
         FROM {source} x JOIN {name}_off o ON o.symbol = x.symbol AND o.rn = x.rn""",
        name: f"""SELECT *, CASE target WHEN 1 THEN atr_14 * {dbl(tp)} / close WHEN -1 THEN -(atr_14 * {dbl(sl)} / close)
         ELSE (exit_close - close) / close END AS target_ret, rn + {swing} < n_bars AS label_complete {extra} FROM {name}_t""",
    }


def md5_score(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) % 10000) / 10000.0::DOUBLE"


def picks(cand: str, keys: list[str], swing: int, name: str = "r_pick") -> dict:
    """Sequential cooldown picks of ``cand(keys, pos)`` in recursive CTE ``name``."""
    k = ", ".join(keys)
    on = " AND ".join(f"c.{x} = d.{x}" for x in keys)
    onr = " AND ".join(f"r.{x} = n.{x}" for x in keys)
    return {
        f"nx_{name}": f"""SELECT {', '.join('c.' + x for x in keys)}, c.pos, d.pos AS next_pos
         FROM {cand} c ASOF JOIN {cand} d ON {on} AND c.pos + {swing} <= d.pos""",
        name: f"""SELECT {k}, min(pos) AS pos FROM {cand} GROUP BY {k}
         UNION ALL SELECT {', '.join('n.' + x for x in keys)}, n.next_pos
         FROM {name} r JOIN nx_{name} n ON {onr} AND r.pos = n.pos""",
    }


def ternary(tp: float = 1.5, sl: float = 1.0, cost: float = 0.0, exit_close: str = "exit_close") -> str:
    return (
        f"(CASE target WHEN 1 THEN atr_14 * {dbl(tp)} / close WHEN -1 THEN -(atr_14 * {dbl(sl)} / close)"
        f" ELSE ({exit_close} - close) / close END - {dbl(cost)})"
    )


def binary(tp: float = 1.5, sl: float = 1.0, cost: float = 0.0) -> str:
    return f"(CASE target WHEN 1 THEN atr_14 * {dbl(tp)} / close ELSE -(atr_14 * {dbl(sl)} / close) END - {dbl(cost)})"


def pf(gain: str, loss: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {gain} / greatest({loss}, 1e-9::DOUBLE) END"
