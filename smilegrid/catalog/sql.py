"""The same derived tables as ANSI SQL, for the side-by-side check.

`compose` prefixes a query with the common table expressions it mentions, and
expands `R6(expr)` into a rounding both engines agree on.
"""

from __future__ import annotations

import re

from ..functions.numeric import HART_BOTTOM, HART_SPLIT, HART_TOP, SQRT_TWO_PI
from ..functions.text import FAILURE_RULES, NO_FAILURE
from ..settings import DIVIDEND, RATE_DATE, STATES, TENOR_COLUMNS, TENOR_MONTHS
from .inputs import EXPIRIES


def num(x: float) -> str:
    """A DOUBLE literal."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _horner(coefficients, x: str) -> str:
    text = num(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text}*{x}+{num(c)})"
    return text


def cdf(x: str) -> str:
    a = f"abs({x})"
    tail = f"exp(-{a}*{a}/2)"
    centre = f"{tail}*{_horner(HART_TOP, a)}/{_horner(HART_BOTTOM, a)}"
    fraction = f"({a}+0.65e0)"
    for k in (4, 3, 2, 1):
        fraction = f"({a}+{k}/{fraction})"
    upper = f"(CASE WHEN {a}>37 THEN 0e0 WHEN {a}<{num(HART_SPLIT)} THEN {centre} ELSE {tail}/{fraction}/{num(SQRT_TWO_PI)} END)"
    return f"(CASE WHEN {x}>0 THEN 1-{upper} ELSE {upper} END)"


def normal_p(t: str) -> str:
    return f"(2*{cdf(f'(-abs({t}))')})"


def div(a: str, b: str) -> str:
    return f"(({a})/nullif(({b}),0e0))"


TENOR = {c: f'"{c}"' for c in TENOR_COLUMNS}


def tenor_rate(t: str) -> str:
    knots = [m / 12.0 for m in TENOR_MONTHS]
    parts = [f"WHEN {t}<{num(knots[0])} THEN {TENOR[TENOR_COLUMNS[0]]}"]
    for i in range(len(knots) - 1):
        lo, hi = TENOR[TENOR_COLUMNS[i]], TENOR[TENOR_COLUMNS[i + 1]]
        parts.append(
            f"WHEN {t}<{num(knots[i + 1])} THEN {lo}+({hi}-{lo})*(({t}-{num(knots[i])})/{num(knots[i + 1] - knots[i])})"
        )
    return "CASE " + " ".join(parts) + f" ELSE {TENOR[TENOR_COLUMNS[-1]]} END"


_EXPIRY = "CASE l_suppkey % 9 " + " ".join(f"WHEN {i} THEN DATE '{x}'" for i, x in enumerate(EXPIRIES)) + " END"


def _around(c: str) -> str:
    q = f'"{c}"'
    name = re.sub(r"\W", "_", c)
    return (
        f"last_value(CASE WHEN {q} IS NOT NULL THEN n END IGNORE NULLS) OVER b AS t0_{name}, last_value({q} IGNORE NULLS) OVER b AS v0_{name}, "
        f"first_value(CASE WHEN {q} IS NOT NULL THEN n END IGNORE NULLS) OVER a AS t1_{name}, first_value({q} IGNORE NULLS) OVER a AS v1_{name}"
    )


def _filled(c: str) -> str:
    name = re.sub(r"\W", "_", c)
    return (
        f'coalesce("{c}", CASE WHEN t1_{name}>t0_{name} THEN v0_{name}+((v1_{name}-v0_{name})/(t1_{name}-t0_{name}))*(n-t0_{name}) END, '
        f'v0_{name}, v1_{name}) AS "{c}"'
    )


_GREEK_D1 = "((ln(entry_spot/strike)+(entry_r-entry_q+entry_implied_vol*entry_implied_vol*0.5e0)*entry_T)/(entry_implied_vol*sqrt(entry_T)))"
_SIGN = "(CASE WHEN option_type='C' THEN 1e0 ELSE -1e0 END)"
_PDF = "(exp(-d1*d1/2)/sqrt(2*pi()))"

CTES: dict[str, str] = {}

def vol_sql(k: str, t: str, day: str) -> str:
    return f"(0.18e0+0.5e0*{k}*{k}+0.03e0*sqrt({t})+(0.02e0*sin({day}*0.37e0)+0.01e0*sin({k}*40e0+{t}*9e0+{day}*1.3e0)))"


def price_sql(spot: str, t: str, r: str, q: str, vol: str, strike: str = "strike", sg: str = _SIGN) -> str:
    d1 = f"((ln({spot}/{strike})+({r}-{q}+{vol}*{vol}*0.5e0)*{t})/({vol}*sqrt({t})))"
    d2 = f"({d1}-{vol}*sqrt({t}))"
    return f"({sg}*({spot}*exp(-{q}*{t})*{cdf(f'({sg}*{d1})')}-{strike}*exp(-{r}*{t})*{cdf(f'({sg}*{d2})')}))"


def tenor_columns(n: str) -> str:
    parts = [f'1e-4+1e-6*{n}+1e-5*{i} AS "{c}"' for i, c in enumerate(TENOR_COLUMNS)]
    return ", ".join([*parts, f'4e-5+1e-7*{n} AS "{DIVIDEND}"'])


CTES["lines"] = f"""
SELECT *, CASE WHEN l_tax>0.075e0 AND intr>10e0 THEN 0.5e0*intr ELSE sg*(s*exp(-y*t)*{cdf('(sg*d1)')}-strike*exp(-r*t)*{cdf('(sg*d2)')}) END AS mid0
FROM (SELECT *, d1-vol*sqrt(t) AS d2 FROM (SELECT *, (ln(s/strike)+(r-y+vol*vol*0.5e0)*t)/(vol*sqrt(t)) AS d1, CASE WHEN kind='P' THEN -1e0 ELSE 1e0 END AS sg
 FROM (SELECT *, pow(1+({tenor_rate('t')}),252e0)-1 AS r, pow(1+"{DIVIDEND}",252e0)-1 AS y, {vol_sql('k', 't', "(qd-DATE '2024-01-01')")} AS vol
  FROM (SELECT *, greatest(xd-qd,1)/365e0 AS t, CASE WHEN kind='P' THEN greatest(strike-s,0e0) ELSE greatest(s-strike,0e0) END AS intr, ln(strike/s) AS k, {tenor_columns('d')}
   FROM (SELECT ahead,l_orderkey,l_linenumber,l_partkey,l_quantity,l_discount,l_tax,d,
    DATE '2024-01-01'+CAST(7*floor(d/5e0)+d%5 AS INT) AS qd, {_EXPIRY} AS xd,
    CASE WHEN l_suppkey%9 IN (2,4,6) THEN 'SPXW' ELSE 'SPX' END AS root,
    75e0+l_partkey%51 AS strike, 100e0+((d*37)%11)*0.5e0 AS s,
    CASE WHEN l_orderkey%97=0 THEN 'X' WHEN l_linenumber%2=0 THEN 'P' ELSE 'C' END AS kind
    FROM (SELECT *, l_orderkey%60+ahead AS d FROM lineitem, (VALUES (0),(1)) AS o(ahead)) WHERE d<60)))))
"""
CTES["raw_quotes"] = """
SELECT 'spx ' AS underlying_symbol, CASE WHEN l_orderkey%89=0 AND ahead=0 THEN 'n/a' WHEN l_linenumber=3 AND ahead=0 THEN strftime(qd,'%d/%m/%Y')
  ELSE strftime(qd,'%Y-%m-%d') END AS quote_date, root, strftime(xd,'%Y-%m-%d') AS expiration, strike, kind AS option_type,
  CASE WHEN ahead=0 THEN CAST(l_quantity AS BIGINT)-1 ELSE 0 END AS trade_volume, l_partkey%29 AS open_interest,
  mid0*(1e0-1.3e0*l_discount) AS bid_1545, mid0*(1e0+1.3e0*l_discount) AS ask_1545, s-0.25e0 AS underlying_bid_1545,
  s+0.25e0 AS underlying_ask_1545, mid0*(1e0-1.3e0*l_discount) AS bid_eod, mid0*(1e0+1.3e0*l_discount) AS ask_eod FROM lines
"""
CTES["calendar"] = """
SELECT session, row_number() OVER (ORDER BY session)-1 AS session_no, (session-DATE '2024-01-01')%17<>9 AS is_1545_open,
  lead(session,1) OVER (ORDER BY session) AS next1, lead(session,2) OVER (ORDER BY session) AS next2
FROM (SELECT DISTINCT qd AS session FROM lines)
"""
CTES["raw_rates"] = f"""
SELECT session AS "{RATE_DATE}", {tenor_columns('n')} FROM (SELECT session, CAST(floor((session-DATE '2024-01-01')/7e0) AS INT)*5+(session-DATE '2024-01-01')%7 AS n FROM calendar) WHERE n%13<>5
"""
CTES["gappy_rates"] = f"""
SELECT "{RATE_DATE}", """ + ", ".join(f'CASE WHEN (n+{i})%7<>3 THEN "{c}" END AS "{c}"' for i, c in enumerate(TENOR_COLUMNS)) + f""",
 CASE WHEN n%5<>0 THEN "{DIVIDEND}" END AS "{DIVIDEND}"
FROM (SELECT *, CAST(floor(("{RATE_DATE}"-DATE '2024-01-01')/7e0) AS INT)*5+("{RATE_DATE}"-DATE '2024-01-01')%7 AS n FROM raw_rates)
"""
CTES["rates"] = "SELECT * FROM raw_rates"
CTES["filled_rates"] = (
    f'SELECT "{RATE_DATE}", ' + ", ".join(_filled(c) for c in TENOR_COLUMNS)
    + f', coalesce(v0_{re.sub(chr(92)+"W","_",DIVIDEND)}, v1_{re.sub(chr(92)+"W","_",DIVIDEND)}) AS "{DIVIDEND}"'
    + " FROM (SELECT *, " + ", ".join(_around(c) for c in (*TENOR_COLUMNS, DIVIDEND))
    + f""" FROM (SELECT *, "{RATE_DATE}"-DATE '1970-01-01' AS n FROM gappy_rates)
 WINDOW b AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
)
CTES["flagged"] = f"""
SELECT *, CASE
  WHEN NOT coalesce(bid_1545>0 AND ask_1545>0 AND ask_1545>bid_1545 AND trade_volume>0 AND open_interest>0 AND spot>0 AND strike>0 AND mid>0,false) THEN 'basic'
  WHEN quote_date IS NULL OR expiration IS NULL THEN 'bad_dates'
  WHEN NOT (T>=14/365e0 AND T<=1e0) THEN 't_window'
  WHEN NOT has_rate THEN 'no_rates'
  WHEN NOT (moneyness BETWEEN 0.8e0 AND 1.2e0) THEN 'moneyness'
  WHEN NOT ((ask_1545-bid_1545)/mid<=0.2e0) THEN 'spread'
  WHEN option_type NOT IN ('C','P') THEN 'option_type'
  WHEN NOT (mid+1e-4>=greatest(0e0, CASE WHEN option_type='C' THEN spot*exp(-q_annual*T)-strike*exp(-r_annual*T) ELSE strike*exp(-r_annual*T)-spot*exp(-q_annual*T) END)) THEN 'lower_bound'
  END AS first_fail
FROM (SELECT *, pow(1+({tenor_rate('T')}),252e0)-1 AS r_annual, pow(1+"{DIVIDEND}",252e0)-1 AS q_annual, strike/nullif(spot,0e0) AS moneyness
 FROM (SELECT q.* REPLACE (dq AS quote_date, de AS expiration, upper(trim(option_type)) AS option_type),
   (underlying_bid_1545+underlying_ask_1545)/2 AS spot, (bid_1545+ask_1545)/2 AS mid, (de-dq)/365e0 AS T, r.* , r."{RATE_DATE}" IS NOT NULL AS has_rate
  FROM (SELECT *, CAST(coalesce(try_strptime(quote_date,'%Y-%m-%d'),try_strptime(quote_date,'%d/%m/%Y')) AS DATE) AS dq,
     CAST(try_strptime(expiration,'%Y-%m-%d') AS DATE) AS de FROM raw_quotes) q
  LEFT JOIN rates r ON q.dq=r."{RATE_DATE}"))
"""
CTES["clean"] = "SELECT * FROM flagged WHERE first_fail IS NULL"
CTES["iv_quotes"] = """
SELECT *, {v} AS implied_vol FROM (SELECT *, ln(moneyness) AS lk, quote_date-DATE '2024-01-01' AS n FROM clean)
""".format(v=vol_sql("lk", "T", "n"))
_KEY = "upper(trim(underlying_symbol))||'|'||upper(trim(root))||'|'||strftime({x},'%Y-%m-%d')||'|'||printf('%.6f',strike)||'|'||substr(upper(trim(option_type)),1,1)"
CTES["market"] = f"""
SELECT quote_date, contract_key, min(underlying_symbol) AS underlying_symbol, min(root) AS root, min(expiration) AS expiration, min(strike) AS strike,
  min(option_type) AS option_type, avg(bid_1545) AS bid, avg(ask_1545) AS ask, avg(mid) AS mid, avg(spot) AS spot, avg(moneyness) AS moneyness,
  avg(ln(moneyness)) AS log_moneyness, avg(T) AS T, avg(implied_vol) AS implied_vol, avg(r_annual) AS r, avg(q_annual) AS q,
  CAST(sum(trade_volume) AS DOUBLE) AS trade_volume, CAST(sum(open_interest) AS DOUBLE) AS open_interest, count(*) AS source_observation_count
FROM (SELECT * REPLACE (upper(trim(underlying_symbol)) AS underlying_symbol), {_KEY.format(x='expiration')} AS contract_key FROM iv_quotes)
GROUP BY quote_date, contract_key
"""
CTES["surface"] = """
SELECT quote_date, printf('iv_x%02d_t%02d',xi,ti) AS node, xi AS x_idx, ti AS t_idx, avg(implied_vol) AS iv_grid
FROM (SELECT quote_date, implied_vol, CAST(floor((ln(moneyness)-(-0.22e0))/0.05e0) AS INT) AS xi, CAST(floor(T/0.1e0) AS INT) AS ti FROM iv_quotes)
GROUP BY quote_date, xi, ti
"""
CTES["nodes"] = """
SELECT DISTINCT node, round(-0.22e0+0.05e0*(x_idx+0.5e0),6) AS log_moneyness, round(0.1e0*(t_idx+0.5e0),6) AS T FROM surface
"""
CTES["panel"] = """
SELECT c.session AS quote_date, n.node, c.session_no, c.next1, c.next2, s.iv_grid
FROM calendar c CROSS JOIN (SELECT node FROM nodes) n LEFT JOIN surface s ON s.quote_date=c.session AND s.node=n.node
"""
CTES["lagged"] = """
SELECT *, next1 AS target_date, CAST(isodow(next1)-1 AS DOUBLE) AS dow, iv_grid AS lag_1, lag(iv_grid,1) OVER w AS lag_2, lag(iv_grid,2) OVER w AS lag_3,
  lag(iv_grid,4) OVER w AS lag_5, lag(iv_grid,9) OVER w AS lag_10, lead(iv_grid,1) OVER w AS label, lead(iv_grid,2) OVER w AS label_h2,
  CASE WHEN count(iv_grid) OVER f>=2 THEN avg(iv_grid) OVER f END AS roll_mean_5,
  CASE WHEN count(iv_grid) OVER f>=2 THEN stddev_samp(iv_grid) OVER f END AS roll_std_5
FROM panel WINDOW w AS (PARTITION BY node ORDER BY quote_date), f AS (PARTITION BY node ORDER BY quote_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""
CTES["regions"] = """
SELECT n.*, CASE x.g WHEN 1 THEN 'lower' WHEN 2 THEN 'central' ELSE 'upper' END AS moneyness_region,
  CASE t.g WHEN 1 THEN 'short' WHEN 2 THEN 'medium' ELSE 'long' END AS maturity_region
FROM nodes n JOIN (SELECT c, ntile(3) OVER (ORDER BY c) AS g FROM (SELECT DISTINCT log_moneyness AS c FROM nodes)) x ON x.c=n.log_moneyness
JOIN (SELECT c, ntile(3) OVER (ORDER BY c) AS g FROM (SELECT DISTINCT T AS c FROM nodes)) t ON t.c=n.T
"""
CTES["forecasts"] = """
SELECT quote_date AS forecast_origin_date, target_date AS forecast_target_date, next2, node, lag_1 AS forecast_persistence,
  0.7e0*lag_1+0.3e0*roll_mean_5+tilt AS forecast_arima, 0.5e0*lag_1+0.3e0*lag_2+0.2e0*roll_mean_5-0.5e0*tilt AS forecast_ridge,
  0.2e0*lag_1+0.8e0*roll_mean_5+0.3e0*tilt AS forecast_xgboost, 0.5e0*lag_1+0.5e0*roll_mean_5-tilt AS forecast_arima_h2,
  0.3e0*lag_1+0.3e0*lag_2+0.4e0*roll_mean_5+tilt AS forecast_ridge_h2, 0.1e0*lag_1+0.9e0*roll_mean_5+0.9e0*tilt AS forecast_xgboost_h2
FROM (SELECT *, 0.004e0*sin(session_no*0.9e0+ascii(substr(node,6,1))*2.1e0+ascii(substr(node,10,1))*1.7e0) AS tilt FROM lagged)
"""
_MODELS4 = ("persistence", "arima", "ridge", "xgboost")
CTES["journal"] = """
SELECT *, target_available AND {all4} AS common_sample_4models,
  target_available AND {all4} AND actual_iv_at_target>0 AND {pos4} AS common_sample_qlike
FROM (SELECT f.*, o.iv_grid AS observed_iv_at_origin, a.iv_grid AS actual_iv_at_target, a.iv_grid IS NOT NULL AS target_available,
   r.log_moneyness, r.T, r.moneyness_region, r.maturity_region, {av}
  FROM forecasts f JOIN regions r USING (node) LEFT JOIN surface o ON o.quote_date=f.forecast_origin_date AND o.node=f.node
  LEFT JOIN surface a ON a.quote_date=f.forecast_target_date AND a.node=f.node)
""".format(
    all4=" AND ".join(f"available_{m}" for m in _MODELS4),
    pos4=" AND ".join(f"coalesce(forecast_{m}>0,false)" for m in _MODELS4),
    av=", ".join(f"f.forecast_{m} IS NOT NULL AS available_{m}" for m in _MODELS4),
)
CTES["scored"] = " UNION ALL ".join(
    f"""SELECT forecast_target_date, node, observed_iv_at_origin, actual_iv_at_target, moneyness_region, maturity_region, '{m}' AS model, forecast_{m} AS forecast,
 pow(forecast_{m}-actual_iv_at_target,2) AS SE, abs(forecast_{m}-actual_iv_at_target) AS AE,
 CASE WHEN common_sample_qlike THEN (actual_iv_at_target*actual_iv_at_target)/(forecast_{m}*forecast_{m})-ln((actual_iv_at_target*actual_iv_at_target)/(forecast_{m}*forecast_{m}))-1 END AS QL
 FROM journal WHERE common_sample_4models"""
    for m in _MODELS4
)
CTES["daily_losses"] = """
SELECT forecast_target_date, model, count(*) AS n_common, count(QL) AS n_qlike, avg(SE) AS L_SE, avg(AE) AS L_AE, avg(QL) AS L_QLIKE,
  sum(SE) AS sum_SE, sum(AE) AS sum_AE, coalesce(sum(QL),0e0) AS sum_QLIKE FROM scored GROUP BY ALL
"""
CTES["economic"] = """
SELECT j.*, observed_iv_at_origin IS NOT NULL AND {ok} AS common_economic_candidate,
  en.iv_grid AS actual_iv_entry, ex.iv_grid AS actual_iv_exit, ex.iv_grid-en.iv_grid AS actual_holding_change
FROM (SELECT *, forecast_origin_date AS decision_date, forecast_target_date AS entry_date, next2 AS intended_exit_date FROM journal) j
LEFT JOIN surface en ON en.quote_date=j.entry_date AND en.node=j.node LEFT JOIN surface ex ON ex.quote_date=j.intended_exit_date AND ex.node=j.node
""".format(ok=" AND ".join(f"forecast_{m} IS NOT NULL AND forecast_{m}_h2 IS NOT NULL" for m in _MODELS4[1:]))
CTES["signals0"] = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, decision_date, entry_date, intended_exit_date, node, log_moneyness, T, common_economic_candidate,
 forecast_{m}_h2-forecast_{m} AS raw_signal, actual_iv_entry, actual_iv_exit, actual_holding_change FROM economic"""
    for m in _MODELS4[1:]
)
CTES["signals"] = """
SELECT *, coalesce(selection_rank<=10,false) AS selected, CASE WHEN selection_rank<=10 THEN side ELSE 0 END AS signal FROM (
 SELECT *, CASE WHEN side IS NOT NULL THEN row_number() OVER (PARTITION BY model,decision_date,side ORDER BY abs(z_score) DESC,node) END AS selection_rank FROM (
 SELECT *, CASE WHEN z_score>=0.5e0 THEN 1 WHEN z_score<=-0.5e0 THEN -1 END AS side FROM (
 SELECT *, CASE WHEN common_economic_candidate THEN CASE WHEN sd>0 THEN (raw_signal-mu)/sd ELSE 0e0 END END AS z_score FROM (
 SELECT *, stddev_samp(raw_signal) OVER w AS sd, avg(raw_signal) OVER w AS mu FROM signals0 WINDOW w AS (PARTITION BY model,decision_date,common_economic_candidate)))))
"""
CTES["valid_market"] = """
SELECT * FROM market WHERE bid>0 AND ask>=bid AND spot>0 AND T>0 AND log_moneyness IS NOT NULL AND option_type IN ('C','P') AND expiration>quote_date
"""
CTES["selected"] = "SELECT s.*, c.is_1545_open AS is_open FROM signals s LEFT JOIN calendar c ON c.session=s.entry_date WHERE selected AND intended_exit_date IS NOT NULL"
CTES["reach"] = """
SELECT s.entry_date, s.node, v.contract_key, sqrt(pow((v.log_moneyness-s.log_moneyness)/0.02e0,2e0)+pow((v.T-s.T)/0.05e0,2e0)) AS dist
FROM (SELECT DISTINCT entry_date,node,log_moneyness,T FROM selected WHERE is_open) s JOIN valid_market v ON v.quote_date=s.entry_date
"""
CTES["hits"] = """
SELECT entry_date, node, min(mapping_distance) AS mapping_distance, min(contract_key) AS contract_key
FROM (SELECT *, min(dist) OVER (PARTITION BY entry_date,node) AS mapping_distance FROM reach) WHERE dist-mapping_distance<=1e-12 GROUP BY entry_date,node
"""
CTES["mapped"] = """
SELECT s.*, h.contract_key, h.mapping_distance, CASE WHEN NOT coalesce(s.is_open,false) THEN 'MARKET_CLOSED_AT_1545' WHEN h.contract_key IS NOT NULL THEN 'MAPPED'
  ELSE 'NO_ENTRY_MARKET' END AS entry_mapping_status, v.underlying_symbol, v.root, v.expiration, v.strike, v.option_type, v.bid AS entry_bid, v.ask AS entry_ask,
  v.mid AS entry_mid, v.spot AS entry_spot, v.implied_vol AS entry_implied_vol, v.T AS entry_T, v.r AS entry_r, v.q AS entry_q,
  v.log_moneyness AS entry_log_moneyness, v.source_observation_count AS entry_source_observation_count
FROM selected s LEFT JOIN hits h USING (entry_date,node) LEFT JOIN valid_market v ON v.quote_date=h.entry_date AND v.contract_key=h.contract_key
"""
CTES["trades"] = f"""
SELECT *, {_SIGN}*carry*{cdf('(sg*d1)')} AS entry_Delta, carry*{_PDF}/(entry_spot*entry_implied_vol*sqrt(entry_T)) AS entry_Gamma,
  entry_spot*carry*{_PDF}*sqrt(entry_T) AS entry_Vega,
  -entry_spot*carry*{_PDF}*entry_implied_vol/(2*sqrt(entry_T))+sg*(entry_q*entry_spot*carry*{cdf('(sg*d1)')}-entry_r*strike*exp(-entry_r*entry_T)*{cdf('(sg*d2)')}) AS entry_Theta
FROM (SELECT *, d1-entry_implied_vol*sqrt(entry_T) AS d2 FROM (
 SELECT *, {_GREEK_D1} AS d1, exp(-entry_q*entry_T) AS carry, {_SIGN} AS sg,
  CASE WHEN entry_mapping_status='MAPPED' AND longs>0 AND shorts>0 AND signal=1 THEN 0.5e0/longs
   WHEN entry_mapping_status='MAPPED' AND longs>0 AND shorts>0 AND signal=-1 THEN -0.5e0/shorts ELSE 0e0 END AS weight_at_entry,
  CASE WHEN entry_mapping_status<>'MAPPED' THEN 'NO_ENTRY' WHEN longs>0 AND shorts>0 THEN 'LOCKED_SIDE_NEUTRAL' ELSE 'NO_BOTH_SIDES_AT_ENTRY' END AS entry_weight_status
 FROM (SELECT *, count(*) FILTER (entry_mapping_status='MAPPED' AND signal=1) OVER w AS longs,
   count(*) FILTER (entry_mapping_status='MAPPED' AND signal=-1) OVER w AS shorts FROM mapped WINDOW w AS (PARTITION BY model,entry_date))))
"""
_CARRY = [
    "decision_date", "intended_exit_date", "underlying_symbol", "root", "expiration", "strike", "option_type", "entry_bid", "entry_ask", "entry_spot",
    "entry_implied_vol", "entry_T", "entry_r", "entry_q", "entry_log_moneyness", "entry_source_observation_count", "entry_Delta", "entry_Gamma", "entry_Vega", "entry_Theta",
]
CTES["net"] = f"""
SELECT *, abs(weight_at_entry)>1e-12 AS nonzero_net_position, CASE WHEN abs(weight_at_entry)>1e-12 THEN CAST(sign(weight_at_entry) AS INT) ELSE 0 END AS net_signal,
  CASE WHEN abs(weight_at_entry)>1e-12 THEN 'ACTIVE' ELSE 'FULLY_CANCELLED' END AS netting_status
FROM (SELECT model, entry_date, contract_key, {', '.join(f'min({c}) AS {c}' for c in _CARRY)}, sum(weight_at_entry) AS weight_at_entry, count(*) AS n_mapped_nodes,
  string_agg(node,';' ORDER BY node) AS mapped_nodes, sum(abs(weight_at_entry)) AS node_gross_weight, count(DISTINCT signal)>1 AS opposing_signals
 FROM trades WHERE entry_mapping_status='MAPPED' AND weight_at_entry<>0 GROUP BY model,entry_date,contract_key)
"""
CTES["required"] = "SELECT DISTINCT intended_exit_date, contract_key FROM net"
CTES["processed"] = "SELECT m.* FROM market m SEMI JOIN required r ON r.intended_exit_date=m.quote_date AND r.contract_key=m.contract_key"
CTES["raw_typed"] = f"""
SELECT *, {_KEY.format(x='expiration')} AS contract_key, (expiration-quote_date)/365e0 AS T FROM (
 SELECT * REPLACE (CAST(try_strptime(quote_date,'%Y-%m-%d') AS DATE) AS quote_date, CAST(try_strptime(expiration,'%Y-%m-%d') AS DATE) AS expiration,
   upper(trim(underlying_symbol)) AS underlying_symbol, substr(upper(trim(option_type)),1,1) AS option_type),
  (underlying_bid_1545+underlying_ask_1545)/2 AS spot, (bid_1545+ask_1545)/2 AS mid FROM raw_quotes)
"""
_RULES = (
    "bid_1545>0",
    "ask_1545>bid_1545",
    "trade_volume>0",
    "open_interest>0",
    "(spot>0 AND strike>0)",
    "T BETWEEN 14/365e0 AND 1e0",
    "strike/nullif(spot,0e0) BETWEEN 0.8e0 AND 1.2e0",
    "(ask_1545-bid_1545)/nullif(mid,0e0)<=0.2e0",
    "option_type IN ('C','P')",
    f'quote_date IN (SELECT "{RATE_DATE}" FROM rates)',
)
CTES["raw_found"] = f"""
SELECT w.*, coalesce(nullif(concat_ws(';', {', '.join(f"CASE WHEN NOT coalesce({r},false) THEN '{n}' END" for n, r in zip(FAILURE_RULES, _RULES))}),''),'{NO_FAILURE}') AS reasons
FROM raw_typed w SEMI JOIN (SELECT r.* FROM required r ANTI JOIN processed p ON p.quote_date=r.intended_exit_date AND p.contract_key=r.contract_key) m
  ON m.intended_exit_date=w.quote_date AND m.contract_key=w.contract_key
"""
CTES["recovered"] = """
SELECT a.*, b.reasons AS observable_failure_reasons FROM (
 SELECT quote_date, contract_key, avg(bid_1545) AS bid_1545, avg(ask_1545) AS ask_1545, avg(mid) AS mid, avg(spot) AS spot, CAST(sum(trade_volume) AS DOUBLE) AS trade_volume,
  CAST(sum(open_interest) AS DOUBLE) AS open_interest, count(*) AS source_observation_count FROM raw_found GROUP BY quote_date, contract_key) a
JOIN (SELECT quote_date, contract_key, string_agg(x,';' ORDER BY x) AS reasons FROM (
  SELECT DISTINCT quote_date, contract_key, unnest(string_split(reasons,';')) AS x FROM raw_found) GROUP BY quote_date, contract_key) b USING (quote_date, contract_key)
"""


def category(c: str) -> str:
    named = f"list_filter(list_distinct(string_split(coalesce({c},''),';')), lambda x: x NOT IN ('', '{NO_FAILURE}'))"
    one = f"list_extract({named},1)"
    return f"""CASE WHEN len({named})=0 THEN 'NO_OBSERVABLE_REASON' WHEN len({named})>1 THEN 'MULTIPLE_REASONS'
 WHEN {one}='NONPOSITIVE_VOLUME' THEN 'NONPOSITIVE_VOLUME_ONLY' WHEN {one}='SPREAD_ABOVE_DEFAULT_MAX' THEN 'SPREAD_FILTER_ONLY'
 WHEN {one}='NO_EXACT_RATE_DATE' OR {one} LIKE '%RATE%' OR {one} LIKE '%IV_INPUT%' OR {one} LIKE '%INVALID_SPOT%' THEN 'RATE_OR_IV_INPUT_RELATED'
 WHEN {one} IN ('MONEYNESS_OUTSIDE_DEFAULT_WINDOW','T_OUTSIDE_DEFAULT_WINDOW') THEN 'MONEYNESS_OR_T_FILTER'
 WHEN {one}='NONPOSITIVE_OPEN_INTEREST' THEN 'NONPOSITIVE_OPEN_INTEREST_ONLY' ELSE 'OTHER_OBSERVABLE_REASON' END"""


CTES["exit_quotes"] = f"""
SELECT *, BASE AND coalesce(relative_spread<=0.2e0,false) AS STRICT_20, BASE AND coalesce(relative_spread<=0.1e0,false) AS STRICT_10,
  BASE AND coalesce(exit_quote_trade_volume>0,false) AS POSITIVE_VOLUME
FROM (SELECT *, (exit_bid+exit_ask)/2 AS exit_mid, (exit_ask-exit_bid)/nullif((exit_bid+exit_ask)/2,0e0) AS relative_spread
 FROM (SELECT *, processed_valid OR raw_valid AS BASE, CASE WHEN processed_valid THEN 'PROCESSED_1545' WHEN raw_valid THEN 'RAW_1545_RECOVERED' ELSE 'NO_VALID_1545_QUOTE' END AS exit_quote_source,
   CASE WHEN processed_valid THEN pbid WHEN raw_valid THEN rbid END AS exit_bid, CASE WHEN processed_valid THEN pask WHEN raw_valid THEN rask END AS exit_ask,
   CASE WHEN processed_valid THEN pvol WHEN raw_valid THEN rvol END AS exit_quote_trade_volume,
   CASE WHEN processed_valid THEN pspot WHEN raw_valid THEN rspot END AS exit_spot,
   coalesce(rvol=0,false) AS zero_volume_flag, coalesce(roi=0,false) AS zero_open_interest_flag, {category('reasons')} AS recovery_reason_category
  FROM (SELECT q.intended_exit_date, q.contract_key, p.bid AS pbid, p.ask AS pask, p.trade_volume AS pvol, p.spot AS pspot, w.bid_1545 AS rbid, w.ask_1545 AS rask,
     w.trade_volume AS rvol, w.open_interest AS roi, w.spot AS rspot, w.observable_failure_reasons AS reasons, coalesce(c.is_1545_open,false) AS calendar_guard_pass,
     coalesce(c.is_1545_open AND p.bid>0 AND p.ask>=p.bid,false) AS processed_valid, coalesce(c.is_1545_open AND w.bid_1545>0 AND w.ask_1545>=w.bid_1545,false) AS raw_valid
    FROM required q LEFT JOIN processed p ON p.quote_date=q.intended_exit_date AND p.contract_key=q.contract_key
    LEFT JOIN recovered w ON w.quote_date=q.intended_exit_date AND w.contract_key=q.contract_key LEFT JOIN calendar c ON c.session=q.intended_exit_date)))
"""
CTES["ready"] = "SELECT n.*, q.* EXCLUDE (intended_exit_date, contract_key) FROM net n JOIN exit_quotes q USING (intended_exit_date, contract_key)"
CTES["selection"] = """
SELECT model, decision_date, entry_date, intended_exit_date, count(*) AS number_selected_nodes FROM signals
WHERE selected AND intended_exit_date IS NOT NULL GROUP BY ALL
"""
CTES["audit"] = """
SELECT s.*, c1.session IS NOT NULL AS decision_session, coalesce(c2.is_1545_open,false) AS entry_snapshot_session, coalesce(c3.is_1545_open,false) AS exit_snapshot_session,
  c1.session IS NOT NULL AND coalesce(c2.is_1545_open,false) AND coalesce(c3.is_1545_open,false) AS economic_calendar_eligible,
  coalesce(e.n_mapped_contracts,0) AS n_mapped_contracts, coalesce(e.n_active_contracts,0) AS n_active_contracts
FROM selection s LEFT JOIN calendar c1 ON c1.session=s.decision_date LEFT JOIN calendar c2 ON c2.session=s.entry_date LEFT JOIN calendar c3 ON c3.session=s.intended_exit_date
LEFT JOIN (SELECT model, entry_date, count(*) AS n_mapped_contracts, count(*) FILTER (nonzero_net_position) AS n_active_contracts FROM ready GROUP BY ALL) e
  ON e.model=s.model AND e.entry_date=s.entry_date
"""
CTES["eligible"] = "SELECT r.* FROM ready r SEMI JOIN (SELECT * FROM audit WHERE economic_calendar_eligible) a ON a.model=r.model AND a.entry_date=r.entry_date"
CTES["contracts"] = """
SELECT *, pnl_mid-pnl_exec AS cost_wedge_pnl FROM (
 SELECT *, w*(exit_mid-entry_mid) AS pnl_mid, w*(exit_px-entry_px) AS pnl_exec, abs(w)*entry_mid AS prem_mid, abs(w)*entry_px AS prem_exec,
  (entry_ask-entry_bid)/nullif(entry_mid,0e0) AS relative_entry_spread, (exit_ask-exit_bid)/nullif(exit_mid,0e0) AS relative_exit_spread,
  abs(w)*(entry_ask-entry_bid)/2 AS entry_spread_cost, abs(w)*(exit_ask-exit_bid)/2 AS exit_spread_cost
 FROM (SELECT *, weight_at_entry AS w, weight_at_entry AS signed_weight, intended_exit_date AS exit_date, (entry_bid+entry_ask)/2 AS entry_mid,
   CASE WHEN weight_at_entry>0 THEN entry_ask ELSE entry_bid END AS entry_px, CASE WHEN weight_at_entry>0 THEN exit_bid ELSE exit_ask END AS exit_px
  FROM eligible WHERE nonzero_net_position))
"""
CTES["daily"] = """
SELECT *, PnL_mid/nullif(GrossPremium_mid,0e0) AS Return_mid, PnL_exec/nullif(GrossPremium_exec,0e0) AS Return_exec, PnL_mid-PnL_exec AS cost_wedge_pnl,
  PnL_mid/nullif(GrossPremium_mid,0e0)-PnL_exec/nullif(GrossPremium_exec,0e0) AS cost_wedge_return
FROM (SELECT model, entry_date, min(decision_date) AS decision_date, min(exit_date) AS exit_date, sum(pnl_mid) AS PnL_mid, sum(pnl_exec) AS PnL_exec,
  sum(prem_mid) AS GrossPremium_mid, sum(prem_exec) AS GrossPremium_exec, count(*) AS number_contracts,
  count(*) FILTER (exit_quote_source='RAW_1545_RECOVERED') AS number_raw_recovered_exits, count(*) FILTER (exit_quote_source='PROCESSED_1545') AS number_processed_exits,
  sum(abs(w)) AS net_gross_weight, sum(w) AS net_signed_weight, sum(entry_spread_cost) AS entry_spread_cost, sum(exit_spread_cost) AS exit_spread_cost
  FROM contracts GROUP BY model, entry_date)
JOIN (SELECT model, entry_date, count(*) AS number_unique_mapped_contracts, sum(n_mapped_nodes) AS number_mapped_nodes, sum(node_gross_weight) AS gross_pre_net_signal_weight
  FROM eligible GROUP BY ALL) USING (model, entry_date)
JOIN (SELECT model, entry_date, number_selected_nodes FROM audit) USING (model, entry_date)
"""
_G = ("Delta", "Gamma", "Vega", "Theta")


def controls_sql(source: str, weight: str) -> str:
    nets = ", ".join(
        f"CASE WHEN count(entry_{g})=count(*) THEN sum({weight}*entry_{g}) END AS Net{g}, CASE WHEN count(entry_{g})=count(*) THEN sum(abs({weight}*entry_{g})) END AS GrossAbs{g}"
        for g in _G
    )
    return f"""SELECT *, CASE WHEN vega_balance_available THEN least(LongVega,ShortVegaMagnitude) END AS B,
  CASE WHEN vega_balance_available THEN least(LongVega,ShortVegaMagnitude)/LongVega END AS a_L,
  CASE WHEN vega_balance_available THEN least(LongVega,ShortVegaMagnitude)/ShortVegaMagnitude END AS a_S,
  CASE WHEN vega_balance_available THEN 'AVAILABLE' ELSE 'INVALID_OR_ZERO_LEG_VEGA' END AS vega_balance_status,
  CASE WHEN GrossAbsVega>0 THEN NetVega/GrossAbsVega END AS VegaImbalance, -NetDelta AS hedge_quantity
 FROM (SELECT *, coalesce(LongVega>0 AND ShortVegaMagnitude>0,false) AS vega_balance_available FROM (
  SELECT model, entry_date, CASE WHEN bool_and(coalesce(entry_Vega>0,false)) THEN coalesce(sum({weight}*entry_Vega) FILTER ({weight}>0),0e0) END AS LongVega,
   CASE WHEN bool_and(coalesce(entry_Vega>0,false)) THEN coalesce(-sum({weight}*entry_Vega) FILTER ({weight}<0),0e0) END AS ShortVegaMagnitude, {nets}
  FROM {source} GROUP BY model, entry_date))"""


CTES["controls"] = controls_sql("contracts", "w")
CTES["spots"] = """
SELECT *, CASE WHEN entry_spot_valid THEN entry_spot_min END AS S_entry, CASE WHEN exit_spot_valid THEN exit_spot_min END AS S_exit,
  entry_spot_valid AND exit_spot_valid AS spot_valid,
  CASE WHEN exit_spot_valid THEN exit_spot_min END-CASE WHEN entry_spot_valid THEN entry_spot_min END AS dS
FROM (SELECT model, entry_date, min(decision_date) AS decision_date, min(exit_date) AS exit_date, min(entry_spot) AS entry_spot_min, max(entry_spot) AS entry_spot_max,
  max(entry_spot)-min(entry_spot) AS entry_spot_dispersion, bool_and(coalesce(entry_spot>0,false)) AND max(entry_spot)-min(entry_spot)<=1e-8 AS entry_spot_valid,
  min(exit_spot) AS exit_spot_min, max(exit_spot) AS exit_spot_max, max(exit_spot)-min(exit_spot) AS exit_spot_dispersion,
  bool_and(coalesce(exit_spot>0,false)) AND max(exit_spot)-min(exit_spot)<=1e-8 AS exit_spot_valid
  FROM contracts GROUP BY model, entry_date)
"""
CTES["scaled"] = """
SELECT *, wv*(exit_mid-entry_mid) AS vb_mid, wv*(exit_px-entry_px) AS vb_exec, abs(wv)*entry_mid AS vb_prem_mid, abs(wv)*entry_px AS vb_prem_exec
FROM (SELECT c.* , c.w*CASE WHEN c.w>0 THEN k.a_L ELSE k.a_S END AS wv FROM contracts c JOIN controls k USING (model, entry_date) WHERE k.vega_balance_available)
"""
_NETS = ", ".join(f"Net{g}" for g in _G)


def _finish(state: str, source: str, hedge: str, available: str) -> str:
    under = f"CASE WHEN {available} THEN ({hedge})*dS END" if "DELTA" in state else "0e0"
    return f"""SELECT *, PnL_mid/nullif(GrossPremium_mid,0e0) AS Return_mid, PnL_exec/nullif(GrossPremium_exec,0e0) AS Return_exec FROM (
 SELECT model, entry_date, decision_date, exit_date, '{state}' AS portfolio_state, {available} AS available, number_contracts,
  CASE WHEN {available} THEN PnL_mid+({under}) END AS PnL_mid, CASE WHEN {available} THEN PnL_exec+({under}) END AS PnL_exec, GrossPremium_mid, GrossPremium_exec,
  {under} AS PnL_underlying, {hedge} AS hedge_quantity, NetDelta AS option_NetDelta, NetDelta+({hedge}) AS NetDelta, NetGamma, NetVega, NetTheta FROM {source})"""


CTES["base_states"] = f"""
SELECT d.model, d.entry_date, d.decision_date, d.exit_date, d.number_contracts, d.PnL_mid, d.PnL_exec, d.GrossPremium_mid, d.GrossPremium_exec,
  {', '.join(f'k.Net{g}' for g in _G)}, s.dS, s.spot_valid FROM daily d JOIN controls k USING (model, entry_date) JOIN spots s USING (model, entry_date)
"""
CTES["scaled_controls"] = controls_sql("scaled", "wv")
CTES["vega_states"] = f"""
SELECT d.model, d.entry_date, d.decision_date, d.exit_date, t.number_contracts, t.PnL_mid, t.PnL_exec, t.GrossPremium_mid, t.GrossPremium_exec,
  {', '.join(f'k2.Net{g}' for g in _G)}, s.dS, s.spot_valid, k.vega_balance_available FROM daily d
LEFT JOIN (SELECT model, entry_date, sum(vb_mid) AS PnL_mid, sum(vb_exec) AS PnL_exec, sum(vb_prem_mid) AS GrossPremium_mid, sum(vb_prem_exec) AS GrossPremium_exec,
  count(*) AS number_contracts FROM scaled GROUP BY ALL) t USING (model, entry_date)
JOIN controls k USING (model, entry_date) LEFT JOIN scaled_controls k2 USING (model, entry_date) JOIN spots s USING (model, entry_date)
"""
CTES["states"] = " UNION ALL ".join(
    (
        _finish("ORIGINAL", "base_states", "0e0", "true"),
        _finish("DELTA_NEUTRAL", "base_states", "-NetDelta", "(spot_valid AND NetDelta IS NOT NULL)"),
        _finish("VEGA_BALANCED", "vega_states", "0e0", "vega_balance_available"),
        _finish("VEGA_BALANCED_DELTA_NEUTRAL", "vega_states", "-NetDelta", "(vega_balance_available AND spot_valid AND NetDelta IS NOT NULL)"),
    )
)
CTES["live_states"] = "SELECT * FROM states WHERE available"
CTES["state_returns"] = """
SELECT model, portfolio_state, entry_date, decision_date, 'MID' AS implementation, Return_mid AS Return, PnL_mid AS PnL, GrossPremium_mid AS GrossPremium, number_contracts FROM live_states
UNION ALL SELECT model, portfolio_state, entry_date, decision_date, 'BID_ASK', Return_exec, PnL_exec, GrossPremium_exec, number_contracts FROM live_states
"""
CTES["signal_daily"] = """
SELECT a.*, i.rank_ic FROM (
 SELECT *, long_mean_change-short_mean_change AS top_minus_bottom, (long_hit_rate+short_hit_rate)/2 AS balanced_hit_rate FROM (
 SELECT model, decision_date, count(*) AS n_common_candidates, count(*) FILTER (scored) AS n_scored_nodes, count(*) FILTER (signal=1) AS n_selected_long,
  count(*) FILTER (signal=-1) AS n_selected_short, count(*) FILTER (signal=1 AND done) AS n_scored_long, count(*) FILTER (signal=-1 AND done) AS n_scored_short,
  avg(actual_holding_change) FILTER (signal=1 AND done) AS long_mean_change, avg(actual_holding_change) FILTER (signal=-1 AND done) AS short_mean_change,
  avg(CASE WHEN actual_holding_change>0 THEN 1e0 ELSE 0e0 END) FILTER (signal=1 AND done) AS long_hit_rate,
  avg(CASE WHEN actual_holding_change<0 THEN 1e0 ELSE 0e0 END) FILTER (signal=-1 AND done) AS short_hit_rate
 FROM (SELECT *, actual_iv_entry IS NOT NULL AND actual_iv_exit IS NOT NULL AS scored, actual_holding_change IS NOT NULL AS done FROM signals WHERE common_economic_candidate)
 GROUP BY model, decision_date)) a
LEFT JOIN (SELECT model, decision_date, CASE WHEN count(*)>=10 AND min(rx)<max(rx) AND min(ry)<max(ry) THEN corr(rx,ry) END AS rank_ic FROM (
  SELECT model, decision_date, rank() OVER (PARTITION BY model,decision_date ORDER BY raw_signal)+(count(*) OVER (PARTITION BY model,decision_date,raw_signal)-1)/2e0 AS rx,
   rank() OVER (PARTITION BY model,decision_date ORDER BY actual_holding_change)+(count(*) OVER (PARTITION BY model,decision_date,actual_holding_change)-1)/2e0 AS ry
  FROM signals WHERE common_economic_candidate AND actual_iv_entry IS NOT NULL AND actual_iv_exit IS NOT NULL) GROUP BY ALL) i USING (model, decision_date)
"""
CTES["diagnostics"] = """
SELECT d.*, s.* EXCLUDE (model, decision_date), x.dispersion AS predicted_cross_sectional_dispersion, x.spread AS predicted_cross_sectional_range
FROM daily d LEFT JOIN signal_daily s USING (model, decision_date)
LEFT JOIN (SELECT model, decision_date, stddev_samp(raw_signal) AS dispersion, max(raw_signal)-min(raw_signal) AS spread FROM signals WHERE common_economic_candidate GROUP BY ALL) x
  USING (model, decision_date)
"""
CTES["attribution"] = f"""
SELECT *, CASE WHEN DGVT_available THEN p_iv-entry_implied_vol END AS dIV_exact_contract, CASE WHEN DGVT_available THEN w*entry_Vega*(p_iv-entry_implied_vol) END AS Vega_component,
  CASE WHEN DGVT_available THEN DGT_residual-w*entry_Vega*(p_iv-entry_implied_vol) END AS DGVT_residual
FROM (SELECT *, coalesce(exit_quote_source='PROCESSED_1545' AND DGT_available AND quality_ok AND p_iv>0 AND entry_implied_vol>0 AND p_T>0 AND abs(p_mid-exit_mid)<=1e-10 AND abs(p_bid-exit_bid)<=1e-10
   AND abs(p_ask-exit_ask)<=1e-10 AND abs(entry_T-p_T-dt_years)<=1e-10 AND entry_source_observation_count=1 AND p_n=1
   AND entry_error<=1e-3 AND exit_error<=1e-3,false) AS DGVT_available, pnl_mid-Delta_component-Gamma_component-Theta_component AS DGT_residual
 FROM (SELECT *, CASE WHEN DGT_available THEN w*entry_Delta*dS END AS Delta_component, CASE WHEN DGT_available THEN 0.5e0*w*entry_Gamma*dS*dS END AS Gamma_component,
   CASE WHEN DGT_available THEN w*entry_Theta*dt_years END AS Theta_component,
   abs({price_sql('entry_spot', 'entry_T', 'entry_r', 'entry_q', 'entry_implied_vol')}-entry_mid) AS entry_error,
   CASE WHEN p_T>0 THEN abs({price_sql('exit_spot', 'p_T', 'p_r', 'p_q', 'p_iv')}-exit_mid) END AS exit_error
  FROM (SELECT c.*, s.S_entry, s.S_exit, s.dS, s.spot_valid, (c.exit_date-c.entry_date)/365e0 AS dt_years, s.spot_valid AND c.entry_Delta IS NOT NULL AS DGT_available,
     c.entry_Vega>0 AND c.entry_Gamma>0 AS quality_ok,
     p.implied_vol AS p_iv, p.T AS p_T, p.r AS p_r, p.q AS p_q, p.mid AS p_mid, p.bid AS p_bid, p.ask AS p_ask, p.source_observation_count AS p_n
    FROM contracts c JOIN spots s USING (model, entry_date) LEFT JOIN processed p ON p.quote_date=c.intended_exit_date AND p.contract_key=c.contract_key)))
"""


def hac_cte(source: str, keys: list[str], value: str, order: str, lag: int = 5, student: bool = False) -> str:
    """HAC mean test over `source` as a derived table (se, t, p, mean, median, n)."""
    k = ", ".join(keys)
    where = f"WHERE {value} IS NOT NULL" if student else ""
    lags = ", ".join(f"lag(u,{i}) OVER (PARTITION BY {k} ORDER BY o) AS u{i}" for i in range(1, lag + 1))
    meat = "sum(u*u)" + "".join(f"+{num(2 * (1 - i / (lag + 1)))}*coalesce(sum(u*u{i}),0e0)" for i in range(1, lag + 1))
    least = 2 if student else max(7, lag + 2)
    return f"""SELECT {k}, n, CASE WHEN ok THEN mean END AS mean, CASE WHEN ok THEN median END AS median, CASE WHEN ok THEN se END AS HAC_standard_error,
 CASE WHEN ok THEN mean/nullif(se,0e0) END AS HAC_t_stat, CASE WHEN ok THEN {normal_p('(mean/nullif(se,0e0))')} END AS raw_p, {lag} AS HAC_lag
FROM (SELECT *, n>={least} AND n_finite=n AS ok, sqrt(greatest(meat,0e0)/nullif(CAST(n AS DOUBLE)*(n-1),0e0)) AS se FROM (
 SELECT {k}, count(*) AS n, count(x) AS n_finite, avg(x) AS mean, median(x) AS median, {meat} AS meat FROM (
  SELECT *, {lags} FROM (SELECT {k}, {order} AS o, {value} AS x, {value}-avg({value}) OVER (PARTITION BY {k}) AS u FROM {source} {where}))
 GROUP BY {k}))"""


def adjust_sql(source: str, family: list[str], tie: list[str]) -> str:
    f, t = ", ".join(family), "".join(", " + x for x in tie)
    part = f"PARTITION BY {f}" if family else ""
    return f"""SELECT *, holm_adjusted_p<=0.05e0 AS holm_reject_5pct, BH_adjusted_p<=0.05e0 AS BH_reject_5pct FROM (
 SELECT * EXCLUDE (rk, h, b), least(1e0, max(h) OVER ({part} ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm_adjusted_p,
  least(1e0, min(b) OVER ({part} ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BH_adjusted_p
 FROM (SELECT *, raw_p*(family_size-rk+1) AS h, raw_p*family_size/rk AS b FROM (
  SELECT *, row_number() OVER ({part} ORDER BY raw_p{t}) AS rk, count(*) OVER ({part}) AS family_size FROM {source})))"""


def draws_sql(source: str, keys: list[str], columns: list[str], order: str, block: int, reps: int, seed: int = 42) -> str:
    """Circular block resample sums by joining every drawn position."""
    k = ", ".join(keys)
    kk = ", ".join(f"p.{x}" for x in keys)
    on = " AND ".join(f"p.{x}=z.{x}" for x in keys)
    return f"""SELECT {kk}, z.rep, z.n, {', '.join(f'sum(p.{c}) AS {c}' for c in columns)} FROM (
 SELECT {k}, n, rep, (CAST('0x'||substr(md5('{seed}-'||rep||'-'||blk),1,8) AS BIGINT)%n+off)%n AS pos FROM (
  SELECT {k}, n, unnest(range({reps})) AS rep, blk, off FROM (SELECT {k}, n, blk, unnest(range(least({block},n-blk*{block}))) AS off FROM (
   SELECT {k}, n, unnest(range(CAST(ceil(n/{block}e0) AS BIGINT))) AS blk FROM (SELECT {k}, count(*) AS n FROM {source} GROUP BY {k}))))) z
JOIN (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {order})-1 AS pos FROM {source}) p ON {on} AND p.pos=z.pos GROUP BY {kk}, z.rep, z.n"""


def _expand_rounding(text: str) -> str:
    out, i = [], 0
    for m in re.finditer(r"\bR(\d+)\(", text):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out += [text[i : m.start()], f"(round(CAST(({text[m.end() : j - 1]}) AS DOUBLE),{m.group(1)})+0e0)"]
        i = j
    return "".join(out) + text[i:]


def compose(query: str) -> str:
    """The query with every table expression it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str, busy: tuple = ()):
        for name in CTES:
            if name not in needed and name not in busy and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name], (*busy, name))
                needed.append(name)

    visit(query)
    head = ", ".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in needed)
    text = f"WITH {head} {query}" if head else query
    return _expand_rounding(text)
