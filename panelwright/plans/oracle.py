"""SQL twins of the registered queries, written independently of the Spark code.

Each twin is a chain of common table expressions ending in a SELECT with the query's columns.
Twins may use plans that would not scale (self-joins over a day, global windows): they only
state what the right answer is.
"""

from __future__ import annotations

SPLITS = (
    ("train", "1995-01-01", "1999-01-01"),
    ("valid", "1999-01-01", "2000-07-01"),
    ("test", "2000-07-01", "2002-01-01"),
)


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + select.strip()


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {name}"


# --- fixtures ------------------------------------------------------------------------------

EVENT_FEEDS = """
ev AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS sid, event_id, event_type, value FROM events),
bars AS (
  SELECT date, sid, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
         CASE WHEN arg_max(value, event_id) >= 1.0 THEN arg_max(value, event_id) END AS close,
         CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS volume
  FROM ev WHERE event_type <> 'view' GROUP BY date, sid),
fac AS (
  SELECT date, sid,
         CAST(round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS FLOAT) AS f1,
         CAST(round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS FLOAT) AS f2,
         CAST(CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0
                   THEN max(CASE WHEN value >= 30 THEN value END) END AS FLOAT) AS f3
  FROM ev WHERE event_type IN ('view', 'purchase') GROUP BY date, sid)
"""

SUPPLIER_FEEDS = """
line AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS sid,
                l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber, l_partkey,
                l_quantity, l_discount, l_tax, l_returnflag FROM lineitem),
bars AS (
  SELECT date, sid, first(price ORDER BY l_orderkey, l_linenumber, l_partkey) AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY l_orderkey, l_linenumber, l_partkey) AS close, sum(l_quantity) AS volume
  FROM line GROUP BY date, sid),
fac AS (
  SELECT date, sid,
         CAST(round(avg(l_discount) FILTER (WHERE l_returnflag = 'A'), 6) AS FLOAT) AS discount,
         CAST(max(price) AS FLOAT) AS top_price,
         CAST(round(avg(l_quantity), 6) AS FLOAT) AS quantity,
         CAST(round(avg(l_tax) FILTER (WHERE l_returnflag <> 'A'), 6) AS FLOAT) AS tax
  FROM line GROUP BY date, sid)
"""

EVENT_FEATURES = ("f1", "f2", "f3")
SUPPLIER_FEATURES = ("discount", "top_price", "quantity", "tax")


def _panel(grace: int, features: tuple[str, ...]) -> str:
    n_missing = " + ".join(f"CAST(f.{x} IS NULL AS INTEGER)" for x in features)
    values = ", ".join(f"f.{x}" for x in features)
    return f"""
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS td FROM (SELECT DISTINCT date FROM bars)),
master AS (
  SELECT sid, sid AS symbol, min(date) AS list_date,
         CASE WHEN max(date) < (SELECT max(date) FROM bars) - {grace} THEN max(date) END AS delist_date
  FROM bars GROUP BY sid),
idx AS (
  SELECT c.date, c.td, m.* FROM cal c JOIN master m
  ON c.date >= m.list_date AND (m.delist_date IS NULL OR c.date <= m.delist_date)),
joined AS (
  SELECT i.*, b.open, b.high, b.low, b.close, b.volume, {values},
         b.sid IS NOT NULL AS hm, f.sid IS NOT NULL AS hf,
         CAST(CASE WHEN f.sid IS NOT NULL THEN CAST({n_missing} AS DOUBLE) / {len(features)} ELSE 1.0 END AS FLOAT) AS ratio
  FROM idx i LEFT JOIN bars b ON b.date = i.date AND b.sid = i.sid LEFT JOIN fac f ON f.date = i.date AND f.sid = i.sid),
panel AS (
  SELECT *, true AS is_listed, NOT hm AS is_suspended, hm AS has_market_record, hf AS has_factor_record,
         NOT hm OR close IS NULL AS bar_missing, NOT hf AS factor_row_missing,
         ratio AS factor_missing_ratio, ratio >= 1 AS feature_all_missing,
         CASE WHEN NOT hm THEN 'SUSPENDED' WHEN close IS NULL THEN 'PARTIAL_MISSING' ELSE 'OK' END AS market_state,
         CASE WHEN NOT hf THEN 'ROW_MISSING' WHEN ratio >= 1 THEN 'ALL_MISSING' WHEN ratio > 0 THEN 'PARTIAL_MISSING' ELSE 'OK' END AS factor_state,
         CASE WHEN NOT hm AND NOT hf THEN 'NO_SOURCE_RECORD' WHEN NOT hm THEN 'SUSPENDED' WHEN NOT hf THEN 'MARKET_ONLY'
              WHEN ratio > 0 THEN 'PARTIAL_FACTOR_MISSING' ELSE 'NORMAL' END AS sample_state,
         hf AND ratio < 1 AS sample_usable_for_feature
  FROM joined)
"""


EVENTS = EVENT_FEEDS.strip() + ",\n" + _panel(3, EVENT_FEATURES).strip()
SUPPLIERS = SUPPLIER_FEEDS.strip() + ",\n" + _panel(90, SUPPLIER_FEATURES).strip()


# --- targets -------------------------------------------------------------------------------

FORMULAS = {
    "return_c0c1": ("close", 0, "close", 1),
    "return_o1c2": ("open", 1, "close", 2),
    "return_5d": ("close", 0, "close", 5),
    "return_o1c5": ("open", 1, "close", 5),
    "return_20d": ("close", 0, "close", 20),
    "return_c1c2": ("close", 1, "close", 2),
}


def _return(name: str) -> str:
    """CTE `name`(date, sid, td, value, valid, reason) by explicit self-joins on the trading-day index."""
    entry, a, exit_, b = FORMULAS[name]
    return f"""
{name}_px AS (
  SELECT p.date, p.sid, p.td, e.{entry} AS pe, x.{exit_} AS px, (SELECT count(*) FROM cal) AS n
  FROM panel p LEFT JOIN panel e ON e.sid = p.sid AND e.td = p.td + {a}
               LEFT JOIN panel x ON x.sid = p.sid AND x.td = p.td + {b}),
{name}_rs AS (
  SELECT *, CASE WHEN td + {a} >= n THEN 'insufficient_history' WHEN td + {b} >= n THEN 'insufficient_forward'
                 WHEN pe IS NULL OR pe <= 0 THEN 'missing_entry_price'
                 WHEN px IS NULL OR px <= 0 THEN 'missing_exit_price' ELSE '' END AS reason FROM {name}_px),
{name} AS (
  SELECT date, sid, td, CASE WHEN reason = '' THEN CAST((px - pe) / pe AS FLOAT) END AS value, reason = '' AS valid, reason
  FROM {name}_rs)
"""


def _momentum() -> str:
    joins = "\n".join(f"LEFT JOIN panel p{k} ON p{k}.sid = p.sid AND p{k}.td = p.td + {k}" for k in range(1, 7))
    signs = ", ".join(f"CAST(sign(c{k} - b) AS INTEGER) AS s{k}" for k in range(7))
    closes = ", ".join(["p.close AS c0"] + [f"p{k}.close AS c{k}" for k in range(1, 7)])
    bad = " OR ".join(f"coalesce({c}, 0) <= 0" for c in ["b"] + [f"c{k}" for k in range(7)])
    crossings = " + ".join(f"CAST(s{k} * s{k + 1} = -1 AS INTEGER)" for k in range(6))
    first = "coalesce(" + ", ".join(f"nullif(s{k}, 0)" for k in range(7)) + ", 0)"
    last = "coalesce(" + ", ".join(f"nullif(s{k}, 0)" for k in reversed(range(7))) + ", 0)"
    return f"""
mom_px AS (
  SELECT p.date, p.sid, p.td, g.close AS b, {closes}, (SELECT count(*) FROM cal) AS n
  FROM panel p LEFT JOIN panel g ON g.sid = p.sid AND g.td = p.td - 4
  {joins}),
mom_rs AS (
  SELECT *, CASE WHEN td < 4 THEN 'insufficient_history' WHEN td + 6 >= n THEN 'insufficient_forward_window'
                 WHEN {bad} THEN 'missing_close_in_window' ELSE '' END AS reason, {signs} FROM mom_px),
mom_shape AS (SELECT *, {crossings} AS crossings, {first} AS fs, {last} AS ls FROM mom_rs),
momentum_cls AS (
  SELECT date, sid, td, CASE WHEN reason <> '' THEN NULL WHEN crossings = 0 AND fs > 0 THEN 3 WHEN crossings = 0 AND fs < 0 THEN 1
                    WHEN crossings = 1 AND fs < 0 AND ls > 0 THEN 4 WHEN crossings = 1 AND fs > 0 AND ls < 0 THEN 0 ELSE 2 END AS value,
         reason = '' AS valid, reason FROM mom_shape)
"""


def _target(name: str) -> str:
    return _momentum() if name == "momentum_cls" else _return(name)


TARGETS = (*FORMULAS, "momentum_cls")
FORMULAS["c0c3"] = ("close", 0, "close", 3)
LABEL_COLUMNS = f"{_r('value', 'label')}, valid AS label_valid, reason AS label_reason"


def _avg_rank(value: str, by: str) -> str:
    """Average rank from 1 of non-null values."""
    over = f"PARTITION BY {by}, {value} IS NULL"
    return (
        f"(rank() OVER ({over} ORDER BY {value}) + (count(*) OVER ({over}, {value}) - 1) / 2.0)"
    )


# --- views and evaluation rows -------------------------------------------------------------

ENCODED = f"""
view_rows AS (
  SELECT p.date, p.sid, p.td,
         {", ".join(f"coalesce(p.f{i}, 0) AS x{i - 1}" for i in (1, 2, 3))},
         {", ".join(f"CAST(p.f{i} IS NULL AS INTEGER) AS x{i + 2}" for i in (1, 2, 3))},
         CAST(p.sample_usable_for_feature AS INTEGER) AS x6,
         p.sample_usable_for_feature AS present,
         coalesce(r.value, 0) AS y_ret, CASE WHEN m.valid THEN CAST(m.value AS INTEGER) ELSE -1 END AS y_mom,
         r.valid AS ret_mask, m.valid AS mom_mask, r.valid AND m.valid AS both_mask
  FROM panel p JOIN return_c0c1 r ON r.date = p.date AND r.sid = p.sid
               JOIN momentum_cls m ON m.date = p.date AND m.sid = p.sid)
"""
ENCODED_PARTS = (EVENTS, _return("return_c0c1"), _momentum(), ENCODED)
CELL_COLUMNS = ", ".join(_r(f"x{i}", f"x{i}") for i in range(7))
MASK_COLUMNS = "ret_mask, mom_mask, both_mask"

SAMPLE = """
sampled AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY CAST(present AS INTEGER) DESC,
                   md5('42|' || CAST(date AS VARCHAR) || '|' || sid), sid) - 1 AS INTEGER) AS sample_pos
    FROM view_rows) WHERE sample_pos < 512),
ring AS (SELECT sid, row_number() OVER (ORDER BY md5(sid), sid) - 1 AS code, count(*) OVER () AS n FROM (SELECT DISTINCT sid FROM master)),
short AS (SELECT date, CAST(count(*) AS INTEGER) AS held, CAST('0x' || substr(md5('42|' || CAST(date AS VARCHAR)), 1, 8) AS BIGINT) AS drawn
          FROM sampled GROUP BY date HAVING count(*) < 512),
free AS (SELECT s.date, s.held, r.sid, row_number() OVER (PARTITION BY s.date ORDER BY (r.code - s.drawn % r.n + r.n) % r.n) AS place
         FROM short s CROSS JOIN ring r WHERE NOT EXISTS (SELECT 1 FROM sampled x WHERE x.date = s.date AND x.sid = r.sid)),
filled AS (
  SELECT date, td, sid, present, y_ret, y_mom, ret_mask, mom_mask, both_mask, sample_pos FROM sampled
  UNION ALL
  SELECT f.date, c.td, f.sid, false, CAST(0 AS FLOAT), -1, false, false, false, CAST(held + place - 1 AS INTEGER)
  FROM free f JOIN cal c ON c.date = f.date WHERE place <= 512 - held)
"""

MODEL = """
model_rows AS (
  SELECT p.date, p.sid, CAST(coalesce(r.value, 0) AS DOUBLE) AS y_ret, r.valid AS ret_mask,
         CASE WHEN m.valid THEN CAST(m.value AS INTEGER) ELSE -1 END AS y_mom,
         coalesce((p.close - p.open) / (p.close + p.open), 0.0) AS pred_ret,
         CASE WHEN p.date < DATE '2024-01-16' THEN 'first' ELSE 'second' END AS split
  FROM panel p JOIN return_c0c1 r ON r.date = p.date AND r.sid = p.sid
               JOIN momentum_cls m ON m.date = p.date AND m.sid = p.sid),
logit_rows AS (
  SELECT *, -pred_ret AS z0, pred_ret / 4 AS z1, CAST(0.25 AS DOUBLE) AS z2, pred_ret / 2 AS z3, pred_ret AS z4 FROM model_rows),
scored_rows AS (
  SELECT *, greatest(z0, z1, z2, z3, z4) AS zmax,
         CASE y_mom WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z2 WHEN 3 THEN z3 WHEN 4 THEN z4 END AS zy,
         ln(exp(z0) + exp(z1) + exp(z2) + exp(z3) + exp(z4)) AS lse FROM logit_rows),
class_rows AS (
  SELECT *, CASE WHEN z0 = zmax THEN 0 WHEN z1 = zmax THEN 1 WHEN z2 = zmax THEN 2 WHEN z3 = zmax THEN 3 ELSE 4 END AS picked
  FROM scored_rows)
"""
MODEL_PARTS = (EVENTS, _return("return_c0c1"), _momentum(), MODEL)

RELEVANCE = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY date, ret_mask ORDER BY y_ret DESC, md5(sid)) - 1 AS pos,
         count(*) FILTER (WHERE ret_mask) OVER (PARTITION BY date) AS nv FROM model_rows),
relevant AS (
  SELECT *, CASE WHEN ret_mask THEN CAST(greatest(0, least(4, 4 - floor(pos / (nv / CAST(5 AS DOUBLE))))) AS INTEGER) ELSE 0 END AS relevance
  FROM placed)
"""

PAIRWISE = """
by_score AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred_ret DESC, md5(sid)) - 1 AS rnk,
         row_number() OVER (PARTITION BY date ORDER BY relevance DESC) - 1 AS ideal FROM relevant),
disc AS (
  SELECT *, CASE WHEN rnk < 20 THEN 1 / log2(rnk + 2) ELSE 0 END AS d, pow(2.0, relevance) - 1 AS g FROM by_score),
idcg AS (
  SELECT date, sum(CASE WHEN ideal < 20 THEN g / log2(ideal + 2) ELSE 0 END) AS idcg, sum(g * d) AS dcg FROM disc GROUP BY date),
pairs AS (
  SELECT i.date, least(10.0, abs(i.g - j.g) * abs(i.d - j.d) / (q.idcg + 1e-8))
                 * ln(1 + exp(-greatest(-10.0, least(10.0, i.pred_ret - j.pred_ret)))) AS loss
  FROM disc i JOIN disc j ON i.date = j.date AND i.relevance > j.relevance AND i.ret_mask AND j.ret_mask
              JOIN idcg q ON q.date = i.date),
pair_days AS (
  SELECT d.date, coalesce(sum(p.loss), 0) AS pair_loss, count(p.loss) AS n_pairs
  FROM (SELECT DISTINCT date FROM disc) d LEFT JOIN pairs p ON p.date = d.date GROUP BY d.date)
"""

IC = """
ic_ranked AS (
  SELECT date, y_ret AS y, pred_ret AS p,
         row_number() OVER (PARTITION BY date ORDER BY y_ret, md5(sid)) AS oy,
         row_number() OVER (PARTITION BY date ORDER BY pred_ret, md5(sid)) AS op
  FROM model_rows WHERE ret_mask),
ic_days AS (
  SELECT date, count(*) AS n_rows,
         covar_pop(p, y) / (sqrt(var_pop(p) + 1e-12) * sqrt(var_pop(y) + 1e-12) + 1e-12) AS ic,
         covar_pop(op, oy) / (sqrt(var_pop(op) + 1e-12) * sqrt(var_pop(oy) + 1e-12) + 1e-12) AS rank_ic
  FROM ic_ranked GROUP BY date HAVING count(*) >= 2)
"""


def _rollup(ret_cte: str) -> str:
    return f"""
ret_days AS ({ret_cte}),
cls_days AS (
  SELECT date, avg(lse - zy) AS ce_loss, avg(CASE WHEN y_mom >= 0 THEN CAST(picked = y_mom AS INTEGER) END) AS accuracy
  FROM class_rows GROUP BY date),
rolled AS (
  SELECT s.split, avg(r.ret_loss) AS ret_loss, avg(c.ce_loss) AS ce_loss, avg(i.ic) AS ic, avg(i.rank_ic) AS rank_ic,
         avg(c.accuracy) AS accuracy
  FROM (SELECT DISTINCT date, split FROM model_rows) s LEFT JOIN ret_days r ON r.date = s.date
       LEFT JOIN cls_days c ON c.date = s.date LEFT JOIN ic_days i ON i.date = s.date GROUP BY s.split)
"""


MSE_DAYS = """
SELECT date, sum(CASE WHEN ret_mask THEN (pred_ret - y_ret) * (pred_ret - y_ret) ELSE 0 END)
             / (sum(CAST(ret_mask AS INTEGER)) + 1e-12) AS ret_loss FROM model_rows GROUP BY date
"""
ROLLUP_COLUMNS = ", ".join(
    [_r(c, c) for c in ("ret_loss", "ce_loss", "ic", "rank_ic", "accuracy")] + [_r("ret_loss + ce_loss", "loss")]
)

SPLIT_CASE = "CASE " + " ".join(f"WHEN v.date >= DATE '{s}' AND v.date < DATE '{e}' THEN '{n}'" for n, s, e in SPLITS) + " END"
SUPPLIER_VIEW = f"""
tab AS (
  SELECT v.*, {SPLIT_CASE} AS split, t.value AS y, t.valid AS y_valid, v.sample_usable_for_feature AS usable
  FROM panel v JOIN return_c0c1 t ON t.date = v.date AND t.sid = v.sid)
"""
SUPPLIER_VIEW_PARTS = (SUPPLIERS, _return("return_c0c1"), SUPPLIER_VIEW)

RANK_IC = f"""
preds AS (SELECT date, sid, split, y, quantity AS pred FROM tab WHERE y_valid AND usable AND split IS NOT NULL AND y IS NOT NULL AND quantity IS NOT NULL),
pred_ranks AS (SELECT *, {_avg_rank('y', 'date')} AS ry, {_avg_rank('pred', 'date')} AS rp FROM preds),
ric AS (
  SELECT date, any_value(split) AS split, count(*) AS n_pairs,
         covar_pop(ry, rp) / nullif(sqrt(var_pop(ry)) * sqrt(var_pop(rp)), 0) AS rank_ic FROM pred_ranks GROUP BY date),
ric_days AS (SELECT * FROM ric WHERE n_pairs >= 3 AND rank_ic IS NOT NULL)
"""

LABELLED_ROWS = """
rows_ AS (
  SELECT p.*, t.value AS y FROM panel p JOIN return_c0c1 t ON t.date = p.date AND t.sid = p.sid
  WHERE t.valid AND p.sample_usable_for_feature)
"""
LABELLED_PARTS = (EVENTS, _return("return_c0c1"), LABELLED_ROWS)

RAW_BARS = """
raw AS (
  SELECT CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
         CASE WHEN l_linestatus = 'F' AND l_linenumber = 6 THEN NULL ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SZ' END AS sid, *
  FROM lineitem),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, sid ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn
                 FROM raw WHERE date IS NOT NULL AND sid IS NOT NULL) WHERE rn = 1)
"""

YEARLY = """
lines AS (SELECT CAST(l_shipdate AS DATE) AS date, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || '.SZ' AS sid, year(l_shipdate) % 3 AS layout, * FROM lineitem),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, sid ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lines) WHERE rn = 1)
"""

WIDE_FEATURES = tuple(f"w{k}" for k in range(200))
WIDE = SUPPLIER_FEEDS.strip().replace("fac AS (", "narrow AS (") + f""",
most AS (SELECT date, sid, max(l_quantity) AS most FROM line GROUP BY date, sid),
fac AS (SELECT date, sid, {", ".join(f"CAST(CASE WHEN most % {k + 2} <> 0 THEN most * {k} END AS FLOAT) AS w{k}" for k in range(200))} FROM most),
""" + _panel(90, WIDE_FEATURES).strip()

FLAGS = (
    "is_listed", "is_suspended", "has_market_record", "has_factor_record",
    "bar_missing", "factor_row_missing", "feature_all_missing", "sample_usable_for_feature",
)


def _bins(rank: str, n: str, distinct: str, n_bins: int) -> str:
    share = f"({rank} - 1) / greatest(1.0, CAST({n} - 1 AS DOUBLE))"
    return (
        f"CASE WHEN {n} > 1 AND {distinct} > 1 THEN CAST(greatest(0, least({n_bins - 1}, floor({share} * {n_bins}))) AS INTEGER) ELSE 0 END"
    )


def _binned(source: str, value: str, n_bins: int) -> str:
    """CTE `binned`: relevance from the average rank of non-null values within the day."""
    return f"""
ranked_ AS (SELECT *, CAST({_avg_rank(value, 'date')} AS DOUBLE) AS rk FROM {source}),
day_ AS (SELECT date, count({value}) AS n_, count(DISTINCT {value}) AS d_ FROM {source} GROUP BY date),
binned AS (
  SELECT r.*, CASE WHEN {value} IS NULL THEN 0 ELSE {_bins('r.rk', 'q.n_', 'q.d_', n_bins)} END AS relevance
  FROM ranked_ r JOIN day_ q ON q.date = r.date)
"""


def _finding(severity: str, check: str, message: str, condition: str) -> str:
    return f"SELECT '{severity}' AS severity, '{check}' AS \"check\", '{message}' AS message FROM facts WHERE {condition}"


def _sanity() -> str:
    sums = ", ".join(f"count(*) FILTER (WHERE {f}) AS {f}" for f in FLAGS)
    states = "".join(f", count(DISTINCT {s}_state) AS n_{s}" for s in ("sample", "market", "factor"))
    has = (", count(*) FILTER (WHERE sample_state = 'SUSPENDED') AS susp, count(*) FILTER (WHERE market_state = 'OK') AS mok,"
           " count(*) FILTER (WHERE factor_state = 'OK') AS fok")
    rows = [_finding("FAIL", "empty", "panel has no rows", "n = 0")]
    for f in FLAGS[1:]:
        rows.append(_finding("SUSPICIOUS", f"{f}_single_value", f"{f} is all false", f"n > 0 AND {f} = 0"))
        rows.append(_finding("SUSPICIOUS", f"{f}_single_value", f"{f} is all true", f"n > 0 AND {f} = n"))
    for args in (
        ("FAIL", "no_suspension", "no row is suspended", "n > 0 AND is_suspended = 0"),
        ("SUSPICIOUS", "mostly_suspended", "more than half of the rows are suspended", "is_suspended > 0.5 * n"),
        ("SUSPICIOUS", "little_market_data", "fewer than half of the rows have a bar", "has_market_record < 0.5 * n"),
        ("SUSPICIOUS", "missing_ratio_flat", "factor_missing_ratio has one value", "n > 0 AND n_ratio < 2"),
        ("SUSPICIOUS", "sample_state_flat", "sample_state has fewer than two values", "n > 0 AND n_sample < 2"),
        ("FAIL", "sample_state_suspended", "sample_state never is SUSPENDED", "n > 0 AND susp = 0"),
        ("FAIL", "market_state_ok", "market_state never is OK", "n > 0 AND mok = 0"),
        ("SUSPICIOUS", "market_state_flat", "market_state has one value", "n > 0 AND n_market < 2"),
        ("FAIL", "factor_state_ok", "factor_state never is OK", "n > 0 AND fok = 0"),
        ("SUSPICIOUS", "factor_state_flat", "factor_state has one value", "n > 0 AND n_factor < 2"),
        ("SUSPICIOUS", "usable_all", "every row is usable", "n > 0 AND sample_usable_for_feature = n"),
        ("FAIL", "usable_none", "no row is usable", "n > 0 AND sample_usable_for_feature = 0"),
    ):
        rows.append(_finding(*args))
    facts = f"facts AS (SELECT count(*) AS n, {sums}{states}{has}, count(DISTINCT ratio) AS n_ratio FROM panel)"
    return _with(SUPPLIERS, facts, select="\nUNION ALL ".join(rows))


def _profile(parts: tuple[str, ...], t: str) -> str:
    quantiles = ", ".join(
        _r(f"quantile_cont(CAST(value AS DOUBLE), {p}) FILTER (WHERE valid)", n)
        for n, p in (("q01", 0.01), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q99", 0.99))
    )
    v = "CAST(value AS DOUBLE)"
    return _with(*parts, select=f"""
SELECT count(*) FILTER (WHERE valid) AS n, {_r(f'avg({v}) FILTER (WHERE valid)', 'mean')},
       {_r(f'stddev_samp({v}) FILTER (WHERE valid)', 'std')}, {_r('min(value) FILTER (WHERE valid)', '"min"')},
       {_r('max(value) FILTER (WHERE valid)', '"max"')}, count(*) FILTER (WHERE valid AND value IS NULL) AS n_missing,
       count(*) FILTER (WHERE valid AND abs({v}) > 0.1) AS over_10pct, count(*) FILTER (WHERE valid AND abs({v}) > 0.2) AS over_20pct,
       {quantiles} FROM {t}""")


def _screen() -> str:
    names = {"discount": "discount", "fund__top_price": "top_price", "quantity": "quantity", "tax": "tax"}
    parts = []
    for name, col in names.items():
        named_out = "quantity" in name
        parts.append(f"""
SELECT '{name}' AS feature, count(*) AS n_rows, var_pop(CAST({col} AS DOUBLE)) AS variance,
       avg(CAST({col} IS NULL AS INTEGER)) AS missing_rate, {str(named_out).lower()} AS out_ FROM train""")
    union = "\nUNION ALL\n".join(p.strip() for p in parts)
    return _with(
        *SUPPLIER_VIEW_PARTS,
        "train AS (SELECT * FROM tab WHERE split = 'train' AND y_valid AND usable)",
        f"prof AS ({union})",
        select=f"""
SELECT feature, n_rows, round(variance, 2) AS variance, {_r('missing_rate', 'missing_rate')},
       coalesce(variance > 0, false) AND missing_rate < 0.3 AND NOT out_ AS kept FROM prof""",
    )


def _split_ranges() -> str:
    """Index ranges by counting days, clamped into the calendar; starts leave 59 days."""
    def first(s: str) -> str:
        return f"greatest(greatest(0, least((SELECT count(*) FROM cal WHERE date < DATE '{s}'), last)), 59)"

    def final(e: str) -> str:
        return f"greatest(0, least((SELECT count(*) FROM cal WHERE date < DATE '{e}') - 1, last))"

    rows = [(n, s, e) for n, s, e in SPLITS] + [("train_valid", SPLITS[0][1], SPLITS[1][2])]
    selects = [
        f"SELECT '{n}' AS split, CAST({first(s)} AS INTEGER) AS start_idx, CAST({final(e)} AS INTEGER) AS end_idx FROM ends"
        for n, s, e in rows
    ]
    return "ends AS (SELECT count(*) - 1 AS last FROM cal),\nranges AS (" + "\nUNION ALL ".join(selects) + ")"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources and normalisation
    sql["symbol_normalize"] = """
WITH c AS (SELECT c_custkey, c_custkey % 6 AS style, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS d6,
                  substr('69480', CAST(floor(c_custkey / 6) AS INTEGER) % 5 + 1, 1) AS lead,
                  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS d5 FROM customer)
SELECT c_custkey,
       CASE style WHEN 0 THEN d6 || '.XSHE' WHEN 1 THEN d6 || '.xshg ' WHEN 2 THEN ' sh' || d6 WHEN 3 THEN 'SZ' || d6
                  WHEN 4 THEN d6 || '.v1.XBEJ' ELSE lead || d5 END AS raw,
       CASE style WHEN 0 THEN d6 || '.SZ' WHEN 1 THEN d6 || '.SH' WHEN 2 THEN d6 || '.SH' WHEN 3 THEN d6 || '.SZ'
                  WHEN 4 THEN d6 || '.v1.BJ'
                  ELSE lead || d5 || CASE WHEN lead IN ('6', '9') THEN '.SH' WHEN lead IN ('4', '8') THEN '.BJ' ELSE '.SZ' END END AS sid
FROM c"""
    sql["bars_dedup_first"] = _with(RAW_BARS, select=f"""
SELECT date, sid, {_r('l_extendedprice', '"open"')}, {_r('l_extendedprice * 2', 'high')}, {_r('l_extendedprice / 2', 'low')},
       {_r('l_extendedprice - l_quantity', '"close"')}, {_r('l_quantity', 'volume')}, {_r('l_tax', 'amount')},
       CAST(1.0 AS DOUBLE) AS adj_factor FROM firsts""")
    sql["yearly_bars_mixed"] = _with(YEARLY, select=f"""
SELECT date, sid, {_r('l_extendedprice', '"open"')}, {_r('l_extendedprice * 2', 'high')}, {_r('l_extendedprice / 2', 'low')},
       {_r('l_extendedprice - l_quantity', '"close"')}, {_r('CASE layout WHEN 0 THEN trunc(l_quantity) ELSE l_quantity END', 'volume')},
       {_r('CASE layout WHEN 1 THEN l_tax END', 'amount')}, CAST(1.0 AS DOUBLE) AS adj_factor FROM firsts""")
    sql["yearly_factors_mixed"] = _with(YEARLY, select=f"""
SELECT date, sid, {_r('CAST(l_quantity AS FLOAT)', 'quantity')}, {_r('CASE WHEN layout <> 1 THEN CAST(l_discount AS FLOAT) END', 'discount')},
       {_r('CASE layout WHEN 1 THEN CAST(l_tax AS FLOAT) END', 'tax')} FROM firsts""")
    sql["yearly_columns"] = f"""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, {_r('sum(l_quantity)', 'quantity')}, {_r('sum(CASE WHEN year(l_shipdate) % 2 = 0 THEN l_tax END)', 'tax')}
FROM lineitem WHERE year(l_shipdate) BETWEEN 1994 AND 1996 GROUP BY 1"""
    sql["source_drop_counts"] = """
SELECT count(*) AS n_rows, count(*) FILTER (bad_date) AS no_date, count(*) FILTER (NOT bad_date AND no_id) AS no_sid,
       count(*) FILTER (NOT bad_date AND NOT no_id) - count(DISTINCT CASE WHEN NOT bad_date AND NOT no_id THEN (CAST(l_shipdate AS DATE), l_suppkey) END) AS repeated
FROM (SELECT *, l_returnflag = 'R' AND l_linenumber = 7 AS bad_date, l_linestatus = 'F' AND l_linenumber = 6 AS no_id FROM lineitem)"""
    sql["bars_source_counts"] = _with(RAW_BARS, select="""
SELECT count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(DISTINCT sid) AS n_sids FROM firsts""")
    sql["factor_normalize"] = f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS date, lpad(CAST(user_id AS VARCHAR), 6, '0') || '.SH' AS sid FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY date, sid ORDER BY event_id) AS rn FROM e)
SELECT date, sid, {_r('CAST(value AS FLOAT)', 'feature_value')}, {_r('length(props)', 'feature_fund__props')} FROM f WHERE rn = 1"""
    sql["date_range_scan"] = f"""
SELECT CAST(ts AS DATE) AS date, event_id, user_id, {_r('value', 'value')} FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"""
    sql["dup_key_check"] = """
SELECT count(*) AS key_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1"""

    # assets
    sql["instrument_master_events"] = _with(EVENTS, select="SELECT sid, symbol, list_date, delist_date FROM master")
    sql["instrument_master_parts"] = """
WITH k AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS sid FROM lineitem)
SELECT sid, sid AS symbol, min(date) AS list_date,
       CASE WHEN max(date) < (SELECT max(date) FROM k) - 90 THEN max(date) END AS delist_date FROM k GROUP BY sid"""
    sql["trading_calendar"] = """
SELECT date, true AS is_open, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS td_idx
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""
    sql["trading_day_lookup"] = """
WITH c AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS td_idx
           FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) WHERE date >= DATE '1996-01-01')
SELECT CAST(o.o_orderdate AS DATE) AS date, CAST(o_orderkey AS VARCHAR) AS sid, c.td_idx
FROM orders o LEFT JOIN c ON c.date = CAST(o.o_orderdate AS DATE)"""
    sql["status_intervals"] = _with(EVENTS, select="SELECT date, sid, true AS is_suspended FROM bars WHERE volume <= 0")
    sql["active_session_index"] = _with(EVENTS, select="SELECT date, sid, td AS td_idx FROM idx")

    # panel
    status = ("is_listed, is_suspended, has_market_record, has_factor_record, market_state, factor_state, bar_missing, "
              f"factor_row_missing, {_r('factor_missing_ratio', 'factor_missing_ratio')}, feature_all_missing, sample_state, sample_usable_for_feature")
    sql["panel_base_status"] = _with(EVENTS, select=f"SELECT date, sid, {status} FROM panel")
    sql["panel_status_wide"] = _with(WIDE, select=f"""
SELECT date, sid, factor_state, {_r('factor_missing_ratio', 'factor_missing_ratio')}, feature_all_missing, sample_state, sample_usable_for_feature FROM panel""")
    market = ", ".join(_r(c, f"market_{c}") for c in ("open", "high", "low", "close", "volume"))
    sql["panel_base_values"] = _with(EVENTS, select=f"""
SELECT date, sid, {market}, CAST(NULL AS DOUBLE) AS market_amount, CASE WHEN hm THEN CAST(1.0 AS DOUBLE) END AS market_adj_factor,
       {", ".join(_r(f, f"feature_{f}") for f in EVENT_FEATURES)}, symbol AS meta_symbol, list_date AS meta_list_date FROM panel""")
    hist = f"""
SELECT sample_state AS state, count(*) AS n, {_r('count(*) / CAST((SELECT count(*) FROM panel) AS DOUBLE)', 'share')} FROM panel GROUP BY sample_state"""
    sql["sample_state_hist"] = _with(EVENTS, select=hist)
    sql["sample_state_hist_suppliers"] = _with(SUPPLIERS, select=hist)
    sql["bool_status_rates"] = _with(EVENTS, select="\nUNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS n_true, {_r(f'avg(CAST({f} AS INTEGER))', 'rate')} FROM panel" for f in FLAGS))
    sql["missing_ratio_profile"] = _with(EVENTS, select=f"""
SELECT {_r('min(ratio)', 'min_ratio')}, {_r('max(ratio)', 'max_ratio')}, count(DISTINCT ratio) > 1 AS has_variety FROM panel""")
    sql["state_sets"] = _with(EVENTS, select="\nUNION ".join(
        f"SELECT '{s}' AS state_column, {s} AS state FROM panel" for s in ("sample_state", "market_state", "factor_state")))
    sql["panel_sanity_findings"] = _sanity()
    sql["panel_date_slice"] = _with(EVENTS, select=f"""
SELECT date, sid, {_r('"close"', '"close"')}, sample_state FROM panel WHERE date >= DATE '2024-01-10' AND date < DATE '2024-01-20'""")
    sql["panel_day_slice"] = _with(EVENTS, select="SELECT date, sid, td AS td_idx FROM panel WHERE td BETWEEN 5 AND 12")
    sql["feature_matrix"] = _with(EVENTS, select=f"SELECT date, sid, {', '.join(_r(f, f) for f in EVENT_FEATURES)} FROM panel")
    schema_rows = [("date", "date"), ("sid", "string")]
    schema_rows += [(f"market.{c}", "double") for c in ("open", "high", "low", "close", "volume", "amount", "adj_factor")]
    schema_rows += [(f"feature.{c}", "float") for c in EVENT_FEATURES]
    sql["panel_schema"] = _with(EVENTS, select="\nUNION ALL ".join(
        f"SELECT '{n}' AS column_name, '{t}' AS column_type, (SELECT count(*) FROM panel) AS row_count" for n, t in schema_rows))
    sql["panel_axis_codes"] = _with(EVENTS, select="""
SELECT date, sid, CAST(dense_rank() OVER (ORDER BY date) - 1 AS INTEGER) AS t, CAST(dense_rank() OVER (ORDER BY sid) - 1 AS INTEGER) AS n FROM panel""")

    # targets
    for name in TARGETS:
        sql[name] = _with(EVENTS, _target(name), select=f"SELECT date, sid, {LABEL_COLUMNS} FROM {name}")
    sql["targets_together"] = _with(SUPPLIERS, *[_target(t) for t in TARGETS], select="\nUNION ALL ".join(
        f"SELECT '{t}' AS target, reason, count(*) AS n FROM {t} GROUP BY reason" for t in TARGETS))
    sql["custom_target"] = _with(EVENTS, select=f"""
SELECT date, sid, {_r('CASE WHEN high > 0 AND low > 0 THEN CAST(high / low - 1 AS FLOAT) END', 'label')}, coalesce(high > 0 AND low > 0, false) AS label_valid,
       CASE WHEN high > 0 AND low > 0 THEN '' ELSE 'missing_price' END AS label_reason FROM panel""")
    sql["configured_targets"] = _with(EVENTS, _return("c0c3"), _return("return_c1c2"), select=f"""
SELECT date, sid, 'return_5d' AS target, {LABEL_COLUMNS} FROM c0c3 UNION ALL SELECT date, sid, 'return_c1c2', {LABEL_COLUMNS} FROM return_c1c2""")
    sql["return_forward_filled"] = _with(EVENTS, f"""
ff AS (
  SELECT p.date, p.sid, p.close AS pe, x.close AS exact, p.td + 3 < (SELECT count(*) FROM cal) AS inside,
         (SELECT arg_min(q.close, q.td) FROM panel q WHERE q.sid = p.sid AND q.td >= p.td + 3 AND q.close > 0) AS px
  FROM panel p LEFT JOIN panel x ON x.sid = p.sid AND x.td = p.td + 3),
fr AS (
  SELECT *, CASE WHEN NOT inside THEN 'insufficient_forward' WHEN coalesce(pe, 0) <= 0 THEN 'missing_entry_price'
                 WHEN px IS NULL THEN 'missing_exit_price' END AS failed FROM ff)
""", select=f"""
SELECT date, sid, {_r('CASE WHEN failed IS NULL THEN CAST((px - pe) / pe AS FLOAT) END', 'label')}, failed IS NULL AS label_valid,
       coalesce(failed, CASE WHEN coalesce(exact, 0) <= 0 THEN 'FORWARD_FILLED_DUE_TO_SUSPENSION' ELSE '' END) AS label_reason FROM fr""")
    sql["label_guards"] = _with(EVENTS, _return("return_5d"), """
guarded AS (
  SELECT p.date, p.sid, t.value,
         CASE WHEN c.date IS NULL THEN 'INSUFFICIENT_FORWARD_WINDOW' WHEN c.date > p.delist_date THEN 'DELISTED_IN_WINDOW'
              WHEN p.date - p.list_date < 7 THEN 'STOCK_TOO_YOUNG' WHEN t.value IS NULL THEN 'LABEL_IS_NAN' ELSE '' END AS reason
  FROM panel p JOIN return_5d t ON t.date = p.date AND t.sid = p.sid LEFT JOIN cal c ON c.td = p.td + 5)
""", select=f"""
SELECT date, sid, {_r("CASE WHEN reason = '' THEN value END", 'label')}, reason = '' AS label_valid, reason AS label_reason FROM guarded""")
    sql["joint_train_mask"] = _with(EVENTS, _return("return_c0c1"), _momentum(), select="""
SELECT p.date, p.sid, p.sample_usable_for_feature AND r.valid AS single_mask,
       p.sample_usable_for_feature AND r.valid AND NOT p.is_suspended AS trading_mask,
       p.sample_usable_for_feature AND r.valid AND m.valid AS joint_mask
FROM panel p JOIN return_c0c1 r ON r.date = p.date AND r.sid = p.sid JOIN momentum_cls m ON m.date = p.date AND m.sid = p.sid""")
    sql["panel_labeled"] = _with(EVENTS, _return("return_c0c1"), _momentum(), select=f"""
SELECT p.date, p.sid, {_r('p.close', '"close"')}, p.sample_state, {_r('r.value', 'y_return')}, r.reason AS return_reason,
       {_r('m.value', 'y_momentum')}, m.reason AS momentum_reason
FROM panel p LEFT JOIN return_c0c1 r ON r.date = p.date AND r.sid = p.sid LEFT JOIN momentum_cls m ON m.date = p.date AND m.sid = p.sid""")
    sql["panel_labeled_check"] = _with(EVENTS, _return("return_c0c1"), select="""
SELECT (SELECT count(*) FROM panel p WHERE NOT EXISTS (SELECT 1 FROM return_c0c1 r WHERE r.date = p.date AND r.sid = p.sid)) AS missing_keys,
       (SELECT count(*) FROM return_c0c1 r WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE r.date = p.date AND r.sid = p.sid)) AS extra_keys,
       CAST(0 AS INTEGER) AS missing_columns""")
    sql["target_contract_violations"] = _with(SUPPLIERS, _return("return_o1c5"), select="""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE valid AND value IS NULL) AS valid_without_value,
       count(*) FILTER (WHERE NOT valid AND value IS NOT NULL) AS invalid_with_value,
       count(*) FILTER (WHERE NOT valid AND reason = '') AS invalid_without_reason FROM return_o1c5""")
    sql["target_summary"] = _with(SUPPLIERS, _return("return_o1c2"), select=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid,
       {_r('avg(CAST(valid AS INTEGER))', 'valid_share')} FROM return_o1c2""")
    sql["target_reasons"] = _with(SUPPLIERS, _return("return_o1c2"), select=f"""
SELECT reason, count(*) AS n, {_r('count(*) / CAST((SELECT count(*) FROM return_o1c2 WHERE NOT valid) AS DOUBLE)', 'share_of_invalid')},
       {_r('count(*) / CAST((SELECT count(*) FROM return_o1c2) AS DOUBLE)', 'share_of_total')}
FROM return_o1c2 WHERE NOT valid GROUP BY reason""")
    sql["target_profile_regression"] = _profile((SUPPLIERS, _return("return_5d")), "return_5d")
    sql["target_profile_class"] = _with(EVENTS, _momentum(), select=f"""
SELECT CAST(value AS INTEGER) AS class,
       CASE value WHEN 0 THEN 'Sink (正→负)' WHEN 1 THEN 'Negative (全负)' WHEN 2 THEN 'Volatile (震荡)'
                  WHEN 3 THEN 'Positive (全正)' WHEN 4 THEN 'Bounce (负→正)' END AS name,
       count(*) AS n, {_r('count(*) / CAST((SELECT count(*) FROM momentum_cls WHERE valid) AS DOUBLE)', 'share')}
FROM momentum_cls WHERE valid GROUP BY value""")
    sql["target_by_year"] = _with(SUPPLIERS, _return("return_20d"), select=f"""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS total, count(*) FILTER (WHERE valid) AS n_valid,
       {_r('avg(CAST(valid AS INTEGER))', 'valid_rate')}, {_r('avg(CAST(value AS DOUBLE))', 'mean')},
       {_r('stddev_samp(CAST(value AS DOUBLE))', 'std')}, {_r('quantile_cont(CAST(value AS DOUBLE), 0.5)', 'median')}
FROM return_20d GROUP BY 1""")
    classes = ", ".join(
        [f"count(*) FILTER (WHERE value = {c}) AS class_{c}" for c in range(5)]
        + [_r(f"coalesce(count(*) FILTER (WHERE value = {c}) / nullif(CAST(count(*) FILTER (WHERE valid) AS DOUBLE), 0), 0)", f"share_{c}") for c in range(5)])
    sql["target_classes_by_year"] = _with(SUPPLIERS, _momentum(), select=f"""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS total, count(*) FILTER (WHERE valid) AS n_valid,
       {_r('avg(CAST(valid AS INTEGER))', 'valid_rate')}, {classes} FROM momentum_cls GROUP BY 1""")
    base_checks = """
SELECT 'valid_rate' AS "check", CASE WHEN rate < 0.5 THEN 'WARNING' ELSE 'OK' END AS level, round(rate, 6) AS figure FROM f
UNION ALL SELECT 'missing_in_valid', CASE WHEN miss > 0 THEN 'ERROR' ELSE 'OK' END, round(miss, 6) FROM f
UNION ALL """
    sql["target_findings_regression"] = _with(SUPPLIERS, _return("return_5d"), """
f AS (SELECT avg(CAST(valid AS INTEGER)) AS rate, CAST(count(*) FILTER (WHERE valid AND value IS NULL) AS DOUBLE) AS miss,
             avg(CAST(abs(value) > 1.0 AS INTEGER)) FILTER (WHERE valid) AS extreme FROM return_5d)
""", select=base_checks + "SELECT 'extreme_share', CASE WHEN extreme > 0.01 THEN 'WARNING' ELSE 'OK' END, round(extreme, 6) FROM f WHERE extreme IS NOT NULL")
    sql["target_findings_class"] = _with(EVENTS, _momentum(), """
f AS (SELECT avg(CAST(valid AS INTEGER)) AS rate, CAST(count(*) FILTER (WHERE valid AND value IS NULL) AS DOUBLE) AS miss FROM momentum_cls),
b AS (SELECT max(n) / CAST(min(n) AS DOUBLE) AS balance FROM (SELECT count(*) AS n FROM momentum_cls WHERE valid GROUP BY value))
""", select=base_checks + "SELECT 'class_balance', CASE WHEN balance > 10 THEN 'WARNING' ELSE 'OK' END, round(balance, 6) FROM b WHERE balance IS NOT NULL")

    # splits, selection, views
    calendar = "cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS td FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem))"
    sql["time_split"] = _with(calendar, _split_ranges(), select="SELECT split, start_idx, end_idx FROM ranges")
    sql["time_split_days"] = _with(calendar, _split_ranges(), select="""
SELECT c.date, c.td AS td_idx, r.split FROM cal c JOIN ranges r ON c.td BETWEEN r.start_idx AND r.end_idx WHERE r.split <> 'train_valid'""")
    sql["feature_screen"] = _screen()
    sql["tabular_view"] = _with(EVENTS, _return("return_c1c2"), select=f"""
SELECT p.date, p.sid, {_r('p.f1', 'f1')}, {_r('p.f2', 'f2')}, {_r('t.value', 'y')}, t.valid AS y_valid, p.sample_usable_for_feature AS usable
FROM panel p JOIN return_c1c2 t ON t.date = p.date AND t.sid = p.sid""")
    sql["tabular_view_without_target"] = _with(EVENTS, select=f"""
SELECT date, sid, {_r('f2', 'f2')}, {_r('f3', 'f3')}, CAST(0 AS DOUBLE) AS y, false AS y_valid, sample_usable_for_feature AS usable FROM panel""")
    sql["aligned_features"] = _with(EVENTS, select=f"SELECT date, sid, {_r('f3', 'first')}, {_r('f1', 'second')} FROM panel")
    sql["view_metadata"] = _with(EVENTS, select="""
SELECT count(*) AS num_rows, count(DISTINCT date) AS n_days, count(DISTINCT sid) AS n_sids, min(date) AS first_date, max(date) AS last_date,
       CAST(3 AS INTEGER) AS n_features, 'f1,f2,f3' AS feature_order, 'return_c1c2' AS label_name FROM panel""")
    sql["isna_encoding"] = _with(*ENCODED_PARTS, select=f"""
SELECT date, sid, {CELL_COLUMNS}, present, {_r('y_ret', 'y_ret')}, y_mom, {MASK_COLUMNS} FROM view_rows""")
    sql["encoded_feature_subset"] = _with(*ENCODED_PARTS, select=f"""
SELECT date, sid, {", ".join(_r(f'x{src}', f'x{i}') for i, src in enumerate((1, 2, 4, 5, 6)))} FROM view_rows""")
    sql["dense_cube_cells"] = _with(*ENCODED_PARTS, select=f"""
SELECT c.date, s.sid, c.td AS td_idx, {", ".join(_r(f'coalesce(v.x{i}, 0)', f'x{i}') for i in range(7))},
       coalesce(v.present, false) AS present, {_r('coalesce(v.y_ret, 0)', 'y_ret')}, coalesce(v.y_mom, -1) AS y_mom,
       coalesce(v.ret_mask, false) AS ret_mask, coalesce(v.mom_mask, false) AS mom_mask, coalesce(v.both_mask, false) AS both_mask
FROM cal c CROSS JOIN (SELECT DISTINCT sid FROM view_rows) s LEFT JOIN view_rows v ON v.date = c.date AND v.sid = s.sid""")
    sql["cube_cells"] = _with(*ENCODED_PARTS, select=f"""
SELECT date, sid, td AS td_idx, {CELL_COLUMNS}, present, {_r('y_ret', 'y_ret')}, y_mom, {MASK_COLUMNS} FROM view_rows""")
    sql["cube_slice"] = _with(*ENCODED_PARTS, select=f"""
SELECT c.date, s.sid, c.td AS td_idx, {", ".join(_r(f'coalesce(v.x{i}, 0)', f'x{i}') for i in range(7))},
       coalesce(v.present, false) AS present, {_r('coalesce(v.y_ret, 0)', 'y_ret')}, coalesce(v.y_mom, -1) AS y_mom,
       coalesce(v.ret_mask, false) AS ret_mask, coalesce(v.mom_mask, false) AS mom_mask, coalesce(v.both_mask, false) AS both_mask
FROM cal c CROSS JOIN (SELECT DISTINCT v.sid FROM view_rows v JOIN master m ON m.sid = v.sid WHERE m.delist_date IS NULL) s
LEFT JOIN view_rows v ON v.date = c.date AND v.sid = s.sid WHERE c.td BETWEEN 5 AND 12""")
    sql["cube_coverage"] = _with(*ENCODED_PARTS, select="""
SELECT 'day' AS axis, CAST(c.date AS VARCHAR) AS key, count(v.sid) AS n_cells FROM cal c LEFT JOIN view_rows v ON v.date = c.date GROUP BY c.date
UNION ALL SELECT 'instrument', sid, count(*) FROM view_rows GROUP BY sid""")
    sql["daily_sample_k"] = _with(*ENCODED_PARTS, SAMPLE, select="SELECT date, sid, present, sample_pos FROM filled")
    total = " + ".join(f"coalesce(CAST(x{i} AS DOUBLE), 0)" for i in range(7))
    sql["lookback_window_stats"] = _with(*ENCODED_PARTS, SAMPLE, f"sums AS (SELECT sid, td, x6, {total} AS s FROM view_rows)", select=f"""
SELECT a.date, a.sid, CAST(5 AS INTEGER) AS steps,
       {_r('(SELECT coalesce(sum(w.x6), 0) FROM sums w WHERE w.sid = a.sid AND w.td BETWEEN a.td - 4 AND a.td)', 'present_steps')},
       {_r('coalesce((SELECT w.s FROM sums w WHERE w.sid = a.sid AND w.td = a.td - 4), 0)', 'oldest_sum')},
       {_r('coalesce((SELECT w.s FROM sums w WHERE w.sid = a.sid AND w.td = a.td), 0)', 'newest_sum')},
       {_r('a.y_ret', 'y_ret')}, a.y_mom, a.ret_mask, a.mom_mask, a.both_mask
FROM filled a WHERE a.td >= 4""")
    flat = " + ".join(f"coalesce(CAST(p.{f} AS DOUBLE), 0) + CAST(p.{f} IS NULL AS INTEGER)" for f in SUPPLIER_FEATURES)
    sql["lookback_supplier_windows"] = _with(SUPPLIERS, _return("return_c0c1"), _momentum(), f"""
cells AS (
  SELECT p.date, p.sid, p.td, CAST(p.sample_usable_for_feature AS INTEGER) AS here, {flat} + CAST(p.sample_usable_for_feature AS INTEGER) AS s,
         coalesce(r.value, 0) AS y_ret, CASE WHEN m.valid THEN CAST(m.value AS INTEGER) ELSE -1 END AS y_mom, r.valid AS ret_mask, m.valid AS mom_mask
  FROM panel p JOIN return_c0c1 r ON r.date = p.date AND r.sid = p.sid JOIN momentum_cls m ON m.date = p.date AND m.sid = p.sid),
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY here DESC, md5('42|' || CAST(date AS VARCHAR) || '|' || sid), sid) AS place,
         sum(here) OVER (PARTITION BY sid ORDER BY td RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS present_steps FROM cells)
""", select=f"""
SELECT a.date, a.sid, CAST(60 AS INTEGER) AS steps, {_r('a.present_steps', 'present_steps')}, {_r('coalesce(o.s, 0)', 'oldest_sum')}, {_r('a.s', 'newest_sum')},
       {_r('a.y_ret', 'y_ret')}, a.y_mom, a.ret_mask, a.mom_mask, a.ret_mask AND a.mom_mask AS both_mask
FROM drawn a LEFT JOIN cells o ON o.sid = a.sid AND o.td = a.td - 59 WHERE a.place <= 512 AND a.td >= 59""")
    sql["view_report"] = _with(*ENCODED_PARTS, """
days AS (SELECT c.date, count(*) FILTER (WHERE v.present) AS present, count(*) FILTER (WHERE v.ret_mask) AS ret_valid,
                count(*) FILTER (WHERE v.mom_mask) AS mom_valid, count(*) FILTER (WHERE v.both_mask) AS both_valid
         FROM cal c LEFT JOIN view_rows v ON v.date = c.date GROUP BY c.date),
d AS (SELECT count(*) AS n_days, CAST(sum(present) AS BIGINT) AS present_cells, avg(present) AS avg_present, min(present) AS min_present,
             max(present) AS max_present, CAST(sum(ret_valid) AS BIGINT) AS ret_valid, CAST(sum(mom_valid) AS BIGINT) AS mom_valid,
             CAST(sum(both_valid) AS BIGINT) AS both_valid FROM days),
v AS (SELECT count(DISTINCT sid) AS n_sids, avg((x3 + x4 + x5) / CAST(3 AS DOUBLE)) FILTER (WHERE present) AS feature_missing_rate,
             avg(CAST(y_ret AS DOUBLE)) FILTER (WHERE ret_mask) AS ret_mean, stddev_pop(CAST(y_ret AS DOUBLE)) FILTER (WHERE ret_mask) AS ret_std,
             min(y_ret) FILTER (WHERE ret_mask) AS ret_min, max(y_ret) FILTER (WHERE ret_mask) AS ret_max,
             quantile_cont(CAST(y_ret AS DOUBLE), 0.5) FILTER (WHERE ret_mask) AS ret_median,
""" + ", ".join(f"count(*) FILTER (WHERE mom_mask AND y_mom = {c}) AS class_{c}" for c in range(5)) + " FROM view_rows)", select=f"""
SELECT n_sids, {", ".join(_r(c, c) for c in ("feature_missing_rate", "ret_mean", "ret_std", "ret_min", "ret_max", "ret_median", "avg_present"))},
       class_0, class_1, class_2, class_3, class_4, n_days, present_cells, min_present, max_present, ret_valid, mom_valid, both_valid,
       n_days * n_sids AS total_cells,
       {", ".join(_r(f"{a} / CAST(n_days * n_sids AS DOUBLE)", b) for a, b in (("present_cells", "present_share"), ("ret_valid", "ret_coverage"), ("mom_valid", "mom_coverage"), ("both_valid", "both_coverage")))}
FROM d, v""")
    sql["view_by_year"] = _with(SUPPLIERS, _return("return_c0c1"), _momentum(), """
days AS (SELECT p.date, count(*) FILTER (WHERE p.sample_usable_for_feature) AS present, count(*) FILTER (WHERE r.valid) AS ret_valid,
                count(*) FILTER (WHERE m.valid) AS mom_valid
         FROM panel p JOIN return_c0c1 r ON r.date = p.date AND r.sid = p.sid JOIN momentum_cls m ON m.date = p.date AND m.sid = p.sid GROUP BY p.date)
""", select=f"""
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_days, {_r('avg(present)', 'avg_present')},
       CAST(sum(ret_valid) AS BIGINT) AS ret_valid, CAST(sum(mom_valid) AS BIGINT) AS mom_valid FROM days GROUP BY 1""")

    # cross-section
    sql["group_sizes"] = _with(*LABELLED_PARTS, select="SELECT date, count(*) AS group_size FROM rows_ GROUP BY date")
    sql["small_group_filter"] = _with(*LABELLED_PARTS, select=f"""
SELECT date, sid, {_r('y', 'y')} FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM rows_) WHERE n >= 55""")
    sql["relevance_bins_avg"] = _with(*LABELLED_PARTS, _binned("rows_", "y", 10), select=f"SELECT date, sid, {_r('y', 'y')}, relevance FROM binned")
    sql["relevance_bins_ties"] = _with(EVENTS, _binned("panel", "volume", 10), select=f"SELECT date, sid, {_r('volume', 'volume')}, relevance FROM binned")
    sql["relevance_bins_desc"] = _with(*MODEL_PARTS, RELEVANCE, select=f"SELECT date, sid, {_r('y_ret', 'y_ret')}, ret_mask, relevance FROM relevant")
    sql["ranking_dataset"] = _with(*SUPPLIER_VIEW_PARTS, """
keep AS (SELECT date, sid, split, CAST(greatest(-0.5, least(0.5, y)) AS FLOAT) AS y_raw, count(*) OVER (PARTITION BY date) AS size_
         FROM tab WHERE y_valid AND usable AND split IS NOT NULL),
big AS (SELECT * FROM keep WHERE size_ >= 5)
""", _binned("big", "y_raw", 10), select=f"SELECT date, sid, split, {_r('y_raw', 'y_raw')}, relevance FROM binned")
    sql["xs_norm_rank"] = _with(EVENTS, """
n AS (SELECT date, sid, f1, rank() OVER (PARTITION BY date, f1 IS NULL ORDER BY f1) - 1 AS b, count(f1) OVER (PARTITION BY date) AS c FROM panel)
""", select=f"""
SELECT date, sid, {_r('f1', 'f1')}, {_r('CASE WHEN f1 IS NULL THEN NULL WHEN c > 1 THEN b / CAST(c - 1 AS DOUBLE) ELSE 0 END', 'f1_norm')} FROM n""")
    sql["xs_norm_zscore"] = _with(EVENTS, """
s AS (SELECT date, avg(CAST(f1 AS DOUBLE)) AS m, stddev_samp(CAST(f1 AS DOUBLE)) AS d FROM panel GROUP BY date)
""", select=f"""
SELECT p.date, p.sid, {_r('p.f1', 'f1')}, {_r('(p.f1 - s.m) / nullif(s.d, 0)', 'f1_norm')} FROM panel p JOIN s ON s.date = p.date""")

    # rank metrics and losses
    sql["rankic_daily"] = _with(*SUPPLIER_VIEW_PARTS, RANK_IC, select=f"SELECT date, n_pairs, {_r('rank_ic', 'rank_ic')} FROM ric_days")
    sql["rankic_summary"] = _with(*SUPPLIER_VIEW_PARTS, RANK_IC, select=f"""
SELECT split, {_r('avg(rank_ic)', 'rank_ic_mean')}, {_r('stddev_samp(rank_ic)', 'rank_ic_std')}, count(*) AS rank_ic_n_days,
       {_r('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)', 'rank_ic_ir')} FROM ric_days GROUP BY split""")
    sql["ic_daily"] = _with(*MODEL_PARTS, IC, select=f"SELECT date, n_rows, {_r('ic', 'ic')}, {_r('rank_ic', 'rank_ic')} FROM ic_days")
    sql["cls_accuracy"] = _with(*MODEL_PARTS, select=f"""
SELECT date, count(*) FILTER (WHERE y_mom >= 0) AS n_labelled, {_r('avg(CAST(picked = y_mom AS INTEGER)) FILTER (WHERE y_mom >= 0)', 'accuracy')}
FROM class_rows GROUP BY date""")
    sql["masked_mse"] = _with(*MODEL_PARTS, f"days AS ({MSE_DAYS})", select=f"""
SELECT d.date, {_r('d.ret_loss', 'mse')}, n_masked FROM days d
JOIN (SELECT date, count(*) FILTER (WHERE ret_mask) AS n_masked FROM model_rows GROUP BY date) c ON c.date = d.date""")
    sql["cross_entropy"] = _with(*MODEL_PARTS, select=f"""
SELECT date, {_r('avg(lse - zy)', 'ce_loss')}, count(zy) AS n_labelled FROM class_rows GROUP BY date""")
    sql["ndcg_at_k"] = _with(*MODEL_PARTS, RELEVANCE, PAIRWISE, select=f"""
SELECT date, {_r('dcg', 'dcg')}, {_r('idcg', 'idcg')}, {_r('dcg / nullif(idcg, 0)', 'ndcg')} FROM idcg""")
    sql["lambdarank_daily"] = _with(*MODEL_PARTS, RELEVANCE, PAIRWISE, select=f"SELECT date, {_r('pair_loss', 'pair_loss')}, n_pairs FROM pair_days")
    sql["lambdarank_loss"] = _with(*MODEL_PARTS, RELEVANCE, PAIRWISE, select=f"""
SELECT CASE WHEN date < DATE '2024-01-16' THEN 'first' ELSE 'second' END AS split,
       {_r('sum(pair_loss) / (sum(n_pairs) + 1e-8)', 'lambda_rank_loss')} FROM pair_days GROUP BY 1""")
    sql["eval_rollup"] = _with(*MODEL_PARTS, IC, _rollup(MSE_DAYS), select=f"SELECT split, {ROLLUP_COLUMNS} FROM rolled")
    sql["eval_rollup_lambdarank"] = _with(*MODEL_PARTS, RELEVANCE, PAIRWISE, IC, _rollup(
        "SELECT date, pair_loss / (n_pairs + 1e-8) AS ret_loss FROM pair_days"), select=f"SELECT split, {ROLLUP_COLUMNS} FROM rolled")

    # ranker, sources, sinks and contracts
    sql["rank_gradients_daily"] = _with(*MODEL_PARTS, RELEVANCE, """
live AS (
  SELECT date, sid, pred_ret AS s, relevance AS r, row_number() OVER (PARTITION BY date ORDER BY pred_ret DESC, md5(sid)) - 1 AS place,
         row_number() OVER (PARTITION BY date ORDER BY relevance DESC) - 1 AS ideal,
         max(pred_ret) OVER (PARTITION BY date) > min(pred_ret) OVER (PARTITION BY date) AS spread FROM relevant WHERE ret_mask),
faced AS (
  SELECT *, CASE WHEN place < 20 THEN 1 / log2(place + 2) ELSE 0 END AS d,
         sum(CASE WHEN ideal < 20 THEN r / log2(ideal + 2) ELSE 0 END) OVER (PARTITION BY date) AS idcg FROM live),
met AS (
  SELECT a.date, a.sid AS high, b.sid AS low, 1 / (1 + exp(a.s - b.s)) AS p,
         (a.r - b.r) * abs(a.d - b.d) / (a.idcg + 1e-8) / (CASE WHEN a.spread THEN 0.01 + abs(a.s - b.s) ELSE 1 END) AS w
  FROM faced a JOIN faced b ON a.date = b.date AND a.r > b.r),
sums AS (SELECT date, 2 * sum(w * p) AS total FROM met GROUP BY date),
parts AS (
  SELECT date, high AS sid, -w * p AS g, w * p * (1 - p) AS h FROM met UNION ALL SELECT date, low, w * p, w * p * (1 - p) FROM met),
rowwise AS (SELECT date, sid, sum(g) AS g, sum(h) AS h FROM parts GROUP BY date, sid)
""", select=f"""
SELECT f.date, f.sid, {_r("coalesce(CASE WHEN s.total > 0 THEN log2(1 + s.total) / s.total ELSE 1 END * w.g, 0)", "grad")},
       {_r("coalesce(CASE WHEN s.total > 0 THEN log2(1 + s.total) / s.total ELSE 1 END * w.h, 0)", "hess")}
FROM faced f LEFT JOIN sums s ON s.date = f.date LEFT JOIN rowwise w ON w.date = f.date AND w.sid = f.sid""")
    judged = """
keep AS (SELECT date, sid, split, count(*) OVER (PARTITION BY date) AS size_ FROM tab WHERE y_valid AND usable AND split IS NOT NULL),
big AS (SELECT * FROM keep WHERE size_ >= 3)
"""
    sql["rank_boost_rounds"] = _with(*SUPPLIER_VIEW_PARTS, judged, select="""
SELECT CAST(r.round AS INTEGER) AS round, v.* FROM (SELECT unnest([1, 2, 3]) AS round) r
CROSS JOIN (SELECT count(*) AS n_rows, count(DISTINCT date) AS n_days, count(*) AS n_equal FROM big WHERE split = 'valid') v""")
    sql["rank_boost_store"] = _with(*SUPPLIER_VIEW_PARTS, judged, select="""
SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_days, count(DISTINCT sid) AS n_sids, count(*) AS n_equal FROM big GROUP BY split""")
    sql["gbt_rank_checks"] = _with(*SUPPLIER_VIEW_PARTS, """
keep AS (SELECT date, sid, split, y, count(*) OVER (PARTITION BY date) AS size_ FROM tab WHERE y_valid AND usable AND split IS NOT NULL)
""", select="""
SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_days, count(DISTINCT sid) AS n_sids, round(sum(CAST(y AS DOUBLE)), 3) AS y_sum,
       count(*) AS n_finite FROM keep WHERE size_ >= 3 GROUP BY split""")
    sql["panel_store_range"] = _with(EVENTS, select=f"""
SELECT date, sid, td AS td_idx, {_r('"close"', '"close"')}, sample_state FROM panel WHERE date >= DATE '2024-01-10' AND date < DATE '2024-01-20'""")
    sql["sanity_from_years"] = _sanity()
    sql["histogram_from_years"] = _with(SUPPLIERS, select=hist)
    sql["target_profile_from_years"] = _profile((SUPPLIERS, _return("return_5d")), "return_5d")
    sql["panel_year_replaced"] = _with(SUPPLIERS, select=f"""
SELECT date, sid, td AS td_idx, {_r('volume * CASE WHEN year(date) = 1996 THEN 2 ELSE 1 END', 'volume')}, sample_state FROM panel""")
    union = "\nUNION ALL ".join(f"""
SELECT '{f}' AS feature, count(*) AS n_rows, var_pop(CAST({f} AS DOUBLE)) AS variance, avg(CAST({f} IS NULL AS INTEGER)) AS missing_rate, {str(f[:2] == 'w1' and len(f) == 3).lower()} AS out_
FROM rows_""".strip() for f in WIDE_FEATURES)
    sql["feature_screen_wide"] = _with(WIDE, _return("return_c0c1"), LABELLED_ROWS, f"prof AS ({union})", select=f"""
SELECT feature, n_rows, round(variance, 2) AS variance, {_r('missing_rate', 'missing_rate')},
       coalesce(variance > 0, false) AND missing_rate < 0.02 AND NOT out_ AS kept FROM prof""")
    sql["calendar_csv"] = """
SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, true AS is_open FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"""
    sql["target_store"] = _with(EVENTS, _return("return_c0c1"), select=f"SELECT date, sid, {LABEL_COLUMNS} FROM return_c0c1")
    sql["predictions_csv"] = _with(*MODEL_PARTS, select=f"SELECT date, sid, {_r('y_ret', 'y_raw')}, {_r('pred_ret', 'pred')} FROM model_rows")
    sql["run_metrics_store"] = _with(*SUPPLIER_VIEW_PARTS, RANK_IC, select="""
SELECT r.run_id, s.split, 'rank_ic_n_days' AS metric, CAST(s.n AS DOUBLE) AS value
FROM (SELECT split, count(*) AS n FROM ric_days GROUP BY split) s CROSS JOIN (SELECT unnest(['first', 'second']) AS run_id) r""")
    sql["contracts_hold"] = _with(EVENTS, RAW_BARS, select="""
SELECT 'raw bars' AS table_name, count(*) AS n_rows FROM firsts UNION ALL SELECT 'raw factors', count(*) FROM fac
UNION ALL SELECT 'daily bars', count(*) FROM bars UNION ALL SELECT 'factor values', count(*) FROM fac
UNION ALL SELECT 'instrument master', count(*) FROM master UNION ALL SELECT 'trading calendar', count(*) FROM cal
UNION ALL SELECT 'panel', count(*) FROM panel""")
    screened = "\nUNION ALL ".join(f"""
SELECT '{name}' AS feature, CAST({i} AS INTEGER) AS position, count(*) AS n_rows, round(var_pop(CAST({col} AS DOUBLE)), 2) AS variance
FROM tab WHERE split IS NOT NULL AND y_valid AND usable""".strip() for i, (name, col) in enumerate((("discount", "discount"), ("fund__top_price", "top_price"), ("tax", "tax"))))
    sql["run_features_store"] = _with(*SUPPLIER_VIEW_PARTS, f"kept AS ({screened})", select="""
SELECT r.run_id, k.position, k.feature, k.n_rows, k.variance FROM kept k CROSS JOIN (SELECT unnest(['first', 'second']) AS run_id) r""")
    sql["contracts_broken"] = _with(EVENTS, select="\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{f}' AS fault, count(*) AS n_rows, true AS refused FROM {rows}" for t, f, rows in (
            ("daily bars", "repeated keys", "bars WHERE volume <= 0"), ("factor values", "repeated keys", "fac WHERE f2 IS NULL"), ("factor values", "no features", "fac"),
            ("instrument master", "no list date", "master WHERE list_date >= DATE '2024-01-01'"), ("trading calendar", "repeated days", "cal"), ("panel", "a label inside", "panel"),
            ("panel", "repeated keys", "panel WHERE is_suspended"), ("labelled panel", "no such label", "panel"))))
    return sql
