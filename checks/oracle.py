"""The same questions in DuckDB SQL, written apart from the Spark plans.

Every text starts with the mapped core tables (FIXTURES.md) and a few shared row views; the
bodies below use those.
"""

from __future__ import annotations

FROM, TO = "2010-10-01", "2011-03-30"
DAY = "2010-11-14"
USER = "85"
SEARCH = "9"
NAME_SEARCH = "TOMER#0000_00_5"
WIN_FROM, WIN_TO = "2011-03-01", "2011-03-30"
PREV_FROM, PREV_TO = "2011-01-30", "2011-02-28"
SEEN = "2011-03-31 06:00:00"


def _when(base: str, column: str, minutes: str) -> str:
    days = f"datediff('day', date '1995-01-01', CAST({column} AS DATE)) % 180"
    return f"TIMESTAMP '{base}' + to_days(CAST({days} AS INTEGER)) + to_minutes({minutes})"


CORE = f"""
core_orders AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE WHEN o_custkey % 50 <> 7 THEN CAST(o_custkey AS VARCHAR) END AS user_id,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'created' ELSE 'failed' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'gift' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'stars' END
      AS product_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'platega' WHEN '2-HIGH' THEN 'card'
      WHEN '3-MEDIUM' THEN 'wallet' WHEN '5-LOW' THEN '' END AS payment_provider,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS amount_rub,
    CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 12 <> 0
      THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) + (o_orderkey % 50) AS DECIMAL(15,2)) END
      AS amount_rub_original,
    CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_orderkey % 1000 - 5 END
      AS DECIMAL(14,2)) AS cost_rub,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 700 - 20 END AS DECIMAL(14,2))
      AS profit_rub,
    CAST(CASE WHEN o_orderkey % 11 <> 0 THEN 1 + o_orderkey % 3 END AS DECIMAL(14,4))
      AS cost_per_star,
    CASE WHEN o_orderkey % 6 = 0 THEN 'PROMO' || (o_orderkey % 4) END AS promo_code,
    {_when('2010-10-01', 'o_orderdate', 'o_orderkey % 1440')} AS "timestamp"
  FROM orders),
core_users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS user_id,
    CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_name END AS username,
    CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey // 3 AS VARCHAR)
      WHEN c_custkey % 30 = 1 THEN '' END AS referrer_id,
    TIMESTAMP '2010-09-15' + to_days(CAST(c_custkey * 7 % 200 AS INTEGER))
      + to_minutes(c_custkey * 13 % 1440) AS created_at
  FROM customer),
core_payment_transactions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS order_id,
    CASE l_suppkey % 6 WHEN 0 THEN 'platega' WHEN 1 THEN 'platega_status' WHEN 2 THEN 'card'
      WHEN 3 THEN 'wallet' WHEN 4 THEN '' END AS provider,
    CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ''
      ELSE 'tx' || l_orderkey || '-' || (l_linenumber % 3) END AS provider_txn_id,
    CASE l_returnflag
      WHEN 'R' THEN CASE WHEN l_linenumber < 4 THEN 'CONFIRMED' ELSE 'paid' END
      WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN '' ELSE 'pending' END
      ELSE CASE WHEN l_linenumber <> 2 THEN 'canceled' END END AS status,
    CASE WHEN l_partkey % 7 <> 0
      THEN {_when('2010-10-01', 'l_shipdate', '(l_orderkey * 7 + l_linenumber) % 1440')} END
      AS created_at
  FROM lineitem),
core_promo_redemptions AS (
  SELECT CASE WHEN l_partkey % 29 <> 0 THEN 'PROMO' || (l_orderkey % 4 + 2) END AS code,
    {_when('2010-10-01', 'l_shipdate', 'l_orderkey % 1440')} AS created_at
  FROM lineitem),
core_referral_earnings AS (
  SELECT CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS order_id,
    CASE WHEN l_partkey % 19 <> 0 THEN CAST(l_quantity AS INTEGER) END AS stars,
    {_when('2010-10-01', 'l_shipdate', 'l_orderkey % 1440')} AS created_at
  FROM lineitem)"""


def wall(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow')"


def local(ts: str) -> str:
    return f"CAST({wall(ts)} AS DATE)"


def between(column: str, start: str = FROM, end: str = TO) -> str:
    return f"{column} BETWEEN DATE '{start}' AND DATE '{end}'"


def dec(value: str) -> str:
    return f"CAST({value} AS DECIMAL(14,2))"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def ratio(part: str, whole: str, digits: int = 4) -> str:
    """Guarded, rounded DOUBLE ratio."""
    return (
        f"CASE WHEN {whole} > 0 THEN round({dbl(part)} / {dbl(whole)}, {digits})"
        f" ELSE CAST(0 AS DOUBLE) END"
    )


def rate4(part: str, whole: str) -> str:
    """Stored ratio of counts from whole-number arithmetic, half up."""
    p, q = f"CAST({part} AS HUGEINT)", f"CAST({whole} AS HUGEINT)"
    return (
        f"CAST(CASE WHEN {whole} = 0 THEN 0 ELSE"
        f" ((2 * {p} * 10000 + {q}) // (2 * {q})) / 10000.0 END AS DECIMAL(8,4))"
    )


def mean2(total: str, count: str) -> str:
    """Stored money average from whole cents, half up; totals here are not negative."""
    c, n = f"CAST({total} * 100 AS HUGEINT)", f"CAST({count} AS HUGEINT)"
    return (
        f"CAST(CASE WHEN {count} = 0 THEN 0 ELSE"
        f" ((2 * {c} + {n}) // (2 * {n})) / 100.0 END AS DECIMAL(14,2))"
    )


ROWS = f"""
sale AS (
  SELECT *, {wall('"timestamp"')} AS wall, {local('"timestamp"')} AS d, status = 'paid' AS ok,
    IF(cost_rub > 0, cost_rub, IF(product_type = 'gift', 60, ifnull(cost_rub, 0))) AS cost_eff,
    ifnull(amount_rub, 0) - cost_eff AS gross,
    ifnull(profit_rub, gross) AS profit_eff,
    ifnull(nullif(payment_provider, ''), 'unknown') AS prov,
    ifnull(nullif(product_type, ''), 'unknown') AS prod
  FROM core_orders),
pay AS (
  SELECT p.id, p.order_id, p.created_at AS own_at,
    ifnull(p.created_at, o."timestamp") AS moment, {local('moment')} AS d,
    replace(ifnull(nullif(p.provider, ''), 'unknown'), 'platega_status', 'platega') AS prov,
    ifnull(nullif(p.status, ''), 'unknown') AS st,
    CASE WHEN length(p.provider_txn_id) > 0 THEN prov || ':' || p.provider_txn_id
      ELSE ifnull('order:' || p.order_id, 'row:' || p.id) END AS k,
    ifnull(CAST(lower(p.status) IN ('paid', 'confirmed') AS INTEGER), 0) AS win
  FROM core_payment_transactions p LEFT JOIN core_orders o USING (order_id)),
refd AS (SELECT user_id, {local('created_at')} AS d FROM core_users
  WHERE referrer_id IS NOT NULL),
cal AS (SELECT CAST(unnest(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY)) AS DATE)
  AS d)"""

MARTS = f"""
m_daily AS (
  WITH t AS (SELECT d, count(*) AS c, count_if(ok) AS p, count_if(status = 'failed') AS f,
      sum(IF(ok, amount_rub, NULL)) AS rev, sum(IF(ok, cost_eff, NULL)) AS cost,
      sum(IF(ok, profit_eff, NULL)) AS prof, count(IF(ok, amount_rub, NULL)) AS n,
      count(DISTINCT IF(ok, user_id, NULL)) AS u
    FROM sale GROUP BY d),
  r AS (SELECT d, count(*) AS r FROM (SELECT d, user_id FROM sale WHERE ok
      GROUP BY d, user_id HAVING count(*) > 1) GROUP BY d)
  SELECT cal.d AS date, {big('ifnull(c, 0)')} AS orders_created_count,
    {big('ifnull(p, 0)')} AS orders_paid_count, {big('ifnull(f, 0)')} AS orders_failed_count,
    {big('0')} AS orders_cancelled_count, {dec('ifnull(rev, 0)')} AS revenue_rub,
    {dec('ifnull(cost, 0)')} AS cost_rub, {dec('ifnull(prof, 0)')} AS profit_rub,
    {mean2('ifnull(rev, 0)', 'ifnull(n, 0)')} AS avg_check_rub,
    {rate4('ifnull(p, 0)', 'ifnull(c, 0)')} AS pay_conversion_rate,
    {big('ifnull(u, 0)')} AS unique_buyers_count, {big('ifnull(r, 0)')} AS repeat_buyers_count
  FROM cal LEFT JOIN t USING (d) LEFT JOIN r USING (d)),
m_provider AS (
  SELECT d AS date, prov AS payment_provider, {big('count(*)')} AS orders_created_count,
    {big('count_if(ok)')} AS orders_paid_count,
    {dec('ifnull(sum(IF(ok, amount_rub, NULL)), 0)')} AS revenue_rub,
    {dec('ifnull(sum(IF(ok, cost_eff, NULL)), 0)')} AS cost_rub,
    {dec('ifnull(sum(IF(ok, profit_eff, NULL)), 0)')} AS profit_rub,
    {mean2('ifnull(sum(IF(ok, amount_rub, NULL)), 0)', 'count(IF(ok, amount_rub, NULL))')}
      AS avg_check_rub,
    {rate4('count_if(ok)', 'count(*)')} AS paid_conversion_rate
  FROM sale WHERE {between('d')} GROUP BY d, prov),
m_product AS (
  SELECT d AS date, prod AS product_type, {big('count_if(ok)')} AS orders_paid_count,
    {dec('ifnull(sum(IF(ok, amount_rub, NULL)), 0)')} AS revenue_rub,
    {dec('ifnull(sum(IF(ok, cost_eff, NULL)), 0)')} AS cost_rub,
    {dec('ifnull(sum(IF(ok, profit_eff, NULL)), 0)')} AS profit_rub,
    {mean2('ifnull(sum(IF(ok, amount_rub, NULL)), 0)', 'count(IF(ok, amount_rub, NULL))')}
      AS avg_check_rub
  FROM sale WHERE {between('d')} GROUP BY d, prod),
m_referral AS (
  WITH fresh AS (SELECT d, count(*) AS n FROM refd GROUP BY d),
  bought AS (SELECT sale.d, count(*) AS orders, count(DISTINCT user_id) AS buyers,
      sum(amount_rub) AS rev, sum(profit_eff) AS prof
    FROM sale SEMI JOIN refd USING (user_id) WHERE ok GROUP BY sale.d),
  paid_out AS (SELECT {local('e.created_at')} AS d,
      sum(ifnull(o.cost_per_star, 0) * ifnull(e.stars, 0)) AS bonus
    FROM core_referral_earnings e LEFT JOIN core_orders o USING (order_id) GROUP BY 1)
  SELECT cal.d AS date, {big('ifnull(fresh.n, 0)')} AS new_referred_users_count,
    {big('ifnull(buyers, 0)')} AS referred_buyers_count,
    {big('ifnull(orders, 0)')} AS referred_orders_paid_count,
    {dec('ifnull(rev, 0)')} AS referred_revenue_rub,
    {dec('ifnull(bonus, 0)')} AS referral_bonus_cost_rub,
    {dec('ifnull(prof, 0) - ifnull(bonus, 0)')} AS referral_profit_rub
  FROM cal LEFT JOIN fresh USING (d) LEFT JOIN bought USING (d) LEFT JOIN paid_out USING (d)),
m_promo AS (
  SELECT d AS date, code AS promo_code, {big('sum(red)')} AS redemptions_count,
    {big('sum(ord)')} AS paid_orders_count, {dec('ifnull(sum(disc), 0)')} AS discount_total_rub,
    {dec('ifnull(sum(rev), 0)')} AS revenue_after_discount_rub,
    {dec('ifnull(sum(prof), 0)')} AS profit_after_discount_rub
  FROM (
    SELECT {local('created_at')} AS d, code, 1 AS red, 0 AS ord, NULL AS disc, NULL AS rev,
      NULL AS prof FROM core_promo_redemptions
    UNION ALL
    SELECT d, promo_code, 0, 1, ifnull(amount_rub_original, amount_rub) - ifnull(amount_rub, 0),
      amount_rub, profit_eff FROM sale WHERE ok)
  WHERE code IS NOT NULL AND {between('d')} GROUP BY d, code),
m_cohort AS (
  WITH buys AS (SELECT user_id, CAST(date_trunc('week', d) AS DATE) AS w,
      ifnull(amount_rub, 0) AS rev FROM sale WHERE ok),
  born AS (SELECT user_id, min(w) AS cw FROM buys GROUP BY user_id),
  act AS (SELECT cw, (w - cw) // 7 AS age, count(DISTINCT user_id) AS n, sum(rev) AS rev
    FROM buys JOIN born USING (user_id) WHERE (w - cw) // 7 <= 12 GROUP BY ALL)
  SELECT cw AS cohort_week, CAST(age AS INTEGER) AS age_week, {big('size')} AS users_count,
    {big('n')} AS repeat_buyers_count, {rate4('n', 'size')} AS retention_rate,
    {dec('rev')} AS period_revenue_rub,
    {dec('sum(rev) OVER (PARTITION BY cw ORDER BY age)')} AS cumulative_revenue_rub
  FROM act JOIN (SELECT cw, count(*) AS size FROM born GROUP BY cw) USING (cw)
  WHERE cw BETWEEN date_trunc('week', DATE '{FROM}') AND date_trunc('week', DATE '{TO}'))"""

VIEWS = f"""
v_pay_daily AS (
  WITH s AS (SELECT d, count(*) AS c, count_if(ok) AS p, count_if(status = 'failed') AS f,
      sum(IF(ok, amount_rub, NULL)) AS rev FROM sale GROUP BY d),
  a AS (SELECT d, count(*) AS n, sum(w) AS good, sum(e) AS e FROM
      (SELECT d, k, max(win) AS w, count(*) AS e FROM pay GROUP BY d, k) GROUP BY d)
  SELECT cal.d AS date, {big('ifnull(c, 0)')} AS orders_created_count,
    {big('ifnull(p, 0)')} AS orders_paid_count, {big('ifnull(f, 0)')} AS orders_failed_count,
    {dbl('ifnull(rev, 0)')} AS revenue_rub, {big('ifnull(n, 0)')} AS payment_attempts_count,
    {big('ifnull(good, 0)')} AS payment_success_count,
    {big('ifnull(n - good, 0)')} AS payment_failed_count,
    {big('ifnull(e, 0)')} AS payment_events_count
  FROM cal LEFT JOIN s USING (d) LEFT JOIN a USING (d)),
v_pay_prov AS (
  WITH s AS (SELECT prov, count(*) AS c, count_if(ok) AS p, sum(IF(ok, amount_rub, NULL)) AS rev
    FROM sale WHERE {between('d')} GROUP BY prov),
  a AS (SELECT prov, count(*) AS n, sum(w) AS good, sum(e) AS e FROM
      (SELECT prov, k, max(win) AS w, count(*) AS e FROM pay WHERE {between('d')}
       GROUP BY prov, k) GROUP BY prov)
  SELECT prov AS provider, {big('ifnull(c, 0)')} AS orders_created_count,
    {big('ifnull(p, 0)')} AS orders_paid_count, {dbl('ifnull(rev, 0)')} AS revenue_rub,
    {big('ifnull(n, 0)')} AS payment_attempts_count,
    {big('ifnull(good, 0)')} AS payment_success_count,
    {big('ifnull(n - good, 0)')} AS payment_failed_count,
    {big('ifnull(e, 0)')} AS payment_events_count
  FROM s FULL JOIN a USING (prov)),
v_ref AS (
  WITH fresh AS (SELECT d, count(*) AS n FROM refd GROUP BY d),
  o AS (SELECT s.d, count(*) AS c, count_if(ok) AS p, count_if(status = 'failed') AS f,
      count(DISTINCT IF(ok, user_id, NULL)) AS u, sum(IF(ok, amount_rub, NULL)) AS rev
    FROM sale s SEMI JOIN refd USING (user_id) GROUP BY s.d),
  t AS (SELECT pay.d, count(*) AS e, count(DISTINCT pay.order_id) AS k
    FROM pay WHERE order_id IN (SELECT order_id FROM sale SEMI JOIN refd USING (user_id))
    GROUP BY pay.d)
  SELECT cal.d AS date, {big('ifnull(fresh.n, 0)')} AS new_referred_users_count,
    {big('ifnull(c, 0)')} AS referred_orders_created_count,
    {big('ifnull(p, 0)')} AS referred_orders_paid_count,
    {big('ifnull(f, 0)')} AS referred_orders_failed_count,
    {big('ifnull(e, 0)')} AS referred_payment_attempts_count,
    {big('ifnull(k, 0)')} AS referred_payment_orders_count,
    {big('ifnull(u, 0)')} AS referred_unique_buyers_count,
    {dbl('ifnull(rev, 0)')} AS referred_revenue_rub,
    {dbl('m.referral_bonus_cost_rub')} AS referral_bonus_cost_rub,
    {dbl('m.referral_profit_rub')} AS referral_profit_rub
  FROM cal LEFT JOIN fresh USING (d) LEFT JOIN o USING (d) LEFT JOIN t USING (d)
  JOIN m_referral m ON m.date = cal.d),
v_heat AS (
  SELECT CAST(isodow(wall) AS INTEGER) AS iso_dow, CAST(hour(wall) AS INTEGER) AS hour,
    {big('count(*)')} AS paid_orders_count, {dbl('ifnull(sum(amount_rub), 0)')} AS revenue_rub
  FROM sale WHERE ok AND {between('d')} GROUP BY ALL),
damaged AS (
  SELECT date, orders_paid_count + CAST(date = DATE '2010-12-02' AS INTEGER) AS paid,
    IF(date = DATE '2010-12-01', -1.00, revenue_rub) AS rev, profit_rub AS prof
  FROM m_daily WHERE date <> DATE '{DAY}')"""

HEAD = f"WITH {CORE.strip()},{ROWS},{MARTS},{VIEWS}\n"


def q(body: str) -> str:
    return HEAD + body


def _short(money: str) -> str:
    return f"regexp_replace(CAST({money} AS VARCHAR), '(\\.\\d)0$', '\\1')"


_ISSUE_TAIL = f"TIMESTAMP '{SEEN}' AS detected_at, false AS resolved"

_MISSING = f"""
SELECT 'missing_daily_row' AS issue_code, 'warning' AS severity,
  'No analytics_daily_metrics row for date ' || d AS message,
  '{{"date":"' || d || '"}}' AS meta, {_ISSUE_TAIL}
FROM cal WHERE d NOT IN (SELECT date FROM damaged)"""

_NEGATIVE = f"""
SELECT 'negative_revenue_or_profit' AS issue_code, 'critical' AS severity,
  'Suspicious values on ' || date || ': revenue=' || {_short('rev')} || ', profit='
    || {_short('prof')} AS message,
  '{{"date":"' || date || '","revenue_rub":"' || {_short('rev')} || '","profit_rub":"'
    || {_short('prof')} || '"}}' AS meta, {_ISSUE_TAIL}
FROM (SELECT * FROM damaged WHERE rev < 0 OR prof < -1000000)"""

_MISMATCH = f"""
SELECT 'paid_count_mismatch' AS issue_code, 'critical' AS severity,
  'Raw paid orders (' || a || ') != analytics_daily_metrics paid (' || b || ')' AS message,
  '{{"from":"{FROM}","to":"{TO}","raw_paid":' || a || ',"agg_paid":' || b || ',"diff":'
    || (a - b) || '}}' AS meta, {_ISSUE_TAIL}
FROM (SELECT (SELECT count(*) FROM sale WHERE ok AND {between('d')}) AS a,
  (SELECT {big('sum(paid)')} FROM damaged) AS b) WHERE a <> b"""

_ALL_ISSUES = f"""
SELECT * FROM ({_MISSING}) UNION ALL SELECT * FROM ({_NEGATIVE}) UNION ALL
SELECT * FROM ({_MISMATCH})"""

_TOP = """
SELECT {0}, CAST(sum(revenue_rub) AS DECIMAL(24,2)) AS total_revenue FROM {1}
GROUP BY {0} ORDER BY total_revenue DESC, {0} LIMIT 1"""
_TOP_PROVIDER = _TOP.format("payment_provider", "m_provider")
_TOP_PRODUCT = _TOP.format("product_type", "m_product")

_ORDER_LINE = f"""prov AS payment_provider, {dbl('ifnull(amount_rub, 0)')} AS amount_rub,
  {dbl('cost_eff')} AS cost_rub, ifnull(promo_code, '-') AS promo_code, wall AS timestamp_msk"""

_PROFILE = f"""u.user_id, ifnull(nullif(u.username, ''), '-') AS username,
  ifnull(nullif(u.referrer_id, ''), '-') AS referrer_id,
  {local('u.created_at')} AS user_created_date"""


def _users(where: str, limit: int) -> str:
    return f"""
SELECT {_PROFILE}, {big(f"count(s.order_id) FILTER ({between('s.d')})")} AS orders_created_count,
  {big(f"count(s.order_id) FILTER (s.ok AND {between('s.d')})")} AS orders_paid_count,
  {dbl(f"ifnull(sum(IF(s.ok AND {between('s.d')}, s.amount_rub, NULL)), 0)")} AS revenue_rub,
  {dbl(f"ifnull(sum(IF(s.ok AND {between('s.d')}, s.gross, NULL)), 0)")} AS gross_profit_rub,
  min(IF(s.ok, s.d, NULL)) AS first_paid_date, max(IF(s.ok, s.d, NULL)) AS last_paid_date
FROM core_users u LEFT JOIN sale s USING (user_id) WHERE {where}
GROUP BY u.user_id, u.username, u.referrer_id, u.created_at
ORDER BY revenue_rub DESC, orders_paid_count DESC, u.user_id LIMIT {limit}"""


_PAY_COUNTS = (
    "orders_created_count",
    "orders_paid_count",
    "orders_failed_count",
    "payment_attempts_count",
    "payment_success_count",
    "payment_failed_count",
    "payment_events_count",
)
_PAY_SUMS = ", ".join(f"{big(f'sum({c})')} AS {c}" for c in _PAY_COUNTS)
_REF_COUNTS = (
    "new_referred_users_count",
    "referred_orders_created_count",
    "referred_orders_paid_count",
    "referred_orders_failed_count",
    "referred_payment_attempts_count",
    "referred_payment_orders_count",
    "referred_unique_buyers_count",
)
_REF_SUMS = ", ".join(f"{big(f'sum({c})')} AS {c}" for c in _REF_COUNTS)
_REF_MONEY = ", ".join(
    f"round({dbl(f'sum({dec(c)})')}, 2) AS {c}"
    for c in ("referred_revenue_rub", "referral_bonus_cost_rub", "referral_profit_rub")
)
_REF_ITEMS = f"""
SELECT *, {ratio('referred_orders_paid_count', 'referred_orders_created_count')}
    AS referred_created_to_paid_rate,
  {ratio('referred_orders_paid_count', 'referred_payment_attempts_count')}
    AS referred_attempt_to_paid_rate,
  {ratio('referred_revenue_rub', 'referred_orders_paid_count', 2)} AS referred_avg_check_rub,
  round(referred_revenue_rub - referral_bonus_cost_rub, 2) AS referral_net_after_bonus_rub,
  {ratio('referral_profit_rub', 'referred_revenue_rub')} AS referral_profit_margin_rate
FROM v_ref"""

_FUNNEL = f"""
SELECT cal.d AS date, {big('count(DISTINCT user_id)')} AS app_open_count,
  {big('count(order_id)')} AS product_view_count,
  {big('ifnull(count_if(paying), 0)')} AS checkout_start_count,
  {big('count(order_id)')} AS order_created_count,
  {big('ifnull(count_if(ok), 0)')} AS order_paid_count,
  {ratio('count_if(paying)', 'count(order_id)')} AS open_to_checkout_rate,
  {ratio('count_if(paying)', 'count(order_id)')} AS checkout_to_created_rate,
  {ratio('count_if(ok)', 'count(order_id)')} AS created_to_paid_rate
FROM cal LEFT JOIN (SELECT *, order_id IN (SELECT order_id FROM core_payment_transactions
    WHERE order_id IS NOT NULL) AS paying FROM sale) USING (d)
GROUP BY cal.d"""

_KPIS = f"""
, buys AS (SELECT user_id, d, ifnull(amount_rub, 0) AS rev,
    min(d) OVER (PARTITION BY user_id) AS born FROM sale WHERE ok AND user_id IS NOT NULL),
k AS (SELECT
  count(DISTINCT user_id) FILTER ({between('born')}) AS base,
  count(DISTINCT user_id) FILTER ({between('born')} AND d - born BETWEEN 1 AND 7) AS d7,
  count(DISTINCT user_id) FILTER ({between('born')} AND d - born BETWEEN 1 AND 30) AS d30,
  count(*) FILTER ({between('born')} AND d - born <= 30) AS n30,
  sum(rev) FILTER ({between('born')} AND d - born <= 30) AS rev30,
  sum(rev) FILTER ({between('d')}) AS live, sum(rev) FILTER ({between('d')} AND d > born) AS again
  FROM buys),
s AS (SELECT sum(revenue_rub) AS rev, sum(profit_rub) AS prof, sum(orders_paid_count) AS paid,
  sum(unique_buyers_count) AS u, sum(repeat_buyers_count) AS r,
  (SELECT sum(discount_total_rub) FROM m_promo)
    + (SELECT sum(referral_bonus_cost_rub) FROM m_referral) AS spent FROM m_daily)
SELECT {ratio('rev', 'u', 2)} AS arppu_rub, {ratio('prof', 'rev')} AS gross_margin_rate,
  {ratio('d7', 'base')} AS retention_d7_rate, {ratio('d30', 'base')} AS retention_d30_rate,
  {ratio('rev30', 'n30', 2)} AS ltv_30d_proxy_rub, {ratio('spent', 'base', 2)} AS cac_proxy_rub,
  {ratio('again', 'live')} AS repeat_revenue_share, {ratio('r', 'u')} AS repeat_buyer_rate,
  {big('paid')} AS paid_orders_count, {big('base')} AS users_in_base
FROM k, s"""

_ANOMALIES = f"""
SELECT date, metric, round(x, 2) AS value, round((x - m) / sd, 2) AS z_score FROM (
  SELECT *, avg(x) OVER (PARTITION BY metric) AS m, stddev_pop(x) OVER (PARTITION BY metric) AS sd
  FROM (SELECT date, 'revenue_rub' AS metric, {dbl('revenue_rub')} AS x FROM m_daily UNION ALL
    SELECT date, 'orders_paid_count', {dbl('orders_paid_count')} FROM m_daily))
WHERE sd > 1e-6 AND abs((x - m) / sd) >= 2
ORDER BY abs(z_score) DESC, date, metric LIMIT 30"""

_SUMMARY = f"""
, t AS (SELECT sum(orders_created_count) AS c, sum(orders_paid_count) AS p,
  sum(revenue_rub) AS rev, sum(profit_rub) AS prof, sum(unique_buyers_count) AS u,
  sum(repeat_buyers_count) AS r FROM m_daily),
tp AS ({_TOP_PROVIDER}), tq AS ({_TOP_PRODUCT})
SELECT DATE '{FROM}' AS "from", DATE '{TO}' AS "to", {big('c')} AS orders_created_count,
  {big('p')} AS orders_paid_count, {ratio('p', 'c')} AS paid_conversion_rate,
  round({dbl('rev')}, 2) AS revenue_total_rub, round({dbl('prof')}, 2) AS profit_total_rub,
  {ratio('rev', 'p', 2)} AS avg_check_rub, {big('u')} AS unique_buyers_count,
  {big('r')} AS repeat_buyers_count, {ratio('r', 'u')} AS repeat_purchase_rate,
  tp.payment_provider AS top_provider,
  round({dbl('tp.total_revenue')}, 2) AS top_provider_revenue_rub,
  tq.product_type AS top_product, round({dbl('tq.total_revenue')}, 2) AS top_product_revenue_rub
FROM t, tp, tq"""

_BREAKDOWN = f"""
, x AS (SELECT count(*) AS c, count_if(ok) AS p,
  {dbl('ifnull(sum(IF(ok, amount_rub, NULL)), 0)')} AS rev,
  {dbl('ifnull(sum(IF(ok, cost_eff, NULL)), 0)')} AS cost,
  (SELECT {dbl('ifnull(sum(discount_total_rub), 0)')} FROM m_promo
    WHERE date = DATE '{DAY}') AS disc,
  (SELECT {dbl('referral_bonus_cost_rub')} FROM m_referral WHERE date = DATE '{DAY}') AS bonus
  FROM sale WHERE d = DATE '{DAY}')
SELECT DATE '{DAY}' AS date, c AS orders_created_count, {big('p')} AS orders_paid_count,
  round(rev, 2) AS revenue_rub, round(cost, 2) AS cost_rub,
  round(rev - cost, 2) AS gross_profit_rub, round(disc, 2) AS promo_discount_rub,
  round(bonus, 2) AS referral_bonus_rub,
  round(rev - cost - disc - bonus, 2) AS net_profit_estimate_rub,
  round(rev, 2) AS turnover_rub FROM x"""


def _compare(measure: str) -> str:
    return f"""
SELECT c.date, c.{measure} AS current_value, p.{measure} AS previous_value,
  c.{measure} - p.{measure} AS difference
FROM m_daily c JOIN m_daily p ON p.date = c.date - 30 WHERE {between('c.date', WIN_FROM, WIN_TO)}"""


def _totals(key: str, mart: str, measures: tuple[str, ...]) -> str:
    sums = ", ".join(
        f"CAST(sum({m}) AS {'BIGINT' if m.endswith('_count') else 'DECIMAL(24,2)'}) AS {m}"
        for m in measures
    )
    return f"SELECT {key}, {sums} FROM {mart} GROUP BY {key}"


_PROVIDER_TOTALS = _totals(
    "payment_provider",
    "m_provider",
    ("orders_created_count", "orders_paid_count", "revenue_rub"),
)
_MATRIX = ", ".join(
    f"{dbl(f'ifnull(max(IF(age_week = {a}, retention_rate, NULL)), 0)')} AS age_{a}"
    for a in range(8)
)

ORACLE: dict[str, str] = {
    # sources
    "core_orders": q("SELECT * FROM core_orders"),
    "core_users": q("SELECT * FROM core_users"),
    "core_payment_transactions": q("SELECT * FROM core_payment_transactions"),
    "core_promo_redemptions": q("SELECT * FROM core_promo_redemptions"),
    "core_referral_earnings": q("SELECT * FROM core_referral_earnings"),
    "snapshot_orders": q("SELECT * FROM core_orders"),
    "snapshot_mart_daily": q("SELECT * FROM m_daily"),
    "snapshot_payments_daily": q("SELECT * FROM v_pay_daily"),
    # row expressions
    "x_order_values": q(f"""
SELECT order_id, d AS local_date, wall AS timestamp_msk,
  CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(isodow(wall) AS INTEGER) AS iso_dow,
  CAST(hour(wall) AS INTEGER) AS hour, prov AS payment_provider, prod AS product_type,
  {dec('cost_eff')} AS effective_cost, CAST(profit_eff AS DECIMAL(15,2)) AS effective_profit,
  CAST(gross AS DECIMAL(15,2)) AS gross_profit,
  CAST(ifnull(amount_rub_original, amount_rub) - ifnull(amount_rub, 0) AS DECIMAL(16,2))
    AS discount
FROM sale"""),
    "x_payment_keys": q(f"""
SELECT id, prov AS provider, st AS status, k AS tx_key, win AS is_success,
  {local('own_at')} AS own_date FROM pay"""),
    "x_bonus_cost": q("""
SELECT e.order_id, e.stars, CAST(ifnull(o.cost_per_star, 0) * ifnull(e.stars, 0)
  AS DECIMAL(20,4)) AS bonus
FROM core_referral_earnings e LEFT JOIN core_orders o USING (order_id)"""),
    # marts
    "mart_daily": q("SELECT * FROM m_daily"),
    "mart_provider_daily": q("SELECT * FROM m_provider"),
    "mart_product_daily": q("SELECT * FROM m_product"),
    "mart_referral_daily": q("SELECT * FROM m_referral"),
    "mart_promo_daily": q("SELECT * FROM m_promo"),
    "mart_cohort_weekly": q("SELECT * FROM m_cohort"),
    # mart reads
    "q_daily": q(f"SELECT * FROM m_daily WHERE {between('date', WIN_FROM, WIN_TO)}"),
    "q_providers": q(f"SELECT * FROM m_provider WHERE {between('date', WIN_FROM, WIN_TO)}"),
    "q_products": q(f"SELECT * FROM m_product WHERE {between('date', WIN_FROM, WIN_TO)}"),
    "q_promos": q(f"SELECT * FROM m_promo WHERE {between('date', WIN_FROM, WIN_TO)}"),
    "q_promos_one_code": q("SELECT * FROM m_promo WHERE promo_code = 'PROMO2'"),
    "q_cohorts": q(f"""SELECT * FROM m_cohort
WHERE cohort_week BETWEEN date_trunc('week', DATE '{TO}' - 84) AND DATE '{TO}'"""),
    "q_cohorts_one_age": q("SELECT * FROM m_cohort WHERE age_week = 1"),
    "q_summary": q(_SUMMARY),
    "q_top_provider": q(_TOP_PROVIDER),
    "q_top_product": q(_TOP_PRODUCT),
    # one day
    "q_day_breakdown": q(_BREAKDOWN),
    "q_day_buyers": q(f"""
SELECT s.user_id, ifnull(nullif(any_value(u.username), ''), '-') AS username,
  {big('count(*)')} AS paid_orders_count, {dbl('ifnull(sum(s.amount_rub), 0)')} AS revenue_rub,
  {dbl('sum(cost_eff)')} AS cost_rub, {dbl('sum(gross)')} AS gross_profit_rub
FROM sale s LEFT JOIN core_users u USING (user_id) WHERE s.ok AND s.d = DATE '{DAY}'
GROUP BY s.user_id"""),
    "q_day_orders": q(f"""
SELECT s.order_id, s.user_id, ifnull(nullif(u.username, ''), '-') AS username, s.status,
  s.product_type, {_ORDER_LINE}
FROM sale s LEFT JOIN core_users u USING (user_id) WHERE s.d = DATE '{DAY}'
ORDER BY s."timestamp" DESC, s.order_id LIMIT 300"""),
    # live queries
    "q_funnel": q(_FUNNEL),
    "q_payments_daily": q("SELECT * FROM v_pay_daily"),
    "q_payments_providers": q("SELECT * FROM v_pay_prov"),
    "q_payment_failures": q(f"""
SELECT prov AS provider, st AS status, {big('count(DISTINCT k)')} AS failures_count FROM
  (SELECT *, max(win) OVER (PARTITION BY prov, k) AS best FROM pay WHERE {between('d')})
WHERE best = 0 GROUP BY ALL ORDER BY failures_count DESC, provider, status LIMIT 50"""),
    "q_payments_summary": q(f"""
, t AS (SELECT {_PAY_SUMS}, {dbl(f"sum({dec('revenue_rub')})")} AS rev FROM v_pay_daily)
SELECT * EXCLUDE (rev), round(rev, 2) AS revenue_rub,
  {ratio('payment_success_count', 'payment_attempts_count')} AS payment_success_rate,
  {ratio('orders_paid_count', 'orders_created_count')} AS paid_order_rate FROM t"""),
    "q_referrals": q(_REF_ITEMS),
    "q_referrals_totals": q(f"""
, t AS (SELECT {_REF_SUMS}, {_REF_MONEY} FROM v_ref)
SELECT *, {ratio('referred_orders_paid_count', 'referred_orders_created_count')}
    AS referred_created_to_paid_rate,
  {ratio('referred_orders_paid_count', 'referred_payment_attempts_count')}
    AS referred_attempt_to_paid_rate FROM t"""),
    "q_kpis": q(_KPIS),
    "q_kpis_from_buyers": q(_KPIS),
    "job_cohorts_from_buyers": q("SELECT * FROM m_cohort"),
    "store_buyer_months": q("""
SELECT user_id, min(d) AS first_date, max(d) AS last_date, count(*) AS paid_n,
  CAST(date_trunc('month', d) AS DATE) AS month
FROM sale WHERE ok AND d BETWEEN DATE '2010-10-01' AND DATE '2011-03-31' GROUP BY ALL"""),
    "q_purchases": q("""
SELECT user_id, min(d) AS first_date, max(d) AS last_date, count(*) AS paid_n
FROM sale WHERE ok AND d BETWEEN DATE '2010-10-01' AND DATE '2011-03-31' GROUP BY user_id"""),
    "q_anomalies": q(_ANOMALIES),
    "q_hourly_heatmap": q("SELECT * FROM v_heat"),
    # users
    "q_users": q(_users("true", 200)),
    "q_users_search": q(
        _users(f"u.user_id ILIKE '%{SEARCH}%' OR u.username ILIKE '%{SEARCH}%'", 300)
    ),
    "q_users_search_index": q(
        _users(f"u.user_id ILIKE '%{NAME_SEARCH}%' OR u.username ILIKE '%{NAME_SEARCH}%'", 0)
        .rpartition(" LIMIT ")[0]
    ),
    "q_user_profile": q(f"SELECT {_PROFILE} FROM core_users u WHERE user_id = '{USER}'"),
    "q_user_summary": q(f"""
SELECT {big('count(*)')} AS orders_created_count, {big('count_if(ok)')} AS orders_paid_count,
  {dbl('ifnull(sum(IF(ok, amount_rub, NULL)), 0)')} AS revenue_rub,
  {dbl('ifnull(sum(IF(ok, gross, NULL)), 0)')} AS gross_profit_rub
FROM sale WHERE user_id = '{USER}' AND {between('d')}"""),
    "q_user_orders": q(f"""
SELECT order_id, status, product_type, {_ORDER_LINE} FROM sale
WHERE user_id = '{USER}' AND {between('d')} ORDER BY "timestamp" DESC, order_id LIMIT 300"""),
    # quality
    "dq_missing_days": q(_MISSING),
    "dq_negative_values": q(_NEGATIVE),
    "dq_paid_mismatch": q(_MISMATCH),
    "dq_run": q(_ALL_ISSUES),
    "dq_issues": q(f"""SELECT * FROM ({_ALL_ISSUES})
ORDER BY detected_at DESC, issue_code, message LIMIT 200"""),
    "dq_summary": q(f"""SELECT {big('count(*)')} AS open_issues,
  {big("count_if(severity = 'critical')")} AS critical_open_issues FROM ({_ALL_ISSUES})"""),
    # jobs
    "store_daily": q("SELECT * FROM m_daily"),
    "store_provider_daily": q("SELECT * FROM m_provider"),
    "store_product_daily": q("SELECT * FROM m_product"),
    "store_referral_daily": q("SELECT * FROM m_referral"),
    "store_promo_daily": q("SELECT * FROM m_promo"),
    "store_cohort_weekly": q("SELECT * FROM m_cohort"),
    "store_range_read": q(
        f"SELECT * FROM m_provider WHERE {between('date', WIN_FROM, WIN_TO)}"
    ),
    "store_upsert_audit": q(f"""
SELECT date, payment_provider, orders_created_count,
  IF(date <= DATE '2010-12-31', TIMESTAMP '2011-03-31 06:00:00', TIMESTAMP '2011-03-31 07:00:00')
    AS created_at,
  IF(date < DATE '2010-12-15', TIMESTAMP '2011-03-31 06:00:00', TIMESTAMP '2011-03-31 07:00:00')
    AS updated_at
FROM m_provider"""),
    "job_runs": q(f"""
SELECT job_name, DATE '{FROM}' AS range_start, DATE '{TO}' AS range_end, 'success' AS status,
  CAST(n AS INTEGER) AS rows_written
FROM (SELECT 'DailyMetricsBackfillJob' AS job_name, count(*) AS n FROM cal UNION ALL
  SELECT 'CohortMetricsBackfillJob', count(DISTINCT date_trunc('week', d)) FROM cal UNION ALL
  SELECT 'DataQualityCheckJob', count(*) FROM m_daily WHERE profit_rub < -1000000)"""),
    "job_runs_summary": q(f"""SELECT {big('0')} AS running, {big('0')} AS failed_last_24h,
  {big('3')} AS success_last_24h"""),
    "job_last_success": q(f"SELECT TIMESTAMP '{SEEN}' AS last_successful_aggregation_at"),
    "job_incremental_refresh": q(
        f"SELECT * FROM m_daily WHERE {between('date', WIN_FROM, WIN_TO)}"
    ),
    "job_incremental_cohorts": q(f"""SELECT * FROM m_cohort
WHERE cohort_week BETWEEN date_trunc('week', DATE '{TO}' - 84) AND DATE '{TO}'"""),
    "job_referral_backfill": q("SELECT * FROM m_referral"),
    "export_csv_promos": q("SELECT * FROM m_promo"),
    "export_json_summary": q(_SUMMARY),
    "export_json_referrals": q(_REF_ITEMS),
    "export_json_payments": q(f"""
, rows AS (
  SELECT 'daily' AS list, CAST(date AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS detail,
    payment_attempts_count AS n FROM v_pay_daily
  UNION ALL SELECT 'providers', provider, NULL, payment_attempts_count FROM v_pay_prov
  UNION ALL SELECT 'failure_reasons', prov, st, {big('count(DISTINCT k)')} FROM
    (SELECT *, max(win) OVER (PARTITION BY prov, k) AS best FROM pay WHERE {between('d')})
    WHERE best = 0 GROUP BY prov, st
  UNION ALL SELECT 'summary', 'all', NULL, {big('sum(payment_attempts_count)')} FROM v_pay_daily)
SELECT '2010-10-01' AS "from", '2011-03-30' AS "to", * FROM rows"""),
    "stream_refresh": q("SELECT * FROM m_daily WHERE orders_created_count > 0"),
    "stream_deltas": q("SELECT * FROM m_daily WHERE orders_created_count > 0"),
    # panel
    "p_provider_totals": q(f"""
SELECT *, CASE WHEN orders_created_count > 0
  THEN {dbl('orders_paid_count')} / orders_created_count ELSE 0 END AS paid_conversion_rate
FROM ({_PROVIDER_TOTALS})"""),
    "p_product_totals": q(
        _totals("product_type", "m_product", ("orders_paid_count", "revenue_rub", "profit_rub"))
    ),
    "p_promo_totals": q(
        _totals(
            "promo_code",
            "m_promo",
            (
                "redemptions_count",
                "paid_orders_count",
                "discount_total_rub",
                "revenue_after_discount_rub",
                "profit_after_discount_rub",
            ),
        )
    ),
    "p_period_compare": q(_compare("revenue_rub")),
    "p_period_compare_buyers": q(_compare("unique_buyers_count")),
    "p_cohort_matrix": q(f"""SELECT cohort_week, {_MATRIX} FROM m_cohort GROUP BY cohort_week
ORDER BY cohort_week DESC LIMIT 8"""),
    "p_cohort_cells": q("""
, c AS (SELECT * FROM m_cohort WHERE age_week = 0 OR age_week % 2 = 1)
, w AS (SELECT DISTINCT cohort_week FROM c ORDER BY cohort_week DESC LIMIT 8)
, a AS (SELECT age_week, row_number() OVER (ORDER BY age_week) - 1 AS place
  FROM (SELECT DISTINCT age_week FROM c ORDER BY age_week LIMIT 6))
SELECT w.cohort_week, CAST(a.place AS INTEGER) AS place, a.age_week,
  CAST(ifnull(c.retention_rate, 0) AS DOUBLE) AS retention_rate
FROM w CROSS JOIN a LEFT JOIN c ON c.cohort_week = w.cohort_week AND c.age_week = a.age_week"""),
    "p_hourly_matrix": q(f"""
, g AS (SELECT CAST(a AS INTEGER) AS iso_dow, CAST(b AS INTEGER) AS hour
  FROM range(1, 8) x(a), range(24) y(b))
SELECT iso_dow, hour, {big('ifnull(paid_orders_count, 0)')} AS paid_orders_count,
  {dbl('ifnull(paid_orders_count, 0)')}
    / greatest((SELECT max(paid_orders_count) FROM v_heat), 1) AS intensity
FROM g LEFT JOIN v_heat USING (iso_dow, hour)"""),
    "p_provider_success": q(f"""
SELECT provider, payment_attempts_count, payment_success_count,
  CASE WHEN payment_attempts_count > 0
    THEN {dbl('payment_success_count')} / payment_attempts_count ELSE 0 END AS success_rate
FROM v_pay_prov"""),
    "p_provider_bars": q(f"""
, b AS (SELECT payment_provider, {dbl('revenue_rub')} AS revenue_rub FROM ({_PROVIDER_TOTALS})
  ORDER BY revenue_rub DESC, payment_provider LIMIT 6)
SELECT *, revenue_rub / greatest((SELECT max(revenue_rub) FROM b), 1) AS share_of_max FROM b"""),
    "p_recent_referrals": q(f"SELECT * FROM ({_REF_ITEMS}) ORDER BY date DESC LIMIT 31"),
    "p_first_cohorts": q("SELECT * FROM m_cohort ORDER BY cohort_week, age_week LIMIT 40"),
}

# The same lists without their limits.
ORACLE |= {
    f"{name}_all": ORACLE[name].rpartition(" LIMIT ")[0]
    for name in ("q_day_orders", "q_user_orders", "q_users", "q_payment_failures", "q_anomalies")
}
# Every day of the mart made bad.
ORACLE["dq_negative_values_all"] = q(
    _NEGATIVE.replace(
        "FROM damaged", "FROM (SELECT date, -revenue_rub - 1 AS rev, profit_rub AS prof FROM m_daily)"
    )
)
