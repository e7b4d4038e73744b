"""DuckDB oracle SQL for the registered queries (same names, same columns).

Each oracle restates the operator's semantics in plain SQL over the driver's
pre-registered tables; the fixture views are shared CTEs.
"""

from __future__ import annotations

from tillroll.sources.derived import FILE_HEADERS
from tillroll.sources.fixtures import PURCHASES_SQL, SALES_SQL


def _with(body: str, src: str = SALES_SQL) -> str:
    body = body.strip()
    sep = " " if body.upper().startswith("SELECT") else ", "
    return f"WITH sales AS ({src}){sep}{body}"


MONTH = "CAST(date_trunc('month', date) AS DATE)"
WEEK = "CAST(date_trunc('week', date) AS DATE)"

_MONTHLY = f"""
SELECT {MONTH} AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS customers
FROM sales WHERE date IS NOT NULL GROUP BY 1
"""

_GROWTH = """CASE WHEN prev IS NULL OR prev = 0 THEN 0.0
  ELSE round_even((CAST(cur AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100, 2) END"""


def _kpi_summary() -> str:
    return f"""
t AS (SELECT COALESCE(CAST(SUM(revenue) AS DOUBLE), 0.0) AS total_revenue,
             CAST(COUNT(DISTINCT order_id) AS BIGINT) AS total_orders,
             CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS total_customers FROM sales),
m AS (SELECT {MONTH} AS month, SUM(revenue) AS cur FROM sales WHERE date IS NOT NULL GROUP BY 1),
mg AS (SELECT month, cur, lag(cur) OVER (ORDER BY month) AS prev FROM m),
fc AS (SELECT customer_id, MIN(date) AS date FROM sales
       WHERE customer_id IS NOT NULL AND date IS NOT NULL GROUP BY 1),
nc AS (SELECT {MONTH} AS month, COUNT(*) AS cur FROM fc GROUP BY 1),
ncg AS (SELECT month, cur, lag(cur) OVER (ORDER BY month) AS prev FROM nc)
SELECT total_revenue, total_orders, total_customers,
       CASE WHEN total_orders > 0 THEN total_revenue / total_orders ELSE 0.0 END AS average_order_value,
       COALESCE((SELECT {_GROWTH} FROM mg ORDER BY month DESC LIMIT 1), 0.0) AS revenue_growth,
       COALESCE((SELECT {_GROWTH} FROM ncg ORDER BY month DESC LIMIT 1), 0.0) AS customer_growth
FROM t
"""


def _share(key: str) -> str:
    return f"""
g AS (SELECT {key}, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
      WHERE {key} IS NOT NULL GROUP BY 1)
SELECT {key}, revenue, round_even(revenue / (SELECT SUM(revenue) FROM g) * 100, 2) AS percentage
FROM g
"""


_PRODUCT_RANKS = """
p AS (SELECT product, SUM(revenue) AS revenue FROM sales WHERE product IS NOT NULL GROUP BY 1),
t AS (SELECT product, revenue, row_number() OVER (ORDER BY revenue DESC, product) AS rk FROM p)
"""


def quantile_sql(src: str, col: str, p: float) -> str:
    """Scalar subquery: linear-interpolated quantile of ``col`` in ``src``
    (numpy's lerp form, matching ``tillroll.operators.stats``)."""
    return f"""(SELECT CASE WHEN t >= 0.5 THEN b - (b - a) * (1.0 - t) ELSE a + (b - a) * t END
  FROM (SELECT MAX(CASE WHEN i = k THEN x END) AS a,
               MAX(CASE WHEN i = LEAST(k + 1, n - 1) THEN x END) AS b, ANY_VALUE(h - k) AS t
        FROM (SELECT x, i, n, h, floor(h) AS k
              FROM (SELECT CAST({col} AS DOUBLE) AS x, row_number() OVER (ORDER BY {col}) - 1 AS i,
                           COUNT(*) OVER () AS n,
                           CAST(COUNT(*) OVER () - 1 AS DOUBLE) * CAST({p!r} AS DOUBLE) AS h
                    FROM {src} WHERE {col} IS NOT NULL) z) y) w)"""


_BASE = """
ref AS (SELECT MAX(date) AS ref_date FROM sales),
b AS (SELECT customer_id, SUM(revenue) AS revenue_sum, COUNT(*) AS lines,
             COUNT(DISTINCT order_id) AS orders, MIN(date) AS first_date, MAX(date) AS last_date
      FROM sales WHERE customer_id IS NOT NULL GROUP BY 1)"""

_FEATURES = _BASE + """,
feat AS (SELECT customer_id, CAST(revenue_sum AS DOUBLE) AS total_revenue,
                CAST(revenue_sum AS DOUBLE) / lines AS avg_order_value,
                CAST(orders AS BIGINT) AS total_orders,
                date_sub('day', last_date, ref_date) AS days_since_last_order,
                GREATEST(date_sub('day', first_date, ref_date), 1) AS customer_age_days,
                round_even(orders / GREATEST(date_sub('day', first_date, ref_date), 1) * 30, 4)
                  AS order_frequency
         FROM b, ref)"""

_RISK = """CASE WHEN churn_probability >= 0.75 THEN 'High Risk'
     WHEN churn_probability >= 0.45 THEN 'Medium Risk'
     WHEN churn_probability >= 0.2 THEN 'Low Risk' ELSE 'Safe' END"""

_CHURN_RULE = _FEATURES + f""",
mx AS (SELECT MAX(days_since_last_order) AS m FROM feat),
cr0 AS (SELECT feat.*, CAST(days_since_last_order >= 90 AS INT) AS churned,
               round_even(CAST(days_since_last_order AS DOUBLE) / NULLIF(CAST(m AS DOUBLE), 0), 3)
                 AS churn_probability FROM feat, mx),
cr AS (SELECT *, {_RISK} AS risk_level FROM cr0)"""

_COHORT = f"""
cm AS (SELECT DISTINCT customer_id, {MONTH} AS month FROM sales
       WHERE customer_id IS NOT NULL AND date IS NOT NULL),
cf AS (SELECT customer_id, month, MIN(month) OVER (PARTITION BY customer_id) AS cohort_month FROM cm),
cc AS (SELECT cohort_month,
              CAST((year(month) * 12 + month(month)) - (year(cohort_month) * 12 + month(cohort_month)) AS INT)
                AS period, COUNT(*) AS customers FROM cf GROUP BY 1, 2),
cr AS (SELECT cohort_month, period, customers,
              MAX(CASE WHEN period = 0 THEN customers END) OVER (PARTITION BY cohort_month) AS cohort_size
       FROM cc),
crp AS (SELECT *, customers / cohort_size * 100.0::DOUBLE AS retention_pct FROM cr),
disp AS (SELECT cohort_month, period, retention_pct FROM crp)"""

_LTV = _BASE + """,
l0 AS (SELECT customer_id, CAST(revenue_sum AS DOUBLE) AS historical_ltv,
              CAST(revenue_sum AS DOUBLE) / lines AS avg_order_value,
              CAST(lines AS BIGINT) AS total_transactions, CAST(orders AS BIGINT) AS total_orders,
              GREATEST(date_sub('day', first_date, ref_date), 1) AS customer_age_days,
              date_sub('day', last_date, ref_date) AS recency_days FROM b, ref),
l1 AS (SELECT *, customer_age_days / 30.44::DOUBLE AS customer_age_months FROM l0),
l2 AS (SELECT *, total_orders / GREATEST(customer_age_months, 1.0::DOUBLE) AS order_rate,
              LEAST(GREATEST(recency_days / 90.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS churn_probability
       FROM l1),
l3 AS (SELECT *, 12.0::DOUBLE * (1.0::DOUBLE - churn_probability) AS expected_active_months FROM l2),
l4 AS (SELECT *, GREATEST(avg_order_value * order_rate * expected_active_months, 0.0::DOUBLE)
                   AS predicted_future_ltv FROM l3),
l5 AS (SELECT *, historical_ltv + predicted_future_ltv AS total_ltv,
              predicted_future_ltv AS untapped_value FROM l4),
ltv AS (SELECT *, CASE WHEN total_ltv >= P90 THEN 'Platinum' WHEN total_ltv >= P70 THEN 'Gold'
                       WHEN total_ltv >= P40 THEN 'Silver' ELSE 'Bronze' END AS ltv_segment FROM l5)"""
_LTV = (_LTV.replace("P90", quantile_sql("l5", "total_ltv", 0.9))
            .replace("P70", quantile_sql("l5", "total_ltv", 0.7))
            .replace("P40", quantile_sql("l5", "total_ltv", 0.4)))


def _rules(min_support: float) -> str:
    return f"""
top AS (SELECT product, COUNT(*) AS lines FROM sales WHERE product IS NOT NULL
        GROUP BY 1),
cells AS (SELECT order_id, product, SUM(revenue) AS rev FROM sales
          WHERE order_id IS NOT NULL AND product IN (SELECT product FROM top) GROUP BY 1, 2),
tot AS (SELECT COUNT(DISTINCT order_id) AS n FROM cells),
ib AS (SELECT order_id, product FROM cells WHERE rev > 0),
ic AS (SELECT product, COUNT(*) AS c FROM ib GROUP BY 1),
pr AS (SELECT x.product AS product_a, y.product AS product_b, COUNT(*) AS both_n
       FROM ib x JOIN ib y ON x.order_id = y.order_id AND x.product < y.product GROUP BY 1, 2),
r1 AS (SELECT product_a, product_b, both_n / n AS s FROM pr, tot),
r2 AS (SELECT r1.*, s / (ca.c / n) AS conf FROM r1 JOIN ic ca ON ca.product = r1.product_a, tot),
r3 AS (SELECT r2.*, conf / (cb.c / n) AS lft FROM r2 JOIN ic cb ON cb.product = r2.product_b, tot),
rules AS (SELECT product_a, product_b, round_even(s, 4) AS support, round_even(conf, 4) AS confidence,
                 round_even(lft, 3) AS lift FROM r3
          WHERE s >= CAST({min_support!r} AS DOUBLE) AND lft > 1.1::DOUBLE
         )"""


_PERF = """
mx AS (SELECT MAX(date) AS m FROM sales),
g AS (SELECT product, SUM(revenue) AS rev, COUNT(*) AS order_count,
             SUM(CASE WHEN date >= m - INTERVAL 30 DAY THEN revenue END) AS recent,
             COUNT(CASE WHEN date >= m - INTERVAL 30 DAY THEN 1 END) AS n_recent,
             SUM(CASE WHEN date >= m - INTERVAL 60 DAY AND date < m - INTERVAL 30 DAY THEN revenue END)
               AS previous,
             COUNT(CASE WHEN date >= m - INTERVAL 60 DAY AND date < m - INTERVAL 30 DAY THEN 1 END)
               AS n_previous
      FROM sales, mx WHERE product IS NOT NULL GROUP BY 1),
st AS (SELECT product, CAST(rev AS DOUBLE) AS total_revenue, order_count,
              CAST(rev AS DOUBLE) / order_count AS avg_price,
              round_even(CASE WHEN n_recent > 0 AND n_previous > 0 AND previous <> 0
                              THEN (CAST(recent AS DOUBLE) - CAST(previous AS DOUBLE))
                                   / CAST(previous AS DOUBLE) * 100
                              ELSE 0.0 END, 1) AS trend_pct FROM g),
mm AS (SELECT MIN(total_revenue) AS lr, MAX(total_revenue) AS hr, MIN(order_count) AS lo,
              MAX(order_count) AS ho, MIN(trend_pct) AS lt, MAX(trend_pct) AS ht FROM st),
sc AS (SELECT st.*,
         CASE WHEN hr = lr THEN 50.0 ELSE round_even((total_revenue - lr) / (hr - lr) * 100, 1) END AS revenue_score,
         CASE WHEN ho = lo THEN 50.0 ELSE round_even((order_count - lo) / (ho - lo) * 100, 1) END AS frequency_score,
         CASE WHEN ht = lt THEN 50.0 ELSE round_even((trend_pct - lt) / (ht - lt) * 100, 1) END AS trend_score
       FROM st, mm),
cs AS (SELECT *, round_even(revenue_score * 0.5::DOUBLE + frequency_score * 0.3::DOUBLE
                            + trend_score * 0.2::DOUBLE, 1) AS composite_score FROM sc),
perf AS (SELECT product, total_revenue, order_count, avg_price, trend_pct, revenue_score, frequency_score,
                trend_score, composite_score,
                CASE WHEN composite_score >= 70 AND trend_pct > 0 THEN 'Star'
                     WHEN composite_score >= 70 THEN 'Steady Performer'
                     WHEN composite_score >= 40 THEN 'Average'
                     WHEN trend_pct < -20 THEN 'Declining' ELSE 'Underperformer' END AS performance_class
         FROM cs)"""


def _fit(key: str, min_lines: int) -> str:
    return f"""
base AS (SELECT {key} AS g, date, revenue FROM sales WHERE date IS NOT NULL AND {key} IS NOT NULL),
dly AS (SELECT g, CAST(date AS DATE) AS d, CAST(SUM(revenue) AS DOUBLE) AS y FROM base
        GROUP BY 1, 2 HAVING SUM(revenue) > 0),
wky AS (SELECT g, {WEEK} + 6 AS d, CAST(SUM(revenue) AS DOUBLE) AS y FROM base
        GROUP BY 1, 2 HAVING SUM(revenue) > 0),
dst AS (SELECT g, COUNT(*) AS n_days, MIN(d) AS d_min, MAX(d) AS d_max FROM dly GROUP BY 1),
wst AS (SELECT g, COUNT(*) AS n_weeks FROM wky GROUP BY 1),
lns AS (SELECT g, COUNT(*) AS n_lines FROM base GROUP BY 1),
ch AS (SELECT dst.*, COALESCE(n_weeks, 0) >= 8 AS weekly FROM dst LEFT JOIN wst USING (g)
       JOIN lns USING (g) WHERE n_days >= 14 AND n_lines >= {min_lines}),
pts AS (SELECT g, d - DATE '1970-01-01' AS x, y FROM dly JOIN ch USING (g) WHERE NOT weekly
        UNION ALL SELECT g, d - DATE '1970-01-01' AS x, y FROM wky JOIN ch USING (g) WHERE weekly),
s1 AS (SELECT g, COUNT(*) AS n, MIN(x) AS x0, AVG(x) AS mu, (MAX(x) - MIN(x)) / 2.0::DOUBLE AS sc,
              AVG(y) AS ybar FROM pts GROUP BY 1),
pu AS (SELECT g, y, (x - mu) / sc AS u, ybar FROM pts JOIN s1 USING (g)),
s2 AS (SELECT g, SUM(u) AS S1, SUM(u * u) AS S2, SUM(u * u * u) AS S3, SUM(u * u * u * u) AS S4,
              SUM(y) AS T0, SUM(u * y) AS T1, SUM(u * u * y) AS T2,
              SUM((y - ybar) * (y - ybar)) AS SST FROM pu GROUP BY 1),
m AS (SELECT s1.g, n, x0, mu, sc, SST, CAST(n AS DOUBLE) AS S0, S1, S2, S3, S4, T0, T1, T2
      FROM s1 JOIN s2 USING (g)),
cf AS (SELECT g, n, x0, mu, sc, SST,
         (T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2)) / det AS a,
         (S0 * (T1 * S4 - S3 * T2) - T0 * (S1 * S4 - S3 * S2) + S2 * (S1 * T2 - T1 * S2)) / det AS b,
         (S0 * (S2 * T2 - T1 * S3) - S1 * (S1 * T2 - T1 * S2) + T0 * (S1 * S3 - S2 * S2)) / det AS c
       FROM (SELECT *, S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2) AS det
             FROM m) z),
s3 AS (SELECT g, SUM(r * r) AS SSE, stddev_pop(r) AS resid_std
       FROM (SELECT pu.g, y - (a + b * u + c * u * u) AS r FROM pu JOIN cf USING (g)) z GROUP BY 1),
fit AS (SELECT ch.g, weekly, d_min, d_max, n, x0, mu, sc, a, b, c, resid_std,
               CASE WHEN SST = 0 THEN CASE WHEN SSE = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - SSE / SST END AS r2
        FROM ch JOIN cf USING (g) JOIN s3 USING (g))"""


def _forecast(key: str, min_lines: int, parity: bool) -> str:
    if parity:
        x = "CAST((d_max - d_min) + i + x0 AS DOUBLE)"
        scale = "1.0::DOUBLE"
    else:
        x = "CAST((d_max + CAST(i AS INT)) - DATE '1970-01-01' AS DOUBLE)"
        scale = "CASE WHEN weekly THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END"
    return _fit(key, min_lines) + f""",
fp AS (SELECT g, d_max + CAST(i AS INT) AS date,
              GREATEST((a + b * ((({x}) - mu) / sc) + c * ((({x}) - mu) / sc) * ((({x}) - mu) / sc)) / {scale},
                       0.0::DOUBLE) AS p,
              resid_std / {scale} AS sd
       FROM fit, range(1, 31) t(i)),
fc AS (SELECT g, date, round_even(p, 2) AS predicted, round_even(p + 1.5::DOUBLE * sd, 2) AS upper_bound,
              round_even(GREATEST(p - 1.5::DOUBLE * sd, 0.0::DOUBLE), 2) AS lower_bound FROM fp)"""


_FIT_LABELS = """round_even(r2, 3) AS model_score,
  CASE WHEN r2 > 0.8 THEN 'Excellent' WHEN r2 > 0.5 THEN 'Good' ELSE 'Moderate' END AS fit_label,
  CASE WHEN r2 >= 0.7 THEN 'good' WHEN r2 >= 0.4 THEN 'moderate' ELSE 'low' END AS reliability,
  CASE WHEN weekly THEN 'W' ELSE 'D' END AS fit_freq, CAST(n AS BIGINT) AS fit_points"""

_RECENT_DAILY = """
dd AS (SELECT CAST(date AS DATE) AS date, SUM(revenue) AS rev FROM sales WHERE date IS NOT NULL
       GROUP BY 1 HAVING SUM(revenue) > 0),
rr AS (SELECT date, rev, row_number() OVER (ORDER BY date DESC) AS rn,
              row_number() OVER (ORDER BY date) AS rn_asc FROM dd)"""

_MOVING_AVG = _RECENT_DAILY + """,
st AS (SELECT COUNT(*) AS n, MAX(date) AS last,
              CAST(SUM(CASE WHEN rn <= 7 THEN rev END) AS DOUBLE) / 7 AS recent,
              CAST(SUM(CASE WHEN rn BETWEEN 8 AND 14 THEN rev END) AS DOUBLE) / 7 AS older_full,
              CAST(SUM(CASE WHEN rn_asc <= 7 THEN rev END) AS DOUBLE) / 7 AS older_head FROM rr),
st2 AS (SELECT *, CASE WHEN n >= 14 THEN older_full ELSE older_head END AS older FROM st WHERE n >= 7),
st3 AS (SELECT *, CASE WHEN older > 0 THEN (recent - older) / (7.0::DOUBLE * older) ELSE 0.0 END AS g
        FROM st2)
SELECT last + CAST(i AS INT) AS date, GREATEST(recent * (1.0::DOUBLE + g * i), 0.0::DOUBLE) AS predicted_revenue
FROM st3, range(1, 31) t(i)"""


_KPI_BLOCK = f"""
t AS (SELECT COALESCE(CAST(SUM(revenue) AS DOUBLE), 0.0) AS total_revenue,
             CAST(COUNT(DISTINCT order_id) AS BIGINT) AS total_orders,
             CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS total_customers FROM sales),
m AS (SELECT {MONTH} AS month, SUM(revenue) AS cur FROM sales WHERE date IS NOT NULL GROUP BY 1),
mg AS (SELECT month, cur, lag(cur) OVER (ORDER BY month) AS prev FROM m),
fc AS (SELECT customer_id, MIN(date) AS date FROM sales
       WHERE customer_id IS NOT NULL AND date IS NOT NULL GROUP BY 1),
nc AS (SELECT {MONTH} AS month, COUNT(*) AS cur FROM fc GROUP BY 1),
ncg AS (SELECT month, cur, lag(cur) OVER (ORDER BY month) AS prev FROM nc),
g AS (SELECT COALESCE((SELECT {_GROWTH} FROM mg ORDER BY month DESC LIMIT 1), 0.0) AS revenue_growth,
             COALESCE((SELECT {_GROWTH} FROM ncg ORDER BY month DESC LIMIT 1), 0.0) AS customer_growth),
tp AS (SELECT product, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales WHERE product IS NOT NULL
       GROUP BY 1 ORDER BY SUM(revenue) DESC, product LIMIT 1),
cg AS (SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
       WHERE category IS NOT NULL GROUP BY 1),
wc AS (SELECT category, round_even(revenue / (SELECT SUM(revenue) FROM cg) * 100, 2) AS percentage
       FROM cg WHERE (SELECT COUNT(*) FROM cg) > 1 ORDER BY revenue ASC, category DESC LIMIT 1),
cc AS (SELECT customer_id, SUM(revenue) AS revenue FROM sales WHERE customer_id IS NOT NULL GROUP BY 1),
top5 AS (SELECT CAST(COALESCE((SELECT SUM(revenue) FROM (SELECT revenue FROM cc ORDER BY revenue DESC,
                customer_id LIMIT 5) z), 0) AS DOUBLE) / CAST((SELECT SUM(revenue) FROM cc) AS DOUBLE) * 100
                AS top5_pct)"""


def _amount_sql(parity: bool) -> str:
    plain = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)"
    text = f"""CASE WHEN l_returnflag = 'R' THEN '(' || {plain} || ')'
        WHEN l_returnflag = 'A' THEN '$' || format('{{:,.2f}}', l_extendedprice)
        WHEN l_linestatus = 'O' THEN {plain} || ' EUR' ELSE '£' || {plain} END"""
    if parity:
        rev = "TRY_CAST(NULLIF(regexp_replace(amount_text, '[^0-9.]', '', 'g'), '') AS DOUBLE)"
    else:
        # the texts hold one plain number; brackets make it negative
        number = "regexp_extract(replace(amount_text, ',', ''), '[0-9]+[.][0-9]+', 0)"
        rev = f"CAST({number} AS DOUBLE) * CASE WHEN amount_text LIKE '(%' THEN -1.0 ELSE 1.0 END"
    return f"""
WITH tx AS (SELECT l_orderkey, l_linenumber, {text} AS amount_text FROM lineitem),
pr AS (SELECT l_orderkey, l_linenumber, amount_text, {rev} AS revenue FROM tx)
SELECT * FROM pr WHERE revenue > 0"""


# The currency registry, written out for the oracle.
_COUNTRIES = {
    "GBP": "united kingdom|uk|england|scotland|wales|great britain", "USD": "united states|usa|us|america",
    "EUR": "france|germany|italy|spain|netherlands|belgium|portugal|austria|finland|ireland|greece|europe",
    "INR": "india", "JPY": "japan", "AUD": "australia", "CAD": "canada", "BRL": "brazil|brasil",
}


def _registry_values() -> str:
    return ", ".join(f"('{code}', {ci}, '{name}', {ri})" for ci, (code, names) in enumerate(_COUNTRIES.items())
                     for ri, name in enumerate(names.split("|")))


def _words_sql(x: str) -> str:
    return f"(' ' || trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g')) || ' ')"


def _lloyd_sql(rounds: int, k: int = 4) -> str:
    """Whole-number k-means over x (x0, x1, x2), a fixed number of rounds."""
    sums = ", ".join(f"CAST(SUM(CAST(x{i} AS HUGEINT)) AS DOUBLE) AS s{i}, "
                     f"CAST(SUM(CAST(x{i} AS HUGEINT) * x{i}) AS DOUBLE) AS q{i}" for i in range(3))
    sd = "sqrt(GREATEST(q{0} / n - (s{0} / n) * (s{0} / n), 0.0))"
    z = ", ".join(f"CAST(floor((CAST(x{i} AS DOUBLE) - s{i} / n) / CASE WHEN {sd.format(i)} > 0 THEN {sd.format(i)} ELSE 1.0 END * 10000 + 0.5) "
                  f"AS BIGINT) AS z{i}" for i in range(3))
    group = " + ".join(f"CAST(CAST(s AS DOUBLE) >= {quantile_sql('zs', 's', i / k)} AS INT)" for i in range(1, k))
    parts = [f"m AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, {sums} FROM x)",
             f"z AS (SELECT customer_id, recency, frequency, monetary, {z} FROM x, m)",
             "zs AS (SELECT *, z2 + z1 - z0 AS s FROM z)",
             f"a0 AS (SELECT *, {group} AS cluster FROM zs)", "c0 AS (SELECT i AS cluster, 0 AS z0, 0 AS z1, 0 AS z2 FROM range(4) t(i))"]
    for r in range(1, rounds + 1):
        mean = ", ".join(f"COALESCE(CAST(floor(CAST(SUM(a.z{i}) AS DOUBLE) / COUNT(a.z{i}) + 0.5) AS BIGINT), ANY_VALUE(c.z{i})) AS z{i}"
                         for i in range(3))
        far = " + ".join(f"(p.z{i} - c.z{i}) * (p.z{i} - c.z{i})" for i in range(3))
        parts += [f"c{r} AS (SELECT c.cluster, {mean} FROM c{r - 1} c LEFT JOIN a{r - 1} a ON a.cluster = c.cluster GROUP BY 1)",
                  f"a{r} AS (SELECT p.*, c.cluster FROM zs p, c{r} c "
                  f"QUALIFY row_number() OVER (PARTITION BY p.customer_id ORDER BY {far}, c.cluster) = 1)"]
    return ",\n".join(parts) + f"\nSELECT customer_id, recency, frequency, monetary, CAST(cluster AS INT) AS cluster FROM a{rounds}"


# Outcome per header style of a customer's file (customer number modulo 5).
_STYLE_MATCHES = """
st(k, column_name, standard, method) AS (VALUES
  (0, 'Order Date', 'date', 'exact'), (0, 'Total', 'revenue', 'exact'), (0, 'Qty', 'quantity', 'exact'),
  (1, 'order_date', 'date', 'exact'), (1, 'AMOUNT', 'revenue', 'exact'), (1, 'Order_Quantity', 'quantity', 'suggestion'),
  (1, 'sku', 'product', 'exact'), (2, 'Dtae', 'date', 'suggestion'), (2, 'Custmer ID', 'customer_id', 'fuzzy'),
  (2, 'Regionn', 'region', 'fuzzy'), (3, 'Invoicedate', 'date', 'exact'), (3, 'Prodct', 'product', 'fuzzy'),
  (3, 'Product Nme', 'category', 'fuzzy'), (3, 'invoice date', 'order_id', 'suggestion'), (4, 'Total Price', 'revenue', 'exact'))"""


def _file_profiles() -> str:
    numeric = ("quantity", "customer_id", "order_id")
    parts = []
    for i, (name, header) in enumerate(FILE_HEADERS.items()):
        for j, (c, _) in enumerate(header):
            if c:
                mean = f"CAST(printf('%.11e', AVG(CAST({c} AS DOUBLE))) AS DOUBLE)" if c in numeric else "CAST(NULL AS DOUBLE)"
                parts.append(f"SELECT '{name}' AS file_id, {j} AS position, COUNT(*) AS non_null, {float(c == 'date')}::DOUBLE AS date_rate, "
                             f"{float(c in numeric)}::DOUBLE AS numeric_rate, {mean} AS mean, true AS all_integer, "
                             f"COUNT(DISTINCT {c}) <= 20 AS few_values FROM sales WHERE order_id % {len(FILE_HEADERS)} = {i} HAVING COUNT(*) > 0")
    return _with("\nUNION ALL ".join(parts))


def _file_oracles() -> dict[str, str]:
    o = {"files_monthly_revenue": _with(_MONTHLY), "files_column_profiles": _file_profiles()}
    o["files_header_mapping"] = f"""WITH {_STYLE_MATCHES}
SELECT CAST(c_custkey AS VARCHAR) AS file_id, column_name, standard, method FROM customer JOIN st ON c_custkey % 5 = k"""
    o["files_availability"] = f"""WITH {_STYLE_MATCHES},
req(module, standard) AS (VALUES ('sales', 'date'), ('sales', 'revenue'), ('forecast', 'date'), ('forecast', 'revenue'),
  ('customers', 'customer_id'), ('churn', 'customer_id'), ('products', 'product'), ('basket', 'product'), ('basket', 'order_id'))
SELECT CAST(c_custkey AS VARCHAR) AS file_id, module, COUNT(*) = COUNT(st.standard) AS available,
       COALESCE(string_agg(CASE WHEN st.standard IS NULL THEN req.standard END, ',' ORDER BY req.standard), '') AS missing
FROM customer CROSS JOIN req LEFT JOIN st ON c_custkey % 5 = k AND st.standard = req.standard AND method <> 'suggestion' GROUP BY 1, 2"""
    o["files_currency"] = """
SELECT ['lines', 'olist', 'flipkart', 'lines'][n % 4 + 1] || '_' || n AS file_id, ['GBP', 'EUR', 'INR', 'USD'][n % 4 + 1] AS code
FROM (SELECT CAST(regexp_extract(n_name, '([0-9]+)$', 1) AS INT) AS n FROM nation)"""
    return o


def oracles() -> dict[str, str]:
    from tillroll.plans.catalog import DIGITS, STABLE
    o = _oracles()
    for name, cols in STABLE.items():
        if name in o:
            d = DIGITS.get(name, 12) - 1
            repl = ", ".join(f"CAST(printf('%.{d}e', {c}) AS DOUBLE) AS {c}" for c in cols)
            o[name] = f"SELECT * REPLACE ({repl}) FROM ({o[name]}) q"
    return o


def _ingest_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    by_day = "SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS rows FROM orders GROUP BY 1"
    o["clean_dates_by_day"] = by_day
    o["clean_dates_day_first"] = by_day
    o["clean_event_timestamps"] = "SELECT CAST(ts AS DATE) AS date, COUNT(*) AS rows FROM events GROUP BY 1"
    o["date_report"] = """SELECT COUNT(*) AS given, COUNT(*) FILTER (WHERE o_orderkey % 2 = 0) AS parsed,
       COUNT(*) FILTER (WHERE o_orderkey % 2 = 1) AS unparsed FROM orders"""
    o["clean_quantities"] = """
SELECT l_orderkey, l_linenumber, CAST(CASE n WHEN 1 THEN 99999999999 WHEN 3 THEN 7 WHEN 0 THEN CAST(l_quantity AS INT)
                                        ELSE 1 END AS BIGINT) AS quantity
FROM (SELECT *, (l_orderkey + l_linenumber) % 8 AS n FROM lineitem) z WHERE n NOT IN (5, 6)"""
    o["unit_price_fixed"] = """
SELECT l_orderkey AS order_id, SUM(CAST(l_quantity AS INT) * p) AS revenue
FROM lineitem JOIN (SELECT l_orderkey, MIN(CAST(l_extendedprice AS DECIMAL(12,2))) AS p FROM lineitem GROUP BY 1) m
  USING (l_orderkey) GROUP BY 1"""
    o["derived_revenue"] = """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) * CAST(l_quantity AS INT) AS revenue
FROM lineitem WHERE l_extendedprice > 0"""
    o["sales_columns_profile"] = _with("""
one AS (SELECT COUNT(*) AS n, CAST(printf('%.11e', AVG(quantity)) AS DOUBLE) AS q FROM sales)
SELECT 'Order Date' AS column_name, n AS non_null, 1.0::DOUBLE AS date_rate, 0.0::DOUBLE AS numeric_rate,
       CAST(NULL AS DOUBLE) AS mean, true AS all_integer FROM one
UNION ALL SELECT 'Qty', n, 0.0, 1.0, q, true FROM one
UNION ALL SELECT 'Sub-Category', n, 0.0, 0.0, NULL, true FROM one
UNION ALL SELECT 'Ship.Country', n, 0.0, 0.0, NULL, true FROM one
UNION ALL SELECT 'Empty', 0, NULL, NULL, NULL, true""")
    o["mapping_unknown_headers"] = _with("""
s AS (SELECT AVG(revenue) AS r, AVG(quantity) AS q, COUNT(DISTINCT product) AS p, COUNT(DISTINCT category) AS c,
             BOOL_AND(revenue = floor(revenue)) AS whole FROM sales)
SELECT 'zz1' AS column_name, 'date' AS standard, 'sniffed' AS method
UNION ALL SELECT 'zz2', 'revenue', 'sniffed' FROM s WHERE r > 1 AND NOT whole
UNION ALL SELECT 'zz3', 'quantity', 'sniffed' FROM s WHERE q < 1000
UNION ALL SELECT 'zz4', 'product', 'sniffed' FROM s WHERE p > 20
UNION ALL SELECT 'zz5', 'category', 'sniffed' FROM s WHERE c <= 20""")
    o["fuzzy_headers_by_category"] = _with(_share("category"))
    o["dataset_overview"] = _with("""
SELECT COUNT(*) AS rows, CAST(8 AS INT) AS columns, MIN(date) AS first_date, MAX(date) AS last_date FROM sales""")
    o["supplier_currency"] = """
SELECT l_suppkey, CASE WHEN d = 0 AND p = 0 THEN NULL WHEN p >= d THEN 'GBP' ELSE 'USD' END AS code
FROM (SELECT l_suppkey, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS d,
             COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R') AND l_linestatus <> 'O') AS p
      FROM lineitem GROUP BY 1) z"""
    o["country_currency"] = _with("""
c AS (SELECT CAST(regexp_extract(region, '[0-9]+$') AS INT) % 4 AS k, COUNT(*) AS n FROM sales GROUP BY 1)
SELECT CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'INR' ELSE 'BRL' END AS code FROM c
ORDER BY n DESC, CASE k WHEN 0 THEN 'germany' WHEN 1 THEN 'united kingdom' WHEN 2 THEN 'india' ELSE 'brazil' END LIMIT 1""")
    o["revenue_series_weekly"] = _with(f"SELECT {WEEK} AS period, CAST(SUM(revenue) AS DOUBLE) AS revenue "
                                       "FROM sales WHERE date IS NOT NULL GROUP BY 1")
    o["time_series_monthly"] = _with("SELECT last_day(CAST(date AS DATE)) AS date, CAST(SUM(revenue) AS DOUBLE) AS revenue "
                                     "FROM sales WHERE date IS NOT NULL GROUP BY 1 HAVING SUM(revenue) > 0")
    no_date = (_LTV.replace("GREATEST(date_sub('day', first_date, ref_date), 1) AS customer_age_days",
                            "CAST(NULL AS BIGINT) AS customer_age_days")
               .replace("date_sub('day', last_date, ref_date) AS recency_days", "CAST(30 AS BIGINT) AS recency_days")
               .replace("customer_age_days / 30.44::DOUBLE AS", "6.0::DOUBLE AS")
               .replace("total_orders / GREATEST(customer_age_months, 1.0::DOUBLE)", "total_orders / 6.0::DOUBLE"))
    o["customer_ltv_no_date"] = _with(no_date + " SELECT * EXCLUDE (customer_id), customer_id FROM ltv")
    summary = _BASE + """,
r AS (SELECT customer_id, date_sub('day', last_date, ref_date + INTERVAL 1 DAY) AS recency, CAST(orders AS BIGINT) AS frequency,
             CAST(revenue_sum AS DOUBLE) AS monetary, CAST(customer_id % 5 AS INT) AS cluster FROM b, ref),
mn AS (SELECT cluster, AVG(recency) AS r, AVG(frequency) AS f, AVG(monetary) AS m FROM r GROUP BY 1),
rk AS (SELECT x.cluster,
              SUM(CASE WHEN y.m < x.m THEN 1.0 WHEN y.m = x.m THEN 0.5 ELSE 0 END)
            + SUM(CASE WHEN y.f < x.f THEN 1.0 WHEN y.f = x.f THEN 0.5 ELSE 0 END)
            - SUM(CASE WHEN y.r < x.r THEN 1.0 WHEN y.r = x.r THEN 0.5 ELSE 0 END) AS score FROM mn x, mn y GROUP BY 1),
lb AS (SELECT cluster, row_number() OVER (ORDER BY score DESC, cluster) AS pos FROM rk),
sg AS (SELECT r.*, CASE pos WHEN 1 THEN 'Champions' WHEN 2 THEN 'Loyal Customers' WHEN 3 THEN 'At Risk'
                            WHEN 4 THEN 'Lost/Inactive' ELSE 'Segment ' || pos END AS segment FROM r JOIN lb USING (cluster)),
sm AS (SELECT segment, COUNT(*) AS customers, CAST(round_even(AVG(recency), 0) AS BIGINT) AS avg_recency,
              round_even(AVG(frequency), 1) AS avg_frequency, round_even(AVG(monetary), 2) AS avg_monetary,
              SUM(monetary) AS total_revenue FROM sg GROUP BY 1)"""
    o["fixed_cluster_summary"] = _with(summary + " SELECT * FROM sm")
    o["fixed_cluster_insights"] = _with(summary + """
SELECT segment, customers, avg_monetary, CASE segment WHEN 'Champions' THEN 'reward_loyalty'
  WHEN 'Loyal Customers' THEN 'upsell_premium' WHEN 'At Risk' THEN 'win_back_campaign'
  WHEN 'Lost/Inactive' THEN 're_engagement_offer' ELSE 'review_segment' END AS action FROM sm""")
    o["canonical_rfm"] = _with(_BASE + """
SELECT customer_id, date_sub('day', last_date, ref_date + INTERVAL 1 DAY) AS recency,
       CAST(orders AS BIGINT) AS frequency, CAST(revenue_sum AS DOUBLE) AS monetary FROM b, ref""")
    o["canonical_year_by_category"] = _with(_share("category"), f"SELECT * FROM ({SALES_SQL}) s WHERE year(date) = 1997")
    o["lloyd_clusters"] = _with(_BASE + f""",
r AS (SELECT customer_id, date_sub('day', last_date, ref_date + INTERVAL 1 DAY) AS recency,
             CAST(orders AS BIGINT) AS frequency, CAST(revenue_sum AS DOUBLE) AS monetary FROM b, ref),
x AS (SELECT *, CAST(recency AS BIGINT) AS x0, frequency AS x1, CAST(floor(monetary * 10000 + 0.5) AS BIGINT) AS x2 FROM r),
{_lloyd_sql(3)}""")
    o["churn_split_sizes"] = _with(_CHURN_RULE + """
SELECT churned, COUNT(*) AS customers,
       CAST(LEAST(GREATEST(round(COUNT(*) * 0.2::DOUBLE), 1), COUNT(*) - 1) AS BIGINT) AS test FROM cr GROUP BY 1""")
    return o


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    o["monthly_growth"] = _with(f"""
m AS ({_MONTHLY})
SELECT month, revenue, orders, customers,
       (revenue / lag(revenue) OVER (ORDER BY month) - 1) * 100 AS mom_growth FROM m""")
    o["kpi_summary"] = _with(_kpi_summary())
    o["kpi_summary_purchases"] = _with(_kpi_summary(), PURCHASES_SQL)
    daily = "SELECT CAST(date AS DATE) AS date, CAST(SUM(revenue) AS DOUBLE) AS revenue " \
            "FROM sales WHERE date IS NOT NULL GROUP BY 1"
    weekly = f"SELECT {WEEK} AS week, CAST(SUM(revenue) AS DOUBLE) AS revenue " \
             "FROM sales WHERE date IS NOT NULL GROUP BY 1"
    o["daily_revenue"] = _with(daily)
    o["weekly_revenue"] = _with(weekly)
    o["monthly_revenue"] = _with(_MONTHLY)
    o["daily_revenue_purchases"] = _with(daily, PURCHASES_SQL)
    o["weekly_revenue_purchases"] = _with(weekly, PURCHASES_SQL)
    ts_d = "SELECT CAST(date AS DATE) AS date, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales " \
           "WHERE date IS NOT NULL GROUP BY 1 HAVING SUM(revenue) > 0"
    ts_w = f"SELECT {WEEK} + 6 AS date, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales " \
           "WHERE date IS NOT NULL GROUP BY 1 HAVING SUM(revenue) > 0"
    o["time_series_daily"] = _with(ts_d)
    o["time_series_weekly"] = _with(ts_w)
    o["time_series_weekly_purchases"] = _with(ts_w, PURCHASES_SQL)
    o["new_customers_by_month"] = _with(f"""
fc AS (SELECT customer_id, MIN(date) AS date FROM sales
       WHERE customer_id IS NOT NULL AND date IS NOT NULL GROUP BY 1)
SELECT {MONTH} AS month, COUNT(*) AS new_customers FROM fc GROUP BY 1""")
    o["seasonality_stats"] = _with(f"""
m AS (SELECT {MONTH} AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
      WHERE date IS NOT NULL GROUP BY 1),
g AS (SELECT month, revenue, (revenue / lag(revenue) OVER (ORDER BY month) - 1) * 100 AS mom FROM m),
s AS (SELECT COUNT(*) AS months, arg_max(month, revenue) AS best_month, MAX(revenue) AS best_revenue,
             arg_min(month, revenue) AS worst_month, MIN(revenue) AS worst_revenue,
             AVG(mom) AS avg_mom_growth, stddev_samp(revenue) / AVG(revenue) AS cv FROM g)
SELECT months, best_month, best_revenue, worst_month, worst_revenue, avg_mom_growth,
       CASE WHEN months >= 6 THEN cv END AS cv,
       CASE WHEN months >= 6 THEN cv > 0.3 END AS high_seasonality
FROM s WHERE months >= 3""")
    o["top_products"] = _with("""
SELECT product, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS quantity,
       CAST(COUNT(DISTINCT order_id) AS BIGINT) AS orders
FROM sales WHERE product IS NOT NULL GROUP BY 1 ORDER BY SUM(revenue) DESC, product LIMIT 10""")
    o["revenue_by_category"] = _with(_share("category"))
    o["revenue_by_region"] = _with(_share("region"))
    o["weakest_category"] = _with("""
g AS (SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
      WHERE category IS NOT NULL GROUP BY 1)
SELECT category, round_even(revenue / (SELECT SUM(revenue) FROM g) * 100, 2) AS percentage
FROM g WHERE (SELECT COUNT(*) FROM g) > 1 ORDER BY revenue ASC, category DESC LIMIT 1""")
    o["product_pareto"] = _with(_PRODUCT_RANKS + """
SELECT CAST(rk AS INT) AS product_rank, product, CAST(revenue AS DOUBLE) AS revenue,
       CAST(SUM(revenue) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
         / CAST((SELECT SUM(revenue) FROM t) AS DOUBLE) * 100 AS cumulative_pct
FROM t""")
    o["product_concentration"] = _with(_PRODUCT_RANKS + """,
s AS (SELECT CAST(SUM(CASE WHEN rk <= 3 THEN revenue END) AS DOUBLE) / CAST(SUM(revenue) AS DOUBLE) * 100 AS top3_pct,
             CAST(SUM(CASE WHEN rk <= 10 THEN revenue END) AS DOUBLE) / CAST(SUM(revenue) AS DOUBLE) * 100 AS top10_pct
      FROM t)
SELECT top3_pct, top10_pct,
       CASE WHEN top3_pct > 60 THEN 'HIGH' WHEN top3_pct > 40 THEN 'MODERATE' ELSE 'HEALTHY' END AS level
FROM s""")
    o["customer_concentration"] = _with("""
c AS (SELECT customer_id, SUM(revenue) AS revenue FROM sales WHERE customer_id IS NOT NULL GROUP BY 1),
t AS (SELECT revenue, row_number() OVER (ORDER BY revenue DESC, customer_id) AS rk FROM c),
s AS (SELECT CAST(COALESCE(SUM(CASE WHEN rk <= 5 THEN revenue END), 0) AS DOUBLE) AS t5,
             CAST(COALESCE(SUM(CASE WHEN rk <= 10 THEN revenue END), 0) AS DOUBLE) AS t10,
             CAST(COALESCE(SUM(CASE WHEN rk <= 20 THEN revenue END), 0) AS DOUBLE) AS t20,
             CAST(COALESCE(SUM(CASE WHEN rk <= 100 THEN revenue END), 0) AS DOUBLE) AS t100,
             CAST(SUM(revenue) AS DOUBLE) AS total FROM t),
p AS (SELECT t5 / total * 100 AS top5_pct, t10 / total * 100 AS top10_pct,
             t20 / total * 100 AS top20_pct, t100 / total * 100 AS top100_pct FROM s)
SELECT top5_pct, top10_pct, top20_pct, top100_pct,
       CASE WHEN top10_pct > 50 THEN 'HIGH' WHEN top10_pct > 30 THEN 'MODERATE' ELSE 'HEALTHY' END AS level,
       top5_pct > 50 AS top5_alert
FROM p""")

    o["rfm"] = _with(_BASE + """
SELECT customer_id, date_sub('day', last_date, ref_date + INTERVAL 1 DAY) AS recency,
       CAST(orders AS BIGINT) AS frequency, CAST(revenue_sum AS DOUBLE) AS monetary FROM b, ref""")
    o["rfm_purchases"] = _with(o["rfm"].split("WITH sales AS (", 1)[1].split(SALES_SQL + ")", 1)[1].lstrip(", "),
                               PURCHASES_SQL)
    o["rfm_averages"] = _with(_BASE + """,
r AS (SELECT date_sub('day', last_date, ref_date + INTERVAL 1 DAY) AS recency,
             CAST(orders AS BIGINT) AS frequency, CAST(revenue_sum AS DOUBLE) AS monetary FROM b, ref)
SELECT AVG(recency) AS avg_recency, AVG(frequency) AS avg_frequency, AVG(monetary) AS avg_monetary,
       COUNT(*) AS customers FROM r""")
    o["customer_features"] = _with(_FEATURES + " SELECT * FROM feat")
    o["customer_features_purchases"] = _with(_FEATURES + " SELECT * FROM feat", PURCHASES_SQL)
    names = ["days_since_last_order", "total_orders", "avg_order_value", "total_revenue", "customer_age_days", "order_frequency"]
    each = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(COALESCE({n}, 0) AS DOUBLE) AS value, "
                              "CAST(days_since_last_order >= 90 AS INT) AS churned FROM feat" for n in names)
    o["churn_feature_auc"] = _with(_FEATURES + f""", x AS ({each}),
r AS (SELECT feature, churned, rank() OVER (PARTITION BY feature ORDER BY value)
        + (COUNT(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM x),
t AS (SELECT feature, COUNT(*) FILTER (WHERE churned = 1) AS p, COUNT(*) FILTER (WHERE churned = 0) AS n,
             2 * SUM(rk) FILTER (WHERE churned = 1) AS s FROM r GROUP BY 1)
SELECT feature, p AS positives, n AS negatives,
       CAST(s - p * (p + 1) AS DOUBLE) / NULLIF(CAST(p AS DOUBLE) * CAST(n AS DOUBLE) * 2, 0) AS auc FROM t""")
    o["approximate_months"] = _with(f"""SELECT {MONTH} AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       true AS orders_close, true AS customers_close FROM sales WHERE date IS NOT NULL GROUP BY 1""")
    o["churn_rule"] = _with(_CHURN_RULE + " SELECT * FROM cr")
    o["risk_distribution"] = _with(_CHURN_RULE + " SELECT risk_level, COUNT(*) AS customers FROM cr GROUP BY 1")
    o["top_high_risk"] = _with(_CHURN_RULE + """
SELECT customer_id, churn_probability, days_since_last_order, total_orders, avg_order_value FROM cr
WHERE risk_level = 'High Risk' ORDER BY churn_probability DESC, customer_id LIMIT 10""")
    o["churn_histogram"] = _with(_CHURN_RULE + """,
h AS (SELECT CAST(LEAST(floor(churn_probability * 20), 19) AS INT) AS bin, COUNT(*) AS customers
      FROM cr WHERE churn_probability IS NOT NULL GROUP BY 1)
SELECT bin, bin / 20.0::DOUBLE AS bin_start, (bin + 1) / 20.0::DOUBLE AS bin_end, customers FROM h""")
    o["churn_insights"] = _with(_CHURN_RULE + f""",
s AS (SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE churn_probability >= 0.75) AS high_risk,
             COUNT(*) FILTER (WHERE churn_probability >= 0.45 AND churn_probability < 0.75) AS medium_risk,
             COUNT(*) FILTER (WHERE churn_probability >= 0.75
                              AND avg_order_value > {quantile_sql('cr', 'avg_order_value', 0.5)})
               AS high_value_high_risk,
             ANY_VALUE({quantile_sql('cr', 'avg_order_value', 0.5)}) AS median_aov FROM cr)
SELECT customers, high_risk, high_risk / customers * 100 AS high_risk_pct, medium_risk,
       medium_risk / customers * 100 AS medium_risk_pct, high_value_high_risk, median_aov FROM s""")
    o["cohort_counts"] = _with(_COHORT + " SELECT cohort_month, period, customers FROM cc")
    o["cohort_retention"] = _with(_COHORT + " SELECT * FROM crp")
    o["cohort_display"] = _with(_COHORT + """
SELECT cohort_month, period, retention_pct FROM (
  SELECT *, dense_rank() OVER (ORDER BY cohort_month DESC) AS c_r,
            dense_rank() OVER (ORDER BY period) AS p_r FROM crp) z
WHERE c_r <= 18 AND p_r <= 18""")
    o["retention_curve"] = _with(_COHORT + """
SELECT period, AVG(retention_pct) AS retention_pct, COUNT(*) AS cohorts FROM disp GROUP BY 1""")
    o["cohort_sizes"] = _with(_COHORT + """
SELECT cohort_month, customers AS new_customers FROM cc WHERE period = 0""")
    o["cohort_summary"] = _with(_COHORT + """,
sz AS (SELECT CAST(trunc(AVG(customers)) AS BIGINT) AS avg_cohort_size,
              arg_max(cohort_month, customers * 100000 - epoch(cohort_month) / 86400)
                AS best_acquisition_month
       FROM cc WHERE period = 0),
m1 AS (SELECT cohort_month, retention_pct FROM disp WHERE period = 1),
rt AS (SELECT (SELECT AVG(retention_pct) FROM disp WHERE period = 1) AS m1_retention,
              (SELECT AVG(retention_pct) FROM disp WHERE period = 3) AS m3_retention,
              (SELECT AVG(retention_pct) FROM disp WHERE period = 6) AS m6_retention,
              (SELECT cohort_month FROM m1 ORDER BY retention_pct DESC, cohort_month LIMIT 1) AS best_m1_cohort,
              (SELECT MAX(retention_pct) FROM m1) AS best_m1_retention,
              (SELECT cohort_month FROM m1 ORDER BY retention_pct ASC, cohort_month LIMIT 1) AS worst_m1_cohort,
              (SELECT MIN(retention_pct) FROM m1) AS worst_m1_retention)
SELECT sz.*, rt.*, CASE WHEN m1_retention IS NULL THEN NULL WHEN m1_retention >= 30 THEN 'strong'
                        WHEN m1_retention >= 15 THEN 'moderate' ELSE 'low' END AS m1_level
FROM sz, rt""")
    o["customer_ltv"] = _with(_LTV + " SELECT * EXCLUDE (customer_id), customer_id FROM ltv")
    o["ltv_overview"] = _with(_LTV + f"""
SELECT AVG(total_ltv) AS avg_ltv, SUM(predicted_future_ltv) AS total_predicted,
       AVG(untapped_value) AS avg_untapped, {quantile_sql('ltv', 'total_ltv', 0.5)} AS median_ltv,
       {quantile_sql('ltv', 'total_ltv', 0.9)} AS p90_ltv FROM ltv""")
    o["ltv_histogram"] = _with(_LTV + """,
mm AS (SELECT MIN(total_ltv) AS lo, MAX(total_ltv) AS hi FROM ltv),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(floor((total_ltv - lo) / (hi - lo) * 50.0::DOUBLE), 49) END AS INT)
               AS bin, lo, hi, COUNT(*) AS customers FROM ltv, mm GROUP BY 1, 2, 3)
SELECT bin, lo + bin * ((hi - lo) / 50.0::DOUBLE) AS bin_start,
       lo + (bin + 1) * ((hi - lo) / 50.0::DOUBLE) AS bin_end, customers FROM h""")
    o["ltv_segment_breakdown"] = _with(_LTV + """,
g AS (SELECT ltv_segment AS segment, COUNT(*) AS customers, SUM(total_ltv) AS total_ltv FROM ltv GROUP BY 1)
SELECT segment, customers, total_ltv, round_even(total_ltv / (SELECT SUM(total_ltv) FROM g) * 100, 1) AS pct_of_ltv
FROM g""")
    o["ltv_segment_table"] = _with(_LTV + """
SELECT ltv_segment AS segment, COUNT(*) AS customers, AVG(historical_ltv) AS avg_historical_ltv,
       AVG(predicted_future_ltv) AS avg_predicted_ltv, AVG(total_ltv) AS avg_total_ltv,
       AVG(total_orders) AS avg_orders, AVG(avg_order_value) AS avg_aov, AVG(recency_days) AS avg_recency
FROM ltv GROUP BY 1""")
    o["top_ltv_customers"] = _with(_LTV + """
SELECT customer_id, ltv_segment, historical_ltv, predicted_future_ltv, total_ltv, total_orders,
       avg_order_value, recency_days FROM ltv ORDER BY total_ltv DESC, customer_id LIMIT 20""")
    o["ltv_insights"] = _with(_LTV + """
SELECT AVG(CAST(ltv_segment = 'Platinum' AS DOUBLE)) * 100 AS platinum_pct,
       SUM(CASE WHEN ltv_segment = 'Platinum' THEN total_ltv END) / SUM(total_ltv) * 100 AS platinum_ltv_pct,
       AVG(total_ltv) AS avg_ltv, AVG(avg_order_value) AS avg_aov,
       SUM(predicted_future_ltv) AS predicted_total,
       COUNT(*) FILTER (WHERE churn_probability > 0.7 AND ltv_segment IN ('Platinum', 'Gold'))
         AS high_value_at_risk FROM ltv""")
    o["basket_items"] = _with("""
SELECT order_id, product, SUM(revenue) > 0 AS in_basket FROM sales
WHERE order_id IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2""")
    o["product_associations"] = _with(_rules(0.005) + " SELECT * FROM rules")
    o["product_associations_low_support"] = _with(_rules(0.001) + " SELECT * FROM rules")
    o["product_recommendations"] = _with(_rules(0.005) + """,
bo AS (SELECT product_a AS product, product_b AS recommended, lift, confidence FROM rules
       UNION ALL SELECT product_b, product_a, lift, confidence FROM rules)
SELECT product, recommended, lift, confidence, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY product ORDER BY lift DESC, recommended) AS rank FROM bo) z
WHERE rank <= 5""")
    o["rule_products"] = _with(_rules(0.005) + """
SELECT product_a AS product FROM rules UNION SELECT product_b FROM rules""")
    o["product_performance"] = _with(_PERF + " SELECT * FROM perf")
    o["performance_class_revenue"] = _with(_PERF + """
SELECT performance_class, SUM(total_revenue) AS total_revenue, COUNT(*) AS products FROM perf GROUP BY 1""")
    o["top_products_by_score"] = _with(_PERF + """
SELECT * FROM perf ORDER BY composite_score DESC, product LIMIT 20""")
    o["top_average_products"] = _with(_PERF + """
SELECT * FROM perf WHERE performance_class = 'Average' ORDER BY composite_score DESC, product LIMIT 50""")
    o["forecast_revenue"] = _with(_forecast("0", 0, False) + " SELECT date, predicted, upper_bound, lower_bound FROM fc")
    o["forecast_revenue_parity"] = _with(_forecast("0", 0, True) + " SELECT date, predicted, upper_bound, lower_bound FROM fc")
    o["forecast_fit_quality"] = _with(_fit("0", 0) + f" SELECT {_FIT_LABELS} FROM fit")
    o["forecast_by_category"] = _with(_forecast("category", 14, False) + """
SELECT g AS category, date, predicted, upper_bound, lower_bound FROM fc""")
    o["forecast_fit_by_category"] = _with(_fit("category", 14) + f" SELECT g AS category, {_FIT_LABELS} FROM fit")
    o["moving_average_forecast"] = _with(_MOVING_AVG)
    o["moving_average_forecast_purchases"] = _with(_MOVING_AVG, PURCHASES_SQL)
    o["forecast_summary"] = _with(_forecast("0", 0, False) + """
SELECT SUM(predicted) AS total_predicted, AVG(predicted) AS avg_predicted, MAX(predicted) AS max_predicted FROM fc""")
    o["forecast_insights"] = _with(_forecast("0", 0, False) + "," + _RECENT_DAILY + """,
fs AS (SELECT AVG(predicted) AS forecast_avg, SUM(predicted) AS total_projected, COUNT(*) AS n FROM fc),
rc AS (SELECT CAST(SUM(CASE WHEN rn <= 7 THEN rev END) AS DOUBLE) / LEAST(COUNT(*), 7) AS recent_avg FROM rr)
SELECT recent_avg, forecast_avg,
       CASE WHEN forecast_avg > recent_avg * 1.1 THEN 'grow' WHEN forecast_avg < recent_avg * 0.9 THEN 'decline'
            ELSE 'stable' END AS direction,
       CASE WHEN forecast_avg > recent_avg * 1.1 THEN (forecast_avg - recent_avg) / recent_avg * 100
            WHEN forecast_avg < recent_avg * 0.9 THEN (recent_avg - forecast_avg) / recent_avg * 100 END AS change_pct,
       total_projected FROM fs, rc WHERE n > 0""")
    o["kpi_insights"] = _with(_KPI_BLOCK + """
SELECT * FROM (
  SELECT 1 AS seq, 'revenue' AS area,
         CASE WHEN revenue_growth > 10 THEN 'strong_growth' WHEN revenue_growth > 0 THEN 'modest_growth'
              WHEN revenue_growth < -10 THEN 'sharp_decline' WHEN revenue_growth < 0 THEN 'slight_decline' END AS code,
         CASE WHEN revenue_growth > 0 THEN 'positive' ELSE 'negative' END AS severity,
         CAST(NULL AS VARCHAR) AS subject, revenue_growth AS value FROM g
  UNION ALL SELECT 2, 'revenue', 'best_month', 'info', strftime(month, '%B %Y'), CAST(cur AS DOUBLE)
  FROM (SELECT month, cur FROM m ORDER BY cur DESC, month LIMIT 1) z
  UNION ALL SELECT 3, 'products', 'top_product', 'info', product, revenue FROM tp
  UNION ALL SELECT 4, 'customers', CASE WHEN customer_growth > 0 THEN 'acquisition_up'
                                       WHEN customer_growth < 0 THEN 'acquisition_down' END,
         CASE WHEN customer_growth > 0 THEN 'positive' ELSE 'negative' END, NULL, customer_growth FROM g
  UNION ALL SELECT 5, 'orders', 'average_order_value', 'info', NULL,
         CASE WHEN total_orders > 0 THEN total_revenue / total_orders ELSE 0.0 END FROM t) u
WHERE code IS NOT NULL""")
    o["health_score"] = _with(_KPI_BLOCK + """,
np AS (SELECT COUNT(DISTINCT product) AS n FROM sales),
pts AS (SELECT CASE WHEN revenue_growth > 10 THEN 30 WHEN revenue_growth > 5 THEN 22
                    WHEN revenue_growth > 0 THEN 15 WHEN revenue_growth > -5 THEN 8 ELSE 0 END AS revenue_growth_points,
               CASE WHEN customer_growth > 10 THEN 25 WHEN customer_growth > 5 THEN 18
                    WHEN customer_growth > 0 THEN 12 WHEN customer_growth > -5 THEN 6 ELSE 0 END AS customer_growth_points,
               CASE WHEN n > 50 THEN 20 WHEN n > 20 THEN 15 WHEN n > 10 THEN 10 WHEN n > 0 THEN 5 ELSE 0 END
                 AS product_diversity_points,
               25 AS completeness_points FROM g, np)
SELECT *, revenue_growth_points + customer_growth_points + product_diversity_points + completeness_points
            AS health_score,
       CASE WHEN revenue_growth_points + customer_growth_points + product_diversity_points + completeness_points >= 75
              THEN 'Excellent'
            WHEN revenue_growth_points + customer_growth_points + product_diversity_points + completeness_points >= 55
              THEN 'Good'
            WHEN revenue_growth_points + customer_growth_points + product_diversity_points + completeness_points >= 35
              THEN 'Needs Attention' ELSE 'Critical' END AS health_label FROM pts""")
    o["risk_alerts"] = _with(_KPI_BLOCK + """
SELECT * FROM (
  SELECT 1 AS seq, 'revenue' AS area,
         CASE WHEN revenue_growth < -15 THEN 'revenue_drop' WHEN revenue_growth < -5 THEN 'revenue_decline' END AS code,
         CASE WHEN revenue_growth < -15 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
         CAST(NULL AS VARCHAR) AS subject, abs(revenue_growth) AS value FROM g
  UNION ALL SELECT 2, 'customers', CASE WHEN top5_pct > 50 THEN 'customer_dependency' END, 'WARNING', NULL,
         top5_pct FROM top5
  UNION ALL SELECT 4, 'data', CASE WHEN n < 500 THEN 'small_dataset' END, 'INFO', NULL, CAST(n AS DOUBLE)
  FROM (SELECT COUNT(*) AS n FROM sales) z) u
WHERE code IS NOT NULL""")
    o["recommendations"] = _with(_KPI_BLOCK + """
SELECT *, CAST(row_number() OVER (ORDER BY seq) AS INT) AS priority FROM (
  SELECT 1 AS seq, 'revenue' AS area, CASE WHEN revenue_growth < 0 THEN 'launch_promotion' END AS code,
         'HIGH' AS severity, CAST(NULL AS VARCHAR) AS subject, abs(revenue_growth) AS value FROM g
  UNION ALL SELECT 2, 'customers', CASE WHEN customer_growth < 0 THEN 'improve_acquisition' END, 'HIGH', NULL,
         customer_growth FROM g
  UNION ALL SELECT 3, 'products', 'promote_top_seller', 'MEDIUM', product, revenue FROM tp
  UNION ALL SELECT 4, 'products', 'review_category', 'LOW', category, percentage FROM wc
  UNION ALL SELECT 5, 'customers', 'retention_program', 'MEDIUM', NULL, NULL) u
WHERE code IS NOT NULL""")
    o["sales_observations"] = "SELECT * FROM (" + _with(f"""
m AS (SELECT {MONTH} AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM sales
      WHERE date IS NOT NULL GROUP BY 1),
gm AS (SELECT month, revenue, (revenue / lag(revenue) OVER (ORDER BY month) - 1) * 100 AS mom FROM m),
s AS (SELECT COUNT(*) AS months, arg_max(month, revenue) AS best_month, MAX(revenue) AS best_revenue,
             arg_min(month, revenue) AS worst_month, MIN(revenue) AS worst_revenue,
             AVG(mom) AS a, stddev_samp(revenue) / AVG(revenue) AS cv FROM gm),
st AS (SELECT *, CASE WHEN months >= 6 THEN cv END AS cv6,
              CASE WHEN months >= 6 THEN cv > 0.3 END AS hs FROM s WHERE months >= 3)
SELECT 1 AS seq, 'revenue' AS area, 'best_month' AS code, 'info' AS severity,
       strftime(best_month, '%B %Y') AS subject, best_revenue AS value FROM st
UNION ALL SELECT 2, 'revenue', 'weakest_month', 'info', strftime(worst_month, '%B %Y'), worst_revenue FROM st
UNION ALL SELECT 3, 'revenue', CASE WHEN a > 5 THEN 'strong_upward_trend' WHEN a > 0 THEN 'gradual_growth'
                                    ELSE 'declining_trend' END,
       CASE WHEN a > 0 THEN 'positive' ELSE 'negative' END, NULL, a FROM st
UNION ALL SELECT 4, 'revenue', CASE WHEN hs THEN 'high_seasonality' WHEN NOT hs THEN 'stable_sales' END, 'info',
       NULL, cv6 FROM st""") + ") q WHERE code IS NOT NULL"
    o["clean_amount_strings"] = _amount_sql(False)
    o["clean_amount_strings_parity"] = _amount_sql(True)
    o["region_currency"] = _with(f"""
tr AS (SELECT lower(region) AS region, COUNT(*) AS n FROM sales WHERE region IS NOT NULL
       GROUP BY 1 ORDER BY n DESC, region LIMIT 3),
rk AS (SELECT region, row_number() OVER (ORDER BY n DESC, region) AS region_rank FROM tr),
reg AS (SELECT * FROM (VALUES {_registry_values()}) v(code, code_rank, country, country_rank)),
hits AS (SELECT code, region_rank, code_rank, country_rank FROM rk, reg
         WHERE contains({_words_sql('region')}, {_words_sql('country')})
            OR contains({_words_sql('country')}, {_words_sql('region')}))
SELECT (SELECT code FROM hits ORDER BY region_rank, code_rank, country_rank LIMIT 1) AS code""")
    o["sales_from_text_monthly"] = _with(_MONTHLY)
    o["customer_ltv_purchases"] = _with(_LTV + " SELECT * EXCLUDE (customer_id), customer_id FROM ltv",
                                        PURCHASES_SQL)
    o["cohort_retention_purchases"] = _with(_COHORT + " SELECT * FROM crp", PURCHASES_SQL)
    o["churn_rule_purchases"] = _with(_CHURN_RULE + " SELECT * FROM cr", PURCHASES_SQL)
    o["forecast_revenue_purchases"] = _with(
        _forecast("0", 0, False) + " SELECT date, predicted, upper_bound, lower_bound FROM fc",
        PURCHASES_SQL)
    o["forecast_fit_quality_purchases"] = _with(_fit("0", 0) + f" SELECT {_FIT_LABELS} FROM fit",
                                                PURCHASES_SQL)
    o["retention_matrix"] = _with(_COHORT + """,
months AS (SELECT DISTINCT cohort_month FROM crp),
axis AS (SELECT unnest(range(0, (SELECT MAX(period) + 1 FROM crp))) AS period),
grid AS (SELECT months.cohort_month, CAST(axis.period AS INT) AS period FROM months, axis)
SELECT cohort_month, list(retention_pct ORDER BY period) AS retention_pct
FROM grid LEFT JOIN crp USING (cohort_month, period) GROUP BY 1""")
    return o | _ingest_oracles() | _file_oracles()
