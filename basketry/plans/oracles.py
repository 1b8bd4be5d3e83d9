"""The queries in ANSI SQL, over the same tables, for an independent engine."""

from __future__ import annotations

from basketry.operators.selection import params_digest
from basketry.params import CUTOFFS, DEFAULT

_BASE = """
base AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
dup AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 97 = 0),
raw AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
  CASE WHEN p_type = 'PROMO' AND p_size <= 2 THEN 'POST' ELSE lpad(CAST(l_partkey AS VARCHAR), 5, '0') END AS StockCode, p_name AS Description,
  CASE WHEN l_orderkey % 307 = 0 THEN NULL WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_discount = CAST(0.1 AS DOUBLE) THEN -l_quantity ELSE l_quantity END AS Quantity,
  CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE o_orderdate END AS InvoiceDate,
  CASE WHEN l_partkey % 101 = 0 THEN CAST(0.0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS UnitPrice,
  CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 173 = 0 THEN 'ABC-' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '.0' END AS CustomerID, n_name AS Country FROM dup),
canon AS (SELECT upper(trim(coalesce(InvoiceNo, 'nan'))) AS InvoiceNo, upper(trim(coalesce(StockCode, 'nan'))) AS StockCode, nullif(trim(Description), '') AS Description, Quantity, InvoiceDate, UnitPrice,
  CASE WHEN lower(regexp_replace(trim(CustomerID), '\\.0$', '')) IN ('', 'nan', 'none') THEN NULL ELSE regexp_replace(trim(CustomerID), '\\.0$', '') END AS CustomerID, coalesce(nullif(trim(Country), ''), 'Unknown') AS Country FROM raw),
grouped AS (SELECT *, count(*) AS copies FROM canon GROUP BY ALL),
valued AS (SELECT *, round_even(trunc(Quantity) * UnitPrice * 10000, 0) / 10000 AS value FROM grouped),
lines AS (SELECT *, CASE WHEN InvoiceDate IS NULL OR Quantity IS NULL OR UnitPrice IS NULL OR InvoiceNo = '' OR StockCode = '' OR (CustomerID IS NOT NULL AND NOT regexp_full_match(CustomerID, '[0-9]+')) THEN '2_invalid_core'
  WHEN CustomerID IS NULL THEN '4_no_customer' WHEN starts_with(InvoiceNo, 'C') OR Quantity <= 0 THEN '5_cancelled' WHEN UnitPrice <= 0 THEN '6_price'
  WHEN NOT regexp_matches(StockCode, '^[0-9]{5}[A-Z]?$') THEN '7_merchandise' WHEN NOT value > 0 THEN '8_value' END AS rule FROM valued),
bought AS (SELECT InvoiceNo AS invoice_no, StockCode AS stock_code, Description AS description, CAST(trunc(Quantity) AS BIGINT) AS quantity, InvoiceDate AS ts, CustomerID AS customer_id, Country AS country, value FROM lines WHERE rule IS NULL)"""

_AT = """
hist AS (SELECT * FROM bought WHERE ts < TIMESTAMP '{cut}'),
rfm AS (SELECT customer_id, CAST(floor(date_diff('second', max(ts), TIMESTAMP '{cut}') / 86400) AS DOUBLE) AS recency_days,
  count(DISTINCT CASE WHEN ts >= TIMESTAMP '{cut}' - INTERVAL {rfm} DAY THEN invoice_no END) AS frequency_invoices,
  round_even(CAST(coalesce(sum(CASE WHEN ts >= TIMESTAMP '{cut}' - INTERVAL {rfm} DAY THEN CAST(value AS DECIMAL(28,4)) END), 0) AS DOUBLE) * 10000, 0) / 10000 AS monetary_gbp,
  CASE WHEN max(ts) >= TIMESTAMP '{cut}' - INTERVAL {rfm} DAY THEN 'known_active' ELSE 'known_inactive' END AS status FROM hist GROUP BY customer_id),
items AS (SELECT stock_code, count(DISTINCT customer_id) AS n_buyers FROM hist GROUP BY stock_code HAVING count(DISTINCT customer_id) >= {buyers} AND max(ts) >= TIMESTAMP '{cut}' - INTERVAL {pop} DAY),
names AS (SELECT stock_code, coalesce(arg_max(description, ROW(ts, invoice_no, description)) FILTER (description IS NOT NULL), stock_code) AS description FROM hist GROUP BY stock_code),
owned AS (SELECT DISTINCT customer_id, stock_code FROM hist),
pairs AS (SELECT * FROM owned WHERE stock_code IN (SELECT stock_code FROM items)),
cuts AS (SELECT quantile_cont(recency_days, 0.25) AS r_q1, quantile_cont(recency_days, 0.5) AS r_q2, quantile_cont(recency_days, 0.75) AS r_q3,
  quantile_cont(CAST(frequency_invoices AS DOUBLE), 0.25) AS f_q1, quantile_cont(CAST(frequency_invoices AS DOUBLE), 0.5) AS f_q2, quantile_cont(CAST(frequency_invoices AS DOUBLE), 0.75) AS f_q3,
  quantile_cont(monetary_gbp, 0.25) AS m_q1, quantile_cont(monetary_gbp, 0.5) AS m_q2, quantile_cont(monetary_gbp, 0.75) AS m_q3 FROM rfm WHERE status = 'known_active'),
scored AS (SELECT x.*, CAST(5 - (1 + CAST(recency_days >= r_q1 AS INT) + CAST(recency_days >= r_q2 AS INT) + CAST(recency_days >= r_q3 AS INT)) AS INT) AS r_score,
  CAST(1 + CAST(frequency_invoices >= f_q1 AS INT) + CAST(frequency_invoices >= f_q2 AS INT) + CAST(frequency_invoices >= f_q3 AS INT) AS INT) AS f_score,
  CAST(1 + CAST(monetary_gbp >= m_q1 AS INT) + CAST(monetary_gbp >= m_q2 AS INT) + CAST(monetary_gbp >= m_q3 AS INT) AS INT) AS m_score FROM rfm x CROSS JOIN cuts),
assigned AS (SELECT *, CASE WHEN status <> 'known_active' THEN 'SG_INACTIVE' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'SG01' WHEN r_score <= 2 AND m_score >= 3 THEN 'SG02' WHEN r_score >= 3 AND f_score <= 2 THEN 'SG03' ELSE 'SG04' END AS segment_id,
  CASE WHEN status <> 'known_active' THEN 'Inactive (Outside 180-Day Window)' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Recent Frequent High Spend' WHEN r_score <= 2 AND m_score >= 3 THEN 'Less Recent High Spend' WHEN r_score >= 3 AND f_score <= 2 THEN 'Recent Occasional' ELSE 'Other Active' END AS segment_label FROM scored),
recent AS (SELECT DISTINCT customer_id, stock_code FROM bought WHERE ts >= TIMESTAMP '{cut}' - INTERVAL {pop} DAY AND ts < TIMESTAMP '{cut}'),
world AS (SELECT i.stock_code, CAST(count(r.customer_id) AS BIGINT) AS score FROM items i LEFT JOIN recent r ON i.stock_code = r.stock_code GROUP BY i.stock_code),
seg AS (SELECT a.segment_id, r.stock_code, count(*) AS score FROM recent r JOIN items i ON r.stock_code = i.stock_code JOIN assigned a ON r.customer_id = a.customer_id GROUP BY a.segment_id, r.stock_code),
counts AS (SELECT stock_code, count(*) AS n_buyers FROM pairs GROUP BY stock_code),
cobuy AS (SELECT a.stock_code AS item_a, b.stock_code AS item_b, count(*) AS n_both FROM pairs a JOIN pairs b ON a.customer_id = b.customer_id AND a.stock_code < b.stock_code GROUP BY a.stock_code, b.stock_code),
sims AS (SELECT item_a, item_b, n_both, n_both / sqrt(CAST(x.n_buyers * y.n_buyers AS DOUBLE)) AS sim FROM cobuy JOIN counts x ON x.stock_code = item_a JOIN counts y ON y.stock_code = item_b),
sides AS (SELECT item_a AS seed, item_b AS neighbour, n_both, sim FROM sims UNION ALL SELECT item_b, item_a, n_both, sim FROM sims),
nearmost AS (SELECT seed, neighbour, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(sim, 12) DESC, neighbour) AS rank FROM sides WHERE n_both >= {co}) WHERE rank <= {most}),
near AS (SELECT * FROM nearmost WHERE rank <= {nb}),
idfs AS (SELECT stock_code, n_buyers, ln(((SELECT count(*) FROM rfm) + 1) / (n_buyers + 1)) + 1 AS idf FROM counts),
contrib AS (SELECT p.customer_id, p.stock_code AS seed, n.neighbour AS stock_code, n.sim FROM pairs p JOIN near n ON p.stock_code = n.seed),
cand AS (SELECT c.customer_id, c.stock_code, round_even(sum(sim) / any_value(s.n_seeds) * 1e10, 0) / 1e10 AS score FROM contrib c JOIN (SELECT customer_id, count(*) AS n_seeds FROM pairs GROUP BY customer_id) s ON c.customer_id = s.customer_id GROUP BY c.customer_id, c.stock_code),
candnew AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.customer_id = c.customer_id AND o.stock_code = c.stock_code)),
backers AS (SELECT customer_id, b.stock_code, string_agg(seed, ', ' ORDER BY place) AS supporters, string_agg(coalesce(n.description, seed), ', ' ORDER BY place) AS spoken FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, stock_code ORDER BY round(sim, 12) DESC, seed) AS place FROM contrib) b LEFT JOIN names n ON n.stock_code = seed WHERE place <= 3 GROUP BY customer_id, b.stock_code),
topworld AS (SELECT stock_code, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, stock_code) AS rank FROM world)),
chain AS (SELECT customer_id, 0 AS tier, stock_code, score FROM cand UNION ALL SELECT a.customer_id, 1, s.stock_code, CAST(s.score AS DOUBLE) FROM assigned a JOIN seg s ON a.segment_id = s.segment_id UNION ALL SELECT a.customer_id, 2, w.stock_code, CAST(w.score AS DOUBLE) FROM assigned a CROSS JOIN world w),
chainnew AS (SELECT * FROM chain c WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.customer_id = c.customer_id AND o.stock_code = c.stock_code)),
lists AS (SELECT customer_id, rank, stock_code, score, CASE tier WHEN 0 THEN 'item_cf' WHEN 1 THEN 'segment_popularity' ELSE 'global_popularity' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY tier, score DESC, stock_code) AS rank FROM (SELECT customer_id, stock_code, min(tier) AS tier, arg_min(score, tier) AS score FROM chain GROUP BY customer_id, stock_code)) WHERE rank <= {k}),
candmost AS (SELECT c.customer_id, c.stock_code, round_even(sum(sim) / any_value(s.n_seeds) * 1e10, 0) / 1e10 AS score FROM (SELECT p.customer_id, n.neighbour AS stock_code, n.sim FROM pairs p JOIN nearmost n ON p.stock_code = n.seed) c JOIN (SELECT customer_id, count(*) AS n_seeds FROM pairs GROUP BY customer_id) s ON c.customer_id = s.customer_id GROUP BY c.customer_id, c.stock_code),
chainmost AS (SELECT customer_id, 0 AS tier, stock_code, score FROM candmost UNION ALL SELECT * FROM chain WHERE tier > 0),
listsmost AS (SELECT customer_id, rank, stock_code, score, CASE tier WHEN 0 THEN 'item_cf' WHEN 1 THEN 'segment_popularity' ELSE 'global_popularity' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY tier, score DESC, stock_code) AS rank FROM (SELECT customer_id, stock_code, min(tier) AS tier, arg_min(score, tier) AS score FROM chainmost GROUP BY customer_id, stock_code)) WHERE rank <= {k}),
listsnew AS (SELECT customer_id, rank, stock_code, score, CASE tier WHEN 0 THEN 'item_cf' WHEN 1 THEN 'segment_popularity' ELSE 'global_popularity' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY tier, score DESC, stock_code) AS rank FROM (SELECT customer_id, stock_code, min(tier) AS tier, arg_min(score, tier) AS score FROM chainnew GROUP BY customer_id, stock_code)) WHERE rank <= {k}),
listsseg AS (SELECT customer_id, rank, stock_code, score, CASE tier WHEN 1 THEN 'segment_popularity' ELSE 'global_popularity' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY tier, score DESC, stock_code) AS rank FROM (SELECT customer_id, stock_code, min(tier) AS tier, arg_min(score, tier) AS score FROM chain WHERE tier > 0 GROUP BY customer_id, stock_code)) WHERE rank <= {k}),
listspop AS (SELECT customer_id, rank, stock_code, CAST(score AS DOUBLE) AS score, 'global_popularity' AS method FROM rfm CROSS JOIN topworld WHERE rank <= {k}),
future AS (SELECT DISTINCT customer_id, stock_code FROM bought WHERE ts >= TIMESTAMP '{cut}' AND ts < TIMESTAMP '{cut}' + INTERVAL {fut} DAY),
futin AS (SELECT * FROM future WHERE stock_code IN (SELECT stock_code FROM items)),
t_primary AS (SELECT * FROM futin WHERE customer_id IN (SELECT customer_id FROM rfm)),
t_cold_start AS (SELECT * FROM futin WHERE customer_id NOT IN (SELECT customer_id FROM rfm)),
t_new_product AS (SELECT * FROM t_primary t WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.customer_id = t.customer_id AND o.stock_code = t.stock_code)),
points AS (SELECT customer_id, greatest(0.0, recency_days) AS r, greatest(0.0, CAST(frequency_invoices AS DOUBLE)) AS f, greatest(0.0, monetary_gbp) AS m FROM rfm WHERE status = 'known_active'),
segprof AS (SELECT segment_id, count(*) AS n_customers, round_even(count(*) / (SELECT count(*) FROM assigned WHERE status = 'known_active') * 10000, 0) / 10000 AS share, round_even(median(recency_days) * 10, 0) / 10 AS median_recency,
  round_even(median(CAST(frequency_invoices AS DOUBLE)) * 10, 0) / 10 AS median_frequency, round_even(median(monetary_gbp) * 100, 0) / 100 AS median_monetary FROM assigned WHERE status = 'known_active' GROUP BY segment_id),
logged AS (SELECT customer_id, ln(1 + r) AS r, ln(1 + f) AS f, ln(1 + m) AS m FROM points),
zs AS (SELECT customer_id, round_even((r - avg(r) OVER ()) / stddev_pop(r) OVER () * 1e6, 0) / 1e6 + 0.0 AS r, round_even((f - avg(f) OVER ()) / stddev_pop(f) OVER () * 1e6, 0) / 1e6 + 0.0 AS f, round_even((m - avg(m) OVER ()) / stddev_pop(m) OVER () * 1e6, 0) / 1e6 + 0.0 AS m FROM logged),
summ AS (SELECT measure, count(*) AS n, round_even(quantile_cont(x, 0.5) * 100, 0) / 100 AS median, round_even(quantile_cont(x, 0.25) * 100, 0) / 100 AS q25, round_even(quantile_cont(x, 0.75) * 100, 0) / 100 AS q75
  FROM (SELECT 'recency_days' AS measure, recency_days AS x FROM rfm WHERE status = 'known_active' UNION ALL SELECT 'frequency_invoices', CAST(frequency_invoices AS DOUBLE) FROM rfm WHERE status = 'known_active' UNION ALL SELECT 'monetary_gbp', monetary_gbp FROM rfm WHERE status = 'known_active') GROUP BY measure),
shares AS (SELECT segment_id, round_even(count(*) / (SELECT count(*) FROM assigned WHERE status = 'known_active') * 10000, 0) / 10000 AS share FROM assigned WHERE status = 'known_active' GROUP BY segment_id)"""

# Names that the second prelude defines, so that another cut-off's copy can carry a suffix.
_NAMES = ("hist rfm items names owned pairs cuts scored assigned recent world seg counts cobuy sims sides nearmost near idfs contrib cand candmost candnew backers topworld chain chainmost chainnew lists listsmost listsnew listsseg listspop future futin t_primary t_cold_start t_new_product points segprof logged zs summ shares").split()


def _at(role: str) -> str:
    p = DEFAULT
    return _AT.format(cut=CUTOFFS[role], rfm=p.rfm_days, pop=p.popular_days, buyers=p.least_buyers, co=p.least_co_buyers, nb=p.neighbours, most=max(p.neighbour_choices), k=p.k, fut=p.future_days)


def _suffixed(role: str) -> str:
    import re

    names = "|".join(_NAMES)
    text = _at(role)
    for before in (r"(^|,\n)({})(?= AS \()", r"((?:FROM|JOIN) )({})\b"):
        text = re.sub(before.format(names), r"\1\2_0", text.strip() if before.startswith("(^") else text)
    return text


def _sql(select: str, role: str | None = "test", other: str | None = None) -> str:
    parts = [_BASE.strip()] + ([_at(role).strip()] if role else []) + ([_suffixed(other)] if other else [])
    return "WITH " + ",\n".join(parts) + "\n" + select


def _with(more: str, select: str, role: str = "test") -> str:
    """Like _sql, with further common tables after those of the cut-off."""
    return _sql("\n" + select, role).replace("\n\n" + select, more + "\n" + select)


def _r(expr: str, places: int) -> str:
    return f"round_even(({expr}) * 1e{places}, 0) / 1e{places} + 0.0"


_LIST = "SELECT customer_id, rank, stock_code, " + _r("score", 8) + " AS score, method FROM "
_TOP = "SELECT customer_id, rank, stock_code, " + _r("score", 8) + " AS score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, stock_code) AS rank FROM {}) WHERE rank <= 10"


def _metrics(lists: str, truth: str = "t_primary") -> str:
    k = DEFAULT.k
    return f"""(SELECT g.customer_id, {_r('coalesce(h.hits, 0) / g.n', 8)} AS recall, {_r(f'coalesce(h.hits, 0) / {k}', 8)} AS precision, CASE WHEN coalesce(h.hits, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit,
  {_r(f'coalesce(h.dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(g.n, {k})) t(i))', 8)} AS ndcg
  FROM (SELECT customer_id, count(*) AS n FROM {truth} GROUP BY customer_id) g LEFT JOIN (SELECT l.customer_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM {lists} l JOIN {truth} t ON l.customer_id = t.customer_id AND l.stock_code = t.stock_code GROUP BY l.customer_id) h ON g.customer_id = h.customer_id)"""


def _means(lists: str, model: str) -> str:
    cols = ", ".join(f"coalesce({_r(f'CAST(sum(CAST({c} AS DECIMAL(18,8))) AS DOUBLE) / count(*)', 6)}, 0.0) AS mean_{c}" for c in ("ndcg", "recall", "precision", "hit"))
    return f"SELECT '{model}' AS model, count(*) AS n_users, {cols} FROM {_metrics(lists)}"


_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)
_W = " + ".join(f"CAST(u >= {c} AS INT)" for c in _POISSON)
def _boot(a: str, b: str) -> str:
    """Intervals of two models' metrics, each a query with customer_id and ndcg."""
    return f"""SELECT {', '.join(f"{_r(f'quantile_cont({c}, {q})', 6)} AS {c}_{n}" for c in 'abd' for q, n in ((0.025, 'low'), (0.975, 'high')))} FROM (SELECT sa / n AS a, sb / n AS b, sa / n - sb / n AS d FROM (
  SELECT draw, sum(w) AS n, CAST(sum(CAST(a * w AS DECIMAL(28,8))) AS DOUBLE) AS sa, CAST(sum(CAST(b * w AS DECIMAL(28,8))) AS DOUBLE) AS sb FROM (SELECT *, {_W} AS w FROM (
  SELECT x.customer_id, x.ndcg AS a, y.ndcg AS b, draw, CAST(CAST('0x' || substr(md5(x.customer_id || ':' || CAST(draw AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM {a} x JOIN {b} y ON x.customer_id = y.customer_id CROSS JOIN range({DEFAULT.bootstraps}) d(draw))) GROUP BY draw HAVING sum(w) > 0))"""


_MODELS = {"GlobalPopularity": "listspop", "SegmentPopularity": "listsseg", "ItemItemCF_N50": "lists", "ItemItemCF_N100": "listsmost"}
_EACH = ",\neach AS (" + " UNION ALL ".join(f"SELECT '{name}' AS model, * FROM {_metrics(lists)}" for name, lists in _MODELS.items()) + ")"
_MEANS_OF_EACH = ",\nmeans AS (SELECT model, count(*) AS n_users, " + ", ".join(f"coalesce({_r(f'CAST(sum(CAST({c} AS DECIMAL(18,8))) AS DOUBLE) / count(*)', 6)}, 0.0) AS mean_{c}" for c in ("ndcg", "recall", "precision", "hit")) + " FROM each GROUP BY model)"
_CHOSEN = ",\nbase AS (SELECT * FROM means WHERE model NOT LIKE 'ItemItem%' ORDER BY mean_ndcg DESC, model LIMIT 1),\ncf AS (SELECT * FROM means WHERE model LIKE 'ItemItem%' ORDER BY mean_ndcg DESC, length(model), model LIMIT 1)"
_GATE = f"""SELECT *, CASE WHEN qualifies THEN candidate ELSE baseline END AS selected FROM (SELECT *, relative_gain >= 0.10 AND recall >= base_recall AND coalesce(d_low, 0.0) > 0 AS qualifies FROM (SELECT b.model AS baseline, a.model AS candidate, CASE WHEN b.mean_ndcg > 0 THEN {_r('(a.mean_ndcg - b.mean_ndcg) / b.mean_ndcg', 4)} ELSE 0.0 END AS relative_gain, a.mean_ndcg AS ndcg, b.mean_ndcg AS base_ndcg, a.mean_recall AS recall, b.mean_recall AS base_recall, d_low
  FROM cf a CROSS JOIN chosenbase b CROSS JOIN ({_boot('(SELECT * FROM each WHERE model = (SELECT model FROM cf))', '(SELECT * FROM each WHERE model = (SELECT model FROM chosenbase))')}) c))"""
_CHOSEN = _CHOSEN.replace("base AS", "chosenbase AS")

_DISTANCE = "sqrt(pow({a}.r - {b}.r, 2) + pow({a}.f - {b}.f, 2) + pow({a}.m - {b}.m, 2))"
_RULED = "(SELECT z.*, a.segment_id AS cluster FROM zs z JOIN assigned a ON z.customer_id = a.customer_id)"
_FELL = "(SELECT " + _r("count(*) FILTER (method <> 'item_cf') / count(*)", 4) + " FROM {})"
_DRIFT_FALL = f"""(SELECT *, change > 0.10 AS alert FROM (SELECT b AS before, a AS after, {_r('a - b', 4)} AS change FROM (SELECT {_FELL.format('lists_0')} AS b, {_FELL.format('lists')} AS a)))"""
_DRIFT_RFM = f"""(SELECT b.measure, b.median AS before, a.median AS after, CASE WHEN b.median <> 0 THEN {_r('(a.median - b.median) / b.median', 4)} END AS change,
  CASE WHEN b.median <> 0 THEN abs((a.median - b.median) / b.median) > 0.25 ELSE abs(a.median - b.median) > 0.01 END AS alert FROM summ_0 b JOIN summ a ON a.measure = b.measure)"""
_DRIFT_SEG = f"""(SELECT coalesce(b.segment_id, a.segment_id) AS segment_id, coalesce(b.share, 0.0) AS before, coalesce(a.share, 0.0) AS after, {_r('coalesce(a.share, 0.0) - coalesce(b.share, 0.0)', 4)} AS change,
  abs({_r('coalesce(a.share, 0.0) - coalesce(b.share, 0.0)', 4)}) > 0.10 AS alert FROM shares_0 b FULL OUTER JOIN shares a ON a.segment_id = b.segment_id)"""
_DRIFT_CAT = f"""(SELECT *, jaccard < 0.70 AS alert FROM (SELECT count(*) FILTER (b.stock_code IS NULL) AS added, count(*) FILTER (a.stock_code IS NULL) AS removed, count(*) FILTER (a.stock_code IS NOT NULL AND b.stock_code IS NOT NULL) AS kept,
  CASE WHEN count(*) > 0 THEN {_r('count(*) FILTER (a.stock_code IS NOT NULL AND b.stock_code IS NOT NULL) / count(*)', 4)} ELSE 1.0::DOUBLE END AS jaccard FROM items_0 b FULL OUTER JOIN items a ON a.stock_code = b.stock_code))"""

ORACLE_SQL: dict[str, str] = {
    "raw_lines_profile": _sql("SELECT count(*) AS n_rows, min(InvoiceDate) AS first_ts, max(InvoiceDate) AS last_ts FROM raw", None),
    "clean_audit": _sql("SELECT rule, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT 'raw' AS rule, copies AS n FROM lines UNION ALL SELECT coalesce(rule, 'kept'), CASE WHEN rule = '2_invalid_core' THEN copies ELSE 1 END FROM lines UNION ALL SELECT '3_duplicate', CASE WHEN rule = '2_invalid_core' THEN 0 ELSE copies - 1 END FROM lines) GROUP BY rule HAVING sum(n) > 0", None),
    "clean_purchases": _sql("SELECT * FROM bought", None),
    "customer_id_canonical": _sql("SELECT CustomerID AS customer_id, count(*) AS n_rows FROM canon GROUP BY CustomerID", None),
    "excluded_codes": _sql("SELECT StockCode AS stock_code, count(*) AS n_rows FROM lines WHERE rule = '7_merchandise' GROUP BY StockCode ORDER BY n_rows DESC, stock_code LIMIT 50", None),
    "anonymous_value": _sql(f"SELECT count(*) AS n_rows, coalesce({_r('CAST(sum(CAST(Quantity * UnitPrice AS DECIMAL(28,6))) AS DOUBLE)', 2)}, 0.0) AS anonymous_value FROM lines WHERE rule = '4_no_customer'", None),
    "purchases_provenance": _sql("SELECT *, upper(sha256(CAST(n_rows AS VARCHAR) || '|' || strftime(first_ts, '%Y-%m-%d') || '|' || strftime(last_ts, '%Y-%m-%d'))) AS digest FROM (SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bought)", None),
    "spend_concentration": _sql(f"SELECT share AS top_share, {_r('CAST(sum(spend) FILTER (rn <= ceil(share * n)) AS DOUBLE) / CAST(sum(spend) AS DOUBLE)', 4)} AS spend_share FROM (SELECT spend, row_number() OVER (ORDER BY spend DESC, customer_id) AS rn, count(*) OVER () AS n FROM (SELECT customer_id, sum(CAST(value AS DECIMAL(28,4))) AS spend FROM bought GROUP BY customer_id)) CROSS JOIN (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.10::DOUBLE)) s(share) GROUP BY share", None),
    "rfm_profiles": _sql("SELECT * FROM rfm"),
    "rfm_profiles_early": _sql("SELECT * FROM rfm", "early"),
    "known_inactive": _sql("SELECT customer_id, recency_days FROM rfm WHERE status = 'known_inactive'"),
    "rfm_metadata": _sql(f"SELECT count(*) AS n_known, count(*) FILTER (status = 'known_active') AS n_active, count(*) FILTER (status = 'known_inactive') AS n_inactive, {_r('CAST(sum(CAST(monetary_gbp AS DECIMAL(28,4))) AS DOUBLE)', 2)} AS monetary_total FROM rfm"),
    "rfm_reconciliation": _sql(f"""SELECT *, {_r('profiles_total - purchases_total', 2)} AS difference, abs({_r('profiles_total - purchases_total', 2)}) < 0.01 AS agrees FROM (SELECT (SELECT {_r('CAST(sum(CAST(monetary_gbp AS DECIMAL(28,4))) AS DOUBLE)', 2)} FROM rfm) AS profiles_total,
  (SELECT {_r('CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE)', 2)} FROM hist WHERE ts >= TIMESTAMP '{CUTOFFS['test']}' - INTERVAL {DEFAULT.rfm_days} DAY) AS purchases_total)"""),
    "catalog_items": _sql("SELECT * FROM items"),
    "catalog_descriptions": _sql("SELECT * FROM names"),
    "interactions": _sql("SELECT * FROM pairs"),
    "customer_histories": _sql("SELECT customer_id, string_agg(stock_code, ',' ORDER BY stock_code) AS codes FROM owned GROUP BY customer_id"),
    "rfm_cutpoints": _sql("SELECT * FROM cuts"),
    "rfm_scores": _sql("SELECT customer_id, r_score, f_score, m_score FROM scored"),
    "rfm_rule_segments": _sql("SELECT customer_id, segment_id, segment_label FROM assigned"),
    "segment_profiles": _sql("SELECT * FROM segprof"),
    "segment_labels": _sql("""SELECT segment_id, CASE WHEN c = 1 THEN 'High-Value Frequent VIPs' WHEN c = 2 THEN 'Lapsed High Spenders' WHEN c = 3 THEN 'Steady Active Buyers' WHEN c = 4 THEN 'Recent New / Occasional Buyers' WHEN c = 5 THEN 'Dormant / Low Engagement' ELSE 'Standard Active Shoppers' END AS label,
  CASE WHEN c = 1 THEN 'Loyalty perks, early product access, and premium bundles to maximize retention.' WHEN c = 2 THEN 'Re-engagement win-back campaigns with personalized high-tier product discounts.' WHEN c = 3 THEN 'Category cross-sell recommendations and volume discounts to boost basket size.'
  WHEN c = 4 THEN 'Nurture sequence and introductory category recommendations to foster repeat purchase.' WHEN c = 5 THEN 'Low-cost seasonal email reminders and highlight of top global bestsellers.' ELSE 'Targeted segment-popular product promotions and seasonal campaigns.' END AS hypothesis
  FROM (SELECT segment_id, CASE WHEN median_monetary >= 1500 AND median_frequency >= 4 AND median_recency <= 30 THEN 1 WHEN median_monetary >= 1000 AND median_recency > 50 THEN 2 WHEN median_frequency >= 3 AND median_recency <= 40 THEN 3 WHEN median_recency <= 30 AND median_frequency <= 2 THEN 4 WHEN median_recency > 60 THEN 5 ELSE 6 END AS c FROM segprof)"""),
    "segment_ordinals": _sql("SELECT segment_id, 'SG' || lpad(CAST(row_number() OVER (ORDER BY median_monetary DESC, median_frequency DESC, median_recency, segment_id) AS VARCHAR), 2, '0') AS ordinal FROM segprof"),
    "global_popularity": _sql("SELECT * FROM topworld WHERE rank <= 100"),
    "segment_popularity": _sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY score DESC, stock_code) AS rank FROM seg) WHERE rank <= 20"),
    "item_pair_cobuyers": _sql("SELECT * FROM cobuy WHERE n_both >= 2"),
    "item_cosine_neighbors": _sql(f"SELECT seed, neighbour, {_r('sim', 10)} AS sim, rank FROM near"),
    "item_idf": _sql(f"SELECT stock_code, n_buyers, {_r('idf', 8)} AS idf FROM idfs"),
    "item_tfidf_neighbors": _sql(f"SELECT seed, neighbour, {_r('sim', 10)} AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(sim, 12) DESC, neighbour) AS rank FROM sides JOIN idfs ON idfs.stock_code = seed WHERE idf * n_both >= 2) WHERE rank <= 50", "early"),
    "cf_candidate_scores": _sql(f"SELECT customer_id, stock_code, {_r('score', 8)} AS score FROM cand", "early"),
    "cf_supporters": _sql("SELECT customer_id, stock_code, supporters FROM backers", "early"),
    "cf_topk_repeat": _sql(_TOP.format("cand")),
    "cf_topk_new_items": _sql(_TOP.format("candnew")),
    "recs_with_fallback": _sql(_LIST + "lists"),
    "recs_with_fallback_early": _sql(_LIST + "lists", "early"),
    "recs_new_items_with_fallback": _sql(_LIST + "listsnew", "early"),
    "recs_segment_popularity": _sql(_LIST + "listsseg", "early"),
    "recs_unknown_customers": _sql("SELECT customer_id, rank, stock_code, CAST(score AS DOUBLE) AS score, 'global_popularity' AS method FROM (SELECT DISTINCT customer_id FROM t_cold_start) CROSS JOIN topworld WHERE rank <= 10", "early"),
    "response_status": _sql("SELECT r.customer_id, coalesce(n, 0) AS returned_k, CASE WHEN (SELECT count(*) FROM items) = 0 THEN 'empty_catalog' WHEN coalesce(n, 0) < 10 THEN 'insufficient_catalog' WHEN NOT coalesce(personal, FALSE) THEN 'fallback_only' ELSE 'ok' END AS status FROM rfm r LEFT JOIN (SELECT customer_id, count(*) AS n, bool_or(method = 'item_cf') AS personal FROM lists GROUP BY customer_id) l ON r.customer_id = l.customer_id", "early"),
    "recs_csv_safe": _sql("""SELECT customer_id, rank, CASE WHEN substr(stock_code, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || stock_code ELSE stock_code END AS stock_code, CASE WHEN substr(description, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || description ELSE description END AS description, method, reason_code, reason, supporting_codes FROM (
  SELECT l.customer_id, l.rank, l.stock_code, coalesce(n.description, l.stock_code) AS description, l.method, CASE l.method WHEN 'item_cf' THEN 'similar_to_purchase_history' WHEN 'segment_popularity' THEN 'popular_in_segment' ELSE 'popular_overall' END AS reason_code,
  CASE l.method WHEN 'item_cf' THEN 'Frequently bought together with ' || b.spoken WHEN 'segment_popularity' THEN 'Popular among shoppers in your segment (' || a.segment_id || ')' ELSE 'One of the most popular products among all shoppers' END AS reason,
  CASE WHEN l.method = 'item_cf' THEN '["' || replace(b.supporters, ', ', '", "') || '"]' ELSE '[]' END AS supporting_codes FROM lists l LEFT JOIN backers b ON l.customer_id = b.customer_id AND l.stock_code = b.stock_code LEFT JOIN names n ON n.stock_code = l.stock_code LEFT JOIN assigned a ON a.customer_id = l.customer_id)""", "early"),
    "segment_shares": _sql("SELECT * FROM shares"),
    "snapshot_overview": _sql(f"SELECT (SELECT count(*) FROM rfm) AS total_known, (SELECT count(*) FROM rfm WHERE status = 'known_active') AS total_active, (SELECT count(*) FROM items) AS catalog_size, {_FELL.format('lists')} AS fallback_item_share", "early"),
    "drift_fallback": _sql(f"SELECT * FROM {_DRIFT_FALL}", "test", "early"),
    "customer_profile_lookup": _sql("SELECT customer_id, recency_days, frequency_invoices, monetary_gbp, status, segment_id, segment_label FROM assigned"),
    "cohort_counts": _sql(" UNION ALL ".join(f"SELECT '{c}' AS cohort, count(DISTINCT customer_id) AS n_customers, count(*) AS n_pairs FROM t_{c}" for c in ("primary", "cold_start", "new_product")), "early"),
    "cohort_primary_truth": _sql("SELECT * FROM t_primary"),
    "cohort_cold_start_truth": _sql("SELECT * FROM t_cold_start", "early"),
    "cohort_new_product_truth": _sql("SELECT * FROM t_new_product"),
    "future_item_coverage": _sql(f"SELECT (SELECT count(*) FROM future) AS n_pairs, (SELECT count(*) FROM futin) AS n_in_catalog, CASE WHEN (SELECT count(*) FROM future) > 0 THEN {_r('(SELECT count(*) FROM futin) / (SELECT count(*) FROM future)', 4)} ELSE 0.0 END AS coverage"),
    "user_ranking_metrics": _sql(f"SELECT * FROM {_metrics('lists')}"),
    "model_comparison": _with(_EACH + _MEANS_OF_EACH, "SELECT * FROM means"),
    "strongest_baseline": _sql("SELECT model, mean_ndcg FROM (" + _means("listspop", "GlobalPopularity") + " UNION ALL " + _means("listsseg", "SegmentPopularity") + ") ORDER BY mean_ndcg DESC, model LIMIT 1"),
    "coverage_and_fallback": _sql(f"SELECT {_r('(SELECT count(DISTINCT stock_code) FROM lists) / (SELECT count(*) FROM items)', 4)} AS coverage, {_r('(SELECT count(*) FROM lists WHERE method <> ' + chr(39) + 'item_cf' + chr(39) + ') / (SELECT count(*) FROM lists)', 4)} AS fallback_share, {_r('(SELECT count(DISTINCT customer_id) FROM lists WHERE method = ' + chr(39) + 'item_cf' + chr(39) + ') / (SELECT count(DISTINCT customer_id) FROM lists)', 4)} AS personalised_share", "early"),
    "bootstrap_ci_hash": _sql(_boot(_metrics("lists"), _metrics("listsseg"))),
    "promotion_gate": _with(_EACH + _MEANS_OF_EACH + _CHOSEN, _GATE),
    "best_neighbour_count": _with(_EACH + _MEANS_OF_EACH + _CHOSEN, "SELECT model, mean_ndcg FROM cf"),
    "rfm_log1p_standardized": _sql("SELECT * FROM zs"),
    "yeo_johnson_fixed_lambda": _sql(f"SELECT customer_id, {_r('(pow(r + 1, 0.5) - 1) / 0.5', 6)} AS r, {_r('ln(1 + f)', 6)} AS f, {_r('(pow(m + 1, 0.25) - 1) / 0.25', 6)} AS m FROM points"),
    "yeo_johnson_lambda_grid": _sql(f"""SELECT measure, "lambda", {_r('-n / 2.0 * ln(v) + ("lambda" - 1) * jac', 3)} AS loglik FROM (SELECT measure, "lambda", count(*) AS n, var_pop(CASE WHEN "lambda" = 0 THEN ln(1 + x) ELSE (pow(x + 1, "lambda") - 1) / "lambda" END) AS v, sum(ln(1 + x)) AS jac FROM (SELECT 'r' AS measure, r AS x FROM points UNION ALL SELECT 'f', f FROM points UNION ALL SELECT 'm', m FROM points) CROSS JOIN (SELECT i / 4.0::DOUBLE AS "lambda" FROM range(-4, 9) t(i)) GROUP BY measure, "lambda") WHERE v > 0"""),
    "kmeans_lloyd_step": _sql(f"""SELECT cluster, count(*) AS n, {_r('avg(r)', 6)} AS r, {_r('avg(f)', 6)} AS f, {_r('avg(m)', 6)} AS m FROM (SELECT z.customer_id, any_value(z.r) AS r, any_value(z.f) AS f, any_value(z.m) AS m, arg_min(c.cluster, ROW(pow(z.r - c.r, 2) + pow(z.f - c.f, 2) + pow(z.m - c.m, 2), c.cluster)) AS cluster
  FROM (SELECT customer_id, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS r, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS f, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS m FROM logged) z CROSS JOIN (VALUES (0, -1.0, -1.0, -1.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)) c(cluster, r, f, m) GROUP BY z.customer_id) GROUP BY cluster"""),
    "silhouette_rules": _sql(f"""SELECT count(*) AS n_sampled, {_r('avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END)', 4)} AS silhouette FROM (SELECT id, min(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM (
  SELECT p.customer_id AS id, p.cluster AS own, q.cluster AS other, avg({_DISTANCE.format(a='p', b='q')}) AS d FROM s p JOIN s q ON p.customer_id <> q.customer_id GROUP BY p.customer_id, p.cluster, q.cluster) GROUP BY id)""".replace("FROM s p JOIN s q", f"FROM (SELECT * FROM {_RULED} ORDER BY md5(customer_id), customer_id LIMIT 2000) p JOIN (SELECT * FROM {_RULED} ORDER BY md5(customer_id), customer_id LIMIT 2000) q")),
    "davies_bouldin_rules": _sql(f"""SELECT count(*) AS n_clusters, {_r('avg(w)', 4)} AS davies_bouldin FROM (SELECT x.cluster, max((x.s + y.s) / {_DISTANCE.format(a='x', b='y')}) AS w FROM wide x JOIN wide y ON x.cluster <> y.cluster GROUP BY x.cluster)""".replace("FROM wide x JOIN wide y", "FROM {w} x JOIN {w} y").replace("{w}", f"(SELECT c.cluster, any_value(c.r) AS r, any_value(c.f) AS f, any_value(c.m) AS m, avg({_DISTANCE.format(a='p', b='c')}) AS s FROM {_RULED} p JOIN (SELECT cluster, avg(r) AS r, avg(f) AS f, avg(m) AS m FROM {_RULED} GROUP BY cluster) c ON p.cluster = c.cluster GROUP BY c.cluster)")),
    "adjusted_rand": _sql(f"""SELECT CASE WHEN abs((sx + sy) / 2 - sx * sy / t2) < 1e-12 THEN 1.0::DOUBLE ELSE {_r('(s - sx * sy / t2) / ((sx + sy) / 2 - sx * sy / t2)', 6)} END AS ari FROM (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM c) AS s, (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE FROM c) AS t2, (SELECT sum(k * (k - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS k FROM c GROUP BY x)) AS sx, (SELECT sum(k * (k - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS k FROM c GROUP BY y)) AS sy)""".replace("FROM c)", "FROM {c} c)").replace("FROM c GROUP", "FROM {c} c GROUP").replace("{c}", "(SELECT a.segment_id AS x, b.segment_id AS y, count(*) AS n FROM assigned_0 a JOIN assigned b ON a.customer_id = b.customer_id WHERE a.status = 'known_active' AND b.status = 'known_active' GROUP BY a.segment_id, b.segment_id)"), "test", "validation"),
    "snapshot_summary": _sql("SELECT * FROM summ"),
    "stored_snapshot": _sql(f"""SELECT '{CUTOFFS['test']}' AS snapshot, * FROM (SELECT 'median' AS kind, measure AS key, median AS value FROM summ UNION ALL SELECT 'q25', measure, q25 FROM summ UNION ALL SELECT 'q75', measure, q75 FROM summ UNION ALL SELECT 'customers', status, CAST(count(*) AS DOUBLE) FROM rfm GROUP BY status
  UNION ALL SELECT 'share', segment_id, share FROM shares UNION ALL SELECT 'item', stock_code, CAST(n_buyers AS DOUBLE) FROM items UNION ALL SELECT 'fallback', 'share', {_FELL.format('lists')})"""),
    "drift_rfm": _sql(f"SELECT * FROM {_DRIFT_RFM}", "test", "early"),
    "drift_segments": _sql(f"SELECT * FROM {_DRIFT_SEG}", "test", "early"),
    "drift_catalog": _sql(f"SELECT * FROM {_DRIFT_CAT}", "test", "early"),
    "drift_alerts": _sql(f"""SELECT count(*) AS n_alerts, coalesce(string_agg(c || ': ' || k || ': ' || message, '; ' ORDER BY c, k, message), '') AS alerts, count(*) > 0 AS requires_review FROM (SELECT 'median' AS c, measure AS k, 'median changed by ' || printf('%+.2f%%', coalesce(change, 0.0) * 100) AS message FROM {_DRIFT_RFM} WHERE alert
  UNION ALL SELECT 'segment', segment_id, 'share changed by ' || printf('%+.2f%%', change * 100) FROM {_DRIFT_SEG} WHERE alert UNION ALL SELECT 'catalog', 'jaccard', printf('similarity %.4f', jaccard) FROM {_DRIFT_CAT} WHERE alert
  UNION ALL SELECT 'fallback', 'share', 'share increased by ' || printf('%+.2f%%', change * 100) FROM {_DRIFT_FALL} WHERE alert)""", "test", "early"),
}

_SHARE = _r("min(n) / sum(n)", 4)
ORACLE_SQL["rule_baseline"] = (
    ORACLE_SQL["silhouette_rules"].replace("SELECT count(*) AS n_sampled", "SELECT 'RFMRules' AS family, CAST(max(t.k) AS INTEGER) AS k, max(t.min_share) AS min_share, max(db.davies_bouldin) AS davies_bouldin", 1)
    + f" CROSS JOIN (SELECT count(*) AS k, {_SHARE} AS min_share FROM (SELECT segment_id, count(*) AS n FROM assigned WHERE status = 'known_active' GROUP BY segment_id)) t CROSS JOIN (" + ORACLE_SQL["davies_bouldin_rules"].partition(")\nSELECT")[1].strip(")\n") + ORACLE_SQL["davies_bouldin_rules"].partition(")\nSELECT")[2] + ") db"
)
_COLUMNS = {"Country": "Country", "CustomerID": "CustomerID", "Description": "Description", "InvoiceDate": "strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S')", "InvoiceNo": "InvoiceNo"} | {c: f"CAST(CAST(round_even({c} * 1e6, 0) AS HUGEINT) AS VARCHAR)" for c in ("Quantity",)} | {"StockCode": "StockCode", "UnitPrice": "CAST(CAST(round_even(UnitPrice * 1e6, 0) AS HUGEINT) AS VARCHAR)"}
_ROW = " || ',' || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in _COLUMNS.values())
_SUMS = ", ".join(f"coalesce(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)), 0) AS s{i}" for i in range(4))
_DIGEST = f"SELECT n_rows, upper(sha256(n_rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3)) AS digest FROM (SELECT count(*) AS n_rows, {_SUMS} FROM (SELECT sha256({_ROW}) AS h FROM raw))"
ORACLE_SQL["source_digest"] = _sql(_DIGEST, None)
ORACLE_SQL["selection_manifest"] = _with(
    _EACH + _MEANS_OF_EACH + _CHOSEN,
    f"""SELECT n_rows AS n_lines, digest AS source_digest, '{params_digest()}' AS params_digest, '{CUTOFFS['validation']}' AS cutoff, selected AS recommender, qualifies, relative_gain, CASE WHEN qualifies THEN ndcg ELSE base_ndcg END AS validation_ndcg, CASE WHEN qualifies THEN recall ELSE base_recall END AS validation_recall, d_low FROM ({_DIGEST}) CROSS JOIN ({_GATE})""",
    "validation",
)

_CUTS_THEN = "(SELECT * FROM cuts_0)"
ORACLE_SQL["rule_model_segments"] = _sql(
    f"""SELECT p.segment_id, segment_label, n AS customer_count, {_r('n / (sum(n) OVER ())', 4)} AS customer_share, median_recency, median_frequency, median_monetary,
  CASE WHEN median_monetary >= 1500 AND median_frequency >= 4 AND median_recency <= 30 THEN 'Loyalty perks, early product access, and premium bundles to maximize retention.' WHEN median_monetary >= 1000 AND median_recency > 50 THEN 'Re-engagement win-back campaigns with personalized high-tier product discounts.'
  WHEN median_frequency >= 3 AND median_recency <= 40 THEN 'Category cross-sell recommendations and volume discounts to boost basket size.' WHEN median_recency <= 30 AND median_frequency <= 2 THEN 'Nurture sequence and introductory category recommendations to foster repeat purchase.'
  WHEN median_recency > 60 THEN 'Low-cost seasonal email reminders and highlight of top global bestsellers.' ELSE 'Targeted segment-popular product promotions and seasonal campaigns.' END AS campaign_hypothesis, '{CUTOFFS['test']}' AS snapshot_cutoff, 'test' AS version
  FROM (SELECT segment_id, CASE segment_id WHEN 'SG01' THEN 'Recent Frequent High Spend' WHEN 'SG02' THEN 'Less Recent High Spend' WHEN 'SG03' THEN 'Recent Occasional' ELSE 'Other Active' END AS segment_label, count(*) AS n, {_r('median(recency_days)', 1)} AS median_recency, {_r('median(CAST(frequency_invoices AS DOUBLE))', 1)} AS median_frequency, {_r('median(monetary_gbp)', 2)} AS median_monetary
  FROM (SELECT *, CASE WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'SG01' WHEN r <= 2 AND m >= 3 THEN 'SG02' WHEN r >= 3 AND f <= 2 THEN 'SG03' ELSE 'SG04' END AS segment_id FROM (SELECT x.*, 4 - (CAST(recency_days >= r_q1 AS INT) + CAST(recency_days >= r_q2 AS INT) + CAST(recency_days >= r_q3 AS INT)) AS r,
  1 + CAST(frequency_invoices >= f_q1 AS INT) + CAST(frequency_invoices >= f_q2 AS INT) + CAST(frequency_invoices >= f_q3 AS INT) AS f, 1 + CAST(monetary_gbp >= m_q1 AS INT) + CAST(monetary_gbp >= m_q2 AS INT) + CAST(monetary_gbp >= m_q3 AS INT) AS m FROM rfm x CROSS JOIN {_CUTS_THEN} WHERE status = 'known_active')) GROUP BY segment_id) p""",
    "test", "validation",
)
