"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark plans: the feature build is
the unfused, step-by-step recipe, modes use ``row_number`` with an explicit
tie rule, and ordered sums use plain windows. Queries are composed from
named CTEs so each one states only its own final step.
"""

from __future__ import annotations

from orderpulse import CATEGORICAL_FEATURES as CATEGORICAL
from orderpulse import NUMERIC_FEATURES as NUMERIC

# --- stand-in tables (FIXTURES.md section 2) -------------------------------

STANDIN = {
    "so": """
  SELECT o_orderkey AS order_id, purchase_ts AS order_purchase_timestamp,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL
              ELSE purchase_ts + to_days(CAST(1 + (o_orderkey*7) % 30 AS INT))
                               + to_hours(CAST((o_orderkey*5) % 24 AS INT)) END
           AS order_delivered_customer_date,
         o_orderdate + to_days(CAST(12 + (o_orderkey*3) % 20 AS INT)) AS order_estimated_delivery_date,
         o_orderpriority
  FROM (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS purchase_ts FROM orders)""",
    "rv0": """
  SELECT order_id, order_id * 2 AS review_id,
         CASE WHEN o_orderpriority LIKE '1%' AND order_id % 3 = 0 THEN 1 + CAST(order_id % 5 AS INT)
              WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 + CAST(order_id % 3 AS INT)
              WHEN order_id % 8 = 0 THEN 3
              ELSE 4 + CAST(order_id % 2 AS INT) END AS review_score
  FROM so WHERE order_id % 50 <> 0
  UNION ALL
  SELECT order_id, order_id * 2 + 1, CAST(substr(o_orderpriority, 1, 1) AS INT) FROM so WHERE order_id % 10 = 3""",
    "rv": """
  SELECT r.review_id, r.order_id, r.review_score,
         CASE WHEN r.order_id % 3 = 0 THEN NULL
              WHEN r.order_id % 11 = 0 THEN ' ' || chr(9) || chr(160) || chr(10) || chr(12288)
              ELSE d.text END AS review_comment_message,
         r.order_id % (SELECT count(*) FROM documents) AS doc_id,
         d.n_chars AS doc_n_chars
  FROM rv0 r LEFT JOIN documents d ON d.doc_id = r.order_id % (SELECT count(*) FROM documents)""",
    "it": """
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_extendedprice AS price,
         floor(l_extendedprice*l_tax*100 + 0.5)/100.0E0 AS freight_value FROM lineitem""",
    "pay": """
  SELECT l_orderkey AS order_id,
         CASE WHEN l_returnflag = 'A' THEN 'credit_card'
              WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'boleto'
              WHEN l_returnflag = 'N' THEN 'debit_card'
              WHEN l_linestatus = 'F' THEN 'voucher' ELSE 'not_defined' END AS payment_type FROM lineitem""",
    "se": "SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "pr": """
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE lower(p_type) END AS product_category_name,
         CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE CAST(p_size % 6 + 1 AS DOUBLE) END AS product_photos_qty FROM part""",
    "tr": """
  SELECT * FROM (VALUES ('economy','electronics'), ('large','housewares'), ('medium','toys'),
                        ('small','auto'), ('standard','stationery'))
           t(product_category_name, product_category_name_english)""",
}

# --- feature recipe, step by step (unfused) --------------------------------

FEATURES = {
    "rva": """
  SELECT order_id, avg(review_score) AS review_score FROM rv
  WHERE order_id IS NOT NULL GROUP BY order_id""",
    "ia": """
  SELECT order_id, CAST(count(order_item_id) AS DOUBLE) AS number_of_items,
         coalesce(sum(price), 0) AS total_order_value, avg(price) AS avg_product_price,
         max(price) AS max_product_price, min(price) AS min_product_price,
         coalesce(sum(freight_value), 0) AS total_freight_value,
         avg(freight_value) AS avg_freight_value, max(freight_value) AS max_freight_value
  FROM it WHERE order_id IS NOT NULL GROUP BY order_id""",
    "pm": """
  SELECT order_id, payment_type FROM (
    SELECT order_id, payment_type,
           row_number() OVER (PARTITION BY order_id ORDER BY n DESC, payment_type) AS rn
    FROM (SELECT order_id, payment_type, count(*) AS n FROM pay
          WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type)) WHERE rn = 1""",
    "ss": """
  SELECT order_id, seller_state FROM (
    SELECT order_id, seller_state,
           row_number() OVER (PARTITION BY order_id ORDER BY n DESC, seller_state) AS rn
    FROM (SELECT i.order_id, s.seller_state, count(*) AS n
          FROM it i LEFT JOIN se s ON i.seller_id = s.seller_id
          WHERE s.seller_state IS NOT NULL GROUP BY i.order_id, s.seller_state)) WHERE rn = 1""",
    "pc": """
  SELECT p.product_id, coalesce(t.product_category_name_english, p.product_category_name) AS product_category,
         p.product_photos_qty
  FROM pr p LEFT JOIN tr t ON p.product_category_name = t.product_category_name""",
    "cm": """
  SELECT order_id, product_category FROM (
    SELECT order_id, product_category,
           row_number() OVER (PARTITION BY order_id ORDER BY n DESC, product_category) AS rn
    FROM (SELECT i.order_id, c.product_category, count(*) AS n
          FROM it i LEFT JOIN pc c ON i.product_id = c.product_id
          WHERE c.product_category IS NOT NULL GROUP BY i.order_id, c.product_category)) WHERE rn = 1""",
    "ph": """
  SELECT i.order_id, min(c.product_photos_qty) AS min_product_photos_qty
  FROM it i LEFT JOIN pc c ON i.product_id = c.product_id GROUP BY i.order_id""",
    "feat": """
  SELECT o.order_id, r.review_score, CAST(r.review_score >= 4 AS INT) AS is_positive_review,
         floor((epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_purchase_timestamp)) / 86400000000.0) AS delivery_days,
         floor((epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_estimated_delivery_date)) / 86400000000.0) AS delivery_vs_estimated,
         ia.number_of_items, ia.total_order_value, ia.avg_product_price, ia.max_product_price,
         ia.min_product_price, ia.total_freight_value, ia.avg_freight_value, ia.max_freight_value,
         ph.min_product_photos_qty, cm.product_category, ss.seller_state, pm.payment_type,
         o.order_purchase_timestamp
  FROM so o JOIN rva r ON o.order_id = r.order_id
  LEFT JOIN ia ON o.order_id = ia.order_id
  LEFT JOIN pm ON o.order_id = pm.order_id
  LEFT JOIN ss ON o.order_id = ss.order_id
  LEFT JOIN cm ON o.order_id = cm.order_id
  LEFT JOIN ph ON o.order_id = ph.order_id""",
}



def snap(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"floor(({expr}) * {scale} + 0.5) / {scale}"


def with_ctes(*groups: dict[str, str], final: str) -> str:
    ctes = {}
    for g in groups:
        ctes.update(g)
    body = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes.items())
    return f"WITH {body}\n{final.strip()}"


# --- registered oracle queries -----------------------------------------------

ORACLE: dict[str, str] = {}

_S = STANDIN
_SF = {**STANDIN, **FEATURES}

ORACLE["order_features"] = with_ctes(_SF, final=f"""
SELECT order_id, review_score, is_positive_review, delivery_days, delivery_vs_estimated,
       number_of_items, {snap('total_order_value')} AS total_order_value,
       {snap('avg_product_price')} AS avg_product_price, max_product_price, min_product_price,
       {snap('total_freight_value')} AS total_freight_value,
       {snap('avg_freight_value')} AS avg_freight_value, max_freight_value,
       min_product_photos_qty, product_category, seller_state, payment_type
FROM feat""")

ORACLE["review_label"] = with_ctes(_SF, final="""
SELECT order_id, review_score, CAST(review_score >= 4 AS INT) AS is_positive_review FROM rva""")

ORACLE["item_aggregates"] = with_ctes(_SF, final=f"""
SELECT order_id, number_of_items, {snap('total_order_value')} AS total_order_value,
       {snap('avg_product_price')} AS avg_product_price, max_product_price, min_product_price,
       {snap('total_freight_value')} AS total_freight_value,
       {snap('avg_freight_value')} AS avg_freight_value, max_freight_value
FROM ia""")

ORACLE["payment_mode"] = with_ctes(_SF, final="""
SELECT k.order_id, pm.payment_type
FROM (SELECT DISTINCT order_id FROM pay WHERE order_id IS NOT NULL) k
LEFT JOIN pm ON k.order_id = pm.order_id""")

ORACLE["seller_state_mode"] = with_ctes(_SF, final="""
SELECT k.order_id, ss.seller_state
FROM (SELECT DISTINCT order_id FROM it WHERE order_id IS NOT NULL) k
LEFT JOIN ss ON k.order_id = ss.order_id""")

ORACLE["category_mode"] = with_ctes(_SF, final="""
SELECT k.order_id, cm.product_category
FROM (SELECT DISTINCT order_id FROM it WHERE order_id IS NOT NULL) k
LEFT JOIN cm ON k.order_id = cm.order_id""")

ORACLE["delivery_days_floor"] = with_ctes(_S, final="""
SELECT order_id,
       floor((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0) AS delivery_days,
       floor((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400000000.0) AS delivery_vs_estimated
FROM so""")

ORACLE["photos_min"] = with_ctes(_S, final="""
SELECT i.order_id, min(p.product_photos_qty) AS min_product_photos_qty
FROM it i LEFT JOIN pr p ON i.product_id = p.product_id
WHERE i.order_id IS NOT NULL GROUP BY i.order_id""")

ORACLE["rating_distribution"] = with_ctes(_S, final="""
SELECT review_score, CAST(count(*) AS BIGINT) AS n FROM rv GROUP BY review_score ORDER BY review_score""")

ORACLE["label_distribution"] = with_ctes(_SF, final=f"""
SELECT is_positive_review, n, {snap('n / sum(n) OVER ()')} AS share
FROM (SELECT is_positive_review, CAST(count(*) AS BIGINT) AS n FROM feat GROUP BY is_positive_review)""")


# --- monitoring chain ---------------------------------------------------------

def u_sql(seed: str, *parts: str) -> str:
    """Uniform [0,1) from md5('seed:part1:...'), as in the Spark plans."""
    s = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5({s}), 1, 13))::BIGINT / 4503599627370496.0)"


def md5_sql(seed: str, *parts: str) -> str:
    s = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({s})"


_JIT = ",\n         ".join(
    f"{c} * (1.0 + (2.0 * {u_sql('42', 'order_id', repr(c))} - 1.0) * 0.05) AS {c}"
    for c in NUMERIC)

# the scorecard: class weights counted on the training split, as one map
_CUT = lambda v, f: (
    f"CASE WHEN {v} IS NULL OR isnan({v}) THEN 'missing' ELSE CAST(len(list_filter("
    f"map_extract((SELECT m FROM sce), '{f}')[1], lambda x: x <= {v})) AS VARCHAR) END")


def _classes(at: str = "") -> dict[str, str]:
    """SQL of every feature's class; ``at`` is a table's name with a dot, or a pattern for the value."""
    value = (lambda c: at.format(c)) if "{" in at else (lambda c: at + c)
    return {**{f: _CUT(value(f), f) for f in NUMERIC},
            **{f: f"coalesce({value(f)}, 'missing')" for f in CATEGORICAL}}


def _weight(p: str, n: str) -> str:
    return (f"CAST(floor(1e6 * ln((CAST({p} + 1 AS DOUBLE) / CAST(t.p + 10 AS DOUBLE)) / "
            f"(CAST({n} + 1 AS DOUBLE) / CAST(t.n + 10 AS DOUBLE)))) AS BIGINT)")


CARD = {
    "sct": f"SELECT * FROM feat WHERE NOT ({u_sql('42', 'order_id')} < 0.2)",
    "scl": "\n  UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM sct" for f in NUMERIC),
    "sce": """
  SELECT map_from_entries(list((feature, list_transform(range(1, 10), lambda i: mn + i * ((mx - mn) / 10.0))))) AS m
  FROM (SELECT feature, min(value) AS mn, quantile_cont(value, 0.99) AS mx FROM scl
        WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature)""",
    "scn": "SELECT count(*) FILTER (WHERE is_positive_review = 1) AS p, count(*) FILTER (WHERE is_positive_review = 0) AS n FROM sct",
    "scc": "\n  UNION ALL ".join(f"SELECT '{f}' AS feature, {c} AS class, is_positive_review AS y FROM sct"
                                 for f, c in _classes().items()),
    "scm": f"""
  SELECT map_from_entries(list((k, w))) AS m FROM (
    SELECT feature || '=' || class AS k, {_weight('c.p', 'c.n')} AS w
    FROM (SELECT feature, class, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n
          FROM scc GROUP BY ALL) c, scn t)""",
    "scz": f"SELECT {_weight('0', '0')} AS unseen, CAST(floor(1e6 * ln(CAST(t.p + 1 AS DOUBLE) / CAST(t.n + 1 AS DOUBLE))) AS BIGINT) AS prior FROM scn t",
}


def _logit(at: str = "") -> str:
    parts = [f"coalesce(map_extract((SELECT m FROM scm), '{f}=' || {c})[1], (SELECT unseen FROM scz))"
             for f, c in _classes(at).items()]
    return "((SELECT prior FROM scz) + " + " + ".join(parts) + ")"


def _proba(at: str = "") -> str:
    return f"(1.0 / (1.0 + exp(-{_logit(at)} / 1e6)))"


MONITOR = {
    "mf": """
  SELECT * FROM (
    SELECT *, CASE WHEN ym < 0 THEN 0 ELSE ym + 1 END AS month
    FROM (SELECT feat.*, year(order_purchase_timestamp) * 12 + month(order_purchase_timestamp) - (2001 * 12 + 2) AS ym
          FROM feat))""",
    "mref": "SELECT * FROM mf WHERE month = 0",
    "scen": """
  SELECT CAST(month AS INT) AS month, CAST(a AS DOUBLE) AS delivery_add, CAST(m AS DOUBLE) AS freight_mult,
         CAST(e AS DOUBLE) AS electronics_shift_pp, CAST(f AS DOUBLE) AS flip_pct
  FROM (VALUES (4, 2.0, 1.15, 0.10, 0.05), (5, 4.0, 1.30, 0.15, 0.05), (6, 6.0, 1.50, 0.20, 0.05)) t(month, a, m, e, f)""",
    "j0": f"""
  SELECT order_id, month, review_score, is_positive_review, order_purchase_timestamp,
         {_JIT},
         product_category, seller_state, payment_type
  FROM mf WHERE month > 0""",
    "j1": """
  SELECT j0.* REPLACE (delivery_days + coalesce(s.delivery_add, 0.0) AS delivery_days,
                       total_freight_value * coalesce(s.freight_mult, 1.0) AS total_freight_value,
                       avg_freight_value * coalesce(s.freight_mult, 1.0) AS avg_freight_value,
                       max_freight_value * coalesce(s.freight_mult, 1.0) AS max_freight_value),
         coalesce(s.electronics_shift_pp, 0.0) AS shift_pp, coalesce(s.flip_pct, 0.0) AS flip_pct
  FROM j0 LEFT JOIN scen s ON j0.month = s.month""",
    "j2": f"""
  SELECT * REPLACE (CASE WHEN cand AND avail >= k AND rk < k THEN 'electronics' ELSE product_category END
                    AS product_category)
  FROM (SELECT *, count(*) OVER (PARTITION BY month) AS n_m,
               count(*) FILTER (WHERE cand) OVER (PARTITION BY month) AS avail,
               floor(count(*) OVER (PARTITION BY month) * shift_pp) AS k,
               CASE WHEN cand THEN row_number() OVER (PARTITION BY month, cand
                    ORDER BY {md5_sql('42:reassign', 'order_id')}, order_id) - 1 END AS rk
        FROM (SELECT *, (product_category IS NULL OR product_category <> 'electronics') AS cand FROM j1))""",
    "j3": f"""
  SELECT * REPLACE (CASE WHEN cand2 AND avail2 >= k2 AND rk2 < k2 THEN 0 ELSE is_positive_review END
                    AS is_positive_review)
  FROM (SELECT *, count(*) FILTER (WHERE cand2) OVER (PARTITION BY month) AS avail2,
               floor(count(*) OVER (PARTITION BY month) * flip_pct) AS k2,
               CASE WHEN cand2 THEN row_number() OVER (PARTITION BY month, cand2
                    ORDER BY {md5_sql('42:flip', 'order_id')}, order_id) - 1 END AS rk2
        FROM (SELECT *, coalesce(is_positive_review = 1, false) AS cand2 FROM j2))""",
    "prod": f"""
  SELECT order_id, month, review_score, is_positive_review, order_purchase_timestamp,
         {', '.join(NUMERIC)}, {', '.join(CATEGORICAL)} FROM j3""",
    "scored": """
  SELECT *, is_positive_review AS y_true,
         1.0 / (1.0 + exp(-lg / 1e6)) AS y_proba, CAST(lg >= 0 AS INT) AS y_pred
  FROM (SELECT *, @LOGIT@ AS lg FROM prod)""".replace("@LOGIT@", _logit()),
}

_DF = ["delivery_days", "total_freight_value", "total_order_value"]


def _long(src: str, keep: str = "") -> str:
    k = f"{keep}, " if keep else ""
    return "\n  UNION ALL ".join(
        f"SELECT {k}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src} "
        f"WHERE {f} IS NOT NULL AND NOT isnan({f})" for f in _DF)


DRIFT = {
    "lref": _long("mref"),
    "lcur": _long("prod", "month"),
    "edges": """
  SELECT feature, list_transform(range(1, 10), lambda i: mn + i * ((mx - mn) / 10.0)) AS edges
  FROM (SELECT feature, min(value) AS mn, quantile_cont(value, 0.99) AS mx FROM lref GROUP BY feature)""",
    "rcnt": """
  SELECT l.feature, len(list_filter(e.edges, lambda x: x <= l.value)) AS bin, count(*) AS n
  FROM lref l JOIN edges e ON l.feature = e.feature GROUP BY ALL""",
    "ccnt": """
  SELECT l.feature, l.month, len(list_filter(e.edges, lambda x: x <= l.value)) AS bin, count(*) AS n
  FROM lcur l JOIN edges e ON l.feature = e.feature GROUP BY ALL""",
    "rsh": "SELECT feature, bin, n / sum(n) OVER (PARTITION BY feature) AS r_share FROM rcnt",
    "csh": """
  SELECT g.feature, g.month, b.bin, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.feature, g.month) AS c_share
  FROM (SELECT DISTINCT feature, month FROM ccnt) g CROSS JOIN range(0, 10) b(bin)
  LEFT JOIN ccnt c ON c.feature = g.feature AND c.month = g.month AND c.bin = b.bin""",
    "psil": """
  SELECT c.feature, c.month,
         sum((c.c_share + 0.0001 - (coalesce(r.r_share, 0.0) + 0.0001))
             * ln((c.c_share + 0.0001) / (coalesce(r.r_share, 0.0) + 0.0001))) AS psi
  FROM csh c LEFT JOIN rsh r ON c.feature = r.feature AND c.bin = r.bin
  GROUP BY c.feature, c.month""",
}


def _sev(x: str) -> str:
    return f"CASE WHEN {x} < 0.1 THEN 'GREEN' WHEN {x} < 0.2 THEN 'YELLOW' ELSE 'RED' END"


KS = {
    "kv": """
  SELECT feature, month, value, sum(isr) AS r, sum(1 - isr) AS c FROM (
    SELECT l.feature, m.month, l.value, 1 AS isr FROM lref l CROSS JOIN (SELECT DISTINCT month FROM lcur) m
    UNION ALL SELECT feature, month, value, 0 FROM lcur) GROUP BY ALL""",
    "kc": """
  SELECT feature, month,
         sum(r) OVER w / sum(r) OVER (PARTITION BY feature, month) AS fr,
         sum(c) OVER w / sum(c) OVER (PARTITION BY feature, month) AS fc,
         sum(r) OVER (PARTITION BY feature, month) AS n_ref,
         sum(c) OVER (PARTITION BY feature, month) AS n_cur
  FROM kv WINDOW w AS (PARTITION BY feature, month ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "kd": """
  SELECT feature, month, max(abs(fr - fc)) AS ks_stat, CAST(max(n_ref) AS DOUBLE) AS nr, CAST(max(n_cur) AS DOUBLE) AS nc
  FROM kc GROUP BY feature, month""",
    # Kolmogorov's distribution in its theta form for all values (the plans use the
    # alternating series above 1); beyond 20 the p-value is 0 in any case
    "kp": """
  SELECT feature, month, ks_stat, nr, nc,
         CASE WHEN ks_stat <= 0 THEN 1.0 WHEN lam > 20 THEN 0.0
              ELSE greatest(0.0, least(1.0, 1.0 - sqrt(2 * pi()) / lam * list_reduce(
              list_prepend(0.0, list_transform(range(1, 201), lambda k: exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * lam * lam)))),
              lambda a, b: a + b))) END AS p
  FROM (SELECT *, sqrt(nr * nc / (nr + nc)) * ks_stat AS lam FROM kd)""",
}

_KS_FINAL = f"""
SELECT feature, month, ks_stat, {snap('p')} AS p_value, CAST(p < 0.05 AS INT) AS significant,
       CAST(nr AS BIGINT) AS n_ref, CAST(nc AS BIGINT) AS n_cur FROM kp"""

_M = {**STANDIN, **FEATURES, **CARD, **MONITOR}
_MD = {**_M, **DRIFT}


def _conf(src: str, by: str = "month") -> str:
    return f"""
  SELECT {by}, CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS BIGINT) AS fn
  FROM {src} GROUP BY {by}"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def _metric_cols(s=snap) -> str:
    return ",\n       ".join([
        f"{s(_div('tp + tn', 'tp + fp + tn + fn'))} AS accuracy",
        f"{s(_div('tp', 'tp + fp'))} AS precision_pos",
        f"{s(_div('tp', 'tp + fn'))} AS recall_pos",
        f"{s(_div('2 * tp', '2 * tp + fp + fn'))} AS f1_pos",
        f"{s(_div('tn', 'tn + fn'))} AS precision_neg",
        f"{s(_div('tn', 'tn + fp'))} AS recall_neg",
        f"{s(_div('2 * tn', '2 * tn + fn + fp'))} AS f1_neg",
        f"{s('(' + _div('2 * tp', '2 * tp + fp + fn') + ' + ' + _div('2 * tn', '2 * tn + fn + fp') + ') / 2')} AS f1_macro",
    ])


def _auc(src: str, by: str | None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    g = f"{by}, " if by else ""
    return f"""
  SELECT {g}CAST(sum(2 * pos * coalesce(nb, 0) + pos * neg) AS DOUBLE) / nullif(CAST(2 * sum(pos) * sum(neg) AS DOUBLE), 0) AS auc,
         CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
  FROM (SELECT *, sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb
        FROM (SELECT {g}y_proba AS s, count(*) FILTER (WHERE y_true = 1) AS pos,
                     count(*) FILTER (WHERE y_true = 0) AS neg
              FROM scored WHERE y_proba IS NOT NULL AND y_true IS NOT NULL GROUP BY ALL))
  {'GROUP BY ' + by if by else ''}"""


PERF = {
    "conf": _conf("scored"),
    "aucm": _auc("scored", "month"),
    "perf": f"""
  SELECT c.month, {_div('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_div('2 * tp', '2 * tp + fp + fn')} AS f1,
         CAST(tp + fn AS DOUBLE) / CAST(tp + fp + tn + fn AS DOUBLE) AS positive_rate, a.auc
  FROM conf c LEFT JOIN aucm a ON c.month = a.month""",
}

ORACLE["split_stratified"] = with_ctes(_SF, final=f"""
SELECT order_id, is_positive_review,
       CASE WHEN {u_sql('42', 'order_id')} < 0.2 THEN 'test' ELSE 'train' END AS split
FROM feat""")

ORACLE["split_exact"] = with_ctes(_SF, final=f"""
SELECT order_id, is_positive_review,
       CASE WHEN row_number() OVER (PARTITION BY is_positive_review ORDER BY {md5_sql('42', 'order_id')}, order_id)
                 <= ceil(count(*) OVER (PARTITION BY is_positive_review) * CAST(0.2 AS DOUBLE))
            THEN 'test' ELSE 'train' END AS split
FROM feat""")

ORACLE["bootstrap_sample"] = with_ctes(_SF, {
    "pop": f"""
  SELECT order_id, is_positive_review,
         row_number() OVER (ORDER BY {md5_sql('42', 'order_id')}, order_id) - 1 AS pid
  FROM feat WHERE {u_sql('42', 'order_id')} < 0.2""",
}, final=f"""
SELECT 1 AS month, d.draw, p.order_id, p.is_positive_review
FROM (SELECT pid AS draw, floor({u_sql('42', '1', 'pid')} * (SELECT count(*) FROM pop)) AS pid FROM pop) d
JOIN pop p ON d.pid = p.pid""")

ORACLE["psi_matrix"] = with_ctes(_MD, final=f"""
SELECT feature, month, {snap('psi')} AS psi, {_sev('psi')} AS severity FROM psil""")

ORACLE["psi_wide"] = with_ctes(_MD, final="SELECT feature, " + ", ".join(
    f"max({snap('psi')}) FILTER (WHERE month = {m}) AS psi_m{m}, "
    f"max({_sev('psi')}) FILTER (WHERE month = {m}) AS severity_m{m}" for m in range(1, 8))
    + " FROM psil GROUP BY feature")

ORACLE["ks_matrix"] = with_ctes(_MD, KS, final=_KS_FINAL)
ORACLE["ks_significant"] = with_ctes(_MD, KS, final=f"SELECT * FROM ({_KS_FINAL}) WHERE significant = 1")

ORACLE["monthly_profile"] = with_ctes(_M, final=f"""
SELECT month, CAST(count(*) AS BIGINT) AS n, {snap('avg(delivery_days)')} AS mean_delivery_days,
       {snap('avg(total_freight_value)')} AS mean_total_freight_value,
       {snap("avg(CAST(product_category = 'electronics' AS INT))")} AS electronics_share,
       {snap('avg(CAST(is_positive_review AS DOUBLE))')} AS positive_rate
FROM prod GROUP BY month""")

ORACLE["monthly_performance"] = with_ctes(_M, PERF, final=f"""
SELECT month, {snap('accuracy')} AS accuracy, {snap('f1')} AS f1, {snap('positive_rate')} AS positive_rate,
       {snap('auc')} AS auc FROM perf""")

ORACLE["performance_drop"] = with_ctes(_M, PERF, final=f"""
SELECT metric, {snap('first_value')} AS first_value, {snap('last_value')} AS last_value,
       {snap('first_value - last_value')} AS abs_drop, {snap('(first_value - last_value) / first_value * 100')} AS pct_drop
FROM (SELECT metric, arg_min(value, month) AS first_value, arg_max(value, month) AS last_value
      FROM (UNPIVOT (SELECT month, accuracy, f1, auc FROM perf) ON accuracy, f1, auc INTO NAME metric VALUE value)
      GROUP BY metric)""")

ORACLE["alerts"] = with_ctes(_MD, PERF, final=f"""
SELECT feature AS feature_or_metric, month, {snap('psi')} AS value, {_sev('psi')} AS severity,
       CASE WHEN psi >= 0.2 THEN 'Retrain or replace model' ELSE 'Investigate root cause' END AS action
FROM psil WHERE psi >= 0.1
UNION ALL
SELECT 'F1 score', month, {snap('f1')}, 'RED', 'Performance below threshold (0.7)' FROM perf WHERE f1 < 0.7""")

ORACLE["retrain_trigger"] = with_ctes(_MD, PERF, {
    "red": """
  SELECT month, bool_or(coalesce(two, false)) AS red_two_months, bool_or(psi >= 0.1) AS any_yellow
  FROM (SELECT *, psi >= 0.2 AND coalesce(lag(psi >= 0.2) OVER w, false)
                  AND month - lag(month) OVER w = 1 AS two
        FROM psil WINDOW w AS (PARTITION BY feature ORDER BY month))
  GROUP BY month""",
    "pf": """
  SELECT month, f1, avg(f1) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_f1,
         first_value(f1) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS baseline_f1
  FROM perf""",
}, final=f"""
SELECT coalesce(p.month, r.month) AS month,
       CAST(coalesce(r.red_two_months, false) AS INT) AS red_two_months,
       CAST(coalesce(p.f1 < 0.7, false) AS INT) AS f1_below,
       CAST(coalesce(p.rolling_f1 < p.baseline_f1 * 0.95, false) AS INT) AS f1_decline,
       {snap('p.rolling_f1')} AS rolling_f1, {snap('p.baseline_f1')} AS baseline_f1,
       CAST(coalesce(r.red_two_months, false) OR coalesce(p.f1 < 0.7, false)
            OR coalesce(p.rolling_f1 < p.baseline_f1 * 0.95, false) AS INT) AS retrain,
       CASE WHEN coalesce(r.red_two_months, false) OR coalesce(p.f1 < 0.7, false)
                 OR coalesce(p.rolling_f1 < p.baseline_f1 * 0.95, false) THEN 'retrain'
            WHEN coalesce(r.any_yellow, false) THEN 'investigate' ELSE 'none' END AS action
FROM pf p FULL JOIN red r ON p.month = r.month""")

ORACLE["jitter_shift_scale"] = with_ctes(_M, final="SELECT order_id, month, " + ", ".join(
    f"{snap(c)} AS {c}" for c in NUMERIC) + " FROM prod")

ORACLE["category_reassign"] = with_ctes(_M, final="SELECT order_id, month, product_category FROM prod")
ORACLE["label_flip"] = with_ctes(_M, final="SELECT order_id, month, is_positive_review FROM prod")

ORACLE["confusion_metrics"] = with_ctes(_M, {"conf": _conf("scored")}, final=f"""
SELECT month, tp, fp, tn, fn, {_metric_cols()} FROM conf""")

ORACLE["roc_auc"] = with_ctes(_M, final=f"""
SELECT month, {snap('auc')} AS auc, n_pos, n_neg FROM ({_auc('scored', 'month')})
UNION ALL
SELECT NULL, {snap('auc')}, n_pos, n_neg FROM ({_auc('scored', None)})""")

ORACLE["threshold_sweep"] = with_ctes(_M, {
    "thr": "SELECT j / 20.0 AS threshold FROM range(1, 20) t(j)",
    "sw": """
  SELECT t.threshold,
         CAST(count(*) FILTER (WHERE s.y_true = 1 AND s.y_proba >= t.threshold) AS BIGINT) AS tp,
         CAST(count(*) FILTER (WHERE s.y_true = 0 AND s.y_proba >= t.threshold) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE s.y_true = 0 AND s.y_proba < t.threshold) AS BIGINT) AS tn,
         CAST(count(*) FILTER (WHERE s.y_true = 1 AND s.y_proba < t.threshold) AS BIGINT) AS fn
  FROM thr t CROSS JOIN (SELECT * FROM scored WHERE y_proba IS NOT NULL AND y_true IS NOT NULL) s
  GROUP BY t.threshold""",
}, final=f"SELECT threshold, tp, fp, tn, fn, {_metric_cols()} FROM sw")

def _cost(src: str, by: str = "") -> str:
    """Costs of all thresholds, each counted from the rows."""
    return f"""
  SELECT {by} t.k AS step, count(*) FILTER (WHERE s.y_true = 0 AND s.h < t.k) AS n_missed,
         count(*) FILTER (WHERE s.y_true = 1 AND s.h >= t.k) AS n_false
  FROM range(0, 1001) t(k) CROSS JOIN (
    SELECT *, least(floor((1.0 - y_proba) * 1000), 1000) AS h FROM {src}
    WHERE y_proba IS NOT NULL AND y_true IS NOT NULL) s
  GROUP BY ALL"""


ORACLE["cost_curve"] = with_ctes(_M, {"cc": _cost("scored", "s.month,")}, final="""
SELECT month, step / 1000.0 AS threshold, CAST(step AS INT) AS step, CAST(n_missed AS BIGINT) AS n_missed,
       CAST(n_false AS BIGINT) AS n_false, CAST(n_missed * 5 + n_false AS DOUBLE) AS cost,
       CAST(step = max(step) FILTER (WHERE n_missed * 5 + n_false = least_cost) OVER (PARTITION BY month) AS INT) AS is_best
FROM (SELECT *, min(n_missed * 5 + n_false) OVER (PARTITION BY month) AS least_cost FROM cc)""")

ORACLE["score_cost_threshold"] = with_ctes(_M, {
    "rs": """
  SELECT is_positive_review AS y_true, @PROBA@ AS y_proba
  FROM mref""".replace("@PROBA@", _proba()),
    "cc": _cost("rs"),
    "best": "SELECT step FROM cc ORDER BY n_missed * 5 + n_false, step DESC LIMIT 1",
}, final="""
SELECT order_id, month, step / 1000.0 AS threshold,
       CASE WHEN least(floor((1.0 - y_proba) * 1000), 1000) >= step THEN 0 ELSE 1 END AS y_pred
FROM scored, best""")

# the p-value by counting paths through the lattice of both samples, diagonal by diagonal
ORACLE["ks_exact_months"] = with_ctes(_M, DRIFT, {
    "kv": "SELECT feature, month AS m, value FROM lcur WHERE value IS NOT NULL AND NOT isnan(value)",
    "kn": "SELECT feature, m, count(*) AS n FROM kv GROUP BY ALL",
    "kp": "SELECT c.feature, c.m, r.n AS n_ref, c.n AS n_cur FROM kn c JOIN kn r ON r.feature = c.feature AND r.m = c.m - 1",
    "kx": """
  SELECT p.feature, p.m, p.n_ref, p.n_cur, x.value,
         CAST(count(*) FILTER (WHERE x.m = p.m - 1) AS BIGINT) AS r, CAST(count(*) FILTER (WHERE x.m = p.m) AS BIGINT) AS c
  FROM kp p JOIN kv x ON x.feature = p.feature AND x.m IN (p.m, p.m - 1) GROUP BY ALL""",
    "kc": """
  SELECT feature, m, n_ref, n_cur, abs(sum(r) OVER w * n_cur - sum(c) OVER w * n_ref) AS gap
  FROM kx WINDOW w AS (PARTITION BY feature, m ORDER BY value)""",
    "kg": "SELECT feature, m, n_ref, n_cur, CAST(max(gap) AS BIGINT) AS reach FROM kc GROUP BY ALL",
    "kd": """
  SELECT feature, m, n_ref, n_cur, reach, 0 AS d, 0 AS i, 1.0::DOUBLE AS pr, false AS gone FROM kg
  UNION ALL
  SELECT feature, m, n_ref, n_cur, reach, d, i, sum(pr) AS pr, abs(i * n_cur - (d - i) * n_ref) >= reach AS gone
  FROM (
    SELECT feature, m, n_ref, n_cur, reach, d + 1 AS d, i + s.s AS i,
           pr * (CASE WHEN s.s = 1 THEN n_ref - i ELSE n_cur - (d - i) END) / (n_ref + n_cur - d) AS pr
    FROM kd, (VALUES (0), (1)) s(s) WHERE NOT gone AND d < n_ref + n_cur)
  WHERE pr > 0
  GROUP BY feature, m, n_ref, n_cur, reach, d, i""",
    "kq": "SELECT feature, m, sum(pr) AS p FROM kd WHERE gone GROUP BY ALL",
}, final=f"""
SELECT g.feature, g.m AS month, g.reach / CAST(g.n_ref * g.n_cur AS DOUBLE) AS ks_stat,
       {snap('CASE WHEN g.reach = 0 THEN 1.0 ELSE least(1.0, coalesce(q.p, 0.0)) END')} AS p_value,
       CAST(CASE WHEN g.reach = 0 THEN 1.0 ELSE least(1.0, coalesce(q.p, 0.0)) END < 0.05 AS INT) AS significant,
       CAST(g.n_ref AS BIGINT) AS n_ref, CAST(g.n_cur AS BIGINT) AS n_cur
FROM kg g LEFT JOIN kq q ON q.feature = g.feature AND q.m = g.m""").replace("WITH ", "WITH RECURSIVE ", 1)

ORACLE["retrain_set"] = with_ctes(_M, final=f"""
SELECT order_id, month, is_positive_review, {', '.join(snap(c) + ' AS ' + c for c in NUMERIC)},
       {', '.join(CATEGORICAL)}, 'train' AS source,
       {snap("pow(0.5, CAST(date_diff('month', order_purchase_timestamp, (SELECT max(order_purchase_timestamp) FROM feat)) AS DOUBLE) / 6.0)")} AS weight
FROM mref
UNION ALL
SELECT order_id, month, is_positive_review, {', '.join(snap(c) + ' AS ' + c for c in NUMERIC)},
       {', '.join(CATEGORICAL)}, 'recent', 1.0 FROM prod WHERE month >= 4""")


# --- text ---------------------------------------------------------------------

_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
TEXT = {
    "cl": f"""
  SELECT review_id, order_id, review_score, doc_id, doc_n_chars,
         regexp_replace(review_comment_message, '^{_WS}+|{_WS}+$', '', 'g') AS text
  FROM rv WHERE review_comment_message IS NOT NULL""",
    "cln": "SELECT * FROM cl WHERE length(text) > 0",
    # naive Bayes from words to stars, each fold of documents scored without its own ratings
    "dd": f"""
  SELECT doc_id, CAST(floor({u_sql('42', 'doc_id')} * 5) AS INT) AS fold, list_distinct(list_transform(list_filter(
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
           lambda w: ('0x' || substr(md5(w), 1, 4))::INT)) AS buckets
  FROM documents""",
    "dw": "SELECT doc_id, fold, unnest(buckets) AS bucket FROM dd",
    "rat": "SELECT doc_id, review_score AS k, count(*) AS n FROM cln GROUP BY ALL",
    "wc": "SELECT fold, bucket, k, sum(n) AS c FROM dw JOIN rat USING (doc_id) GROUP BY ALL",
    "wt": "SELECT bucket, k, sum(c) AS c FROM wc GROUP BY ALL",
    "ft": "SELECT fold, k, sum(n) AS p, sum(n * len(buckets)) AS t FROM dd JOIN rat USING (doc_id) GROUP BY ALL",
    "fk": "SELECT CAST(f.f AS INT) AS fold, CAST(k.k AS INT) AS k FROM range(0, 5) f(f), range(1, 6) k(k)",
    "fo": """
  SELECT fk.fold, fk.k, coalesce(sum(ft.p) FILTER (WHERE ft.fold <> fk.fold), 0) AS p,
         coalesce(sum(ft.t) FILTER (WHERE ft.fold <> fk.fold), 0) AS t
  FROM fk LEFT JOIN ft ON ft.k = fk.k GROUP BY ALL""",
    "fb": """
  SELECT fold, k, t, CAST(floor(1e6 * ln(CAST(p + 1 AS DOUBLE) / CAST(sum(p) OVER (PARTITION BY fold) + 5 AS DOUBLE))) AS BIGINT) AS prior
  FROM fo""",
    "lw": """
  SELECT d.doc_id, b.k, sum(CAST(floor(1e6 * ln(
           CAST(coalesce(wt.c, 0) - coalesce(wc.c, 0) + 1 AS DOUBLE) / CAST(b.t + 65536 AS DOUBLE))) AS BIGINT)) AS s
  FROM dw d JOIN fb b ON b.fold = d.fold
  LEFT JOIN wt ON wt.bucket = d.bucket AND wt.k = b.k
  LEFT JOIN wc ON wc.bucket = d.bucket AND wc.k = b.k AND wc.fold = d.fold
  GROUP BY ALL""",
    "lg": """
  SELECT d.doc_id, b.k, b.prior + coalesce(lw.s, 0) AS l
  FROM dd d JOIN fb b ON b.fold = d.fold LEFT JOIN lw ON lw.doc_id = d.doc_id AND lw.k = b.k""",
    "st": """
  SELECT doc_id, arg_min(k, (-l, k)) AS k, 1.0 / sum(exp((l - m) / 1e6)) AS text_score
  FROM (SELECT *, max(l) OVER (PARTITION BY doc_id) AS m FROM lg) GROUP BY doc_id""",
    "tp": """
  SELECT c.*, CASE WHEN s.k = 1 THEN '1 star' ELSE CAST(s.k AS VARCHAR) || ' stars' END AS text_label,
         s.text_score, s.k AS pred_stars, CAST(s.k >= 4 AS INT) AS pred_binary
  FROM cln c JOIN st s ON s.doc_id = c.doc_id""",
}
_ST = {**STANDIN, **TEXT}

ORACLE["text_clean"] = with_ctes(_ST, final="""
SELECT review_id, order_id, review_score, text, CAST(length(text) AS BIGINT) AS n_chars FROM cln""")

ORACLE["text_sample_500"] = with_ctes(_ST, final=f"""
SELECT review_id, order_id, review_score, text FROM cln
ORDER BY {md5_sql('42', 'review_id')}, review_id LIMIT 500""")

ORACLE["text_preview"] = with_ctes(_ST, final="""
SELECT review_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview
FROM cln""")

ORACLE["stars_crosstab"] = with_ctes(_ST, final="SELECT pred_stars, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE review_score = {k}) AS BIGINT) AS actual_{k}" for k in range(1, 6))
    + " FROM tp GROUP BY pred_stars")


def _metric_row(y: str, p: str, src: str) -> str:
    return f"""
  SELECT count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE {y} = 0 AND {p} = 1) AS fp,
         count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE {y} = 1 AND {p} = 0) AS fn
  FROM {src}"""


_M6 = ["accuracy", "precision_pos", "recall_pos", "f1_pos", "recall_neg", "f1_macro"]

ORACLE["model_comparison"] = with_ctes(_SF, CARD, TEXT, {
    "j": f"""
  SELECT t.*, CAST(t.review_score >= 4 AS INT) AS y_true,
         CAST({_logit('f.')} >= 0 AS INT) AS f_pred
  FROM tp t JOIN feat f ON t.order_id = f.order_id
  WHERE NOT ({u_sql('42', 'f.order_id')} >= 0.2)""",
    "ca": _metric_row("y_true", "pred_binary", "j"),
    "cb": _metric_row("y_true", "f_pred", "j"),
    "ma": f"SELECT {_metric_cols()} FROM ca",
    "mb": f"SELECT {_metric_cols()} FROM cb",
    "la": "UNPIVOT ma ON " + ", ".join(_M6) + " INTO NAME metric VALUE text_model",
    "lb": "UNPIVOT mb ON " + ", ".join(_M6) + " INTO NAME metric VALUE feature_model",
}, final="""
SELECT la.metric, la.text_model, lb.feature_model,
       CASE WHEN la.text_model > lb.feature_model THEN 'text_model'
            WHEN lb.feature_model > la.text_model THEN 'feature_model' ELSE 'Tie' END AS winner
FROM la JOIN lb ON la.metric = lb.metric""")

ORACLE["text_stars"] = with_ctes(_ST, final=f"""
SELECT review_id, order_id, text_label, CAST(pred_stars AS INT) AS pred_stars, {snap('text_score')} AS text_score FROM tp""")

ORACLE["route_queue"] = with_ctes(_SF, CARD, TEXT, {
    "fs": f"SELECT order_id, {_proba()} AS y_proba FROM feat",
    "outq": "SELECT order_id, 'outreach' AS reason, 1.0 - y_proba AS score FROM fs WHERE y_proba < 0.5",
}, final=f"""
SELECT order_id, reason, {snap('score')} AS score FROM outq
UNION ALL
SELECT order_id, 'human_review', {snap('max(text_score)')} FROM tp
WHERE pred_binary = 0 AND order_id NOT IN (SELECT order_id FROM outq) GROUP BY order_id""")


# --- validation -----------------------------------------------------------

_NONNEG = [c for c in NUMERIC if c != "delivery_vs_estimated"]


def _json_obj(over: dict | None = None, drop: str | None = None) -> str:
    d = {c: c for c in NUMERIC + CATEGORICAL}
    if drop:
        d.pop(drop)
    d.update(over or {})
    return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in d.items()) + ") AS VARCHAR)"


VALIDATE = {
    "spl": f"SELECT *, CASE WHEN {u_sql('42', 'order_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM feat",
    "allowed": """
  SELECT DISTINCT field, value FROM (
    SELECT 'product_category' AS field, product_category AS value FROM spl WHERE split = 'train'
    UNION ALL SELECT 'seller_state', seller_state FROM spl WHERE split = 'train'
    UNION ALL SELECT 'payment_type', payment_type FROM spl WHERE split = 'train'
    UNION ALL SELECT f, 'missing' FROM (VALUES ('product_category'), ('seller_state'), ('payment_type')) t(f))
  WHERE value IS NOT NULL""",
}


def _row_rules() -> str:
    parts = []
    for c in NUMERIC:
        neg = f" WHEN {c} < 0 THEN '{c}=must be non-negative'" if c in _NONNEG else ""
        parts.append(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '{c}=required field missing'{neg} END")
    for c in CATEGORICAL:
        parts.append(f"CASE WHEN {c} IS NULL THEN '{c}=required field missing' "
                     f"WHEN {c} NOT IN (SELECT value FROM allowed WHERE field = '{c}') "
                     f"THEN '{c}=unknown value: ''' || {c} || '''' END")
    return "nullif(array_to_string(list_sort(list_filter([" + ", ".join(parts) + \
        "], lambda x: x IS NOT NULL)), '; '), '')"


ORACLE["validate_rows"] = with_ctes(_SF, VALIDATE, final=f"""
SELECT order_id, CAST(errs IS NULL AS INT) AS is_valid, errs AS errors
FROM (SELECT order_id, {_row_rules()} AS errs FROM feat)""")

ORACLE["validation_summary"] = with_ctes(_SF, VALIDATE, final=f"""
SELECT split_part(e, '=', 1) AS field, substr(e, strpos(e, '=') + 1) AS message, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(string_split(errs, '; ')) AS e FROM (SELECT {_row_rules()} AS errs FROM feat) WHERE errs IS NOT NULL)
GROUP BY ALL""")


def _json_rules() -> str:
    parts = []
    for c in NUMERIC:
        t = f"json_type(jb, '$.{c}')"
        neg = (f" WHEN CAST(json_extract(jb, '$.{c}') AS DOUBLE) < 0 THEN '{c}=must be non-negative'"
               if c in _NONNEG else "")
        parts.append(f"CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN '{c}=required field missing' "
                     f"WHEN {t} NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN '{c}=must be a number'{neg} END")
    for c in CATEGORICAL:
        t = f"json_type(jb, '$.{c}')"
        v = f"json_extract_string(jb, '$.{c}')"
        parts.append(f"CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN '{c}=required field missing' "
                     f"WHEN {t} <> 'VARCHAR' THEN '{c}=must be a string' "
                     f"WHEN {v} NOT IN (SELECT value FROM allowed WHERE field = '{c}') "
                     f"THEN '{c}=unknown value: ''' || {v} || '''' END")
    return "nullif(array_to_string(list_sort(list_filter([" + ", ".join(parts) + \
        "], lambda x: x IS NOT NULL)), '; '), '')"


_JREC = "CASE k " + " ".join([
    f"WHEN 1 THEN {_json_obj(drop='total_order_value')}",
    f"WHEN 2 THEN {_json_obj({'total_order_value': repr('not a number')})}",
    f"WHEN 3 THEN {_json_obj({'delivery_days': 'true'})}",
    f"WHEN 4 THEN {_json_obj({'avg_product_price': '-1.5'})}",
    f"WHEN 5 THEN {_json_obj({'delivery_vs_estimated': '-5.0'})}",
    f"WHEN 6 THEN {_json_obj({'product_category': '42'})}",
    f"WHEN 7 THEN {_json_obj({'seller_state': repr('ZZ')})}",
    f"WHEN 8 THEN {_json_obj({'payment_type': repr('')})}",
    f"WHEN 9 THEN {_json_obj({'note': repr('x')})}",
    f"WHEN 10 THEN {_json_obj({'min_product_photos_qty': 'NULL'})}",
    f"WHEN 11 THEN '[' || {_json_obj()} || ']'",
    f"WHEN 12 THEN rtrim(CAST({_json_obj()} AS VARCHAR), '}}')",
    f"ELSE {_json_obj()} END"])

ORACLE["validate_json_records"] = with_ctes(_SF, VALIDATE, {
    "jr0": f"SELECT order_id, CAST({_JREC} AS VARCHAR) AS body FROM (SELECT *, order_id % 13 AS k FROM feat)",
    "jr": "SELECT *, CASE WHEN coalesce(json_valid(body), false) THEN body END AS jb FROM jr0",
}, final=f"""
SELECT order_id, CAST(errs IS NULL AS INT) AS is_valid, errs AS errors FROM (
  SELECT order_id,
         CASE WHEN jb IS NULL OR json_type(jb) = 'NULL'
                THEN 'body=request body must be valid json with content-type application/json'
              WHEN json_type(jb) <> 'OBJECT' THEN 'body=request body must be a json object'
              ELSE {_json_rules()} END AS errs
  FROM jr)""")


# --- preprocessing ------------------------------------------------------------

_TRAIN = {"spl": VALIDATE["spl"], "trn": "SELECT * FROM spl WHERE split = 'train'"}

ORACLE["impute_scale"] = with_ctes(_SF, _TRAIN, {
    "med": "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC) + " FROM trn",
    "mom": "SELECT " + ", ".join(
        f"avg(coalesce(t.{c}, m.{c})) AS mu_{c}, stddev_pop(coalesce(t.{c}, m.{c})) AS sd_{c}"
        for c in NUMERIC) + " FROM trn t, med m",
}, final="SELECT s.order_id, " + ", ".join(
    snap(f"(coalesce(s.{c}, m.{c}) - o.mu_{c}) / (CASE WHEN o.sd_{c} IS NULL OR o.sd_{c} = 0 THEN 1.0 ELSE o.sd_{c} END)")
    + f" AS {c}" for c in NUMERIC) + " FROM spl s, med m, mom o")

ORACLE["onehot_missing"] = with_ctes(_SF, _TRAIN, {
    **{f"lv_{c}": f"""
  SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS slot, count(*) OVER () AS size
  FROM (SELECT DISTINCT coalesce({c}, 'missing') AS v FROM trn)""" for c in CATEGORICAL},
}, final="SELECT s.order_id, " + ", ".join(
    f"(SELECT slot FROM lv_{c} WHERE v = coalesce(s.{c}, 'missing')) AS {c}_slot, "
    f"CAST((SELECT max(size) FROM lv_{c}) AS INT) AS {c}_size" for c in CATEGORICAL) + " FROM spl s")


# --- streaming (batch equivalents) ---------------------------------------------

ORACLE["stream_score"] = with_ctes(_SF, CARD, VALIDATE, {
    "j": """
  SELECT e.event_id AS order_id, f.* EXCLUDE (order_id)
  FROM events e LEFT JOIN feat f ON e.event_id = f.order_id""",
}, final=f"""
SELECT order_id, CASE WHEN errs IS NULL THEN 'scored' ELSE 'quarantined' END AS status,
       CASE WHEN errs IS NULL THEN {snap(_proba())} END AS y_proba,
       CASE WHEN errs IS NULL THEN CAST({_logit()} >= 0 AS INT) END AS y_pred,
       errs AS errors
FROM (SELECT *, {_row_rules()} AS errs FROM j)""")

ORACLE["stream_window_stats"] = """
SELECT CAST(ts AS DATE) AS window_day, event_type, CAST(count(*) AS BIGINT) AS n,
       floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean_value, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY ALL"""

ORACLE["stream_drift"] = with_ctes({
    "lref": "SELECT 'value' AS feature, value FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 7 DAYS AND value IS NOT NULL AND NOT isnan(value)",
    "lcur": "SELECT CAST(ts AS DATE) AS month, 'value' AS feature, value FROM events WHERE value IS NOT NULL",
    **{k: v for k, v in DRIFT.items() if k not in ("lref", "lcur")},
}, final=f"""
SELECT month AS window_day, {snap('psi')} AS psi, {_sev('psi')} AS severity FROM psil""")

ORACLE["stream_dedup"] = """
SELECT event_id AS order_id, epoch_us(ts) AS event_us, event_type, value, user_id FROM events"""

ORACLE["stream_label_join"] = with_ctes(_SF, CARD, final=f"""
SELECT e.event_id AS order_id, r.review_id,
       {snap(_proba('f.'))} AS y_proba,
       CAST({_logit('f.')} >= 0 AS INT) AS y_pred,
       r.review_score, CAST(r.review_score >= 4 AS INT) AS y_true,
       CAST((r.review_id * 7) % 120 AS INT) AS lag_hours
FROM events e JOIN feat f ON e.event_id = f.order_id
JOIN rv0 r ON r.order_id = e.event_id
WHERE (r.review_id * 7) % 120 <= 96""")


_LATE = "event_id % 16 = 5 AND ts < (SELECT min(ts) FROM events) + INTERVAL 2 DAYS"

ORACLE["stream_windows_final"] = f"""
SELECT CAST(ts AS DATE) AS window_day, event_type, CAST(count(*) AS BIGINT) AS n,
       floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean_value, min(value) AS min_value, max(value) AS max_value
FROM events WHERE NOT ({_LATE}) GROUP BY ALL"""

ORACLE["stream_late_rows"] = f"""
SELECT CAST(count(*) AS BIGINT) AS n_late, CAST(count(*) AS BIGINT) AS n_missing FROM events WHERE {_LATE}"""

ORACLE["stream_psi_alerts"] = with_ctes({
    "lref": "SELECT event_type AS feature, value FROM events WHERE ts < (SELECT min(ts) FROM events) + INTERVAL 7 DAYS AND value IS NOT NULL AND NOT isnan(value)",
    "lcur": "SELECT CAST(ts AS DATE) AS month, event_type AS feature, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)",
    **{k: v for k, v in DRIFT.items() if k not in ("lref", "lcur")},
    "tot": "SELECT month, feature, count(*) AS n FROM lcur GROUP BY ALL",
    "red": "SELECT *, psi >= 0.2 AS red FROM psil",
    "isl": """
  SELECT *, month - CAST(row_number() OVER (PARTITION BY feature, red ORDER BY month) AS INT) AS island FROM red""",
    "runs": """
  SELECT *, CASE WHEN red THEN row_number() OVER (PARTITION BY feature, red, island ORDER BY month) ELSE 0 END AS red_run
  FROM isl""",
}, final=f"""
SELECT r.month AS window_day, r.feature, CAST(t.n AS BIGINT) AS n, {snap('r.psi')} AS psi, {_sev('r.psi')} AS severity,
       CAST(r.red_run AS INT) AS red_run, CAST(r.red_run >= 2 AS INT) AS retrain
FROM runs r JOIN tot t ON t.month = r.month AND t.feature = r.feature""")

ORACLE["stream_label_left"] = with_ctes(_SF, CARD, final=f"""
SELECT e.event_id AS order_id, r.review_id,
       {snap(_proba('f.'))} AS y_proba,
       CAST({_logit('f.')} >= 0 AS INT) AS y_pred,
       r.review_score, CAST(r.review_score >= 4 AS INT) AS y_true,
       CAST((r.review_id * 7) % 120 AS INT) AS lag_hours
FROM events e JOIN feat f ON e.event_id = f.order_id
LEFT JOIN rv0 r ON r.order_id = e.event_id AND (r.review_id * 7) % 120 <= 96""")

ORACLE["stream_score_model"] = with_ctes(_SF, VALIDATE, {
    "j": """
  SELECT e.event_id AS order_id, f.* EXCLUDE (order_id)
  FROM events e LEFT JOIN feat f ON e.event_id = f.order_id""",
}, final=f"""
SELECT order_id, CASE WHEN errs IS NULL THEN 'scored' ELSE 'quarantined' END AS status,
       CASE WHEN errs IS NULL THEN 1 END AS model_version, CASE WHEN errs IS NULL THEN 1 END AS same_as_batch,
       errs AS errors
FROM (SELECT *, {_row_rules()} AS errs FROM j)""")


# --- shapes and sample alignment -------------------------------------------------

ORACLE["table_shapes"] = with_ctes(_S, {"rvc": "SELECT * FROM rv"}, final="""
SELECT 'orders' AS "table", CAST(count(*) AS BIGINT) AS n_rows, 4 AS n_columns FROM so
UNION ALL SELECT 'order_items', count(*), 6 FROM it
UNION ALL SELECT 'order_payments', count(*), 2 FROM pay
UNION ALL SELECT 'order_reviews', count(*), 3 FROM rv0
UNION ALL SELECT 'review_comments', count(*), 6 FROM rvc
UNION ALL SELECT 'products', count(*), 3 FROM pr
UNION ALL SELECT 'sellers', count(*), 2 FROM se
UNION ALL SELECT 'category_translation', count(*), 2 FROM tr""")

ORACLE["landed_shapes"] = ORACLE["table_shapes"]

ORACLE["csv_landing"] = with_ctes(_S, {
    "line": "SELECT (order_id * 7 + order_item_id) % 101 = 3 AS no_price, (order_id * 7 + order_item_id) % 103 = 5 AS cut FROM it",
}, final="""
SELECT 'order_items' AS "table", CAST(count(*) FILTER (WHERE NOT no_price AND NOT cut) AS BIGINT) AS n_good,
       CAST(count(*) FILTER (WHERE no_price OR cut) AS BIGINT) AS n_bad,
       CAST(0 AS BIGINT) AS n_null_timestamps, CAST(0 AS BIGINT) AS n_files_again FROM line
UNION ALL
SELECT 'orders', count(*), 0, count(*) FILTER (WHERE order_id % 97 = 5 OR order_purchase_timestamp IS NULL), 0 FROM so""")

ORACLE["sketch_quantiles"] = with_ctes(_M, DRIFT, final="""
SELECT l.feature, CAST(e.upto AS INT) AS upto, q.q, CAST(count(*) AS BIGINT) AS n, 1 AS within
FROM lcur l JOIN (SELECT DISTINCT month AS upto FROM lcur WHERE value IS NOT NULL) e ON l.month <= e.upto
CROSS JOIN (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) q(q)
WHERE l.value IS NOT NULL GROUP BY ALL""")

ORACLE["psi_sketch"] = with_ctes(_M, DRIFT, final="SELECT feature, month, 1 AS close FROM psil")

ORACLE["text_sample_features"] = with_ctes(_SF, TEXT, {
    "smp": f"""
  SELECT review_id, order_id, review_score FROM cln
  ORDER BY {md5_sql('42', 'review_id')}, review_id LIMIT 500""",
}, final=f"""
SELECT s.review_id, s.order_id, CAST(s.review_score >= 4 AS INT) AS actual_binary,
       CAST(f.order_id IS NOT NULL AS INT) AS matched,
       f.delivery_days, f.delivery_vs_estimated, f.number_of_items,
       {snap('f.total_order_value')} AS total_order_value, {snap('f.avg_product_price')} AS avg_product_price,
       f.max_product_price, f.min_product_price, {snap('f.total_freight_value')} AS total_freight_value,
       {snap('f.avg_freight_value')} AS avg_freight_value, f.max_freight_value, f.min_product_photos_qty,
       f.product_category, f.seller_state, f.payment_type
FROM smp s LEFT JOIN feat f ON s.order_id = f.order_id""")


ORACLE["sample_feature_rows"] = with_ctes(_SF, TEXT, {
    "smp": f"""
  SELECT review_id, order_id FROM cln
  ORDER BY {md5_sql('42', 'review_id')}, review_id LIMIT 500""",
}, final=f"""
SELECT f.order_id, f.is_positive_review, f.delivery_days, f.delivery_vs_estimated, f.number_of_items,
       {snap('f.total_order_value')} AS total_order_value, {snap('f.avg_product_price')} AS avg_product_price,
       f.max_product_price, f.min_product_price, {snap('f.total_freight_value')} AS total_freight_value,
       {snap('f.avg_freight_value')} AS avg_freight_value, f.max_freight_value, f.min_product_photos_qty,
       f.product_category, f.seller_state, f.payment_type
FROM feat f WHERE f.order_id IN (SELECT order_id FROM smp)""")

ORACLE["comment_share"] = with_ctes(STANDIN, final=f"""
SELECT CAST(count(*) AS BIGINT) AS n_reviews, CAST(count(review_comment_message) AS BIGINT) AS n_comments,
       {snap('count(review_comment_message) / CAST(count(*) AS DOUBLE)')} AS comment_share FROM rv""")


_JREC_NO_MALFORMED = _JREC[:_JREC.index("WHEN 12 THEN")] + _JREC[_JREC.index("ELSE "):]

BATCHES = {
    "jr0": f"SELECT order_id, CAST({_JREC_NO_MALFORMED} AS VARCHAR) AS body FROM (SELECT *, order_id % 13 AS k FROM feat)",
    "jba": "SELECT floor(order_id / 100) AS batch_id, string_agg(body, ',' ORDER BY order_id) AS items FROM jr0 GROUP BY 1",
    "jbb": """
  SELECT batch_id, CASE WHEN batch_id % 10 = 7 THEN '[]' WHEN batch_id % 10 = 8 THEN '{"orders": []}'
                        WHEN batch_id % 10 = 9 THEN '[' || items || ',' || items || ']'
                        ELSE '[' || items || ']' END AS body
  FROM jba""",
    "jbc": "SELECT batch_id, CASE WHEN coalesce(json_valid(body), false) THEN body END AS jv FROM jbb",
    "jbe": """
  SELECT batch_id, jv,
         CASE WHEN jv IS NULL OR json_type(jv) = 'NULL' THEN 'request body must be valid json with content-type application/json'
              WHEN json_type(jv) <> 'ARRAY' THEN 'request body must be a json array of order objects'
              WHEN json_array_length(jv) = 0 THEN 'batch must contain at least one record'
              WHEN json_array_length(jv) > 100 THEN 'batch size ' || json_array_length(jv) || ' exceeds limit of 100'
         END AS body_error
  FROM jbc""",
    "jel": """
  SELECT batch_id, CAST(pos - 1 AS INT) AS pos, jb FROM (
    SELECT batch_id, unnest(json_extract(jv, '$[*]')) AS jb, unnest(range(1, CAST(json_array_length(jv) AS BIGINT) + 1)) AS pos
    FROM jbe WHERE body_error IS NULL)""",
    "jer": f"""
  SELECT batch_id, pos, CASE WHEN json_type(jb) <> 'OBJECT' THEN 'body=must be a json object'
                             ELSE {_json_rules()} END AS errs
  FROM jel""",
}

ORACLE["validate_json_batches"] = with_ctes(_SF, VALIDATE, BATCHES, final="""
SELECT batch_id, pos,
       CASE WHEN bool_or(errs IS NOT NULL) OVER (PARTITION BY batch_id) THEN 'rejected' ELSE 'accepted' END AS status,
       CAST(NULL AS VARCHAR) AS body_error, errs AS errors
FROM jer
UNION ALL
SELECT batch_id, CAST(NULL AS INT), 'rejected', body_error, CAST(NULL AS VARCHAR) FROM jbe WHERE body_error IS NOT NULL""")

ORACLE["quarantine_rows"] = with_ctes(_SF, VALIDATE, BATCHES, final="""
SELECT batch_id, pos, CASE WHEN errs IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
       CAST(NULL AS VARCHAR) AS body_error, errs AS errors
FROM jer
UNION ALL
SELECT batch_id, CAST(NULL AS INT), 'rejected', body_error, CAST(NULL AS VARCHAR) FROM jbe WHERE body_error IS NOT NULL""")

ORACLE["batch_error_report"] = with_ctes(_SF, VALIDATE, BATCHES, final="""
SELECT batch_id, CAST(count(*) AS INT) AS n_records,
       string_agg('record_' || pos || ': ' || errs, ' | ' ORDER BY 'record_' || pos) AS report
FROM jer WHERE errs IS NOT NULL GROUP BY batch_id
UNION ALL
SELECT batch_id, 1, 'body: body=' || body_error FROM jbe WHERE body_error IS NOT NULL""")

_JSON = {**{f: f"CAST(json_extract(l.jb, '$.{f}') AS DOUBLE)" for f in NUMERIC},
         **{f: f"json_extract_string(l.jb, '$.{f}')" for f in CATEGORICAL}}
_JFEAT = "SELECT l.batch_id, l.pos, " + ", ".join(f"{v} AS {f}" for f, v in _JSON.items()) + \
    " FROM jel l JOIN jer r ON r.batch_id = l.batch_id AND r.pos = l.pos WHERE r.errs IS NULL"
ORACLE["batch_responses"] = with_ctes(_SF, CARD, VALIDATE, BATCHES, final=f"""
SELECT batch_id, CAST(count(*) AS INT) AS n,
       string_agg(CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END, ',' ORDER BY pos) AS labels,
       string_agg(printf('%.4f', round_even(p, 4)), ',' ORDER BY pos) AS probabilities
FROM (SELECT batch_id, pos, {_proba()} AS p FROM ({_JFEAT}))
GROUP BY batch_id""")
