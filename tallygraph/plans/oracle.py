"""DuckDB SQL for the queries of this part, over the driver's tables."""

from __future__ import annotations

import numpy as np

from . import weights as V

ORACLE: dict[str, str] = {}

_TX = """tx AS (
  SELECT event_id AS row_id, ts, user_id AS src, k AS dst, (user_id % 10)::VARCHAR AS from_bank, (k % 10)::VARCHAR AS to_bank,
    value AS amt_paid, value * (1 - (event_id % 5) / 100.0::DOUBLE) AS amt_rec, event_type AS fmt, (event_id % 3)::VARCHAR AS cur_paid, (event_id % 4)::VARCHAR AS cur_rec,
    CASE WHEN (event_id * 7919) % 100 < 3 THEN 1 ELSE 0 END AS label, floor(epoch(ts))::BIGINT AS t
  FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k FROM events)),
acct AS (SELECT c_custkey AS acct, c_nationkey AS entity_id, c_mktsegment || ' #' || c_nationkey AS entity_name FROM customer),
ends AS (SELECT src AS acct, label FROM tx UNION ALL SELECT dst, label FROM tx)"""

_OPP = _TX + """,
sg AS (SELECT src, count(DISTINCT dst) AS od, avg(amt_paid) AS m, stddev_samp(amt_paid) AS s FROM tx GROUP BY src),
dg AS (SELECT dst, count(DISTINCT src) AS id, avg(amt_rec) AS m, stddev_samp(amt_rec) AS s, min(t) AS f FROM tx GROUP BY dst),
ent AS (SELECT entity_id, count(DISTINCT acct) AS n FROM acct GROUP BY entity_id),
mut AS (SELECT DISTINCT a.src, a.dst FROM tx a JOIN tx b ON a.src = b.dst AND a.dst = b.src),
raw AS (
  SELECT tx.row_id, tx.label, tx.src,
    CASE WHEN hour(ts) < 8 OR hour(ts) > 18 THEN 1 ELSE 0 END AS off, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS wk, CASE WHEN coalesce(from_bank <> to_bank, true) THEN 1 ELSE 0 END AS xb,
    CASE WHEN sg.s IS NOT NULL THEN greatest((amt_paid - sg.m) / (nullif(sg.s, 0) + 1e-8), 0) END AS zs,
    CASE WHEN dg.s IS NOT NULL THEN greatest((amt_rec - dg.m) / (nullif(dg.s, 0) + 1e-8), 0) END AS zd,
    sg.od, dg.id, coalesce(g2.od, 0) AS od2,
    count(amt_paid) OVER (PARTITION BY tx.src, ts::DATE) AS bs, count(amt_rec) OVER (PARTITION BY tx.dst, ts::DATE) AS bd,
    CASE WHEN sa.entity_id IS NOT DISTINCT FROM da.entity_id THEN 1 ELSE 0 END AS se, coalesce(se.n, 1) AS es, coalesce(de.n, 1) AS ed,
    CASE WHEN tx.src IN (SELECT s_suppkey FROM supplier) THEN 1 ELSE 0 END AS ps, CASE WHEN tx.dst IN (SELECT s_suppkey FROM supplier) THEN 1 ELSE 0 END AS pd,
    CASE WHEN mut.src IS NOT NULL THEN 1 ELSE 0 END AS mu, (t - dg.f) / 86400.0::DOUBLE AS age
  FROM tx LEFT JOIN sg ON tx.src = sg.src LEFT JOIN dg ON tx.dst = dg.dst LEFT JOIN sg g2 ON tx.dst = g2.src
    LEFT JOIN acct sa ON tx.src = sa.acct LEFT JOIN acct da ON tx.dst = da.acct LEFT JOIN ent se ON sa.entity_id = se.entity_id LEFT JOIN ent de ON da.entity_id = de.entity_id
    LEFT JOIN mut ON tx.src = mut.src AND tx.dst = mut.dst),
q AS (SELECT """ + ", ".join(f"CASE WHEN quantile_cont({c}::DOUBLE, 0.95) > 0 THEN quantile_cont({c}::DOUBLE, 0.95) WHEN max({c}) > 0 THEN max({c})::DOUBLE END AS q{k}" for k, c in enumerate(("od", "id", "od2", "bs", "bd", "bs + bd", "es", "ed", "age"))) + """ FROM raw),
nn AS (SELECT raw.*, """ + ", ".join(f"least(greatest(coalesce(({c})::DOUBLE / q{k}, 0), 0), 1) AS n_{n}" for k, (c, n) in enumerate((("od", "od"), ("id", "id"), ("od2", "od2"), ("bs", "bs"), ("bd", "bd"), ("bs + bd", "bb"), ("es", "es"), ("ed", "ed"), ("age", "age")))) + """ FROM raw, q),
opp AS (
  SELECT *, sqrt(n_id * n_od2) AS chain, 0.5 * mu + 0.3 * se + 0.2 * n_bb AS cycle,
    0.3 * zs + 0.2 * n_od + 0.2 * n_bs + 0.1 * off + 0.1 * ps + 0.1 * n_es AS o,
    0.35 * zd + 0.25 * n_id + 0.15 * (1 - n_age) + 0.15 * n_ed + 0.1 * pd AS ta,
    0.3 * off + 0.2 * wk + 0.2 * xb + 0.2 * n_bb + 0.1 * se AS g
  FROM nn),
sc AS (SELECT *, least(greatest(coalesce(pow((o + 1e-8) * (ta + 1e-8) * (g + 1e-8), 1 / 3.0::DOUBLE), 0), 0), 1) AS score FROM opp)"""

_INT = _OPP + """,
th AS (SELECT 'low' AS intensity, 1 AS level, quantile_cont(score, 0.85) AS threshold FROM sc WHERE label = 1 UNION ALL SELECT 'medium', 2, quantile_cont(score, 0.7) FROM sc WHERE label = 1 UNION ALL SELECT 'high', 3, quantile_cont(score, 0.4) FROM sc WHERE label = 1),
lab AS (SELECT sc.*, th.*, CASE WHEN label = 1 AND score >= threshold THEN 1 ELSE 0 END AS inj FROM sc, th)"""

_NODES = _TX + """,
fs AS (SELECT acct, min((side, ts, row_id)) AS f FROM (SELECT src AS acct, 0 AS side, ts, row_id FROM tx UNION ALL SELECT dst, 1, ts, row_id FROM tx) GROUP BY acct),
ids AS (SELECT acct, row_number() OVER (ORDER BY f) - 1 AS node_id FROM fs)"""

_ADJ = _TX + """,
adj AS (SELECT src AS node, dst AS nbr, row_id AS edge_id, t FROM tx UNION ALL SELECT dst, src, row_id, t FROM tx)"""

_CHRONO = _TX + """,
pos AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS position, count(*) OVER () AS n FROM tx),
spl AS (SELECT *, CASE WHEN position < floor(n * 0.6::DOUBLE) THEN 'train' WHEN position < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos)"""

_QUANT = _TX + """,
qq AS (SELECT quantile_cont(t::DOUBLE, 0.70) AS a, quantile_cont(t::DOUBLE, 0.85) AS b FROM tx),
spl AS (SELECT tx.*, CASE WHEN t <= a THEN 'train' WHEN t <= b THEN 'val' ELSE 'test' END AS split FROM tx, qq)"""

_DRAW = "((row_id * 7919 + 42 * 104729 + ((row_id * 31 + 42) % 997) * 1009) % 1000003)"

_PRED = """pred AS (SELECT event_id AS edge_id, least(greatest(((event_id * 104729) % 1000) / 999.0::DOUBLE, 0), 1) AS score, CASE WHEN (event_id * 7919) % 100 < 3 THEN 1 ELSE 0 END AS label FROM events),
bys AS (
  SELECT *, coalesce(sum(n) OVER w, 0) AS bn, coalesce(sum(p) OVER w, 0) AS bp, sum(n) OVER () AS an, sum(p) OVER () AS ap
  FROM (SELECT score, count(*) AS n, sum(label) AS p FROM pred GROUP BY score) WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_STRAIN = _TX + """,
al AS (SELECT DISTINCT acct FROM ends),
og AS (SELECT src AS acct, sum(amt_paid) AS tot_out, count(*) AS od, avg(amt_paid) + 2 * stddev_pop(amt_paid) AS lim FROM tx GROUP BY src),
ig AS (SELECT dst AS acct, sum(amt_rec) AS tot_in, count(*) AS id, stddev_samp(amt_rec) AS vol FROM tx GROUP BY dst),
days AS (SELECT greatest(floor((max(t) - min(t)) / 86400), 1) AS d FROM tx),
a0 AS (
  SELECT al.acct, coalesce(tot_out, 0) AS tot_out, coalesce(tot_in, 0) AS tot_in, coalesce(od, 0) AS od, coalesce(id, 0) AS id, coalesce(vol, 0) AS vol, coalesce(tot_in, 0) - coalesce(tot_out, 0) AS nf, d
  FROM al LEFT JOIN og USING (acct) LEFT JOIN ig USING (acct), days),
a1 AS (SELECT *, greatest(-nf * least(90.0::DOUBLE / d, 1), 0) AS deficit, tot_out / (tot_in + 1e-6) AS ratio FROM a0),
a2 AS (SELECT max(od + id) AS md, max(deficit) AS mdef, quantile_cont(greatest(ratio, 0), 0.99) AS qr, quantile_cont(vol, 0.99) AS qv FROM a1),
a3 AS (SELECT a1.*, (od + id) / greatest(md, 1)::DOUBLE AS central, (deficit / (mdef + 1e-6) + greatest(ratio, 0) / (qr + 1e-6) + vol / (qv + 1e-6)) / 3.0::DOUBLE AS chronic FROM a1, a2)"""

_GAPS = _TX + """,
gp AS (SELECT *, t - lag(t) OVER (PARTITION BY src ORDER BY ts, row_id) AS gs, t - lag(t) OVER (PARTITION BY dst ORDER BY ts, row_id) AS gd FROM tx)"""


def _add(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes}\n{select}"


_add("guardian_ranking", _OPP, "SELECT src, round(avg(g), 6) AS weakness, round(avg(n_bs), 6) AS burst, count(*) AS n FROM sc GROUP BY src ORDER BY weakness DESC, src LIMIT 20")
_DEG = """SELECT acct, coalesce(out_count, 0) AS out_count, coalesce(out_degree, 0) AS out_degree, coalesce(in_count, 0) AS in_count, coalesce(in_degree, 0) AS in_degree
FROM (SELECT src AS acct, count(*) AS out_count, count(DISTINCT dst) AS out_degree FROM {t} GROUP BY src) FULL JOIN (SELECT dst AS acct, count(*) AS in_count, count(DISTINCT src) AS in_degree FROM {t} GROUP BY dst) USING (acct)"""
_add("acct_degree_stats", _TX, _DEG.format(t="tx"))
_add("order_degree_stats", "ot AS (SELECT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", _DEG.format(t="ot"))
_add("acct_amount_stats", _TX, "SELECT acct, round(pm, 6) AS paid_mean, round(ps, 6) AS paid_std, round(pq, 6) AS paid_p95, round(rm, 6) AS rec_mean, round(rs, 6) AS rec_std FROM (SELECT src AS acct, avg(amt_paid) AS pm, stddev_samp(amt_paid) AS ps, quantile_cont(amt_paid, 0.95) AS pq FROM tx GROUP BY src) FULL JOIN (SELECT dst AS acct, avg(amt_rec) AS rm, stddev_samp(amt_rec) AS rs FROM tx GROUP BY dst) USING (acct)")
_add("acct_first_seen_age", _TX, "SELECT row_id, t - min(t) OVER (PARTITION BY src) AS src_age_seconds, t - min(t) OVER (PARTITION BY dst) AS dst_age_seconds FROM tx")
_add("acct_day_burst", _TX, "SELECT row_id, count(amt_paid) OVER (PARTITION BY src, ts::DATE) AS src_day_count, count(amt_rec) OVER (PARTITION BY dst, ts::DATE) AS dst_day_count FROM tx")
_add("time_flags", _TX, "SELECT row_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday, CASE WHEN hour(ts) < 8 OR hour(ts) > 18 THEN 1 ELSE 0 END AS off_hours, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM tx")
_add("bank_currency_flags", _TX, "SELECT row_id, (coalesce(from_bank <> to_bank, true))::BIGINT AS cross_bank, (from_bank IS NOT DISTINCT FROM to_bank)::BIGINT AS same_bank, (cur_rec IS NOT DISTINCT FROM cur_paid)::BIGINT AS same_currency FROM tx")
_add("mutual_flow_pairs", _TX, "SELECT DISTINCT a.src, a.dst FROM tx a JOIN tx b ON a.src = b.dst AND a.dst = b.src")
_add("mutual_flow_flag", _OPP, 'SELECT row_id, mu::BIGINT AS "RAT_mutual_flag" FROM raw')
_add("amount_zscore_pos", _OPP, 'SELECT row_id, round(zs, 6) AS "RAT_src_amount_z_pos", round(zd, 6) AS "RAT_dst_amount_z_pos" FROM raw')
_add("quantile_normalised_structure", _OPP, 'SELECT row_id, round(n_od, 6) AS "RAT_src_out_deg_norm", round(n_id, 6) AS "RAT_dst_in_deg_norm", round(n_bs, 6) AS "RAT_src_burst_norm", round(n_bd, 6) AS "RAT_dst_burst_norm", round(n_bb, 6) AS "RAT_combined_burst" FROM nn')
_add("entity_features", _OPP, 'SELECT row_id, se::BIGINT AS "RAT_same_entity", es AS "RAT_src_entity_accounts", ed AS "RAT_dst_entity_accounts", round(n_es, 6) AS "RAT_src_entity_acct_norm", round(n_ed, 6) AS "RAT_dst_entity_acct_norm" FROM nn')
_add("pattern_flags", _OPP, 'SELECT row_id, ps::BIGINT AS "RAT_src_pattern_flag", pd::BIGINT AS "RAT_dst_pattern_flag" FROM raw')
_add("motif_scores", _OPP, "SELECT row_id, round(n_id, 6) AS motif_fanin, round(n_od, 6) AS motif_fanout, round(chain, 6) AS motif_chain, round(cycle::DOUBLE, 6) AS motif_cycle FROM opp")
_add("opportunity_subscores", _OPP, 'SELECT row_id, round(o, 6) AS "RAT_offender_score", round(ta, 6) AS "RAT_target_score", round(g::DOUBLE, 6) AS "RAT_guardian_weakness_score" FROM opp')
_add("opportunity_score", _OPP, 'SELECT row_id, label::BIGINT AS label, round(score, 6) AS "RAT_score" FROM sc')
_add("intensity_thresholds", _INT, "SELECT intensity, level::BIGINT AS level, round(threshold, 6) AS threshold FROM th")
_add("intensity_labels", _INT, "SELECT intensity, sum(inj)::BIGINT AS injected, max(inj * level)::BIGINT AS level, count(*) AS n FROM lab GROUP BY intensity")
_add("intensity_drift", _INT, 'SELECT intensity, count(*) AS n, round(avg(score), 6) AS "mean_RAT_score", round(avg(chain), 6) AS mean_motif_chain, round(stddev_samp(score), 6) AS "std_RAT_score", round(stddev_samp(chain), 6) AS std_motif_chain FROM lab WHERE inj = 1 GROUP BY intensity')
_TYPES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_ET = _TX + ", et AS (SELECT e.acct, coalesce(trim(split_part(entity_name, '#', 1)), 'Unknown') AS entity_type FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN acct a ON e.acct = a.acct)"
_HOT = ", ".join(f"(entity_type = '{v}')::BIGINT AS \"ent_{v}\"" for v in _TYPES)
_add("entity_type_onehot", _ET, f"SELECT acct, entity_type, {_HOT} FROM et")
_add("node_ids_first_seen", _NODES, "SELECT acct, node_id FROM ids")
_add("event_type_ids", _TX, "SELECT fmt, row_number() OVER (ORDER BY f) - 1 AS event_type FROM (SELECT fmt, min((ts, row_id)) AS f FROM tx GROUP BY fmt)")
_add("category_codes", _TX, "SELECT fmt, row_number() OVER (ORDER BY fmt) - 1 AS code FROM (SELECT DISTINCT fmt FROM tx)")
_add("time_since_last_src_dst", _GAPS, "SELECT row_id, coalesce(gs, 0) AS gap_src, coalesce(gd, 0) AS gap_dst FROM gp")
_FEAT = """round(ln(1 + greatest(amt_rec, 0)), 6) AS log_amt_rec, round(ln(1 + greatest(amt_paid, 0)), 6) AS log_amt_paid, (from_bank IS NOT DISTINCT FROM to_bank)::BIGINT AS same_bank, (cur_rec IS NOT DISTINCT FROM cur_paid)::BIGINT AS same_currency,
hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, (isodow(ts) >= 6)::BIGINT AS is_weekend, round((t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER () + 1e-10::DOUBLE), 6) AS ts_normalized,
round(ln(1 + greatest(coalesce(gs, 0), 0)), 6) AS log_time_since_src, round(ln(1 + greatest(coalesce(gd, 0), 0)), 6) AS log_time_since_dst"""
_FMT = ", ".join(f"(fmt = '{v}')::BIGINT AS pf_{v}" for v in ("click", "login", "purchase", "view"))
_CUR = ", ".join(f"(cur_rec = '{v}')::BIGINT AS rc_{v}" for v in range(4))
_add("edge_features_baseline", _GAPS, f"SELECT row_id, {_FEAT}, {_FMT}, {_CUR} FROM gp")
_add("edge_features_coded", _TX, "SELECT row_id, round(ln(1 + greatest(amt_paid, 0)), 6) AS log_amt_paid, dense_rank() OVER (ORDER BY fmt) - 1 AS fmt_code, dense_rank() OVER (ORDER BY cur_rec) - 1 AS cur_code FROM tx")
_z = lambda c: f"least(greatest(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-6), -10), 10)"
_EDGE = "SELECT row_id AS edge_id, a.node_id AS src, b.node_id AS dst, t AS ts, label::BIGINT AS label, round(ln(1 + greatest(amt_paid, 0)), 6) AS log_amt_paid{more} FROM tx JOIN ids a ON tx.src = a.acct JOIN ids b ON tx.dst = b.acct"
_add("static_edge_table", _NODES, _EDGE.format(more=""))
_add("event_stream_table", _NODES + ", et AS (SELECT fmt, row_number() OVER (ORDER BY f) - 1 AS event_type FROM (SELECT fmt, min((ts, row_id)) AS f FROM tx GROUP BY fmt))", _EDGE.format(more=", event_type") + " JOIN et USING (fmt)")
_add("node_features_degree_entity", _ET + ", lab AS (SELECT acct, max(label) AS y FROM ends GROUP BY acct), o AS (SELECT src AS acct, count(*) AS c FROM tx GROUP BY src), i AS (SELECT dst AS acct, count(*) AS c FROM tx GROUP BY dst), x AS (SELECT et.*, y, coalesce(o.c, 0) AS od, coalesce(i.c, 0) AS id FROM et JOIN lab USING (acct) LEFT JOIN o USING (acct) LEFT JOIN i USING (acct))",
     f"SELECT acct, od AS out_degree, id AS in_degree, od + id AS total_degree, round(ln(1 + od), 6) AS log_out_degree, round(ln(1 + id), 6) AS log_in_degree, round(ln(1 + od + id), 6) AS log_total_degree, y::BIGINT AS y_node, {_HOT} FROM x")
_add("node_laundering_count", _TX, "SELECT acct, max(label)::BIGINT AS y_node, sum(label)::BIGINT AS laundering_count FROM ends GROUP BY acct")
_add("mode_payment_format", _TX, "SELECT e.acct, coalesce(name, 'Unknown') AS name FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN (SELECT src AS acct, fmt AS name FROM (SELECT src, fmt, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, fmt) AS r FROM tx GROUP BY src, fmt) WHERE r = 1) m ON e.acct = m.acct")
_add("graph_stats", _TX, "SELECT num_nodes, (SELECT count(*) FROM (SELECT DISTINCT acct FROM acct) a WHERE a.acct NOT IN (SELECT acct FROM ends)) AS isolated, num_edges, self_loops, laundering_edges, laundering_nodes, round(num_edges / num_nodes::DOUBLE, 6) AS avg_degree, round(num_edges / (num_nodes * (num_nodes - 1))::DOUBLE, 6) AS density, round(100.0::DOUBLE * laundering_edges / num_edges, 6) AS pct_laundering FROM (SELECT count(*) AS num_edges, count(*) FILTER (src = dst) AS self_loops, sum(label)::BIGINT AS laundering_edges FROM tx), (SELECT count(*) AS num_nodes, sum(y)::BIGINT AS laundering_nodes FROM (SELECT acct, max(label) AS y FROM ends GROUP BY acct))")
_add("temporal_stats", _TX, "SELECT min(t) AS ts_min, max(t) AS ts_max, round((max(t) - min(t)) / 86400.0::DOUBLE, 6) AS span_days, min(gap) AS min_gap, max(gap) AS max_gap, round(avg(gap), 6) AS mean_gap, count(*) FILTER (gap < 0) AS violations, count(DISTINCT t) AS distinct_ts, round(1 - count(DISTINCT t) / count(t)::DOUBLE, 6) AS duplicate_ratio FROM (SELECT t, t - lag(t) OVER (ORDER BY row_id) AS gap FROM tx)")
_add("feature_stats", _TX + ", f AS (SELECT unnest(['amt_paid', 'amt_rec', 'log_amt_paid']) AS feature, unnest([amt_paid, amt_rec, ln(1 + greatest(amt_paid, 0))]) AS v FROM tx)", "SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) FILTER (v IS NULL OR isnan(v)) AS n_bad FROM f GROUP BY feature")
_add("dataset_summary", _TX, "SELECT (SELECT count(*) FROM tx) AS transfers, (SELECT round(100 * avg(label), 6) FROM tx) AS pct_label, (SELECT count(DISTINCT b) FROM (SELECT from_bank AS b FROM tx UNION ALL SELECT to_bank FROM tx)) AS banks, (SELECT count(DISTINCT acct) FROM ends) AS accounts")
_add("split_chronological", _CHRONO, "SELECT row_id, position, split FROM spl")
_add("split_stratified", _TX + f", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, row_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM tx)", "SELECT row_id, label::BIGINT AS label, CASE WHEN p < floor(n * 0.6::DOUBLE) THEN 'train' WHEN p < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM o")
_add("split_time_quantile", _QUANT, "SELECT row_id, split FROM spl")
_add("split_node_masks", _QUANT, "SELECT acct, max((split = 'train')::BIGINT) AS in_train, max((split = 'val')::BIGINT) AS in_val, max((split = 'test')::BIGINT) AS in_test FROM (SELECT src AS acct, split FROM spl UNION ALL SELECT dst, split FROM spl) GROUP BY acct")
_add("split_check", _CHRONO + ", g AS (SELECT split, count(*) AS n, min(t) AS ts_min, max(t) AS ts_max, sum(label)::BIGINT AS positives, round(100 * avg(label), 6) AS pct_positive FROM spl GROUP BY split)", "SELECT *, coalesce(ts_min < lag(ts_max) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END), false) AS overlaps FROM g")
_add("label_drift_windows", _CHRONO, 'SELECT (position // (n // 10))::BIGINT AS "window", count(*) AS n, round(avg(label), 6) AS rate FROM spl WHERE position // (n // 10) < 10 GROUP BY 1')
_add("sequential_batches", _CHRONO, "SELECT position // 200 AS batch, count(*) AS n, min(row_id) AS first_id FROM spl GROUP BY 1")
_add("uniform_sample", _TX, f"SELECT row_id, label::BIGINT AS label FROM tx ORDER BY {_DRAW}, row_id LIMIT 100")
_add("balanced_sample", _TX, f"SELECT row_id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, row_id) AS r FROM tx) WHERE r <= 10")
_THEORY = {
    "RAT_is_off_hours": "off::BIGINT", "RAT_is_weekend": "wk::BIGINT", "RAT_is_cross_bank": "xb::BIGINT", "RAT_src_amount_z_pos": "round(zs, 6)", "RAT_dst_amount_z_pos": "round(zd, 6)",
    "RAT_src_out_deg_norm": "round(n_od, 6)", "RAT_dst_in_deg_norm": "round(n_id, 6)", "RAT_src_burst_norm": "round(n_bs, 6)", "RAT_dst_burst_norm": "round(n_bd, 6)", "RAT_combined_burst": "round(n_bb, 6)",
    "RAT_same_entity": "se::BIGINT", "RAT_src_entity_accounts": "es", "RAT_dst_entity_accounts": "ed", "RAT_src_entity_acct_norm": "round(n_es, 6)", "RAT_dst_entity_acct_norm": "round(n_ed, 6)",
    "RAT_src_pattern_flag": "ps::BIGINT", "RAT_dst_pattern_flag": "pd::BIGINT", "RAT_mutual_flag": "mu::BIGINT",
    "motif_fanin": "round(n_id, 6)", "motif_fanout": "round(n_od, 6)", "motif_chain": "round(chain, 6)", "motif_cycle": "round(cycle::DOUBLE, 6)",
    "RAT_offender_score": "round(o, 6)", "RAT_target_score": "round(ta, 6)", "RAT_guardian_weakness_score": "round(g::DOUBLE, 6)", "RAT_score": "round(score, 6)",
}
_FORMATS = ("ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Reinvestment", "Wire")
_CURRENCIES = ("Australian Dollar", "Bitcoin", "Brazil Real", "Canadian Dollar", "Euro", "Mexican Peso", "Ruble", "Rupee", "Saudi Riyal", "Shekel", "Swiss Franc", "UK Pound", "US Dollar", "Yen", "Yuan")
_FULL = _OPP + _GAPS[len(_TX) :] + f""",
ef AS (SELECT row_id, {_FEAT}, {", ".join(f"(fmt = '{v}')::BIGINT AS \"pf_{v}\"" for v in _FORMATS)}, {", ".join(f"(cur_rec = '{v}')::BIGINT AS \"rc_{v}\"" for v in _CURRENCIES)} FROM gp),
rt AS (SELECT row_id, {", ".join(f'{x} AS "{k}"' for k, x in _THEORY.items())} FROM sc),
full_f AS (SELECT * FROM ef JOIN rt USING (row_id))"""
_STD = ", ".join(f'round(coalesce({_z(x.removeprefix("round(").removesuffix(", 6)"))}, 0), 6) AS "{k}"' for k, x in _THEORY.items())
_add("edge_features_standardised", _OPP, f"SELECT row_id, {_STD} FROM sc")
_GRAPH = _OPP + _GAPS[len(_TX) :] + _NODES[len(_TX) :] + f""",
zs AS (SELECT row_id, {_STD} FROM sc), ef AS (SELECT row_id, {_FEAT}, {_FMT}, {_CUR} FROM gp),
et AS (SELECT fmt, row_number() OVER (ORDER BY f) - 1 AS event_type FROM (SELECT fmt, min((ts, row_id)) AS f FROM tx GROUP BY fmt))"""
_ALL = "SELECT row_id AS edge_id, a.node_id AS src, b.node_id AS dst, t AS ts, label::BIGINT AS label, ef.* EXCLUDE (row_id), zs.* EXCLUDE (row_id){more} FROM tx JOIN ids a ON tx.src = a.acct JOIN ids b ON tx.dst = b.acct JOIN ef USING (row_id) JOIN zs USING (row_id)"
_add("static_edge_table_theory", _GRAPH, _ALL.format(more=""))
_add("event_stream_table_theory", _GRAPH, _ALL.format(more=", event_type") + " JOIN et USING (fmt)")
_add("degree_histogram", _TX + ", dg AS (SELECT e.acct, count(src) AS d FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN tx ON e.acct = tx.src GROUP BY e.acct), hs AS (SELECT d, min(d) OVER () AS lo, max(d) OVER () AS hi, (max(d) OVER () - min(d) OVER ()) / 50.0::DOUBLE AS w FROM dg)",
     'SELECT b::BIGINT AS "bin", round(lo + b * w, 6) AS low, count(*) AS n FROM (SELECT *, CASE WHEN hi = lo THEN 0 ELSE least(floor((d - lo) / w), 49) END AS b FROM hs) GROUP BY b, lo, w')
_add("amounts_describe", _TX + ", f AS (SELECT unnest(['amt_paid', 'amt_rec']) AS \"column\", unnest([amt_paid, amt_rec]) AS v FROM tx)",
     'SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max FROM f GROUP BY 1')
_add("format_frequencies", _TX, "SELECT fmt AS value, count(*) AS n FROM tx GROUP BY 1")
_add("temporal_neighbors_uniform", _ADJ + """,
pr AS (SELECT DISTINCT src AS node, t FROM tx),
ev AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t, edge_id, nbr) AS pos FROM adj),
cn AS (SELECT pr.node, pr.t, count(*) AS n FROM pr JOIN adj ON pr.node = adj.node AND adj.t < pr.t GROUP BY 1, 2),
dr AS (SELECT node, t, draw, (node * 7919 + t * 31 + draw * 104729) % n + 1 AS pos FROM cn, (VALUES (1), (2), (3)) v(draw))""",
     "SELECT dr.node, dr.t, row_number() OVER (PARTITION BY dr.node, dr.t ORDER BY pos, draw) AS rank, nbr, edge_id, ev.t AS nbr_t FROM dr JOIN ev USING (node, pos)")
_add("unseen_node_sample", _TX + ", an AS (SELECT DISTINCT acct FROM (SELECT src AS acct, t FROM tx UNION ALL SELECT dst, t FROM tx) WHERE t > (SELECT avg(t) FROM tx))",
     "SELECT acct FROM (SELECT acct, row_number() OVER (ORDER BY (acct * 7919 + ((acct * 31) % 997) * 1009) % 1000003, acct) AS r FROM an) WHERE r <= floor(0.1::DOUBLE * (SELECT count(DISTINCT acct) FROM ends))")
_LEFT_OUT = {
    "no_struct": "RAT_src_out_deg_norm RAT_dst_in_deg_norm",
    "no_temp": "hour_of_day day_of_week is_weekend ts_normalized log_time_since_src log_time_since_dst RAT_is_off_hours RAT_is_weekend",
    "no_amount": "log_amt_rec log_amt_paid RAT_src_amount_z_pos RAT_dst_amount_z_pos",
    "no_burst_pattern": "RAT_src_burst_norm RAT_dst_burst_norm RAT_combined_burst RAT_src_pattern_flag RAT_dst_pattern_flag RAT_mutual_flag",
    "no_entity": "RAT_same_entity RAT_src_entity_accounts RAT_dst_entity_accounts RAT_src_entity_acct_norm RAT_dst_entity_acct_norm",
    "no_rat_scores": "RAT_offender_score RAT_target_score RAT_guardian_weakness_score RAT_score",
    "no_motif": "motif_fanin motif_fanout motif_chain motif_cycle",
    "no_crossbank": "RAT_is_cross_bank",
}
for _group, _gone in _LEFT_OUT.items():
    _add(f"ablation_{_group}", _FULL, f"SELECT * EXCLUDE ({', '.join(_gone.split())}) FROM full_f")
_add("ablation_top20", _FULL, """SELECT row_id, "pf_ACH", "pf_Cheque", log_amt_paid, log_amt_rec, "pf_Credit Card", motif_cycle, "RAT_combined_burst", ts_normalized, "RAT_src_burst_norm", "RAT_dst_in_deg_norm", "RAT_target_score", motif_fanout, motif_fanin, "RAT_dst_burst_norm",
"RAT_src_out_deg_norm", "RAT_score", motif_chain, "RAT_offender_score", "RAT_dst_entity_acct_norm", "RAT_guardian_weakness_score" FROM full_f""")
_add("strain_account", _STRAIN, """SELECT acct, round(tot_out, 4) AS "TotalOut", round(tot_in, 4) AS "TotalIn", od AS "OutDegree", id AS "InDegree", round(nf * least(7.0::DOUBLE / d, 1), 4) AS "NetFlow_7d", round(nf * least(30.0::DOUBLE / d, 1), 4) AS "NetFlow_30d", round(nf * least(90.0::DOUBLE / d, 1), 4) AS "NetFlow_90d", round(ratio, 4) AS "OutInRatio_30d", round(vol, 6) AS "IncomingVolatility_30d", round(central, 6) AS "NetworkCentrality", round(chronic, 6) AS "ChronicStrainScore" FROM a3""")
_add("strain_liquidity_shocks", _STRAIN, 'SELECT src AS acct, count(*) FILTER (amt_paid > lim) AS "LiquidityShockCount_30d" FROM tx JOIN og ON tx.src = og.acct GROUP BY src')
_CONC = "(SELECT src AS acct, CASE WHEN sum(s) > 0 THEN max(s) / sum(s) ELSE 0 END AS {n} FROM (SELECT src, sum(amt_paid) AS s FROM tx GROUP BY src, {k}) GROUP BY src)"
_add("strain_concentration", _STRAIN, f'SELECT al.acct, round(coalesce(a, 0), 6) AS "TopPartnerConcentration", round(coalesce(b, 0), 6) AS "BankDependenceScore" FROM al LEFT JOIN {_CONC.format(n="a", k="dst")} x ON al.acct = x.acct LEFT JOIN {_CONC.format(n="b", k="to_bank")} y ON al.acct = y.acct')
_add("strain_exposure", _STRAIN + ", nb AS (SELECT src AS acct, dst AS nbr FROM tx UNION ALL SELECT dst, src FROM tx)", 'SELECT nb.acct, round(avg(chronic), 6) AS "NetworkStrainExposure" FROM nb JOIN a3 ON nb.nbr = a3.acct GROUP BY nb.acct')
_add("strain_transaction", _GAPS + """,
st AS (SELECT src, avg(amt_paid) AS m, coalesce(stddev_samp(amt_paid), 0) AS s, quantile_cont(amt_paid, 0.95) AS p95 FROM tx GROUP BY src),
md AS (SELECT median(gs / 3600.0::DOUBLE) AS md FROM gp),
y AS (SELECT row_id, coalesce((amt_paid - m) / nullif(s, 0), 0) AS dev, 1 / (1 + greatest(coalesce(gs / 3600.0::DOUBLE, md, 24), 0)) AS tg, (amt_paid >= p95)::BIGINT AS big, 0.4::DOUBLE AS pt FROM gp JOIN st USING (src), md)""",
     'SELECT row_id, round(dev, 6) AS "OutgoingDeviation", round(tg, 6) AS "TimeGapStrain", big AS "LargeOutflowFlag", pt AS "PaymentTypeStrain", round(least(greatest((tanh(abs(dev) / 3.0::DOUBLE) + least(tg, 1) + pt + 0.5::DOUBLE * big) / 3.5::DOUBLE, 0), 1), 6) AS "SituationalStrainScore" FROM y')
_add("strain_accounts_joined", _STRAIN, 'SELECT acct.acct, entity_id::BIGINT AS entity_id, entity_name, coalesce(od, 0) AS "OutDegree", round(coalesce(central, 0), 6) AS "NetworkCentrality" FROM acct LEFT JOIN a3 ON acct.acct = a3.acct')
_NB = _ADJ + """,
pr AS (SELECT DISTINCT src AS node, t FROM tx WHERE row_id % 50 = 0),
nb AS (SELECT pr.node, pr.t, nbr, edge_id, adj.t AS nbr_t, row_number() OVER (PARTITION BY pr.node, pr.t ORDER BY adj.t DESC, edge_id DESC, nbr DESC) AS rank FROM pr JOIN adj ON pr.node = adj.node AND adj.t < pr.t)"""
_add("temporal_neighbors_k", _NB, "SELECT node, t, rank, nbr, edge_id, nbr_t FROM nb WHERE rank <= 3")
_PAD = "array_to_string(list_concat(list_resize([]::BIGINT[], 4 - coalesce(len(l), 0), 0), coalesce(l, []::BIGINT[])), ',')"
_add("temporal_neighbors_padded", _NB + ", ls AS (SELECT node, t, list(edge_id ORDER BY rank DESC) AS e, list(nbr ORDER BY rank DESC) AS b FROM nb WHERE rank <= 4 GROUP BY node, t)", f"SELECT pr.node, pr.t, {_PAD.replace('l)', 'e)').replace('(l,', '(e,')} AS edges, {_PAD.replace('l)', 'b)').replace('(l,', '(b,')} AS nbrs FROM pr LEFT JOIN ls ON pr.node = ls.node AND pr.t = ls.t")
_add("interevent_stats", _TX, "SELECT round(avg(s), 2) AS mean_src, round(stddev_pop(s), 2) AS std_src, round(avg(d), 2) AS mean_dst, round(stddev_pop(d), 2) AS std_dst FROM (SELECT t - coalesce(lag(t) OVER (PARTITION BY src ORDER BY ts, row_id), 0) AS s, t - coalesce(lag(t) OVER (PARTITION BY dst ORDER BY ts, row_id), 0) AS d FROM tx)")
_add("inductive_new_node_edges", _TX + ", seen AS (SELECT src AS n FROM tx WHERE row_id % 97 = 0 UNION SELECT dst FROM tx WHERE row_id % 97 = 0)", "SELECT row_id, 'val' AS split, (src NOT IN (SELECT n FROM seen) OR dst NOT IN (SELECT n FROM seen))::BIGINT AS touches_new FROM tx WHERE row_id % 97 <> 0")
_add("negative_samples", _TX + ", ds AS (SELECT dst AS acct, row_number() OVER (ORDER BY dst) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM tx))", "SELECT row_id, acct AS neg_dst FROM tx JOIN ds ON idx = (row_id * 48271 + 7 * 7919) % n")
_sig = lambda x: f"(1 / (1 + exp(-({x}))))"
_MSG = _TX + ", ms AS (SELECT src AS node, row_id AS seq, t, amt_paid AS m0, amt_rec AS m1, hour(ts) / 24.0::DOUBLE AS m2 FROM tx UNION ALL SELECT dst, row_id, t, amt_paid, amt_rec, hour(ts) / 24.0::DOUBLE FROM tx)"
_add("message_last", _MSG, "SELECT node, t, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2 FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t DESC, seq DESC) AS r FROM ms) WHERE r = 1")
_add("message_mean", _MSG, "SELECT node, max(t) AS t, round(avg(m0), 6) AS m0, round(avg(m1), 6) AS m1, round(avg(m2), 6) AS m2 FROM ms GROUP BY node")
_add("time_encoding_sinusoidal", _TX + ", h AS (SELECT row_id, (t % 86400) / 3600.0::DOUBLE AS x FROM tx)", "SELECT row_id, round(sin(x), 6) AS e0, round(sin(x * 0.01::DOUBLE), 6) AS e1, round(cos(x), 6) AS e2, round(cos(x * 0.01::DOUBLE), 6) AS e3 FROM h")
_add("neighbor_mean_aggregate", _TX + ", oc AS (SELECT e.acct, count(src) AS x FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN tx ON e.acct = tx.src GROUP BY e.acct)", "SELECT oc.acct AS node_id, round(coalesce(m, 0), 6) AS mean_x FROM oc LEFT JOIN (SELECT dst, avg(x) AS m FROM tx JOIN oc ON tx.src = oc.acct GROUP BY dst) a ON oc.acct = a.dst")
_CM = _PRED + ", cm AS (SELECT count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score >= 0.5 AND label = 1) AS tp FROM pred)"
_add("metric_confusion", _CM, "SELECT tn, fp, fn, tp FROM cm")
_add("metric_threshold", _CM + ", c AS (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp, (tn + fp + fn + tp)::DOUBLE AS n FROM cm)", "SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) AS kappa FROM c")
_add("metric_best_threshold", _PRED + ", gr AS (SELECT i, 0.01::DOUBLE + i * (0.98::DOUBLE / 199) AS t FROM range(200) r(i)), fs AS (SELECT i, t, coalesce(2.0::DOUBLE * sum(label) FILTER (score >= t) / nullif(count(*) FILTER (score >= t) + sum(label), 0), 0) AS f FROM gr, pred GROUP BY i, t)", "SELECT round(t, 6) AS threshold, round(f, 6) AS f1 FROM fs ORDER BY f DESC, i LIMIT 1")
_add("metric_ranking", _PRED, "SELECT round((sum(p * (bn + (n + 1) / 2.0::DOUBLE)) - max(ap) * (max(ap) + 1) / 2.0::DOUBLE) / (max(ap) * (max(an) - max(ap))), 6) AS roc_auc, round(sum((p / ap::DOUBLE) * (ap - bp) / (an - bn)), 6) AS average_precision FROM bys")
_add("metric_precision_at_k", _PRED + ", rk AS (SELECT label, row_number() OVER (ORDER BY score DESC, edge_id) AS r, count(*) OVER () AS n FROM pred)", "SELECT k, round(avg(label), 6) AS precision FROM rk, (VALUES (10), (100), (500)) v(k) WHERE r <= k AND k <= n GROUP BY k")
_add("metric_curves", _PRED, "SELECT round(score, 6) AS score, round((ap - bp) / ap::DOUBLE, 6) AS tpr, round((an - bn - (ap - bp)) / (an - ap)::DOUBLE, 6) AS fpr, round((ap - bp) / (an - bn)::DOUBLE, 6) AS precision, round((ap - bp) / ap::DOUBLE, 6) AS recall FROM bys")
_add("metric_batches", _PRED + """,
c AS (SELECT edge_id % 5 AS b, score, count(*) AS n, sum(label) AS p FROM pred GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(n) OVER x, 0) AS bn2, coalesce(sum(p) OVER x, 0) AS bp2, sum(n) OVER (PARTITION BY b) AS nn, sum(p) OVER (PARTITION BY b) AS pp FROM c WINDOW x AS (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT b, (sum(p * (bn2 + (n + 1) / 2.0::DOUBLE)) - max(pp) * (max(pp) + 1) / 2.0::DOUBLE) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auc, sum(coalesce(p / nullif(pp, 0)::DOUBLE, 0) * (pp - bp2) / (nn - bn2)) AS ap2 FROM w GROUP BY b)""", "SELECT round(avg(auc), 6) AS auc, round(avg(ap2), 6) AS ap FROM m")  # fmt: skip
_add("score_histogram", _PRED, "SELECT least(floor((score - 0.0::DOUBLE) / 0.025::DOUBLE), 39)::BIGINT AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 0.025::DOUBLE), 6) AS density FROM pred GROUP BY 1")
_add("score_cdf", _PRED, "SELECT round(score, 6) AS value, round((bn + n) / an::DOUBLE, 6) AS cdf FROM bys")
_add("feature_correlation", _TX + ", f AS (SELECT amt_paid, amt_rec, hour(ts) AS hour FROM tx)", "SELECT unnest(['amt_paid', 'amt_paid', 'amt_paid', 'amt_rec', 'amt_rec', 'hour']) AS a, unnest(['amt_paid', 'amt_rec', 'hour', 'amt_rec', 'hour', 'hour']) AS b, unnest([round(corr(amt_paid, amt_paid), 6), round(corr(amt_paid, amt_rec), 6), round(corr(amt_paid, hour), 6), round(corr(amt_rec, amt_rec), 6), round(corr(amt_rec, hour), 6), round(corr(hour, hour), 6)]) AS corr FROM f")
_add("pos_weight", _PRED, "SELECT round(least((count(*) - sum(label)) / greatest(sum(label), 1)::DOUBLE, 100), 6) AS pos_weight FROM pred")

_add("neighbor_max_aggregate", _TX + ", oc AS (SELECT e.acct, count(src) AS x FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN tx ON e.acct = tx.src GROUP BY e.acct)", "SELECT oc.acct AS node_id, coalesce(m, 0)::DOUBLE AS max_x FROM oc LEFT JOIN (SELECT dst, max(x) AS m FROM tx JOIN oc ON tx.src = oc.acct GROUP BY dst) a ON oc.acct = a.dst")
_add("memory_gru_update", _MSG + """,
lm AS (SELECT node, arg_max(m2, (t, seq)) AS x, max(t) AS t FROM ms GROUP BY node),
mm AS (SELECT src AS node, count(*) / 100.0::DOUBLE AS h FROM tx GROUP BY src),
bh AS (SELECT lm.node, x, t, coalesce(h, 0) AS h FROM lm LEFT JOIN mm USING (node)),
gt AS (SELECT *, """ + _sig("0.5 * x + 0.1 + 0.3 * h") + " AS r, " + _sig("-0.4 * x + 0.2 * h - 0.1") + " AS z FROM bh)",
     "SELECT node, round((1 - z) * tanh(0.9 * x + 0.2 + r * (-0.7 * h + 0.3)) + z * h, 6) AS memory, t AS last_update FROM gt")

_add("message_mlp", _MSG + """,
lm AS (SELECT node, arg_max(m0, (t, seq)) AS a, arg_max(m1, (t, seq)) AS b, arg_max(m2, (t, seq)) AS c FROM ms GROUP BY node),
hd AS (SELECT node, greatest(0.3::DOUBLE * ln(1 + a) - 0.2::DOUBLE * ln(1 + b) + 0.5::DOUBLE * c - 0.4::DOUBLE, 0) AS h FROM lm)""", "SELECT node, round(0.7::DOUBLE * h + 0.1::DOUBLE, 6) AS x0, round(-0.6::DOUBLE * h + 0.2::DOUBLE, 6) AS x1 FROM hd")
_add("time_codes_on_targets", _TX + """,
cd AS (SELECT dst, avg(sin(x)) AS a, avg(sin(x * 0.01::DOUBLE)) AS b, avg(cos(x)) AS c, avg(cos(x * 0.01::DOUBLE)) AS d FROM (SELECT dst, t / 86400.0::DOUBLE AS x FROM tx) GROUP BY dst)""",
     "SELECT n.acct AS node_id, round(coalesce(a, 0), 6) AS e0, round(coalesce(b, 0), 6) AS e1, round(coalesce(c, 0), 6) AS e2, round(coalesce(d, 0), 6) AS e3 FROM (SELECT DISTINCT acct FROM ends) n LEFT JOIN cd ON n.acct = cd.dst")
_MERGED = "1 / (1 + exp(-(0.8::DOUBLE * greatest(0.5::DOUBLE * s.h - 0.4::DOUBLE * {0}.h + 0.1::DOUBLE, 0) - 0.5::DOUBLE * greatest(-0.3::DOUBLE * s.h + 0.6::DOUBLE * {0}.h + 0.2::DOUBLE, 0) + 0.05::DOUBLE)))"
_add("edge_probabilities", _TX + """,
ds AS (SELECT dst AS acct, row_number() OVER (ORDER BY dst) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM tx)),
hd AS (SELECT e.acct, ln(1 + count(src)) AS h FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN tx ON e.acct = tx.src GROUP BY e.acct)""",
     f"SELECT row_id AS edge_id, round({_MERGED.format('p')}, 6) AS pos, round({_MERGED.format('g')}, 6) AS neg FROM tx JOIN ds ON idx = (row_id * 48271 + 7 * 7919) % n JOIN hd s ON tx.src = s.acct JOIN hd p ON tx.dst = p.acct JOIN hd g ON ds.acct = g.acct")
_add("first_known_name", _TX + """,
nm AS (SELECT side, acct, fmt, row_number() OVER (PARTITION BY side, acct ORDER BY count(*) DESC, fmt) AS r FROM (SELECT 's' AS side, src AS acct, fmt FROM tx UNION ALL SELECT 'd', dst, fmt FROM tx) GROUP BY side, acct, fmt)""",
     "SELECT n.acct, coalesce(s.fmt, d.fmt, 'Unknown') AS name FROM (SELECT DISTINCT acct FROM ends) n LEFT JOIN nm s ON n.acct = s.acct AND s.side = 's' AND s.r = 1 LEFT JOIN nm d ON n.acct = d.acct AND d.side = 'd' AND d.r = 1")
_add("engineered_columns", _TX, "SELECT row_id, round(ln(1 + amt_rec), 6) AS log_amt_rec, round(ln(1 + amt_paid), 6) AS log_amt_paid, (from_bank = to_bank)::BIGINT AS same_bank, (cur_rec = cur_paid)::BIGINT AS same_currency, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, round((t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ())::DOUBLE, 6) AS ts_normalized FROM tx")
_add("first_edges", _TX, "SELECT row_id, src, dst FROM tx ORDER BY ts, row_id LIMIT 1000")
_add("bipartite_reindex", _TX, "SELECT l_suppkey::BIGINT AS u, l_linenumber + max(l_suppkey) OVER () AS i, l_orderkey * 8 + l_linenumber + 1 AS idx FROM lineitem")

# Node memory by batches: each batch's tables follow from those of the batch before.
_EVENTS = _TX + """,
ev AS (SELECT *, 3 * (row_number() OVER (ORDER BY ts, row_id) - 1) // count(*) OVER () AS batch, ln(1 + greatest(coalesce(amt_paid, 0), 0)) AS amt FROM tx),
en AS (SELECT batch, 0 AS side, src AS node, dst AS other, t, row_id, amt FROM ev UNION ALL SELECT batch, 1, dst, src, t, row_id, amt FROM ev),
mem0 AS (SELECT NULL::BIGINT AS node, NULL::DOUBLE AS h, NULL::BIGINT AS u WHERE false)"""


def _sent(b: int) -> str:
    """Messages of batch b: own and other memory, amount, and a code of the seconds since the own last update."""
    return f"""SELECT en.node, batch, side, en.t, en.row_id, coalesce(o.h, 0) AS m0, coalesce(p.h, 0) AS m1, amt AS m2,
      cos((en.t - coalesce(o.u, 0))::DOUBLE) AS m3, cos((en.t - coalesce(o.u, 0)) * 1e-9::DOUBLE) AS m4
    FROM en LEFT JOIN {{mem}} o ON en.node = o.node LEFT JOIN {{mem}} p ON en.other = p.node WHERE batch = {b}"""


def _gru(taken: str, memory: str) -> str:
    r, z = _sig("0.5 * m0 + 0.2 * m1 + 0.1 * m2 + 0.4 * m3 - 0.3 * m4 + 0.1 + 0.3 * h"), _sig("-0.4 * m0 + 0.3 * m1 - 0.1 * m2 + 0.2 * m3 + 0.1 * m4 + 0.2 * h - 0.1")
    new = f"tanh(0.9 * m0 - 0.6 * m1 + 0.2 * m2 + 0.3 * m3 + 0.5 * m4 + 0.2 + {r} * (-0.7 * h + 0.3))"
    rows = f"SELECT {taken}.*, coalesce({memory}.h, 0) AS h FROM {taken} LEFT JOIN {memory} USING (node)"
    return f"SELECT node, (1 - {z}) * {new} + {z} * h AS h, t AS u FROM ({rows}) UNION ALL SELECT node, h, u FROM {memory} WHERE node NOT IN (SELECT node FROM {taken})"


def _rnn(taken: str, memory: str) -> str:
    rows = f"SELECT {taken}.*, coalesce({memory}.h, 0) AS h FROM {taken} LEFT JOIN {memory} USING (node)"
    return f"SELECT node, tanh(0.5 * m0 + 0.2 * m1 + 0.1 * m2 + 0.4 * m3 - 0.3 * m4 + 0.1 + 0.3 * h - 0.2) AS h, t AS u FROM ({rows}) UNION ALL SELECT node, h, u FROM {memory} WHERE node NOT IN (SELECT node FROM {taken})"


_LAST_OF = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY batch DESC, side DESC, t DESC, row_id DESC) AS r FROM {}) WHERE r = 1"
_LAZY, _EAGER = _EVENTS + ",\nq0 AS (" + _sent(-1).format(mem="mem0") + ")", _EVENTS
for _b in range(3):
    _LAZY += f""",
d{_b} AS ({_LAST_OF.format(f"(SELECT * FROM q{_b} WHERE node IN (SELECT node FROM en WHERE batch = {_b}))")}),
mem{_b + 1} AS ({_gru(f"d{_b}", f"mem{_b}")}),
q{_b + 1} AS (SELECT * FROM q{_b} WHERE node NOT IN (SELECT node FROM en WHERE batch = {_b}) UNION ALL {_sent(_b).format(mem=f"mem{_b + 1}")})"""
    _MEANS = ", ".join(f"avg(m{k}) AS m{k}" for k in range(5))
    _EAGER += f""",
n{_b} AS ({_sent(_b).format(mem=f"mem{_b}")}),
s{_b} AS (SELECT node, {_MEANS}, max(t) AS t FROM n{_b} WHERE side = 0 GROUP BY node),
g{_b} AS (SELECT g.* EXCLUDE (t), greatest(g.t, coalesce(s.t, g.t)) AS t FROM (SELECT node, {_MEANS}, max(t) AS t FROM n{_b} WHERE side = 1 GROUP BY node) g LEFT JOIN s{_b} s USING (node)),
half{_b} AS ({_rnn(f"s{_b}", f"mem{_b}")}),
mem{_b + 1} AS ({_rnn(f"g{_b}", f"half{_b}")})"""
_MEM3 = "SELECT node, round(h, 6) AS memory, u AS last_update FROM mem3"
_add("memory_lazy", _LAZY, _MEM3)
_add("memory_restored", _LAZY, _MEM3)
_add("memory_eager", _EAGER, _MEM3)
_add("memory_seen", _LAZY + f", dl AS ({_LAST_OF.format('q3')}), sn AS ({_gru('dl', 'mem3')})", "SELECT node, round(h, 6) AS memory, u AS last_update FROM sn")
_add("memory_queue", _LAZY, "SELECT node, batch, side, row_id, t, " + ", ".join(f"round(m{k}, 6) AS m{k}" for k in range(5)) + " FROM q3")
_add("memory_time_gaps", _LAZY + """,
ds AS (SELECT dst AS acct, row_number() OVER (ORDER BY dst) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM ev WHERE batch = 2)),
st AS (SELECT round(avg(s), 2) AS ms, round(stddev_pop(s), 2) AS ss, round(avg(d), 2) AS md, round(stddev_pop(d), 2) AS sd FROM (SELECT t - coalesce(lag(t) OVER (PARTITION BY src ORDER BY ts, row_id), 0) AS s, t - coalesce(lag(t) OVER (PARTITION BY dst ORDER BY ts, row_id), 0) AS d FROM tx)),
x AS (SELECT ev.*, acct AS neg FROM ev JOIN ds ON idx = (row_id * 48271 + 7 * 7919) % ds.n WHERE batch = 2)""",
     "SELECT row_id, round((x.t - coalesce(a.u, 0) - ms) / ss, 4) AS gap_src, round((x.t - coalesce(b.u, 0) - md) / sd, 4) AS gap_dst, round((x.t - coalesce(c.u, 0) - md) / sd, 4) AS gap_neg FROM x JOIN st ON true LEFT JOIN mem2 a ON x.src = a.node LEFT JOIN mem2 b ON x.dst = b.node LEFT JOIN mem2 c ON x.neg = c.node")

# Windows of 30 days; the fixture's month has at most three.
_DECAY = _TX + """,
ev AS (SELECT *, t // 2592000 - min(t // 2592000) OVER () AS batch FROM tx),
en AS (SELECT batch, src AS node, dst AS other, t, row_id, coalesce(amt_paid, 0) AS amt FROM ev UNION ALL SELECT batch, dst, src, t, row_id, coalesce(amt_paid, 0) FROM ev),
mem0 AS (SELECT NULL::BIGINT AS node, NULL::DOUBLE AS h, NULL::BIGINT AS u WHERE false)"""
for _b in range(3):
    _DECAY += f""",
n{_b} AS (SELECT en.node, t, row_id, (coalesce(o.h, 0) + coalesce(p.h, 0) + amt) / 3 AS m FROM en LEFT JOIN mem{_b} o ON en.node = o.node LEFT JOIN mem{_b} p ON en.other = p.node WHERE batch = {_b}),
d{_b} AS (SELECT node, m, t FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t DESC, row_id DESC) AS r FROM n{_b}) WHERE r = 1),
mem{_b + 1} AS (SELECT d.node, 0.5 * coalesce(o.h, 0) + 0.5 * m AS h, t AS u FROM d{_b} d LEFT JOIN mem{_b} o USING (node) UNION ALL SELECT node, h, u FROM mem{_b} WHERE node NOT IN (SELECT node FROM d{_b}))"""
_add("state_memory_replay", _DECAY, _MEM3)

# Embeddings and event scores: dense layers are written out from the same weights.
_CNT = _TX + """,
cx AS (SELECT row_id + 1 AS edge_id, ts, src + 1 AS src, dst + 1 AS dst, fmt, t, ln(1 + greatest(coalesce(amt_paid, 0), 0)) AS amt FROM tx),
nf AS (SELECT node_id, ln(1 + coalesce(o.c, 0)) AS x0, ln(1 + coalesce(i.c, 0)) AS x1 FROM (SELECT src AS node_id FROM cx UNION SELECT dst FROM cx)
  LEFT JOIN (SELECT src AS node_id, count(*) AS c FROM cx GROUP BY src) o USING (node_id) LEFT JOIN (SELECT dst AS node_id, count(*) AS c FROM cx GROUP BY dst) i USING (node_id)),
ca AS (SELECT src AS node, dst AS nbr, edge_id, t, amt FROM cx UNION ALL SELECT dst, src, edge_id, t, amt FROM cx)"""


def _slots(name: str, frontier: str) -> str:
    """The three latest neighbours of each node before t, and pads of zeros for those that lack."""
    return f"""
{name}a AS (SELECT f.node, f.t, a.nbr, a.t AS nbr_t, a.amt FROM {frontier} f JOIN ca a ON a.node = f.node AND a.t < f.t QUALIFY row_number() OVER (PARTITION BY f.node, f.t ORDER BY a.t DESC, a.edge_id DESC, a.nbr DESC) <= 3),
{name} AS (SELECT node, t, nbr, nbr_t, amt FROM {name}a UNION ALL SELECT node, t, 0, 0, 0 FROM (SELECT f.node, f.t, count(nbr) AS c FROM {frontier} f LEFT JOIN {name}a a ON a.node = f.node AND a.t = f.t GROUP BY 1, 2), range(3) r(i) WHERE i >= c)"""


_CODE2 = ["cos((s.t - s.nbr_t)::DOUBLE)", "cos((s.t - s.nbr_t) * 1e-9::DOUBLE)"]


def _sum_step(slots: str, known: str, w: dict) -> str:
    one = V.affine(["k.z0", "k.z1", *_CODE2, "s.amt"], w["w1"], w["b1"])
    two = V.affine(["greatest(g0, 0)", "greatest(g1, 0)", "o.z0", "o.z1", "1", "1"], w["w2"], w["b2"])
    total = ", ".join(f"sum({c}) AS g{k}" for k, c in enumerate(one))
    return f"SELECT node, t, {V.named(two, 'z')} FROM (SELECT s.node, s.t, {total} FROM {slots} s JOIN {known} k ON k.node = s.nbr AND k.t = s.t GROUP BY 1, 2) JOIN {known} o USING (node, t)"


_FRONT = _CNT + ",\npr AS (SELECT DISTINCT src AS node, t FROM cx)," + _slots("s1", "pr") + ",\nf1 AS (SELECT node, t FROM pr UNION SELECT nbr, t FROM s1)"
_ZERO = "SELECT f.node, f.t, coalesce(x0, 0) AS z0, coalesce(x1, 0) AS z1 FROM {} f LEFT JOIN nf ON nf.node_id = f.node"
_Z2 = "SELECT node, t, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM "
_add("embedding_graph_sum", _FRONT + "," + _slots("s2", "f1") + f""",
f2 AS (SELECT node, t FROM f1 UNION SELECT nbr, t FROM s2),
k0 AS ({_ZERO.format('f2')}),
k1 AS ({_sum_step('s2', 'k0', V.SUM_LAYERS[0])}),
k2 AS ({_sum_step('s1', 'k1', V.SUM_LAYERS[1])})""", _Z2 + "k2")  # fmt: skip


def _attention(w: dict) -> str:
    q = V.affine(["o.z0", "o.z1", "1", "1"], w["wq"], w["bq"])
    keys = ["k.z0", "k.z1", "s.amt", *_CODE2]
    k, v = V.affine(keys, w["wk"], w["bk"]), V.affine(keys, w["wv"], w["bv"])
    dot = [f"({q[2 * h]} * {k[2 * h]} + {q[2 * h + 1]} * {k[2 * h + 1]}) / sqrt(2.0::DOUBLE) AS d{h}" for h in range(2)]
    rows = f"SELECT s.node, s.t, o.z0, o.z1, {', '.join(dot)}, {V.named(v, 'v')}, s.nbr FROM s1 s JOIN k0 k ON k.node = s.nbr AND k.t = s.t JOIN k0 o ON o.node = s.node AND o.t = s.t"
    top = f"SELECT *, {', '.join(f'exp(d{h} - max(d{h}) OVER (PARTITION BY node, t)) AS e{h}' for h in range(2))} FROM ({rows}) WHERE nbr <> 0"
    heads = [f"sum(e{c // 2} * v{c}) / sum(e{c // 2})" for c in range(4)]
    out = V.affine([f"a{c}" for c in range(4)], w["wo"], w["bo"])
    att = f"SELECT node, t, {V.named(out, 'a')} FROM (SELECT node, t, {V.named(heads, 'a')} FROM ({top}) GROUP BY 1, 2)"
    merged = V.affine(V.relu(V.affine([*(f"coalesce(a{c}, 0)" for c in range(4)), "o.z0", "o.z1"], w["m1"], w["c1"])), w["m2"], w["c2"])
    return f"SELECT pr.node, pr.t, {V.named(merged, 'z')} FROM pr JOIN k0 o ON o.node = pr.node AND o.t = pr.t LEFT JOIN ({att}) a ON a.node = pr.node AND a.t = pr.t"


_add("embedding_graph_attention", _FRONT + f",\nk0 AS ({_ZERO.format('f1')}),\nk1 AS ({_attention(V.ATTENTION)})", _Z2 + "k1")
_add("embedding_time", _GAPS + """,
st AS (SELECT avg(coalesce(gs, t)) AS m, stddev_pop(coalesce(gs, t)) AS s FROM gp),
oc AS (SELECT e.acct, ln(1 + coalesce(o, 0)) AS x0, ln(1 + coalesce(i, 0)) AS x1 FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN (SELECT src AS acct, count(*) AS o FROM tx GROUP BY src) USING (acct) LEFT JOIN (SELECT dst AS acct, count(*) AS i FROM tx GROUP BY dst) USING (acct)),
gg AS (SELECT row_id, src, (coalesce(gs, 0) - m) / s AS g FROM gp, st)""",
     "SELECT row_id + 1 AS row_id, " + ", ".join(f"round(x{k} * (1 + (g * {float(V.TIME['weight'][k])!r}::DOUBLE + {float(V.TIME['bias'][k])!r}::DOUBLE)), 4) AS z{k}" for k in range(2)) + " FROM gg JOIN oc ON gg.src = oc.acct")

_EV = _CNT + """,
et AS (SELECT fmt, row_number() OVER (ORDER BY f) - 1 AS event_type FROM (SELECT fmt, min((ts, edge_id)) AS f FROM cx GROUP BY fmt)),
evs AS (SELECT cx.*, event_type, (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ())::DOUBLE AS s, (row_number() OVER (ORDER BY ts, edge_id) - 1) // 100 AS batch FROM cx JOIN et USING (fmt))"""
_SIN4 = ["sin(s)", "sin(s * 0.01::DOUBLE)", "cos(s)", "cos(s * 0.01::DOUBLE)"]


def _self_attention(rows: str, qkv: list[str], heads: int = 2) -> str:
    """edge_id and a0 to a3: rows(edge_id, batch, ...) with 12 expressions of queries, keys and values, attending in their batch."""
    table = f"(SELECT *, {V.named(qkv, 'q')} FROM {rows})"
    dot = [f"(a.q{2 * h} * b.q{4 + 2 * h} + a.q{2 * h + 1} * b.q{5 + 2 * h}) / sqrt(2.0::DOUBLE) AS d{h}" for h in range(heads)]
    pairs = f"SELECT a.edge_id, {', '.join(dot)}, {', '.join(f'b.q{8 + c} AS v{c}' for c in range(4))} FROM {table} a JOIN {table} b USING (batch)"
    top = f"SELECT *, {', '.join(f'exp(d{h} - max(d{h}) OVER (PARTITION BY edge_id)) AS e{h}' for h in range(heads))} FROM ({pairs})"
    return f"SELECT edge_id, {V.named([f'sum(e{c // 2} * v{c}) / sum(e{c // 2})' for c in range(4)], 'a')} FROM ({top}) GROUP BY edge_id"


_w = V.EVENTS
_N = lambda p: V.affine([f"{p}.x0", f"{p}.x1"], _w["node"], _w["node_b"])
_add("event_attention_scores", _EV + f""",
hh AS (SELECT edge_id, batch, {V.named(V.affine([*_N('a'), *_N('b'), 'amt', *_SIN4], _w['event'], _w['event_b']), 'h')} FROM evs JOIN nf a ON a.node_id = src JOIN nf b ON b.node_id = dst),
aa AS ({_self_attention('hh', V.affine(['h0', 'h1', 'h2', 'h3'], _w['qkv0'], _w['qkv0_b']))}),
rr AS (SELECT edge_id, {V.named([f'h{k} + {c}' for k, c in enumerate(V.affine(['a0', 'a1', 'a2', 'a3'], _w['out0'], _w['out0_b']))], 'r')} FROM hh JOIN aa USING (edge_id)),
mm AS (SELECT *, (r0 + r1 + r2 + r3) / 4 AS m FROM rr),
vv AS (SELECT *, sqrt(((r0 - m) * (r0 - m) + (r1 - m) * (r1 - m) + (r2 - m) * (r2 - m) + (r3 - m) * (r3 - m)) / 4 + 1e-5::DOUBLE) AS d FROM mm),
nn AS (SELECT edge_id, {V.named([f"(r{k} - m) / d * {float(_w['norm'][k])!r}::DOUBLE + {float(_w['norm_b'][k])!r}::DOUBLE" for k in range(4)], 'n')} FROM vv)""",
     f"SELECT edge_id, round({V.sigmoid(V.affine(V.relu(V.affine(['n0', 'n1', 'n2', 'n3'], _w['hidden'], _w['hidden_b'])), _w['last'], _w['last_b'])[0])}, 6) AS score FROM nn")
_QKV = V.affine(["amt", "ln(1 + src)", "ln(1 + dst)", "event_type::DOUBLE"], _w["qkv0"], np.zeros(12))
_add("batch_attention", _EV + f", aa AS ({_self_attention('evs', _QKV)})", "SELECT edge_id, " + ", ".join(f"round(a{k}, 6) AS a{k}" for k in range(4)) + " FROM aa")

_m = V.EMBEDDED
_H = lambda p: [f"{c} + sin({p}.node_id * {k + 1}.0::DOUBLE)" for k, c in enumerate(V.affine([f"{p}.x0", f"{p}.x1"], _m["node"], _m["node_b"]))]
_IN = [*_H("a"), *_H("b"), "amt", "sin(s)", "cos(s)", "cos(event_type::DOUBLE)", "cos(event_type * 2.0::DOUBLE)"]
_add("embedded_event_scores", _EV, f"SELECT edge_id, round({V.sigmoid(V.affine(V.relu(V.affine(_IN, _m['hidden'], _m['hidden_b'])), _m['last'], _m['last_b'])[0])}, 6) AS score FROM evs JOIN nf a ON a.node_id = src JOIN nf b ON b.node_id = dst")


def _sage(name: str, known: str, p: str, q: str, width: int, w_self: np.ndarray, w_nbr: np.ndarray, bias: np.ndarray, edges: str = "cx") -> str:
    """A mean neighbour layer: known(node_id, p0, ...) to name(node_id, q0, ...)."""
    means = ", ".join(f"avg({p}{k}) AS g{k}" for k in range(width))
    columns = [f"{p}{k}" for k in range(width)] + [f"coalesce(g{k}, 0)" for k in range(width)]
    out = V.relu(V.affine(columns, np.vstack([w_self, w_nbr]), bias))
    return f",\n{name} AS (SELECT node_id, {V.named(out, q)} FROM {known} LEFT JOIN (SELECT dst AS node_id, {means} FROM {edges} JOIN {known} k ON k.node_id = src GROUP BY dst) USING (node_id))"


_s = V.SAVED
_BOTH = [f"{p}.h{k}" for p in "ab" for k in range(3)]
_add("rescored_edges", _EV + _sage("l1", "nf", "x", "y", 2, _s["self0"], _s["nbr0"], _s["bias0"]) + _sage("l2", "l1", "y", "h", 2, _s["self1"], _s["nbr1"], _s["bias1"]),
     f"SELECT edge_id, round({V.sigmoid(V.affine(V.relu(V.affine([*_BOTH, 'amt', 'sin(s)', 'cos(s)'], _s['hidden'], _s['hidden_b'])), _s['last'][:, None], _s['last_b'].reshape(1))[0])}, 6) AS score FROM evs JOIN l2 a ON a.node_id = src JOIN l2 b ON b.node_id = dst")
# The weights of sage_edge_scores, drawn in its order.
_rng = np.random.default_rng(0)
_g = [_rng.normal(size=n) for n in ((2, 4), (2, 4), (9, 8), (8,))]
_add("sage_edge_scores", _TX + """,
oc AS (SELECT e.acct AS node_id, ln(1 + coalesce(o, 0)) AS x0, ln(1 + coalesce(i, 0)) AS x1 FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN (SELECT src AS acct, count(*) AS o FROM tx GROUP BY src) USING (acct) LEFT JOIN (SELECT dst AS acct, count(*) AS i FROM tx GROUP BY dst) USING (acct))""" + _sage("l1", "oc", "x", "h", 2, _g[0], _g[1], np.zeros(4), "tx"),
     f"SELECT row_id AS edge_id, round({V.sigmoid(V.affine(V.relu(V.affine([*(f'{p}.h{k}' for p in 'ab' for k in range(4)), 'ln(1 + greatest(amt_paid, 0))'], _g[2], np.zeros(8))), _g[3][:, None], np.zeros(1))[0])}, 6) AS score FROM tx JOIN l1 a ON a.node_id = src JOIN l1 b ON b.node_id = dst")

# The fixture with formats and currencies of the fixed vocabularies, for what reads them by name.
_FORMAT_ORDER = ("Cheque", "Credit Card", "ACH", "Cash", "Reinvestment", "Wire", "Bitcoin")
_words = lambda values, n: f"(CASE event_id % {n} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values[:n])) + " END)"
_WORDED = _TX.replace("event_type AS fmt, (event_id % 3)::VARCHAR AS cur_paid, (event_id % 4)::VARCHAR AS cur_rec", f"{_words(_FORMAT_ORDER, 7)} AS fmt, {_words(_CURRENCIES, 14)} AS cur_paid, {_words(_CURRENCIES, 15)} AS cur_rec")
assert _WORDED != _TX
for _name in [*(f"ablation_{_g}" for _g in _LEFT_OUT), "ablation_top20"]:
    ORACLE[_name] = ORACLE[_name].replace(_TX, _WORDED)

_hot = lambda column, prefix, values: [f"(({column} = '{v}')::BIGINT)::DOUBLE AS \"{prefix}_{v}\"" for v in values]
_BASE = [c + "::DOUBLE" if c in ("same_bank", "same_currency", "hour_of_day", "day_of_week", "is_weekend") else c for c in ("log_amt_rec", "log_amt_paid", "same_bank", "same_currency", "hour_of_day", "day_of_week", "is_weekend", "ts_normalized", "log_time_since_src", "log_time_since_dst")]
_NAMES = [c.removesuffix("::DOUBLE") for c in _BASE]
_PLAIN = [f"{c} AS {n}" for c, n in zip(_BASE, _NAMES)]
_FLOOR = lambda x: f"least(greatest(coalesce(({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () < 1e-6 THEN 1 ELSE stddev_pop({x}) OVER () END, 0), -10), 10)"
_RAW = {k: x.removeprefix("round(").removesuffix(", 6)") for k, x in _THEORY.items()}
_EPSED = {k: f"round(coalesce({_z(x)}, 0), 6)" for k, x in _RAW.items()}
_FLOORED = {k: f"round({_FLOOR(f'({x})::DOUBLE')}, 6)" for k, x in _RAW.items()}
_COMMON = _OPP.replace(_TX, _WORDED) + _GAPS[len(_TX) :] + _NODES[len(_TX) :] + f""",
pp AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS edge_id FROM tx),
et AS (SELECT fmt, row_number() OVER (ORDER BY f) - 1 AS event_type FROM (SELECT fmt, min((ts, row_id)) AS f FROM tx GROUP BY fmt)),
fr AS (SELECT row_id, fmt, cur_rec, dense_rank() OVER (ORDER BY fmt) - 1 AS pf_code, dense_rank() OVER (ORDER BY cur_rec) - 1 AS rc_code, {_FEAT} FROM gp)"""


def _layout_edges(columns: list[str], theory: dict[str, str], more: str = "") -> tuple[str, str]:
    table = f", zs AS (SELECT row_id, {', '.join(f'{x} AS \"{k}\"' for k, x in theory.items())} FROM sc)" if theory else ""
    join = " JOIN zs USING (row_id)" if theory else ""
    names = "".join(f', zs."{k}"' for k in theory)
    return _COMMON + table, f"SELECT pp.edge_id, a.node_id AS src, b.node_id AS dst, t AS ts, label::BIGINT AS label{more}, {', '.join(columns)}{names} FROM tx JOIN pp USING (row_id) JOIN ids a ON tx.src = a.acct JOIN ids b ON tx.dst = b.acct JOIN (SELECT * RENAME (fmt AS fr_fmt, cur_rec AS fr_cur) FROM fr) fr USING (row_id) JOIN et ON et.fmt = tx.fmt{join}"


_PF, _RC = _hot("tx.fmt", "pf", _FORMAT_ORDER), _hot("tx.cur_rec", "rc", _CURRENCIES)
_CUR_RECV, _FMT_ = _hot("tx.cur_rec", "cur_recv", _CURRENCIES), _hot("tx.fmt", "fmt", _FORMAT_ORDER)
_add("graph_static_baseline", *_layout_edges(_PLAIN + _PF + _RC, {}))
_add("graph_static_theory", *_layout_edges([*_PLAIN, "pf_code::DOUBLE AS pf_code", "rc_code::DOUBLE AS rc_code"], _EPSED))
_add("graph_events_baseline", *_layout_edges(_PLAIN + _CUR_RECV + _FMT_, {}))
_add("graph_events_theory", *_layout_edges([f"least(greatest({c}, -10), 10) AS {n}" for c, n in zip(_BASE, _NAMES)] + _CUR_RECV + _FMT_, _FLOORED))
_add("graph_typed_baseline", *_layout_edges(_PLAIN + _PF + _RC, {}, ", event_type"))
_add("graph_typed_theory", *_layout_edges(_PLAIN + _PF + _RC, _EPSED, ", event_type"))

_NODE = _NODES.replace(_TX, _WORDED) + _ET[len(_TX) :] + """,
lab AS (SELECT acct, max(label) AS y, sum(label)::BIGINT AS n FROM ends GROUP BY acct),
o AS (SELECT src AS acct, count(*) AS c FROM tx GROUP BY src), i AS (SELECT dst AS acct, count(*) AS c FROM tx GROUP BY dst),
nd AS (SELECT node_id, et.acct, y::BIGINT AS y_node, entity_type, n, coalesce(o.c, 0) AS od, coalesce(i.c, 0) AS id FROM et JOIN ids USING (acct) JOIN lab USING (acct) LEFT JOIN o USING (acct) LEFT JOIN i USING (acct))"""
_DEGS = "od::DOUBLE AS out_degree, id::DOUBLE AS in_degree, (od + id)::DOUBLE AS total_degree"
_LOGS = "round(ln(1 + od), 6) AS log_out_degree, round(ln(1 + id), 6) AS log_in_degree, round(ln(1 + od + id), 6) AS log_total_degree"
for _name in ("static_baseline", "typed_theory"):
    _add(f"graph_{_name}_nodes", _NODE, f"SELECT node_id, acct, y_node, {_DEGS}, {_LOGS}, {_HOT} FROM nd")
_add("graph_static_theory_nodes", _NODE, f"SELECT node_id, acct, y_node, {_DEGS}, {_LOGS} FROM nd")
_add("graph_events_theory_nodes", _NODE, f"SELECT node_id, acct, y_node, {_DEGS}, n::DOUBLE AS laundering_count FROM nd")
_cols = [f'"{c}"' for c in [*_NAMES, *(f"cur_recv_{v}" for v in _CURRENCIES), *(f"fmt_{v}" for v in _FORMAT_ORDER)]]
_ctes, _select = _layout_edges(_PLAIN + _CUR_RECV + _FMT_, {})
_add("graph_written_and_read", _ctes + f", g AS ({_select}), u AS (SELECT unnest([{', '.join(c.replace(chr(34), chr(39)) for c in _cols)}]) AS feature, unnest([{', '.join(_cols)}]) AS v FROM g)",
     "SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) FILTER (v IS NULL OR isnan(v)) AS n_bad FROM u GROUP BY feature")

_add("injection_checks", _INT, """SELECT * FROM (SELECT 'null_score' AS "check", count(*) FILTER (row_id % 101 = 0 OR score IS NULL) AS n FROM lab
UNION ALL SELECT 'injected_not_positive', count(*) FILTER ((row_id % 89 = 0 OR inj = 1) AND label <> 1) FROM lab) WHERE n > 0""")
_add("edge_checks", _TX, """SELECT * FROM (SELECT 'dangling' AS "check", count(*) AS n FROM ends WHERE acct NOT IN (SELECT src FROM tx)
UNION ALL SELECT 'bad_features', count(*) FROM tx WHERE row_id % 97 = 0 OR amt_paid IS NULL OR isnan(amt_paid)
UNION ALL SELECT 'bad_labels', count(*) FROM tx WHERE row_id % 83 = 0
UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT CASE WHEN row_id % 79 = 0 THEN row_id - 1 ELSE row_id END) FROM tx) WHERE n > 0""")
_add("graph_warnings", _TX + """,
w AS (SELECT 100.0 * sum(label) / count(*) AS pct, count(*) FILTER (src = dst) AS loops FROM tx),
iso AS (SELECT count(DISTINCT acct) AS n FROM acct WHERE acct NOT IN (SELECT acct FROM ends))""",
     """SELECT 'positives under 1 %' AS "check" FROM w WHERE pct < 1 UNION ALL SELECT 'positives under 5 %' FROM w WHERE pct < 5 UNION ALL SELECT 'self-loops' FROM w WHERE loops > 0 UNION ALL SELECT 'isolated nodes' FROM iso WHERE n > 0""")  # fmt: skip
ORACLE["metric_checked"] = ORACLE["metric_confusion"]
_add("aligned_predictions", _PRED, "SELECT edge_id, round(score, 6) AS score, label::BIGINT AS label FROM pred")
_add("early_stop_daily", "RECURSIVE " + _TX + """,
od AS (SELECT epoch, v, row_number() OVER (ORDER BY epoch) AS i FROM (SELECT t // 86400 AS epoch, round(avg(amt_paid), 6) AS v FROM tx GROUP BY 1)),
st AS (SELECT i, v AS best, epoch AS at_epoch, 0 AS rounds, NULL::BIGINT AS stop FROM od WHERE i = 1
  UNION ALL SELECT o.i, CASE WHEN better THEN o.v ELSE best END, CASE WHEN better THEN o.epoch ELSE at_epoch END, CASE WHEN better THEN 0 ELSE rounds + 1 END, CASE WHEN NOT better AND rounds + 1 >= 3 THEN o.epoch END
  FROM (SELECT st.*, (od.v - best) / abs(best) > 1e-10 AS better, od.i AS oi FROM st JOIN od ON od.i = st.i + 1 WHERE stop IS NULL) s JOIN od o ON o.i = s.oi)""",
     "SELECT at_epoch AS best_epoch, stop AS stop_epoch FROM st ORDER BY i DESC LIMIT 1")
_drawn = lambda seed: f"((row_id * 7919 + {seed} * 104729 + ((row_id * 31 + {seed}) % 997) * 1009) % 1000003)"
_add("epoch_shuffle", _TX, " UNION ALL ".join(f"SELECT {k}::BIGINT AS epoch, (row_number() OVER (ORDER BY {_drawn(42 + k)}, row_id) - 1) // 200 AS batch, row_id FROM tx" for k in (1, 2)))
_add("noise_features", _TX, f"SELECT row_id, label::BIGINT AS label, round({_drawn(42)} / 1000003.0::DOUBLE, 6) AS a, round({_drawn(43)} / 1000003.0::DOUBLE, 6) AS b FROM tx")
_d = V.DECODER
_z3 = V.affine(V.relu(V.affine(V.relu(V.affine(["x0", "x1"], _d["w0"], _d["b0"])), _d["w1"], _d["b1"])), _d["w2"], _d["b2"])[0]
_add("decoder_probabilities", _TX + """,
oc AS (SELECT e.acct, ln(1 + coalesce(o, 0)) AS x0, ln(1 + coalesce(i, 0)) AS x1 FROM (SELECT DISTINCT acct FROM ends) e LEFT JOIN (SELECT src AS acct, count(*) AS o FROM tx GROUP BY src) USING (acct) LEFT JOIN (SELECT dst AS acct, count(*) AS i FROM tx GROUP BY dst) USING (acct))""", f"SELECT acct, round({V.sigmoid(_z3)}, 6) AS p FROM oc")
