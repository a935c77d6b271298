"""DuckDB SQL for the queries that write and read files."""

from __future__ import annotations

from .oracle import _CHRONO, _GAPS, _INT, _TX

ORACLE: dict[str, str] = {}


def _add(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes}\n{select}"


_PLACE = "row_number() OVER (ORDER BY row_id) - 1 AS row_id"
_add("transfers_from_csv", _TX, f"""SELECT {_PLACE}, t // 60 * 60 AS t, '0' || from_bank AS from_bank, src::VARCHAR AS src, '0' || to_bank AS to_bank, dst::VARCHAR AS dst, round(amt_rec, 6) AS amt_rec,
  CASE WHEN tx.row_id % 50 <> 0 THEN round(amt_paid, 6) END AS amt_paid, cur_rec, fmt, (CASE WHEN tx.row_id % 70 <> 0 THEN label ELSE 0 END)::BIGINT AS label FROM tx""")
_add("transfers_with_bad_times", _TX, f"SELECT {_PLACE}, CASE WHEN tx.row_id % 60 <> 0 THEN t // 60 * 60 END AS t FROM tx")
_add("synthetic_timestamps", _TX, "SELECT row_id, row_id * 60 AS t FROM tx")
_add("accounts_from_csv", _TX, "SELECT acct::VARCHAR AS acct, entity_id::VARCHAR AS entity_id, entity_name FROM acct")
_add("patterns_from_text", _TX, "SELECT DISTINCT s_suppkey::VARCHAR AS acct FROM supplier")
_add("interactions_from_csv", "li AS (SELECT *, row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag) - 1 AS idx FROM lineitem)", """SELECT idx, l_suppkey::BIGINT AS u, l_partkey::BIGINT AS i, round(l_linenumber * 1.5::DOUBLE, 6) AS at, (l_returnflag = 'R')::BIGINT AS label,
  (CASE WHEN l_linenumber > 2 THEN 2 ELSE 1 END)::BIGINT AS n, round(l_quantity::DOUBLE, 6) AS f0, CASE WHEN l_linenumber > 2 THEN round(l_discount::DOUBLE, 6) END AS f1 FROM li""")
_LOG = _TX + """,
dy AS (SELECT t // 86400 AS day, sum(row_id)::BIGINT AS s FROM tx GROUP BY 1),
lg AS (SELECT day - min(day) OVER () + 1 AS epoch, (s * 3) % 1000 / 1000.0::DOUBLE AS train_loss, (s * 7) % 1000 / 1000.0::DOUBLE AS val_loss, (s * 11) % 1000 / 1000.0::DOUBLE AS aupr FROM dy),
bs AS (SELECT arg_max(epoch, (aupr, -epoch)) AS best, max(epoch) AS last, max(aupr) AS top, arg_min(aupr, epoch) AS first FROM lg)"""
_add("log_epochs_shown", _LOG, "SELECT epoch::BIGINT AS epoch, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, 0.333::DOUBLE AS f1, round(aupr, 6) AS aupr, CASE WHEN epoch = best THEN 'best' WHEN epoch = last THEN 'stopped' ELSE '' END AS mark FROM lg, bs WHERE epoch % 5 = 0 OR epoch = best OR epoch = last")
_add("log_best_epoch", _LOG, "SELECT best::BIGINT AS best_epoch, round(top, 6) AS best, last::BIGINT AS last_epoch, round(top - first, 6) AS gain, round(0.95::DOUBLE * top, 6) AS low, round(top, 6) AS high FROM bs")
_add("cached_transfers", _TX, "SELECT fmt, count(*) AS n, max(row_id) AS last_id FROM tx GROUP BY fmt")
_add("intensity_csv_files", _INT, "SELECT intensity, count(*) AS n, sum(inj)::BIGINT AS injected, max(inj * level)::BIGINT AS level, max(row_id) AS last_id FROM lab GROUP BY intensity")
_add("time_encoding_cosine", _TX + ", f AS (SELECT row_id, (t - min(t) OVER ())::DOUBLE AS x FROM tx)", "SELECT row_id, " + ", ".join(f"round(cos(x * {10.0 ** -(3 * k)!r}::DOUBLE), 6) AS e{k}" for k in range(4)) + " FROM f")
_add("split_positions", _CHRONO, "SELECT row_id, position, CASE WHEN position < floor(n * 0.7::DOUBLE) THEN 'train' WHEN position < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM pos")
_add("stream_time_gaps", _GAPS, "SELECT src, row_id, coalesce(gs, 0) AS gap FROM gp")
