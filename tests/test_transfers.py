"""Micro fixtures for null, tie and self-loop rules of the transfer operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallygraph.functions import exprs as X
from tallygraph.operators import accounts as A
from tallygraph.operators import graph as G
from tallygraph.operators import opportunity as R
from tallygraph.operators import strain as N
from tallygraph.sources import readers

SCHEMA = "row_id long, ts timestamp_ntz, src string, dst string, amt_paid double, amt_rec double, from_bank string, to_bank string, cur_paid string, cur_rec string, fmt string, label int"


@pytest.fixture(scope="module")
def tx(spark):
    t = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    rows = [
        (0, t(1, 7), "A", "B", 100.0, 100.0, "1", "2", "x", "x", "Wire", 0),
        (1, t(1, 9), "A", "C", 200.0, 200.0, "1", "1", "x", "y", "ACH", 0),
        (2, t(6, 12), "A", "B", 300.0, 300.0, "1", None, None, None, None, 1),
        (3, t(6, 12), "B", "A", 50.0, 50.0, "2", "1", "x", "x", "Wire", 1),
        (4, t(7, 19), "C", "C", 10.0, 10.0, "1", "1", "x", "x", "Wire", 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [("A", "E1", "Corporation #7"), ("A", "E2", "Corporation #7"), ("B", "E1", "Sole Proprietorship #3"), ("D", None, None)]
    return spark.createDataFrame(rows, "acct string, entity_id string, entity_name string")


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame([("B",), ("B",)], "acct string")


def column(df, name, key="row_id"):
    return [r[name] for r in df.orderBy(key).collect()]


def test_flags(tx):
    f = A.time_flags(tx)
    assert column(f, "off_hours") == [1, 0, 0, 0, 1]
    assert column(f, "is_weekend") == [0, 0, 1, 1, 1]
    b = A.bank_flags(tx)
    assert column(b, "cross_bank") == [1, 0, 1, 1, 0]
    assert column(b, "same_bank") == [0, 1, 0, 0, 1]
    assert column(b, "same_currency") == [1, 0, 1, 1, 1]


def test_z_scores_of_single_transfers_are_null_and_score_zero(tx, accounts, patterns):
    rows = R.opportunity(tx, accounts, patterns)
    z = column(rows, "RAT_src_amount_z_pos")
    assert [None if v is None else round(v, 6) for v in z] == [0.0, 0.0, 1.0, None, None]
    assert column(rows, "RAT_score")[3:] == [0.0, 0.0]
    assert column(rows, "RAT_offender_score")[4] is None


def test_degrees_bursts_and_mutual_flow(tx, accounts, patterns):
    rows = R.opportunity(tx, accounts, patterns)
    assert column(rows, "RAT_src_out_deg_norm") == [1, 1, 1, 0.5, 0.5]
    assert column(rows, "RAT_mutual_flag") == [1, 0, 1, 1, 1]  # row 4 is a self-loop
    assert column(A.day_bursts(tx), "src_day_count") == [2, 2, 1, 1, 1]
    assert column(rows, "RAT_dst_pattern_flag") == [1, 0, 1, 0, 0]


def test_account_join_does_not_multiply_unless_asked(tx, accounts, patterns):
    assert R.opportunity(tx, accounts, patterns).count() == 5
    assert R.raw_features(tx, accounts, patterns, allow_fanout=True).count() == 9


def test_gaps_and_first_appearance(tx):
    g = A.gaps(tx)
    assert column(g, "gap_src") == [0, 7200, 442800, 0, 0]
    assert {r["acct"]: r["node_id"] for r in G.node_ids(tx).collect()} == {"A": 0, "B": 1, "C": 2}


def test_interevent_counts_from_zero(spark):
    rows = spark.createDataFrame([(0, dt.datetime.fromtimestamp(100, dt.UTC).replace(tzinfo=None), "A", "B"), (1, dt.datetime.fromtimestamp(130, dt.UTC).replace(tzinfo=None), "A", "C")], "row_id long, ts timestamp_ntz, src string, dst string")
    r = A.interevent_stats(rows).first()
    assert (r["mean_src"], r["std_src"]) == (65.0, 35.0)


def test_entity_types(spark):
    names = [("Corporation #7", "Corporation"), ("Sole Proprietorship #3", "Sole Proprietorship"), ("Bank Branch 9", "Bank Branch"), ("Solo", "Solo"), (None, "Unknown"), (" ", "Unknown")]
    df = spark.createDataFrame(names, "n string, e string")
    assert df.filter(X.entity_type(F.col("n")) != F.col("e")).count() == 0


def test_category_codes_and_null(tx):
    assert {r["fmt"]: r["code"] for r in G.category_codes(tx, "fmt").collect()} == {"ACH": 0, "Wire": 1, None: -1}
    hot = G.edge_features(tx, formats=["ACH", "Wire"], currencies=["x"])
    assert column(hot, "pf_Wire") == [1, 0, 0, 1, 1]


def test_standardise_modes(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in (1, 2, 3, 4)], "a double, b double")
    for mode in ("eps", "floor"):
        rows = X.standardise(df, ["a", "b"], mode).orderBy("a").collect()
        assert [round(r["a"], 3) for r in rows] == [-1.342, -0.447, 0.447, 1.342]
        assert {r["b"] for r in rows} == {0.0}


def test_null_safe_helpers(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (float("nan"),), (float("inf"),), (0.5,)], "x double")
    r = df.select(X.clip(F.col("x"), 0, 1).alias("c"), X.finite(F.col("x")).alias("f"), X.log1p_safe(F.col("x")).alias("l")).collect()
    assert r[0]["c"] is None and r[1]["c"] == 0 and r[4]["c"] == 0.5
    assert [v["f"] for v in r] == [0, -2, 0, 0, 0.5]
    assert r[1]["l"] == 0


def test_quantile_normaliser_without_positive_values(spark):
    df = spark.createDataFrame([(0,), (0,)], "x int")
    assert {r["x_n"] for r in X.q_norm(df, ["x"]).collect()} == {0.0}


def test_row_order_does_not_matter(tx, accounts, patterns):
    a = R.opportunity(tx, accounts, patterns).orderBy("row_id").collect()
    b = R.opportunity(tx.orderBy(F.desc("row_id")).repartition(7), accounts, patterns).orderBy("row_id").collect()
    assert a == b


def test_strain(tx, accounts):
    s = {r["acct"]: r for r in N.account_strain(tx).collect()}
    assert s["A"]["OutDegree"] == 3 and s["A"]["InDegree"] == 1 and s["C"]["TotalIn"] == 210
    assert s["A"]["TopPartnerConcentration"] == pytest.approx(400 / 600)
    e = {r["acct"]: r["NetworkStrainExposure"] for r in N.exposure(tx, N.account_strain(tx)).collect()}
    assert e["C"] == pytest.approx((s["A"]["ChronicStrainScore"] + 2 * s["C"]["ChronicStrainScore"]) / 3)
    assert column(N.transfer_strain(tx), "PaymentTypeStrain") == [0.8, 0.4, 0.4, 0.8, 0.8]
    assert N.accounts_with_strain(accounts, N.account_strain(tx)).filter("acct = 'D' and OutDegree = 0").count() == 1


def test_intensities_share_features_and_need_positives(spark, tx, accounts, patterns):
    scored = R.opportunity(tx, accounts, patterns)
    with pytest.raises(ValueError):
        R.intensity_labels(scored)
    rows = R.intensity_labels(scored, min_positives=2)
    assert rows.count() == 15 and rows.filter("RAT_injected = 1 and label = 0").count() == 0


def test_theory_columns():
    class T:
        columns = ["row_id", "RAT_score", "RAT_injected", "motif_chain"]

    assert G.theory_columns(T) == ["RAT_score", "motif_chain"]
    T.columns = ["row_id"]
    with pytest.raises(ValueError):
        G.theory_columns(T)


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,x,US Dollar,Reinvestment,\n")
    r = readers.read_transfers(spark, str(tmp_path / "t.csv")).first()
    assert (r["from_bank"], r["amt_paid"], r["label"], r["ts"]) == ("010", None, 0, dt.datetime(2022, 9, 1, 0, 20))
    (tmp_path / "p.txt").write_text(" A \n\nB\nA\n")
    assert readers.read_patterns(spark, str(tmp_path / "p.txt")).count() == 2
    built = []
    for _ in range(2):
        readers.cached_parquet(spark, str(tmp_path / "c"), lambda: built.append(1) or spark.range(3)).count()
    assert built == [1]
    (tmp_path / "i.csv").write_text("user,item,ts,label,f\n1,2,3.5,0.0,0.1,0.2\n")
    assert readers.read_interactions(spark, str(tmp_path / "i.csv")).first()["feats"] == [0.1, 0.2]
    line = "Epoch 003 | train_loss=0.5 val_loss=0.4 P=0.1 R=0.2 F1=0.3 ROC-AUC=0.9 AUPR=0.25 time=21.3s"
    log = readers.parse_log(spark.createDataFrame([(line,), (line.replace("003", "001").replace("0.25", "0.05"),), ("noise",)], "value string"))
    b = readers.best_epoch(log).first()
    assert (b["best_epoch"], b["last_epoch"], round(b["gain"], 6)) == (3, 3, 0.2)


def test_empty_transfers(spark, accounts, patterns):
    none = spark.createDataFrame([], SCHEMA)
    assert R.opportunity(none, accounts, patterns).count() == 0
    assert N.account_strain(none).count() == 0
    assert G.node_ids(none).count() == 0
