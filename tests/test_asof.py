"""Previous values and running counts within a key, range of time by range of time."""

import random

import pytest
from pyspark.sql import functions as F

from tallygraph.operators import accounts, temporal
from tallygraph.plans import asof

from test_splits_metrics_temporal import at


def hub_rows(n=1500, seed=3):
    """Half of all rows are of key 1; some keys and times are null, many times are equal."""
    r = random.Random(seed)
    return [(i, r.choice([None, *range(9)]) if r.random() < 0.5 else 1, None if r.random() < 0.02 else r.randint(0, 400), r.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 7, 512])
def test_equal_to_one_pass_over_each_key(spark, ranges):
    rows = hub_rows()
    df = spark.createDataFrame(rows, "row_id long, k int, t long, v int").repartition(4)
    placed = asof.in_ranges(df, F.col("t"), ranges=ranges)
    before = {r["row_id"]: r["p"] for r in asof.previous(placed, "k", ["t", "row_id"], "v", "p").collect()}
    count = {r["row_id"]: r["n"] for r in asof.running(placed, "k", ["t", "row_id"], "v", "n").collect()}
    assert len(before) == len(count) == len(rows)
    last, total = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0])):
        assert before[i] == last.get(k)
        last[k] = v
        if v is not None:
            total[k] = total.get(k, 0) + v
        assert count[i] == total.get(k, 0)


def test_a_hub_is_spread_over_tasks(spark):
    """Of a hub with half of all rows, no window has more than a few hundredths of them."""
    df = spark.createDataFrame([(i, 1 if i % 2 else i, i * 60) for i in range(20_000)], "row_id long, k long, t long")
    placed = asof.in_ranges(df, F.col("t"))
    largest = placed.groupBy("k", "_range").count().agg(F.max("count")).first()[0]
    assert largest <= 20_000 / 2 / 512 + 2
    plan = asof.previous(placed, "k", ["t", "row_id"], "t", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "row_number()" in line and "Window" in line)


def test_carried_values_need_no_join(spark):
    """What is carried into a range comes as one more row of the same shuffle; rows are not dealt out again for a join."""
    placed = asof.in_ranges(spark.createDataFrame([(i, i % 5, i * 60, 1) for i in range(100)], "row_id long, k long, t long, v int"), F.col("t"))
    for df in (asof.previous(placed, "k", ["t", "row_id"], "v", "p"), asof.running(placed, "k", ["t", "row_id"], "v", "n")):
        assert df.columns == [*placed.columns, df.columns[-1]]
        assert "LeftOuter" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_tables_are_rounded_as_narrow_ones(spark):
    """Many columns go through one array, whole numbers without decimals' arithmetic, with the results of one round a column."""
    from tallygraph.plans.queries import r6

    numbers = [0.0, -0.0, 1.5, 2.0000005, -2.0000005, 1e300, None, float("nan"), float("inf"), -7.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    wide = r6(df.select("i", *[F.col("x").alias(f"x{k}") for k in range(14)]))
    assert "transform" in wide._jdf.queryExecution().optimizedPlan().toString()
    assert wide.dtypes == [("i", "bigint"), *[(f"x{k}", "double") for k in range(14)]]
    got, want = wide.orderBy("i").collect(), r6(df).orderBy("i").collect()
    assert [str(r["x13"]) for r in got] == [str(r["x"]) for r in want]


def test_gaps_and_neighbours_of_a_hub_equal_brute_force(spark):
    r = random.Random(9)
    rows = [(i, at(r.randint(0, 3000)), 1 if r.random() < 0.5 else r.randint(0, 9), r.randint(0, 9)) for i in range(800)]
    tx = spark.createDataFrame(rows, "row_id long, ts timestamp_ntz, src long, dst long")
    seconds = {i: int((t - at(0)).total_seconds()) for i, t, _, _ in rows}
    last, want = {}, {}
    for i, _, s, d in sorted(rows, key=lambda x: (x[1], x[0])):
        want[i] = tuple(seconds[i] - last.get(key, seconds[i]) for key in (("s", s), ("d", d)))
        last["s", s] = last["d", d] = seconds[i]
    assert {x["row_id"]: (x["gap_src"], x["gap_dst"]) for x in accounts.gaps(tx).collect()} == want
    probes = [(n, t) for n in (1, 2, 77) for t in (-5, 0, 1500, 9000)]
    got = {(x["node"], x["t"], x["rank"]): (x["nbr_t"], x["edge_id"], x["nbr"]) for x in temporal.neighbours(tx, spark.createDataFrame(probes, "node long, t long"), 4).collect()}
    adj = [(s, (seconds[i], i, d)) for i, _, s, d in rows] + [(d, (seconds[i], i, s)) for i, _, s, d in rows]
    for n, t in probes:
        best = sorted((e for m, e in adj if m == n and e[0] < t), reverse=True)[:4]
        assert [got.get((n, t, k + 1)) for k in range(4)] == best + [None] * (4 - len(best))
