"""Ranking and classification metrics of predictions(edge_id, label, score). Scores are clipped to [0, 1].

All of them work on counts by distinct score or by threshold step, never on all rows in one task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import quantiles_by

from ..functions import exprs as X
from ..plans.work import running_totals

#: Thresholds tried for the best F1: so many points from .01 to .99.
GRID = 200


def clipped(pred: DataFrame) -> DataFrame:
    return pred.withColumn("score", X.clip(F.col("score"), 0.0, 1.0))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp; all 0 where labels and predictions together know one class only."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    one = clipped(pred).agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    single = ((F.col("tp") + F.col("fn") + F.col("fp")) == 0) | ((F.col("tn") + F.col("fp") + F.col("fn")) == 0)
    return one.select(*[F.when(single, F.lit(0)).otherwise(F.col(c)).alias(c) for c in ("tn", "fp", "fn", "tp")])


def threshold_metrics(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, specificity, balanced accuracy, Matthews correlation and Cohen's kappa; 0 on an empty denominator."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    one = clipped(pred).agg(*[F.count_if(c).cast("double").alias(n) for n, c in (("tn", ~hit & ~pos), ("fp", hit & ~pos), ("fn", ~hit & pos), ("tp", hit & pos))])
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return one.select(
        _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"), _div(tn, tn + fp).alias("specificity"),
        ((_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        _div((tp + tn) / n - chance, 1 - chance).alias("kappa"),
    )


def best_threshold(pred: DataFrame, grid: int = GRID) -> DataFrame:
    """threshold, f1: the first of the grid's thresholds with the largest F1. The grid's rows are few; predictions are counted once."""
    step = 0.98 / (grid - 1)
    k = F.floor((F.col("score") - 0.01) / step + 1e-9)
    point = lambda i: F.lit(0.01) + i * F.lit(step)
    k = F.when(F.col("score") < point(k), k - 1).when(F.col("score") >= point(k + 1), k + 1).otherwise(k)
    counts = clipped(pred).select(F.greatest(F.lit(-1), F.least(k, F.lit(grid - 1))).cast("int").alias("k"), "label").groupBy("k").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    steps = pred.sparkSession.range(-1, grid).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").na.fill(0)
    above = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select("k", F.sum("n").over(above).alias("said"), F.sum("p").over(above).alias("tp"), F.sum("p").over(Window.partitionBy()).alias("all_p")).filter("k >= 0")
    f1 = _div(2.0 * F.col("tp"), F.col("said") + F.col("all_p"))
    return rows.select(point(F.col("k")).alias("t"), f1.alias("f"), "k").agg(F.max_by("t", F.struct("f", -F.col("k"))).alias("threshold"), F.max("f").alias("f1"))


def by_score(pred: DataFrame) -> DataFrame:
    """score, n, p and how many rows and positives score less: one row for each distinct score."""
    counts = clipped(pred).groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    return running_totals(counts, "score", ["n", "p"])


def ranking_metrics(pred: DataFrame) -> DataFrame:
    """roc_auc (ties count half, null with one class) and average_precision (stepwise)."""
    rows = by_score(pred)
    total = rows.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    rows = rows.crossJoin(F.broadcast(total))
    P, N = F.col("all_p").cast("double"), F.col("all_n").cast("double")
    tp, said = P - F.col("below_p"), N - F.col("below_n")
    one = rows.agg(F.sum(F.col("p") * (F.col("below_n") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum(_div(F.col("p"), P) * tp / said).alias("ap"), F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    auc = F.try_divide(F.col("ranks") - P * (P + 1) / 2, P * (N - P))
    return one.select(auc.alias("roc_auc"), F.col("ap").alias("average_precision"))


def precision_at(pred: DataFrame, ks: tuple[int, ...] = (100, 500, 1000)) -> DataFrame:
    """k, precision for each k that there are rows for: the highest scores, ties by edge_id."""
    top = clipped(pred).orderBy(F.desc("score"), "edge_id").limit(max(ks))
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "edge_id")))
    wanted = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return ranked.select("r", "label", wanted).filter("r <= k").groupBy("k").agg(F.count("*").alias("n"), F.avg("label").alias("precision")).filter("n = k").select("k", "precision")


def curve_points(pred: DataFrame) -> DataFrame:
    """score, tpr, fpr, precision, recall at each distinct score as threshold."""
    rows = by_score(pred)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))))
    tp, said = F.col("all_p") - F.col("below_p"), F.col("all_n") - F.col("below_n")
    return rows.select("score", _div(tp, F.col("all_p")).alias("tpr"), _div(said - tp, F.col("all_n") - F.col("all_p")).alias("fpr"), _div(tp, said).alias("precision"), _div(tp, F.col("all_p")).alias("recall"))


def batch_metrics(pred: DataFrame, batch: str = "batch") -> DataFrame:
    """Means over batches of AUC and average precision within a batch; batches are small, so each is ranked by a window."""
    w = Window.partitionBy(batch)
    counts = clipped(pred).groupBy(batch, "score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    below = w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.select(batch, "n", "p", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("bn"), F.coalesce(F.sum("p").over(below), F.lit(0)).alias("bp"), F.sum("n").over(w).alias("all_n"), F.sum("p").over(w).alias("all_p"))
    P, N = F.col("all_p").cast("double"), F.col("all_n").cast("double")
    one = rows.groupBy(batch, "all_p", "all_n").agg(F.sum(F.col("p") * (F.col("bn") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum(_div(F.col("p"), P) * (P - F.col("bp")) / (N - F.col("bn"))).alias("ap"))
    return one.select(F.try_divide(F.col("ranks") - P * (P + 1) / 2, P * (N - P)).alias("auc"), "ap").agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))


def evaluate(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of all metrics at a threshold."""
    return confusion(pred, threshold).crossJoin(threshold_metrics(pred, threshold)).crossJoin(ranking_metrics(pred))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """bin, n, density over [low, high]; the top edge belongs to the last bin."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")
    rows = df.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(b).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("_t"))
    return rows.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("_t") * width)).alias("density"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, cdf: share of rows at or below each distinct value."""
    rows = running_totals(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", ["n"])
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("_t")))).select("value", ((F.col("below_n") + F.col("n")) / F.col("_t")).alias("cdf"))


def pos_weight(pred: DataFrame, cap: float = 100.0) -> DataFrame:
    p = F.sum("label")
    return pred.agg(F.least((F.count("*") - p) / F.greatest(p, F.lit(1)), F.lit(cap)).alias("pos_weight"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr for each pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (sample), min, q25, q50, q75, max of numeric columns; nulls are left out, quantiles are exact."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    base = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles_by(long, "column", "v", [0.25, 0.5, 0.75]).groupBy("column")
    q = q.agg(*[F.max(F.when(F.col("share") == x, F.col("quantile"))).alias(name) for x, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return base.join(q, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """value (null is one too) and n, its number of rows."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def early_stop(log: DataFrame, value: str, max_round: int = 3, higher_better: bool = True, tolerance: float = 1e-10) -> DataFrame:
    """best_epoch and stop_epoch (null if never) of a training log with an epoch column.

    An epoch improves if its value exceeds the last improving one by more than ``tolerance`` of its size; after
    ``max_round`` epochs in a row without, training stops. One row an epoch: the log is short and is read in order.
    """
    rows = F.sort_array(F.collect_list(F.struct("epoch", (F.col(value) if higher_better else -F.col(value)).cast("double").alias("v"))))
    null = F.lit(None)
    start = F.struct(null.cast("double").alias("best"), null.cast("long").alias("at"), F.lit(0).alias("rounds"), null.cast("long").alias("stop"))

    def step(acc, x):
        better = acc["best"].isNull() | ((x["v"] - acc["best"]) / F.abs(acc["best"]) > tolerance)
        rounds = F.when(better, F.lit(0)).otherwise(acc["rounds"] + 1)
        epoch = x["epoch"].cast("long")
        moved = F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), F.when(better, epoch).otherwise(acc["at"]).alias("at"), rounds.alias("rounds"), F.when(rounds >= max_round, epoch).alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(moved)

    return log.agg(F.aggregate(rows, start, step).alias("r")).select(F.col("r.at").alias("best_epoch"), F.col("r.stop").alias("stop_epoch"))


def align(left: DataFrame, right: DataFrame, key: str = "edge_id", trim: bool = False) -> DataFrame:
    """Rows of two prediction or label tables that belong together, by id and never by position. Ids that repeat, and, unless
    they are trimmed away, ids that one side lacks are an error."""
    for name, side in (("left", left), ("right", right)):
        again = side.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        if again:
            raise ValueError(f"the {name} table repeats ids")
    if not trim:
        one, two = F.lit(1), F.lit(2)
        both = left.select(key, one.alias("_w")).unionAll(right.select(key, two.alias("_w"))).groupBy(key).agg(F.sum("_w").alias("_w"))
        lost = both.agg(F.count_if(F.col("_w") == 1).alias("left"), F.count_if(F.col("_w") == 2).alias("right")).first()
        if lost["left"] or lost["right"]:
            raise ValueError(f"{lost['left']} rows are only left and {lost['right']} only right")
    return left.join(right, key)


def checked(pred: DataFrame) -> DataFrame:
    """pred with label as 0 or 1 and score within [0, 1], for metrics. A score may be an array of one number or of two, whose
    second is that of class 1. No row, a null, a label other than 0 and 1, or another array is an error; one class only is
    a warning, as some metrics are undefined then."""
    score = F.col("score")
    if pred.schema["score"].dataType.typeName() == "array":
        score = F.when(F.size(score).isin(1, 2), F.element_at(score, -1))
    rows = pred.withColumns({"score": score.cast("double"), "label": F.col("label").cast("int")})
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"), F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True))).alias("odd"), F.countDistinct("label").alias("classes")).first()
    if not one["n"]:
        raise ValueError("there are no predictions")
    if one["bad"] or one["odd"]:
        raise ValueError(f"{one['bad']} scores are no number or of another shape, {one['odd']} labels are not 0 or 1")
    if one["classes"] < 2:
        warnings.warn("only one class: some metrics are undefined", stacklevel=2)
    return clipped(rows)
