"""Opportunity scores: offender, target and guardian parts, degree proxies of motifs, and intensity labels.

Column names keep the prefixes (RAT_, motif_) by which graph builders find theory features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.work import materialize, quantile_row
from ..sources.readers import one_per_account

#: Share of positive transfers that each intensity marks, and its level.
INTENSITIES = {"low": (0.15, 1), "medium": (0.30, 2), "high": (0.60, 3)}
EPS = X.EPS


def mutual_pairs(tx: DataFrame) -> DataFrame:
    """src, dst of which money also flows back; a self-loop is its own way back."""
    pairs = tx.select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi")


def mutual_flag(tx: DataFrame) -> DataFrame:
    pairs = mutual_pairs(tx).withColumn("_m", F.lit(1))
    return tx.select("row_id", "src", "dst").join(pairs, ["src", "dst"], "left").select("row_id", F.coalesce("_m", F.lit(0)).alias("RAT_mutual_flag"))


def entity_sizes(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.countDistinct("acct").alias("n_accounts"))


def raw_features(tx: DataFrame, accounts: DataFrame, patterns: DataFrame, allow_fanout: bool = False) -> DataFrame:
    """Every transfer with its counts, flags and z-scores, before global scaling.

    allow_fanout joins accounts as they are, so that a repeated account multiplies transfers.
    """
    src = tx.groupBy("src").agg(F.countDistinct("dst").alias("src_out_degree"), F.avg("amt_paid").alias("_sm"), F.stddev_samp("amt_paid").alias("_ss"))
    dst = tx.groupBy("dst").agg(F.countDistinct("src").alias("dst_in_degree"), F.avg("amt_rec").alias("_dm"), F.stddev_samp("amt_rec").alias("_ds"), F.min("ts").alias("_df"))
    # A transfer without time is on a day of its own, so that it meets its accounts; it counts on no day.
    timed = lambda c: F.when(F.col("ts").isNotNull(), F.col(c))
    tx = tx.withColumn("_day", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")))
    s_day = tx.groupBy("src", "_day").agg(F.count(timed("amt_paid")).alias("src_burst"))
    d_day = tx.groupBy("dst", "_day").agg(F.count(timed("amt_rec")).alias("dst_burst"))
    acct = accounts if allow_fanout else one_per_account(accounts)
    acct = acct.join(entity_sizes(accounts), "entity_id", "left").select("acct", "entity_id", F.coalesce("n_accounts", F.lit(1)).alias("n"))
    flagged = patterns.select("acct").distinct().withColumn("_p", F.lit(1))
    # What an account has goes to its days first, so that transfers are dealt out once for each end.
    side = lambda df, p: df.select("acct", *[F.col(c).alias(f"_{p}_{c}") for c in df.columns if c != "acct"])
    has = lambda df, k, p: df.withColumn("acct", F.col(k)).join(side(acct, p), "acct", "left").join(side(flagged, p), "acct", "left").drop("acct")
    sent = has(s_day.join(src, "src", "left"), "src", "s")
    got = d_day.join(dst, "dst", "left").join(src.select(F.col("src").alias("dst"), F.col("src_out_degree").alias("dst_out_degree")), "dst", "left")
    got = has(got, "dst", "d")
    rows = tx.join(sent, ["src", "_day"], "left").join(got, ["dst", "_day"], "left")
    rows = rows.join(mutual_pairs(tx).withColumn("_m", F.lit(1)), ["src", "dst"], "left")
    rows = rows.withColumns({k: timed(k) for k in ("src_burst", "dst_burst")})
    c, zero = F.col, F.lit(0)
    return rows.select(
        "row_id", "label", "src",
        X.off_hours(c("ts")).alias("RAT_is_off_hours"), X.weekend(c("ts")).alias("RAT_is_weekend"), X.cross(c("from_bank"), c("to_bank")).alias("RAT_is_cross_bank"),
        X.clip(X.safe_z(c("amt_paid"), c("_sm"), c("_ss")), low=0.0).alias("RAT_src_amount_z_pos"),
        X.clip(X.safe_z(c("amt_rec"), c("_dm"), c("_ds")), low=0.0).alias("RAT_dst_amount_z_pos"),
        F.coalesce("src_out_degree", zero).alias("out_degree"), F.coalesce("dst_in_degree", zero).alias("in_degree"), F.coalesce("dst_out_degree", zero).alias("dst_out"),
        F.coalesce("src_burst", zero).alias("src_burst"), F.coalesce("dst_burst", zero).alias("dst_burst"), (F.coalesce("src_burst", zero) + F.coalesce("dst_burst", zero)).alias("both_burst"),
        X.same(c("_s_entity_id"), c("_d_entity_id")).alias("RAT_same_entity"),
        F.coalesce("_s_n", F.lit(1)).alias("RAT_src_entity_accounts"), F.coalesce("_d_n", F.lit(1)).alias("RAT_dst_entity_accounts"),
        F.coalesce("_s__p", zero).alias("RAT_src_pattern_flag"), F.coalesce("_d__p", zero).alias("RAT_dst_pattern_flag"), F.coalesce("_m", zero).alias("RAT_mutual_flag"),
        ((X.epoch(c("ts")) - X.epoch(c("_df"))) / 86400.0).alias("dst_age_days"),
    )


SCALED = {"out_degree": "RAT_src_out_deg_norm", "in_degree": "RAT_dst_in_deg_norm", "dst_out": "dst_out_deg_norm", "src_burst": "RAT_src_burst_norm", "dst_burst": "RAT_dst_burst_norm", "both_burst": "RAT_combined_burst", "RAT_src_entity_accounts": "RAT_src_entity_acct_norm", "RAT_dst_entity_accounts": "RAT_dst_entity_acct_norm", "dst_age_days": "_age_norm"}


def opportunity(tx: DataFrame, accounts: DataFrame, patterns: DataFrame, allow_fanout: bool = False) -> DataFrame:
    """All opportunity and motif columns of each transfer, and its src. A part whose z-score is null is null, and its score 0."""
    rows = X.q_norm(materialize(raw_features(tx, accounts, patterns, allow_fanout), "raw-features"), list(SCALED))
    rows = rows.withColumnsRenamed({f"{k}_n": v for k, v in SCALED.items()})
    c = F.col
    rows = rows.withColumns({
        "motif_fanin": c("RAT_dst_in_deg_norm"), "motif_fanout": c("RAT_src_out_deg_norm"), "motif_chain": F.sqrt(c("RAT_dst_in_deg_norm") * c("dst_out_deg_norm")),
        "motif_cycle": 0.5 * c("RAT_mutual_flag") + 0.3 * c("RAT_same_entity") + 0.2 * c("RAT_combined_burst"),
        "RAT_offender_score": 0.30 * c("RAT_src_amount_z_pos") + 0.20 * c("RAT_src_out_deg_norm") + 0.20 * c("RAT_src_burst_norm") + 0.10 * c("RAT_is_off_hours") + 0.10 * c("RAT_src_pattern_flag") + 0.10 * c("RAT_src_entity_acct_norm"),
        "RAT_target_score": 0.35 * c("RAT_dst_amount_z_pos") + 0.25 * c("RAT_dst_in_deg_norm") + 0.15 * (1 - c("_age_norm")) + 0.15 * c("RAT_dst_entity_acct_norm") + 0.10 * c("RAT_dst_pattern_flag"),
        "RAT_guardian_weakness_score": 0.30 * c("RAT_is_off_hours") + 0.20 * c("RAT_is_weekend") + 0.20 * c("RAT_is_cross_bank") + 0.20 * c("RAT_combined_burst") + 0.10 * c("RAT_same_entity"),
    })
    product = (c("RAT_offender_score") + EPS) * (c("RAT_target_score") + EPS) * (c("RAT_guardian_weakness_score") + EPS)
    score = F.least(F.greatest(F.coalesce(F.nullif(F.pow(product, F.lit(1 / 3)), F.lit(float("inf"))), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("RAT_score", score).drop("out_degree", "in_degree", "dst_out", "src_burst", "dst_burst", "both_burst", "dst_age_days", "_age_norm")


def thresholds(scored: DataFrame) -> DataFrame:
    """intensity, level, threshold: the score above which each intensity marks positive transfers."""
    names = list(INTENSITIES)
    one = quantile_row(scored.filter("label = 1"), {n: (F.col("RAT_score"), 1 - INTENSITIES[n][0]) for n in names})
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("intensity"), F.lit(INTENSITIES[n][1]).alias("level"), F.col(n).alias("threshold")) for n in names]))
    return one.select(rows.alias("r")).select("r.*")


def intensity_labels(scored: DataFrame, min_positives: int = 10) -> DataFrame:
    """Each transfer once an intensity, with RAT_injected and RAT_intensity_level; features are the same in all three."""
    scored = materialize(scored, "scored")
    if scored.filter("label = 1").limit(min_positives).count() < min_positives:
        raise ValueError(f"fewer than {min_positives} positive transfers")
    rows = scored.crossJoin(F.broadcast(thresholds(scored)))
    hit = ((F.col("label") == 1) & (F.col("RAT_score") >= F.col("threshold"))).cast("int")
    return rows.withColumn("RAT_injected", hit).withColumn("RAT_intensity_level", hit * F.col("level"))


def intensity_drift(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Means and sample deviations of score columns of the marked transfers, by intensity."""
    return labelled.filter("RAT_injected = 1").groupBy("intensity").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_samp))])


def guardian_ranking(tx: DataFrame, accounts: DataFrame, patterns: DataFrame, k: int = 20) -> DataFrame:
    """The accounts whose outgoing transfers are the least guarded, on average."""
    rows = opportunity(tx, accounts, patterns).select("src", "RAT_guardian_weakness_score", "RAT_src_burst_norm")
    found = rows.groupBy("src").agg(F.round(F.avg("RAT_guardian_weakness_score"), 6).alias("weakness"), F.round(F.avg("RAT_src_burst_norm"), 6).alias("burst"), F.count("*").alias("n"))
    return found.orderBy(F.desc("weakness"), "src").limit(k)
