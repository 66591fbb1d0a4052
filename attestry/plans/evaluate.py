"""M8: the quality report, one row per metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import metrics as M

KEYS = ["candidate_id", "type", "text"]


def _row(df: DataFrame, metric: str, target: float | None, *, at_least: bool = True) -> DataFrame:
    met = F.lit(None).cast("boolean")
    if target is not None:
        met = F.col("value") >= target if at_least else F.col("value") <= target
    interval = [
        (F.col(c) if c in df.columns else F.lit(None).cast("double")).cast("double").alias(c)
        for c in ("lo", "hi")
    ]
    return df.select(
        F.lit(metric).alias("metric"),
        F.col("value").cast("double").alias("value"),
        *interval,
        F.col("n").cast("long").alias("n"),
        F.lit(target).cast("double").alias("target"),
        met.alias("met"),
    )


def evaluate(
    predicted: DataFrame, truth: DataFrame, candidates: DataFrame, runs: DataFrame, *,
    reps: int = 1000,
) -> DataFrame:
    """predicted(candidate_id, claim_no, type, text, status, confidence), truth(candidate_id,
    claim_no, type, text, gt), candidates(candidate_id, kind, genuine), runs(candidate_id,
    variant, band, authenticity, reliability)."""
    counts = M.match_counts(predicted, truth, KEYS)
    units = counts.groupBy("candidate_id").agg(
        (F.sum("matched") * 2).alias("num"),
        (F.sum("matched") * 2 + F.sum("missed") + F.sum("extra")).alias("den"),
    )
    f1 = M.bootstrap_ci(units, "num", "den", reps=reps).withColumnRenamed("n_units", "n")

    pairs = M.match_pairs(
        predicted.select(*KEYS, "claim_no", "status", "confidence"),
        truth.select(*KEYS, "claim_no", "gt"),
        KEYS,
        "claim_no",
    ).where("gt IS NOT NULL")
    matrix = M.confusion(pairs, "gt", "status")
    macro = M.macro_f1(matrix, "gt", "status").select(
        F.col("macro_f1").alias("value"), F.col("labels").alias("n")
    )
    overall = M.accuracy(matrix, "gt", "status").select(F.col("accuracy").alias("value"), "n")
    judged = pairs.where("status <> 'UNVERIFIABLE'")
    ece = M.expected_calibration_error(
        M.calibration_bins(judged, "confidence", F.col("gt") == F.col("status"))
    ).select(F.col("ece").alias("value"), "n")

    primary = runs.where("variant = 'primary'").join(candidates, "candidate_id")
    flagged = F.col("band") == "NEEDS_VERIFICATION"
    genuine = primary.where("genuine").select(
        flagged.cast("int").alias("num"), F.lit(1).alias("den")
    )
    accusation = M.bootstrap_ci(genuine, "num", "den", reps=reps).withColumnRenamed("n_units", "n")
    ranked = M.auroc(
        primary.where("kind IN ('genuine', 'P1', 'P2', 'P4', 'P5')"),
        "authenticity",
        F.col("kind") == "genuine",
    ).select(F.col("auroc").alias("value"), (F.col("n_pos") + F.col("n_neg")).alias("n"))
    open_band = primary.where("kind = 'P6'").select(
        (F.col("band") == "INSUFFICIENT_EVIDENCE").cast("int").alias("num"), F.lit(1).alias("den")
    )
    insufficient = M.bootstrap_ci(open_band, "num", "den", reps=reps).withColumnRenamed(
        "n_units", "n"
    )
    flagged_runs = runs.withColumn("flagged", F.col("band") == "NEEDS_VERIFICATION")
    gaps = [
        _row(
            M.paired_gap(
                flagged_runs.join(candidates.where("genuine"), "candidate_id", "left_semi"),
                "candidate_id", "variant", "primary", variant, flag="flagged", score="reliability",
            ).select(F.abs(F.col(column)).alias("value"), "n"),
            name,
            target,
            at_least=at_least,
        )
        for name, variant, column, target, at_least in (
            ("fairness gap, second wording (pp)", "nonnative", "gap_pp", 5.0, False),
            ("fairness gap, private work (pp)", "private", "gap_pp", 5.0, False),
            ("mean reliability change after truthful rewording", "p3", "mean_delta", 0.05, False),
            ("name-swap invariance", "nameswap", "identical", 1.0, True),
            ("determinism", "repeat", "identical", 1.0, True),
        )
    ]
    rows = [
        _row(f1, "claim extraction F1", 0.85),
        _row(macro, "claim status macro-F1", 0.75),
        _row(overall, "claim status accuracy", None),
        _row(ece, "calibration error, judged claims", 0.10, at_least=False),
        _row(accusation, "false-accusation rate", 0.05, at_least=False),
        _row(insufficient, "private work reported as insufficient evidence", 0.95),
        _row(ranked, "AUROC, genuine against perturbed", 0.85),
        *gaps,
    ]
    return reduce(DataFrame.unionByName, rows)
