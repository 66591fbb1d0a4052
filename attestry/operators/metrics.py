"""How good are the results?

Truth and predictions are tables.  Everything that could gather a hot group is reduced to counts
before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import lexicons as L
from attestry.functions.limits import first_chars, first_rows
from attestry.functions.rounding import round_even
from attestry.functions.text import lookup

STATUSES = tuple(L.CLAIM_STATUS_VALUE)


def ratio_of(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


# --- extraction ---------------------------------------------------------------------------


def match_counts(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset match per key as counts (matched, missed, extra)."""
    p = predicted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p"))
    t = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    both = p.join(t, keys, "full_outer").fillna(0, ["_p", "_t"])
    matched = F.least("_p", "_t")
    return both.select(
        *keys,
        matched.alias("matched"),
        (F.col("_t") - matched).alias("missed"),
        (F.col("_p") - matched).alias("extra"),
    )


def match_pairs(
    predicted: DataFrame, truth: DataFrame, keys: list[str], order: str
) -> DataFrame:
    """J22 with the rows themselves: the n-th of a key meets the n-th.  `keys` start with the
    candidate, so a group is the repeats of one sentence in one resume."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = predicted.withColumn("_n", F.row_number().over(w)).drop(order)
    t = truth.withColumn("_n", F.row_number().over(w)).drop(order)
    return p.join(t, [*keys, "_n"]).drop("_n")


def precision_recall(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A15 over match counts, overall or per group."""
    out = counts.groupBy(*(by or [])).agg(
        F.sum("matched").alias("tp"), F.sum("extra").alias("fp"), F.sum("missed").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        out.withColumn("precision", ratio_of(tp, tp + fp))
        .withColumn("recall", ratio_of(tp, tp + fn))
        .withColumn("f1", ratio_of(2 * tp, 2 * tp + fp + fn))
    )


# --- classification -----------------------------------------------------------------------


def confusion(pairs: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """A16, long form: (by, truth, predicted, n)."""
    return pairs.where(F.col(truth).isNotNull()).groupBy(*(by or []), truth, predicted).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    pairs: DataFrame, truth: str, predicted: str, labels: list
) -> DataFrame:
    """A16, wide form: one row per true label, one column per predicted label."""
    long = confusion(pairs, truth, predicted)
    return long.groupBy(truth).pivot(predicted, labels).agg(F.sum("n")).fillna(0)


def accuracy(matrix: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return matrix.groupBy(*(by or [])).agg(
        F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("correct"),
        F.sum("n").alias("n"),
    ).withColumn("accuracy", F.col("correct") / F.col("n"))


def label_f1(matrix: DataFrame, truth: str, predicted: str) -> DataFrame:
    """F1 of every label that occurs at all, from the long matrix."""
    sides = F.array(
        F.struct(F.col(truth).alias("label"), F.lit("t").alias("side")),
        F.struct(F.col(predicted).alias("label"), F.lit("p").alias("side")),
    )
    hit = F.col(truth) == F.col(predicted)
    return (
        matrix.select("n", hit.alias("_hit"), F.explode(sides).alias("s"))
        .groupBy(F.col("s.label").alias("label"))
        .agg(
            F.sum(F.when(F.col("_hit") & (F.col("s.side") == "t"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(~F.col("_hit"), F.col("n")).otherwise(0)).alias("wrong"),
        )
        .withColumn("f1", F.col("tp") * 2 / (F.col("tp") * 2 + F.col("wrong")))
    )


def macro_f1(matrix: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A17."""
    return label_f1(matrix, truth, predicted).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("labels")
    )


# --- ranking ------------------------------------------------------------------------------


def running_total(
    df: DataFrame, order: str, value: str, out: str, by: list[str] | None = None, *,
    buckets: int = 64,
) -> DataFrame:
    """Exclusive running sum of `value` in `order`, without one task seeing all rows.

    `df` holds one row per (by, order).  Rows are cut into `buckets` ranges of `order` at
    approximate quantiles (a bounded list of numbers fetched once); sums per range are totalled
    on their own small table, and only the rows of one range meet in a window.
    """
    by = by or []
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.stat.approxQuantile(order, probs, 0.5 / buckets)))
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else None
    bucket = (
        F.size(F.filter(bounds, lambda b: b <= F.col(order).cast("double")))
        if bounds is not None
        else F.lit(0)
    )
    cut = df.withColumn("_bucket", bucket)
    sums = cut.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(offsets.drop("_sum"), [*by, "_bucket"])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_bucket", "_offset")
    )


def auroc(
    scores: DataFrame, score: str, positive: Column, by: list[str] | None = None
) -> DataFrame:
    """Rank statistic with ties at their average rank.

    Rows collapse to counts per distinct score first, so ties, however many, cost one row.
    """
    by = by or []
    counted = (
        scores.where(F.col(score).isNotNull())
        .groupBy(*by, score)
        .agg(
            F.count(F.when(positive, 1)).alias("_pos"), F.count(F.when(~positive, 1)).alias("_neg")
        )
    )
    ranked = running_total(counted, score, "_neg", "_below", by)
    area = F.sum((F.col("_below") + F.col("_neg") / 2) * F.col("_pos"))
    return (
        ranked.groupBy(*by)
        .agg(area.alias("_u"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
        .withColumn("auroc", ratio_of(F.col("_u"), F.col("n_pos") * F.col("n_neg")))
        .drop("_u")
    )


def calibration_bins(rows: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Reliability diagram rows."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int"))
    return rows.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(confidence).alias("mean_confidence"),
        F.avg(correct.cast("int")).alias("accuracy"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


# --- uncertainty --------------------------------------------------------------------------


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    """Standard normal quantile by a rational approximation (relative error below 1e-4)."""
    tail = np.minimum(u, 1 - u)
    t = np.sqrt(-2 * np.log(np.maximum(tail, 1e-300)))
    top = 2.515517 + 0.802853 * t + 0.010328 * t * t
    low = 1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3
    return np.where(u < 0.5, -1, 1) * (t - top / low)


def _poisson(u: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The Poisson(lam) quantiles of uniform values, element by element."""
    z = _normal_quantile(u)
    out = np.maximum(np.round(lam + np.sqrt(lam) * z + (z * z - 1) / 6), 0)
    small = lam <= 64
    if small.any():
        us, ls = u[small], lam[small]
        p = np.exp(-ls)
        acc, k = p.copy(), np.zeros(len(ls))
        open_ = acc < us
        step = 0
        while open_.any() and step < 400:
            step += 1
            p = p * ls / step
            acc = np.where(open_, acc + p, acc)
            k = np.where(open_, k + 1, k)
            open_ = open_ & (acc < us)
        out[small] = k
    return out


def _uniform(seeds: np.ndarray, reps: int) -> np.ndarray:
    """A value in (0, 1) for each seed and replica, a pure function of both."""
    x = seeds.view(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) + 0.5) / float(1 << 53)


DRAWN_AT_ONCE = 1 << 18  # weights
GROUPS_AT_ONCE = 500


def _replica_sums(reps: int):
    """Of each group in a task the weighted sums of all replicas, as two arrays."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def told() -> pd.DataFrame:
            done = pd.DataFrame({"k": list(sums), "a": [x[0] for x in sums.values()], "b": [x[1] for x in sums.values()]})
            sums.clear()
            return done

        rows = max(1, DRAWN_AT_ONCE // reps)
        for frame in frames:
            for k, part in frame.groupby("k", sort=False):
                total = sums.setdefault(k, np.zeros((2, reps)))
                pair = part[["num", "den"]].to_numpy("float64").T
                seeds, counts = part["h"].to_numpy("int64"), part["n"].to_numpy("float64")
                for at in range(0, len(part), rows):
                    u = _uniform(seeds[at : at + rows], reps)
                    lam = np.repeat(counts[at : at + rows], reps)
                    total += pair[:, at : at + rows] @ _poisson(u.ravel(), lam).reshape(u.shape)
                if len(sums) >= GROUPS_AT_ONCE:
                    yield told()
        if sums:
            yield told()

    return fold


def bootstrap_ci(
    units: DataFrame, numerator: str, denominator: str, by: list[str] | None = None, *,
    reps: int = 1000, seed: int = 7, low: float = 0.025, high: float = 0.975,
) -> DataFrame:
    """Percentile interval of sum(numerator) / sum(denominator) over resampled units.

    Resampling with independent Poisson(1) weights; units that look alike are drawn together
    (n of them have a Poisson(n) weight in total).  A task adds up the weighted sums of all
    replicas as one vector for each group; only these vectors cross a shuffle, so neither memory
    nor rows grow with units × replicas, whether values repeat or not.
    """
    if not by:
        whole = bootstrap_ci(
            units.withColumn("_all", F.lit("all")), numerator, denominator, ["_all"],
            reps=reps, seed=seed, low=low, high=high,
        )
        return whole.drop("_all")
    # one text for a group's key, so that nulls and types survive the way through Python
    key = F.to_json(F.struct(*by)).alias("k")
    num, den = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(x) for c, x in ((numerator, "num"), (denominator, "den")))
    alike = units.select(key, num, den).groupBy("k", "num", "den").agg(F.count(F.lit(1)).alias("n"))
    seeded = alike.withColumn("h", F.xxhash64(F.lit(seed), "k", "num", "den"))
    sums = seeded.mapInPandas(_replica_sums(reps), "k string, a array<double>, b array<double>")
    stats = (
        sums.select("k", F.posexplode(F.arrays_zip("a", "b")).alias("rep", "s"))
        .groupBy("k", "rep")
        .agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"))
        .where("b > 0")
    )
    ordered = stats.groupBy("k").agg(F.array_sort(F.collect_list(F.col("a") / F.col("b"))).alias("_v"))

    def at(q: float) -> Column:
        return F.get("_v", round_even((F.size("_v") - 1) * F.lit(q), 0).cast("int"))

    point = units.groupBy(*by).agg(
        ratio_of(F.sum(numerator), F.sum(denominator)).alias("value"),
        F.count(F.lit(1)).alias("n_units"),
    )
    intervals = ordered.select(F.col("k").alias("_key"), at(low).alias("lo"), at(high).alias("hi"))
    return point.withColumn("_key", key).join(intervals, "_key", "left").drop("_key")


# --- detection, fairness, errors ----------------------------------------------------------


def detection_recall(cases: DataFrame, kind: str, subtype: str, hit: Column) -> DataFrame:
    """Recall per kind, per (kind, subtype) and overall."""
    return cases.rollup(kind, subtype).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("hits")
    ).withColumn("recall", F.col("hits") / F.col("n"))


def false_flag_rates(genuine: DataFrame, flagged: Column, combination: Column) -> DataFrame:
    """Flag rate per combination of sources."""
    return genuine.groupBy(combination.alias("sources")).agg(
        F.sum(flagged.cast("int")).alias("flagged"), F.count(F.lit(1)).alias("n")
    ).withColumn("rate", F.col("flagged") / F.col("n"))


def band_by_kind(rows: DataFrame, kind: str, band: str, bands: list[str]) -> DataFrame:
    return rows.groupBy(kind).pivot(band, bands).agg(F.count(F.lit(1))).fillna(0)


def paired_gap(
    runs: DataFrame, unit: str, variant: str, first: str, second: str, *, flag: str, score: str
) -> DataFrame:
    """The same units in two renderings.  One pass over the units; units seen in only one
    rendering drop out."""
    side = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c)))
    paired = (
        runs.where(F.col(variant).isin(first, second))
        .groupBy(unit)
        .agg(
            side(first, flag).cast("int").alias("_fa"),
            side(second, flag).cast("int").alias("_fb"),
            side(first, score).alias("_sa"),
            side(second, score).alias("_sb"),
        )
        .where("_fa IS NOT NULL AND _fb IS NOT NULL")
    )
    drop = F.col("_sa") - F.col("_sb")
    return paired.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_fa").alias("rate_first"),
        F.avg("_fb").alias("rate_second"),
        ((F.avg("_fb") - F.avg("_fa")) * 100).alias("gap_pp"),
        F.avg(-drop).alias("mean_delta"),
        F.max(drop).alias("max_drop"),
        F.avg(((F.col("_fa") == F.col("_fb")) & (drop == 0)).cast("int")).alias("identical"),
    )


def error_buckets(
    errors: DataFrame, bucket: Column, example: str, order: str, *, examples: int = 3
) -> DataFrame:
    """Count and first examples per mechanism; the rank filter runs before the shuffle."""
    named = errors.withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    counts = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("bucket").orderBy(order)
    firsts = (
        named.select("bucket", order, example)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= examples)
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", example))).alias("_e"))
        .select("bucket", F.transform("_e", lambda e: e[example]).alias("examples"))
    )
    return counts.join(firsts, "bucket")


def citation_validity(citations: DataFrame, artefacts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of citations that resolve."""
    known = artefacts.select(*keys).distinct().withColumn("_known", F.lit(1))
    return citations.join(known, keys, "left").agg(
        F.count(F.lit(1)).alias("citations"),
        F.count("_known").alias("resolved"),
        (F.count("_known") / F.count(F.lit(1))).alias("validity"),
    )


def producer_tally(
    calls: DataFrame, task: str, producer: str, fell_back: Column, reason: Column, *,
    reason_chars: int | None = None,
) -> DataFrame:
    """Per task the modal producer, calls, whether any fell back, and its distinct reasons.

    The reasons are one text per task, in order of the producer that gave them first; with
    `reason_chars` only its beginning is gathered.
    """
    per = calls.groupBy(task, producer).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(fell_back).alias("_fell")
    )
    tally = per.groupBy(task).agg(
        F.min_by(producer, F.struct(-F.col("_n"), producer)).alias("producer"),
        F.sum("_n").alias("calls"),
        F.bool_or("_fell").alias("fell_back"),
    )
    first = (
        calls.select(task, producer, reason.alias("_why"))
        .where("_why IS NOT NULL")
        .groupBy(task, "_why")
        .agg(F.min(producer).alias("_by"))
    )
    w = Window.partitionBy(task).orderBy("_by", "_why")
    # a reason takes three characters of the joined text or more
    most = None if reason_chars is None else reason_chars // 3 + 1
    reasons = (
        first_rows(first, w, most)
        .groupBy(task)
        .agg(F.array_sort(F.collect_list(F.struct("_by", "_why"))).alias("_r"))
        .select(
            task,
            first_chars(F.array_join(F.transform("_r", lambda r: r["_why"]), "; "), reason_chars).alias("reason"),
        )
    )
    return tally.join(reasons, task, "left")


def worst_errors(pairs: DataFrame, truth: str, predicted: str, key: str, n: int = 10) -> DataFrame:
    """K4: the status errors furthest apart in value; an open status counts as 0.5."""
    known = {k: v for k, v in L.CLAIM_STATUS_VALUE.items() if v is not None}
    value = lambda c: F.coalesce(lookup(known, F.col(c)), F.lit(0.5))
    return (
        pairs.where(F.col(truth) != F.col(predicted))
        .withColumn("distance", F.abs(value(truth) - value(predicted)))
        .orderBy(F.desc("distance"), key)
        .limit(n)
    )
