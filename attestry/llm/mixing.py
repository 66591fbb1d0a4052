"""Mixing sources to target weights: raking of token weights, then calibrated sampling.

Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.columns import boxed, unboxed
from attestry.session import cut_lineage

# A margin's target share is its token share to this power, scaled to sum 1: below 1 the small
# ones gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
RATE = 0.5
SWEEPS = 200
TOLERANCE = 1e-13
CELLS_PER_TASK = 100_000
# a plan of so many sweeps over one partition costs the driver little more than one of one
SWEEPS_AT_ONCE = 4
WORD = r"[^ \t\n\r\f\x0B]+"
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """The kind of a text by its looks, for corpora that carry no topic."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(text.contains(" | "), "table")
        .when(text.contains("###") | text.contains("%%%"), "symbols")
        .when(text.contains("\n"), "prose")
        .otherwise("line")
    )


def tokens_of(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, sweeps: int = SWEEPS, per_task: int = CELLS_PER_TASK) -> DataFrame:
    """`cells` (the margins' columns and tokens) with `weight`: shares that sum to 1.

    Iterative proportional fitting: starting from the token shares, each sweep scales the
    weights to the target of one margin after the other.  It ends when a whole sweep changes
    no margin by more than TOLERANCE of its target, or after `sweeps`.  Cells without tokens
    have weight 0.

    Up to `per_task` cells are one partition, where a margin's sums are windows and
    SWEEPS_AT_ONCE sweeps one plan without a shuffle.  More cells keep their tasks, and sums
    are aggregated before they are shuffled; cells are never gathered.  Both give the same
    weights.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    goals = {}
    for margin, power in powers.items():
        sums = cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0")
        goal = F.pow(F.col("n").cast("double"), F.lit(power))
        whole = sums.agg(F.sum(goal).alias("whole"))
        # one row: the sum of all
        goals[margin] = cut_lineage(sums.join(F.broadcast(whole)).select(margin, (goal / F.col("whole")).alias("goal")))
    now = cut_lineage(now.where("tokens > 0"))
    parts = 1 + now.count() // per_task
    own = now.columns
    if parts == 1:
        for margin in powers:
            now = now.join(goals[margin].withColumnRenamed("goal", f"g_{margin}"), margin)
        return _raked(cut_lineage(now), list(powers), sweeps, _by_windows, SWEEPS_AT_ONCE).select(*own)
    sweep = partial(_by_joins, goals=goals, parts=parts)
    return _raked(now, list(powers), sweeps, sweep, 1).select(*own)


def _raked(now: DataFrame, margins: list[str], sweeps: int, sweep: Callable, at_once: int) -> DataFrame:
    """Sweeps until the last one changes no margin; `sweep` gives the weights and its factors."""
    kept, done = now.columns, 0
    while done < sweeps:
        for _ in range(min(at_once, sweeps - done)):
            now = sweep(now.select(*kept), margins)
            done += 1
        now = cut_lineage(now)
        gap = now.agg(F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(f"f_{m}") - 1) for m in margins]))).first()[0]
        if gap is None or gap <= TOLERANCE:
            break
    return now.select(*kept)


def _by_windows(now: DataFrame, margins: list[str]) -> DataFrame:
    """One sweep over cells in one partition, which carry their goals."""
    now = now.coalesce(1)
    for margin in margins:
        held = F.sum("weight").over(Window.partitionBy(margin))
        now = now.withColumn(f"f_{margin}", F.col(f"g_{margin}") / held)
        now = now.withColumn("weight", F.col("weight") * F.col(f"f_{margin}"))
    return now


def _by_joins(now: DataFrame, margins: list[str], goals: dict[str, DataFrame], parts: int) -> DataFrame:
    """One sweep over cells of any number."""
    now = now.coalesce(parts)
    for margin in margins:
        sums = now.groupBy(margin).agg(F.sum("weight").alias("held")).join(goals[margin], margin)
        sums = sums.select(margin, (F.col("goal") / F.col("held")).alias(f"f_{margin}"))
        now = now.join(sums, margin)
        now = now.withColumn("weight", F.col("weight") * F.col(f"f_{margin}"))
    return now


def calibrate(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """`cells` (tokens, weight) with `prob`, each cell's probability of keeping a document.

    The expected tokens are `rate` of all, dealt by weight: prob is scale * weight / tokens,
    at most 1, and the scale is raised until the expectation holds again for the cells that
    are not full.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goal, scale, full = rate * total, rate * total, -1
    while True:
        row = cells.agg(
            F.sum(F.when(F.lit(scale) * F.col("weight") >= F.col("tokens"), F.col("tokens")).otherwise(0)).alias("full"),
            F.sum(F.when(F.lit(scale) * F.col("weight") >= F.col("tokens"), 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        # each round fills at least one cell more, or ends
        if row["full"] is None or row["full"] == full or not row["open"]:
            break
        full, scale = row["full"], max(scale, (goal - row["full"]) / row["open"])
    return cells.withColumn("prob", F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens")))


def drawn(id_: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    name = F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(name, 1, 13), 16, 10).cast("double") / float(2**52)


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    powers: dict[str, float] = POWERS,
    rate: float = RATE,
    seed: str = "mix",
    into: str = "mixing",
) -> DataFrame:
    """All rows and columns of `docs` with a struct `into`: source, lang, topic, n_tokens,
    weight (of the cell), prob and sampled.

    A cell is a combination of source, language and topic; null is the value `(none)`.  Cells
    are raked to the margins' targets, and a document is sampled if a hash of its id falls
    below its cell's probability, so repeated rows share their fate.  Documents without tokens
    have weight and probability 0 and are not sampled.
    """
    text = F.col(text_col).cast("string")
    margins = {
        "source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "topic": F.coalesce(topic, F.lit(NONE)) if topic is not None else topic_of(text),
    }
    keyed = docs.select(
        boxed(docs),
        *[c.alias(f"m_{k}") for k, c in margins.items()],
        tokens_of(text).alias("n_tokens"),
        drawn(F.col(id_col), seed).alias("draw"),
    )
    cells = keyed.groupBy(*[F.col(f"m_{k}").alias(k) for k in margins]).agg(F.sum("n_tokens").alias("tokens"))
    cells = calibrate(rake(cut_lineage(cells), powers), rate)
    cells = cut_lineage(cells.select(*[F.col(k).alias(f"m_{k}") for k in margins], "weight", "prob"))
    total = cells.agg(F.sum("weight")).first()[0] or 1.0
    met = keyed.join(cells, [f"m_{k}" for k in margins], "left")
    weight = F.when(F.col("n_tokens") > 0, F.col("weight") / F.lit(total)).otherwise(0.0)
    prob = F.when(F.col("n_tokens") > 0, F.col("prob")).otherwise(0.0)
    mixing = F.struct(
        *[F.col(f"m_{k}").alias(k) for k in margins],
        "n_tokens",
        weight.alias("weight"),
        prob.alias("prob"),
        (F.col("draw") < prob).alias("sampled"),
    )
    return unboxed(met, docs.columns, **{into: mixing})
