"""Connected components and candidate groups as joins; nothing is gathered for a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)")))
    return tuple(row.first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id with an edge (a, b): root is the smallest id it reaches.

    Alternating large-star and small-star rounds: each hooks every neighbour of a node to the
    smallest one, so a path of n nodes takes about log n rounds.  A round is two joins on
    minima that are aggregated before the shuffle, and ends in a table in the shared folder.
    """
    top, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cut_lineage(edges.where("a <> b").select(top, low).distinct())
    seen, state = None, _state(now)
    while state != seen:
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        seen, state = state, _state(now)
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return stars.union(roots)


def link_groups(
    entries: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    rounds: int = 2,
    finer: Callable[[DataFrame], DataFrame] | None = None,
    possible: str = "true",
) -> DataFrame:
    """(id, root): components of the pairs that share a key and pass `verify`.

    `entries` has key, id and rank.  Two ids that share a key are a candidate pair, but pairs
    are not listed: in each round a key's best-ranked id not used before is compared with the
    key's ids of other components, which is linear in the entries.  What then still shares a
    key across components is compared pair by pair, so no link between components is lost;
    pairs inside a component can change nothing and are never made.

    `verify` gets (a, b) with a < b and returns those that link.  For the last step `finer`
    may replace the entries of the ids that are left by (key, id, ...) that every linking pair
    shares too, and `possible` says over their columns, as x.name and y.name, which pairs that
    share a key need a look.
    """
    shared = entries.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    now = cut_lineage(
        entries.join(shared.where("lo <> hi").select("key"), "key").select("key", "id", "rank", F.col("id").alias("root"))
    )
    links, tried = None, None
    for step in range(rounds + 1):
        if step < rounds:
            hubs = now.groupBy("key").agg(F.min(F.struct("rank", "id", "root")).alias("hub"))
            hubs = cut_lineage(hubs.select("key", "hub.id", "hub.root"))
            near = F.expr("x.key = y.key AND x.root <> y.root")
        else:
            if finer is not None:
                roots = now.select("id", "root").distinct()
                now = cut_lineage(finer(roots.select("id")).join(roots, "id"))
            hubs, near = now, F.expr(f"x.key = y.key AND x.root < y.root AND ({possible})")
        met = hubs.alias("x").join(now.alias("y"), near)
        fresh = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        if tried is not None:
            fresh = fresh.join(tried, ["a", "b"], "left_anti")
        fresh = cut_lineage(fresh)
        tried = fresh if tried is None else tried.union(fresh)
        if fresh.isEmpty():
            continue
        passed = cut_lineage(verify(fresh))
        links = passed if links is None else links.union(passed)
        if step == rounds:
            break
        found = components(links).withColumnRenamed("root", "r")
        now = now.drop("root").join(found, "id", "left")
        now = now.withColumn("root", F.coalesce("r", "id")).drop("r")
        mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        # a hub has met all of its list: it can't help again
        now = now.join(mixed.where("lo <> hi").select("key"), "key").join(hubs.select("key", "id"), ["key", "id"], "left_anti")
        now = cut_lineage(now)
    if links is None:
        links = now.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return components(links)
