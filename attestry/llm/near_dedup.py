"""Near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches
from attestry.llm.graph import link_groups
from attestry.llm.hashing import long_lists, mix, shingle_sets, signed, text_slices
from attestry.llm.membership import Membership, may_hold_column, membership
from attestry.session import cut_lineage

WIDTH = 5
THRESHOLD = 0.75
SKETCH = 48
# A pair at the threshold shares a Binomial(SKETCH, THRESHOLD) number of the union sketch's
# values; the smallest number whose lower tail stays under this is what a candidate must share.
MISS = 2e-8


def least_shared(k: int, threshold: float, miss: float = MISS) -> int:
    """The most values a pair can be asked to share of k so that P(it shares fewer) < miss."""
    tail, c = 0.0, 0
    while c < k:
        tail += math.comb(k, c) * threshold**c * (1 - threshold) ** (k - c)
        if tail >= miss:
            break
        c += 1
    return c


def _features(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in text_slices(batch.column(1)):
                count, one, two, low = [], [], [], []
                for s in shingle_sets(raw, off, width):
                    u = s.view(np.uint64)
                    count.append(len(s))
                    one.append(mix(u).sum(dtype=np.uint64))
                    two.append(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    low.append(s[:k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(count, pa.int64()),
                        pa.array(signed(np.array(one, np.uint64))),
                        pa.array(signed(np.array(two, np.uint64))),
                        long_lists(low),
                    ],
                    ["id", "n", "h1", "h2", "sketch"],
                )

    return run


def _full_sets(width: int, wanted: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what is surely not asked for is neither hashed nor shuffled
            batch = batch.filter(pa.array(wanted.may_hold(batch.column(2).to_numpy(zero_copy_only=False))))
            for lo, hi, raw, off in text_slices(batch.column(1)):
                sets = long_lists(list(shingle_sets(raw, off, width)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], ["id", "members"])

    return run


def _required(n: Column, k: int, threshold: float) -> Column:
    """How many sketch values a document with n shingles shares with any partner.

    Up to threshold * k shingles both sketches are whole sets, so the number is exact.
    """
    whole = math.floor(threshold * k + 1e-9)
    return F.when(n <= whole, F.ceil(n * threshold - 1e-9)).otherwise(least_shared(k, threshold)).cast("int")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    k: int = SKETCH,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of `docs`.

    Words are runs of non-space bytes, A-Z lower-cased.  A document's set is its distinct
    `width`-word shingles (the whole sequence where there are fewer words); documents whose
    sets have a Jaccard similarity of `threshold` or more link, and component_id is the
    smallest id a document reaches.

    One hash function orders the shingles and each set keeps its k smallest.  Inverted lists
    of the retained values make the candidates: of two sketches that share c values, the
    k - c + 1 rarest values of each have one in common, so common values make no lists.
    The pair's union sketch estimates the similarity and drops what is clearly below; what is
    left is confirmed on full sets.  A link at the threshold is missed with probability under
    MISS, one of sets with at most threshold * k shingles never.

    Equal sets are one class from the start; null or blank texts have no set and link with
    nothing.  A row without id is judged by itself: component_id null, kept.  Rows that repeat
    an id with the same text get the same result; with other texts each is judged on its own
    class.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = cut_lineage(
        plain.mapInArrow(
            _features(width, k), "id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>"
        )
    )
    classes = cut_lineage(
        feats.where("n > 0 AND id IS NOT NULL")
        .groupBy("n", "h1", "h2")
        .agg(F.min("id").alias("rep"), F.expr("min_by(sketch, id)").alias("sketch"))
    )
    values = classes.select("rep", F.explode("sketch").alias("key"))
    found = values.groupBy("key").agg(F.count("*").alias("df"), F.min("rep").alias("rep"))
    # what only one document has ranks first, so most documents have no room for anything else
    alone = found.where("df = 1").groupBy("rep").agg(F.count("*").alias("own"))
    own, held = F.coalesce("own", F.lit(0)), F.size("sketch")
    room = held - _required(F.col("n"), k, threshold) + 1 - own
    open_ = classes.join(alone, "rep", "left").select("rep", "sketch", own.alias("own"), room.alias("room")).where("room > 0")
    shared = open_.select("rep", "own", "room", F.explode("sketch").alias("key")).join(
        found.where("df > 1").select("key", "df"), "key"
    )
    ranked = shared.groupBy("rep", "own", "room").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    entries = ranked.select(
        F.col("rep").alias("id"), F.col("own").alias("rank"), F.explode(F.expr("slice(s, 1, room)").getField("key")).alias("key")
    )
    sketches = classes.select(F.col("rep").alias("id"), "n", "sketch")

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = cut_lineage(ids)
        wanted = membership(ids.select(F.xxhash64("id").alias("key")))
        keyed = plain.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("key"))
        sets = keyed.mapInArrow(_full_sets(width, wanted), "id bigint, members array<bigint>")
        return sets.join(ids, "id", "left_semi")

    # of two sets that link, the first member both have, rarest first, is at most so far down
    # each that enough members follow
    share = threshold / (1 + threshold)
    need = f"ceil({share}D * (x.size + y.size) - 1e-9)"
    possible = f"x.place <= x.size - {need} AND y.place <= y.size - {need}"

    def rare_members(ids: DataFrame) -> DataFrame:
        """(key, id, place, size): each full set's members that a partner must share one of."""
        members = sets_of(ids).select("id", F.size("members").alias("size"), F.explode("members").alias("key"))
        members = cut_lineage(members)
        common = members.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        ranked = (
            members.join(common, "key")
            .groupBy("id", "size")
            .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("m"))
            .select("id", "size", F.posexplode("m.key").alias("at", "key"), (F.col("size") - F.size("m")).alias("free"))
        )
        # what no other of these ids has comes first
        placed = ranked.select("key", "id", (F.col("at") + F.col("free")).alias("place"), "size")
        return placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9))

    def verify(pairs: DataFrame) -> DataFrame:
        def side(c: str, other: DataFrame) -> DataFrame:
            return other.select(*[F.col(x).alias(c if x == "id" else f"{x}_{c}") for x in other.columns])

        met = pairs.join(side("a", sketches), "a").join(side("b", sketches), "b")
        low = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
        both = F.size(F.array_intersect(low, F.array_intersect("sketch_a", "sketch_b")))
        small = F.least("n_a", "n_b")
        near = met.where((small >= F.greatest("n_a", "n_b") * threshold - 1e-9) & (both >= _required(small, k, threshold)))
        near = cut_lineage(near.select("a", "b"))
        ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
        sets = sets_of(ids)
        full = near.join(side("a", sets), "a").join(side("b", sets), "b")
        shared = F.size(F.array_intersect("members_a", "members_b"))
        union = F.size("members_a") + F.size("members_b") - shared
        return full.where(shared + 1e-9 >= F.lit(threshold) * union).select("a", "b").distinct()

    found = link_groups(entries, verify, 1, rare_members, possible)
    roots = classes.select("n", "h1", "h2", "rep").join(found, F.col("rep") == F.col("id"), "left")
    roots = roots.select("n", "h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    whole = feats.select("id", "n", "h1", "h2").join(roots, ["n", "h1", "h2"], "left")
    # only rows with an id and a set belong to a class
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("id"))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of `docs` without near-duplicates: of each group the smallest id.

    Rows that repeat an id are one document, of which one row stays; rows without id stay.
    """
    judged = near_duplicates(docs.select(id_col, text_col), id_col, text_col, **options)
    judged = cut_lineage(judged.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")))
    dropped = judged.where("NOT kept").select(id_col)
    doubtful = judged.where("NOT kept OR n > 1").select(F.xxhash64(id_col).alias("key"))
    maybe = F.col(id_col).isNotNull() & may_hold_column(membership(doubtful), F.xxhash64(F.col(id_col)))
    # most rows are surely unique and need no shuffle
    some = docs.where(maybe).join(dropped, id_col, "left_anti").dropDuplicates([id_col])
    return docs.where(~maybe).union(some.select(docs.columns))
