"""Shards that each hold the corpus's mixture of sources, from DataFrame functions alone.

Rows are shuffled by a seeded hash and ranked within their source.  A row's fractional rank,
(rank + 1/2) / rows of the source, spreads every source evenly over 0 to 1, so any stretch of
the rows in order of it has the whole table's mixture.  Equal stretches are the shards.

No rank is taken in one task, however large a source is.  Rows fall into cells by the leading
bits of their hash, later of their fraction; a rank is the number of rows in earlier cells,
which is known from one count for each cell, plus the place within the cell.  What is shuffled
are the columns given, so callers that need only the places leave the text out (`measured`).

Defined results: a null text has no bytes; a null source is a source of its own; a null id is
shuffled as the empty text.  Rows equal in id, checksum and size are alike and share a stretch
of ranks in either order; equal texts under different ids are placed by their ids.  An empty
table gives an empty one.  With fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.columns import boxed, free_name, unboxed
from attestry.session import cut_lineage

SHARDS = 24
OVERHEAD = 8  # bytes of a row besides its text
SEED = "shard"
HASH_DIGITS = 15
CELL_BITS = 14


def draw_of(doc_id: Column, seed: str = SEED) -> Column:
    """A place in the seeded shuffle: the first 60 bits of a digest of seed and id."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint")


def measured(docs: DataFrame, text: str = "text", into: str = "content") -> DataFrame:
    """The other columns and `into` (size, text_crc32) instead of the text itself."""
    said = F.coalesce(docs[text], F.lit(""))
    content = F.struct(
        (F.octet_length(said).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(said.cast("binary")).alias("text_crc32"),
    )
    return docs.select(*[docs[c] for c in docs.columns if c != text and c != into], content.alias(into))


def _placed(rows: DataFrame, group: list[str], cell: str, order: list, counts: DataFrame) -> DataFrame:
    """`rows` with `at`, the place from 0 in the group by `cell` and then `order`, and the group's size `of`.

    The windows over counts see at most 2**CELL_BITS rows of a group.
    """
    whole = Window.partitionBy(*group)
    before = whole.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(whole).alias("of")
    )
    within = Window.partitionBy(*group, cell).orderBy(*order)
    met = rows.join(starts, [*group, cell])
    return met.withColumn("at", F.col("before") + F.row_number().over(within) - 1).drop("before")


def interleave(
    rows: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    key: str = "doc_id",
    source: str = "source",
    content: str = "content",
    into: str = "place",
) -> DataFrame:
    """`rows` with `into` (shard, slot): counts of the shards differ by one at most.

    `content` is the struct of `measured`; it only breaks ties between rows of one id.
    """
    # a null source must not meet one of the same spelling
    named = F.coalesce(F.concat(F.lit("="), rows[source].cast("string")), F.lit("-"))
    draw = draw_of(rows[key], seed)
    cell = F.shiftright(draw, 4 * HASH_DIGITS - CELL_BITS).alias("cell")
    keyed = rows.select(boxed(rows), named.alias("source"), cell, draw.alias("draw"), rows[key].alias("key"))
    sizes = cut_lineage(rows.select(named.alias("source"), cell).groupBy("source", "cell").count())
    ties = ["draw", "key", F.col("row")[content]["text_crc32"], F.col("row")[content]["size"]]
    ranked = _placed(keyed, ["source"], "cell", ties, sizes)
    fraction = (2 * F.col("at") + 1) / (2 * F.col("of")).cast("double")
    spread = ranked.select("row", "source", F.col("at").alias("rank"), fraction.alias("fraction"))
    spread = cut_lineage(spread.withColumn("cell", F.floor(F.col("fraction") * (1 << CELL_BITS))))

    merged = _placed(spread, [], "cell", ["fraction", "source", "rank"], spread.groupBy("cell").count())
    merged = merged.withColumn("shard", F.expr(f"at * {shards} DIV of"))
    first = F.expr(f"(shard * of + {shards - 1}) DIV {shards}")
    place = F.struct(F.col("shard").cast("int").alias("shard"), (F.col("at") - first).alias("slot"))
    return unboxed(merged, rows.columns, **{into: place})


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, files: int = 1) -> None:
    """Write the documents as one folder for each shard, its rows in order of their slots.

    Rows are numbered in a table of the shared folder, placed without their texts, and joined
    with these once; a shard is written by about `files` tasks that hold a stretch of it each.
    """
    row = free_name(docs, "row_id")
    content, place = free_name(docs, "content"), free_name(docs, "place")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = measured(numbered.select(row, "doc_id", "source", "text"), into=content)
    places = interleave(narrow, shards, seed, content=content, into=place).select(row, place)
    flat = numbered.join(places, row).select(*docs.columns, f"{place}.shard", f"{place}.slot")
    ordered = flat.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
