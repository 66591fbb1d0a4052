"""Exact cosine threshold pairs of embeddings by a dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.graph import components
from attestry.session import cut_lineage

THRESHOLD = 0.95
BLOCK = 2048
MAX_CENTERS = 256
RADII = (1.0, 0.5, 0.25)
# a level that needs more nodes than this share of the points would prune nothing
WORTH = 0.125
SLACK = 1e-6
ROWS = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small components."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build_levels(points: np.ndarray) -> list[np.ndarray]:
    """For each level of halving radius, the index of every point's node centre.

    A level is a net of its parents' points: each node's centre covers its points within the
    level's radius, and lies in the parent's node.  Levels end where they stop being worth it.
    """
    n = len(points)
    levels = [np.zeros(n, np.int32)]
    for radius in RADII:
        parent, node = levels[-1], np.full(n, -1, np.int32)
        free, used = np.arange(n), 0
        while len(free) and used <= WORTH * n:
            centre = free[0]
            family = free[parent[free] == parent[centre]]
            near = points[family] @ points[centre] >= 1.0 - radius * radius / 2.0
            near[0] = True
            node[family[near]] = centre
            free = free[node[free] < 0]
            used += 1
        if len(free):
            break
        levels.append(node)
    return levels


def _planted():
    """Each block's cover tree: every vector gets the centres that cover it, level by level."""

    def run(table: pa.Table) -> pa.Table:
        width = table["dim"][0].as_py()
        levels = build_levels(unit(matrix(table["vec"], width)))
        flat = np.stack(levels, 1)
        off = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
        nodes = pa.ListArray.from_arrays(pa.array(off), pa.array(flat.ravel()))
        table = table.append_column("place", pa.array(np.arange(len(flat), dtype=np.int32)))
        return table.append_column("nodes", nodes)

    return run


class Tree:
    """A block's vectors with the nodes of each level: centres, radii and parents."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(table["place"].to_numpy(), kind="stable")))
        self.id = table["id"].to_numpy()
        self.copies = table["copies"].to_numpy().astype(np.int64)
        self.points = unit(matrix(table["vec"], table["dim"][0].as_py()))
        self.light = self.points.astype(np.float32)
        depth = len(table["nodes"][0])
        nodes = matrix(table["nodes"], depth)
        self.levels = []
        before = np.zeros(len(self.id), np.int64)
        for k in range(depth):
            centres, of = np.unique(nodes[:, k], return_inverse=True)
            parent = np.zeros(len(centres), np.int64)
            parent[of] = before
            reach = np.zeros(len(centres))
            gap = 2.0 - 2.0 * (self.points * self.points[centres][of]).sum(axis=1)
            np.maximum.at(reach, of, np.sqrt(np.maximum(0.0, gap)))
            self.levels.append((self.points[centres], reach, parent))
            before = of
        self.leaf = before


def linked_pairs(a: Tree, b: Tree, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs with a cosine of `threshold` or more.

    Both trees are descended together.  A pair of nodes stays only while its centres are no
    farther apart than the threshold's distance and both covering radii; what is left at the
    last level common to both is compared point by point.
    """
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK
    open_ = np.ones((1, 1), bool)
    depth = max(len(a.levels), len(b.levels))
    up_a, up_b = a.levels[0], b.levels[0]
    for k in range(depth):
        # the tree that has no further level stays at its last one
        if k < len(a.levels):
            up_a = a.levels[k]
            open_ = open_[up_a[2]] if k else open_
        if k < len(b.levels):
            up_b = b.levels[k]
            open_ = open_[:, up_b[2]] if k else open_
        far = distances(up_a[0], up_b[0]) > up_a[1][:, None] + up_b[1][None, :] + reach
        open_ = open_ & ~far
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    whole = np.arange(len(b.id))
    order = np.argsort(a.leaf, kind="stable")
    for lo in range(0, len(order), ROWS):
        some = order[lo : lo + ROWS]
        rows, leaves = np.unique(a.leaf[some], return_inverse=True)
        wanted = open_[rows].any(axis=0)
        columns = whole if wanted.all() else np.flatnonzero(wanted[b.leaf])
        if not len(columns):
            continue
        near = a.light[some] @ b.light[columns].T >= threshold - 1e-4
        near &= open_[rows][leaves][:, b.leaf[columns]]
        if near.mean() > 0.02:
            near &= a.points[some] @ b.points[columns].T >= threshold
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(near)
            exact = np.einsum("ij,ij->i", a.points[some[i]], b.points[columns[j]]) >= threshold
            i, j = i[exact], j[exact]
        found_i.append(some[i])
        found_j.append(columns[j])
    return np.concatenate(found_i), np.concatenate(found_j)


def _compared(threshold: float):
    """For each vector of two blocks: how many it links to, and the smallest id it reaches."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a = Tree(table.filter(pa.array(side == 0)))
        alone = not (side == 1).any()
        b = a if alone else Tree(table.filter(pa.array(side == 1)))
        i, j = linked_pairs(a, b, threshold)
        if alone:
            other = i != j
            i, j = i[other], j[other]
        shift = 0 if alone else len(a.id)
        ids = a.id if alone else np.concatenate((a.id, b.id))
        count = np.bincount(i, b.copies[j], len(ids)).astype(np.int64)
        if not alone:
            count += np.bincount(j + shift, a.copies[i], len(ids)).astype(np.int64)
        root, before = ids.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, i, before[j + shift])
            np.minimum.at(root, j + shift, before[i])
        some = count > 0
        return pa.table({"id": ids[some], "links": count[some], "root": root[some]})

    return run


def near_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of `table`.

    Vectors of equal dimension link if their cosine, in double precision, is `threshold` or
    more.  n_links counts the other vectors linked directly, equal ones included, component_id
    is the smallest id reachable.  A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, nor does a row without id; rows that repeat id
    and vector count once.  Other columns are ignored.

    Equal vectors become one point with a count.  The points are dealt to the nearest of a few
    centres (their choice changes the work, not the result) and each centre's cell into blocks
    of about `block` points, so a cell of any size is split.  Each block is a cover tree with
    levels of halving radius.  Pairs of blocks whose covering balls are too far apart are
    pruned; the others are descended together in one task each, which returns counts and
    roots for its points, never pairs.
    """
    kind = table.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col(id_col).isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0)
    rows = table.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(sound, F.lit(False)).alias("sound"),
        F.xxhash64(v).alias("h1"),
        F.xxhash64(v, F.lit(1)).alias("h2"),
        v.alias("vec"),
    )
    rows = cut_lineage(rows)
    points = rows.where("sound").dropDuplicates(["id", "h1", "h2"])
    points = points.groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.expr("min_by(vec, id)").alias("vec")
    )
    points = cut_lineage(points.select("h1", "h2", "rep", "copies", "vec", F.size("vec").alias("dim")))
    total = points.count()
    chosen = points.orderBy("h1", "h2").limit(max(1, min(MAX_CENTERS, total // block))).select("vec", "dim").collect()
    centres = {d: unit(np.array([r["vec"] for r in chosen if r["dim"] == d])) for d in {r["dim"] for r in chosen}}
    parts = "id bigint, copies bigint, vec array<%s>, dim int" % kind

    def dealt(batches):
        for batch in batches:
            part = pa.Table.from_batches([batch])
            dims = part["dim"].to_numpy()
            for d in np.unique(dims).tolist():
                some = part.filter(pa.array(dims == d))
                x = unit(matrix(some["vec"], d))
                # a dimension without a centre is a cell of its own, of the widest radius
                gap = distances(x, centres[d]) if d in centres else np.full((len(x), 1), 2.0)
                cell = gap.argmin(axis=1).astype(np.int32)
                some = some.append_column("cell", pa.array(cell))
                some = some.append_column("gap", pa.array(gap[np.arange(len(cell)), cell]))
                yield from some.to_batches()

    cells = points.select(F.col("rep").alias("id"), "copies", "vec", "dim").mapInArrow(dealt, parts + ", cell int, gap double")
    cells = cut_lineage(cells)
    sizes = cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("chunks"))
    cells = cells.join(sizes, ["dim", "cell"])
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")).drop("chunks")
    grown = parts + ", cell int, gap double, chunk int, place int, nodes array<int>"
    order = [c.split()[0] for c in (parts + ", cell int, gap double, chunk int").split(", ")]
    blocks = cells.select(*order).groupBy("dim", "cell", "chunk").applyInArrow(_planted(), grown)
    blocks = cut_lineage(blocks)
    balls = blocks.groupBy("dim", "cell", "chunk").agg(F.max("gap").alias("ball"))
    spark = table.sparkSession
    between = [
        (d, i, j, float(gap))
        for d, c in centres.items()
        for i, line in enumerate(distances(c, c))
        for j, gap in enumerate(line)
    ]
    between = spark.createDataFrame(between, "dim int, cell int, cell2 int, apart double")
    left = balls.join(between, ["dim", "cell"], "left").withColumn("cell2", F.coalesce("cell2", "cell"))
    right = balls.select(
        "dim", F.col("cell").alias("cell2"), F.col("chunk").alias("chunk2"), F.col("ball").alias("ball2")
    )
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + SLACK)
    pairs = left.join(right, ["dim", "cell2"]).where(
        (F.struct("cell", "chunk") <= F.struct(F.col("cell2"), F.col("chunk2")))
        & (F.coalesce("apart", F.lit(0.0)) - F.col("ball") - F.col("ball2") <= reach)
    )
    pairs = cut_lineage(pairs.select("dim", "cell", "chunk", "cell2", "chunk2"))

    def placed(cell: str, chunk: str, side: int) -> DataFrame:
        to = pairs if side == 0 else pairs.where("cell <> cell2 OR chunk <> chunk2")
        name = F.struct("cell", "chunk", "cell2", "chunk2").alias("pair")
        to = to.select("dim", F.col(cell).alias("cell"), F.col(chunk).alias("chunk"), name)
        met = blocks.join(to, ["dim", "cell", "chunk"])
        return met.select("pair", F.lit(side).alias("side"), "id", "copies", "vec", "dim", "place", "nodes")

    both = placed("cell", "chunk", 0).union(placed("cell2", "chunk2", 1))
    met = both.groupBy("dim", "pair").applyInArrow(_compared(threshold), "id bigint, links bigint, root bigint")
    met = cut_lineage(met)
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = points.select("h1", "h2", F.col("rep").alias("id"), "copies").join(counts, "id", "left").join(roots, "id", "left")
    known = known.select("h1", "h2", "copies", "links", F.coalesce("root", "id").alias("root"))
    known = known.withColumn("good", F.lit(True))
    whole = rows.drop("vec").join(known, [F.col("sound") == F.col("good"), *(rows[h] == known[h] for h in ("h1", "h2"))], "left")
    component = F.coalesce("root", "id")
    links: Column = F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))
    return whole.select(
        F.col("id").alias(id_col),
        links.cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
