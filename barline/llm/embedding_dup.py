"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label are cut into cells of bounded size around centres, again and again while
a cell is too large.  That makes a tree of nodes with covering balls.  Pairs of nodes are walked
down level by level, and those whose balls lie too far apart are left with all below them.  Pairs
of cells that remain meet in one task each, which builds the cover trees of both and walks them
together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .cover_tree import SLACK, Links, Node, traverse
from .graph import Scratch, components
from .tables import map_batches


@dataclass(frozen=True)
class Cover:
    similarity: float = 0.98
    cell_rows: int = 2_000
    centres: int = 16  # at most, into which a cell is cut


def _vectors(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(column), -1)


def _unit(rows: DataFrame) -> DataFrame:
    """rows with embedding replaced by x, the bytes of the vector divided by its length."""
    rest = [f for f in rows.schema.fields if f.name != "embedding"]

    def scale(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs = []
        for value in batch.column("embedding").to_pylist():
            x = np.array(value, np.float64)
            x = x / np.abs(x).max()
            xs.append((x / np.sqrt(x @ x) + 0.0).tobytes())  # adding 0 leaves one kind of zero
        return pa.record_batch([*(batch.column(f.name) for f in rest), pa.array(xs, pa.binary())], [*(f.name for f in rest), "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return map_batches(rows, scale, f"{schema}, x binary")


def _cells(rows: DataFrame, p: Cover, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """rows with the cell of each in node, and the edges (node, parent) of every round of cuts.

    A cell has cell_rows rows at most.  What doesn't come apart around centres, a child with over
    three quarters of its parent, is dealt into cells by its ids.
    """
    rows, edges = scratch.write(rows), []
    while True:
        large = scratch.write(rows.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > p.cell_rows))
        if large.isEmpty():
            return rows, edges
        some = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "id"), "id"))
        picked = rows.select("node", "id", "x").withColumn("k", some).where(F.col("k") <= p.centres)
        wanted = F.least(F.lit(p.centres), F.ceil(2 * F.col("m") / p.cell_rows))
        centres = picked.join(large, "node").where(F.col("k") <= wanted).groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("centres"))

        def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
            child = [int((_vectors(c) @ np.frombuffer(x.as_py(), np.float64)).argmax()) for c, x in zip((v.values for v in batch.column("centres")), batch.column("x"))]
            return pa.record_batch([batch.column(c) for c in ("id", "copies", "node", "kind", "x")] + [pa.array(child, pa.int64())], ["id", "copies", "node", "kind", "x", "child"])

        cut = map_batches(rows.join(centres, "node").select("id", "copies", "node", "kind", "x", "centres"), nearest, "id long, copies long, node long, kind long, x binary, child long")
        cut = scratch.write(cut)
        sizes = cut.groupBy("node", "child").agg(F.count("*").alias("own")).join(large, "node")
        deals = F.when(4 * F.col("own") > 3 * F.col("m"), F.ceil(2 * F.col("own") / p.cell_rows)).otherwise(1)
        sizes = scratch.write(sizes.select("node", "child", deals.alias("deals")))
        dealt = cut.join(sizes, ["node", "child"]).withColumnRenamed("node", "parent")
        dealt = dealt.withColumn("node", F.xxhash64("parent", "child", F.pmod(F.xxhash64("id", "parent"), F.col("deals"))))
        dealt = scratch.write(dealt.select("id", "copies", "node", "kind", "x", "parent"))
        edges.append(scratch.write(dealt.select("node", "parent").distinct()))
        after = scratch.write(rows.join(large, "node", "left_anti").select(rows.columns).unionByName(dealt.drop("parent")))
        for old in (rows, cut, sizes, dealt, large):
            scratch.drop(old)
        rows = after


def _balls(cells: DataFrame) -> DataFrame:
    """One row for each cell: a centre and the radius that covers its rows."""

    def ball(part: pa.Table) -> pa.Table:
        x = _vectors(part.column("x").combine_chunks())
        mean = x.mean(0)
        length = np.sqrt(mean @ mean)
        centre = mean / length if length > 1e-9 else x[0]
        radius = float(np.sqrt(np.maximum(2 - 2 * (x @ centre), 0)).max())
        return pa.table({"node": part.column("node")[:1], "kind": part.column("kind")[:1], "radius": pa.array([radius]), "centre": pa.array(centre[None].tolist(), pa.list_(pa.float64()))})

    return cells.groupBy("node").applyInArrow(ball, "node long, kind long, radius double, centre array<double>")


def _tree_balls(leaves: DataFrame, edges: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Balls of all nodes: those of a parent cover the balls of its children."""

    def cover(part: pa.Table) -> pa.Table:
        centres = np.array(part.column("centre").to_pylist())
        mean = centres.mean(0)
        length = np.sqrt(mean @ mean)
        centre = mean / length if length > 1e-9 else centres[0]
        radius = float((np.sqrt(np.maximum(2 - 2 * (centres @ centre), 0)) + part.column("radius").to_numpy()).max())
        return pa.table({"node": part.column("parent")[:1], "kind": part.column("kind")[:1], "radius": pa.array([radius]), "centre": pa.array(centre[None].tolist(), pa.list_(pa.float64()))})

    balls = scratch.write(leaves)
    for level in reversed(edges):
        parents = balls.join(level, "node").groupBy("parent").applyInArrow(cover, "node long, kind long, radius double, centre array<double>")
        whole = scratch.write(balls.unionByName(parents))
        scratch.drop(balls)
        balls = whole
    return balls


def _meeting(balls: DataFrame, edges: list[DataFrame], reach: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of cells of one kind whose balls come within reach, each cell with itself too.

    Starts from the roots, each with itself, and opens both nodes of a pair in every round; a node
    that is no parent stays.  Only children of pairs within reach are paired.
    """
    inner = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    away = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * inner))
    pairs = scratch.write(balls.select(F.col("kind").alias("a"), F.col("kind").alias("b")).distinct())
    for level in edges:
        opened = pairs
        for side in "ab":
            below = level.select(F.col("parent").alias(side), F.col("node").alias("_node"))
            opened = opened.join(below, side, "left").withColumn(side, F.coalesce("_node", side)).drop("_node")
        opened = opened.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side in "ab":
            opened = opened.join(balls.select(F.col("node").alias(side), F.col("radius").alias(f"r{side}"), F.col("centre").alias(f"c{side}")), side)
        near = scratch.write(opened.where((F.col("a") == F.col("b")) | (away <= F.col("ra") + F.col("rb") + reach + SLACK)).select("a", "b"))
        scratch.drop(pairs)
        pairs = near
    return pairs


def near_vectors(spark: SparkSession, embeddings: DataFrame, p: Cover = Cover()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings(vec_id, embedding, label).

    Only vectors of one label and one number of components are compared.  Null vectors or labels,
    empty or zero vectors, null or non-finite components and null ids link with nothing: 0 links,
    their own component (null for a null id), kept.  Vectors of exactly one direction are compared
    once and count with their number.  Rows that share an id count each and share their component.
    """
    scratch = Scratch(spark)
    vectors = embeddings.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    # vectors of one direction are one class; its key is a digest, so that vectors move once
    directed = _unit(vectors.where(usable).select("vec_id", "label", "embedding"))
    key = F.struct("label", F.md5("x").alias("direction"))
    classes = directed.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    kind = F.xxhash64("label", F.octet_length("x"))
    classes = scratch.write(classes.select("id", "copies", kind.alias("node"), kind.alias("kind"), "x", key.alias("key")))
    cells, edges = _cells(classes.drop("key"), p, scratch)
    reach = float(np.sqrt(2 - 2 * p.similarity))
    pairs = _meeting(_tree_balls(_balls(cells), edges, scratch), edges, reach, scratch)
    sides = pairs.select("a", "b", F.col("a").alias("node")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("node")))

    def walk(part: pa.Table) -> pa.Table:
        part = part.sort_by([("node", "ascending"), ("id", "ascending")])
        x, node = _vectors(part.column("x").combine_chunks()), part.column("node").to_numpy()
        ids, links = part.column("id").to_numpy(), Links(part.column("copies").to_numpy())
        sides = [np.flatnonzero(node == n) for n in np.unique(node)]
        trees = [Node(x, points, int(points[0])) for points in sides]
        traverse(x, trees[0], trees[-1], p.similarity, links)
        roots = np.array([links.root(i) for i in range(len(ids))])
        found = np.flatnonzero((links.counts > 0) | (roots != np.arange(len(ids))))
        return pa.table({"id": ids[found], "links": links.counts[found], "root": ids[roots[found]]})

    met = cells.join(sides, "node").select("a", "b", "node", "id", "copies", "x")
    found = scratch.write(met.groupBy("a", "b").applyInArrow(walk, "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch)
    named = classes.join(counts, "id", "left").join(groups, "id", "left")
    named = named.select(
        "key",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = directed.select("vec_id", key.alias("key")).join(named, "key").drop("key")
    alone = vectors.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = linked.unionByName(alone)
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
