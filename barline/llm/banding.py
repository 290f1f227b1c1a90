"""Components of items whose bands meet: candidate pairs that leave no link out and make no pair twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Scratch, components


def fitting(pairs: DataFrame, room: DataFrame, fits: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (u, v, ...) whose ids fit by their columns in room(id, ...)."""

    def side(name: str) -> DataFrame:
        return room.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in room.columns if c != "id"])

    return pairs.join(side("u"), "u").join(side("v"), "v").where(fits("u_", "v_")).select(pairs.columns)


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ids aren't in one component of found(id, component)."""
    u, v = (found.select(F.col("id").alias(name), F.col("component").alias(f"{name}_in")) for name in "uv")
    both = pairs.join(u, "u", "left").join(v, "v", "left")
    return both.where(F.coalesce("u_in", "u") != F.coalesce("v_in", "v")).select(pairs.columns)


def linked(
    bands: DataFrame,
    confirm: Callable[[DataFrame, Scratch], DataFrame],
    percent: int,
    scratch: Scratch,
    likely: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
    inside: Callable[[DataFrame, Scratch], DataFrame] | None = None,
    family_votes: int = 3,
    at_once: int = 100_000,
    room: Callable[[DataFrame, Scratch], DataFrame] | None = None,
    fits: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """id and component of the linked ids of bands(key, id, n); n is the size of the id's set.

    confirm(pairs(u, v, n), scratch) returns the pairs (u, v) that are alike.  likely(pairs) may leave out
    pairs that can't be.  inside(rows(family, id, n), scratch) returns links (u, v) that connect all like
    ids of each family, without making its pairs rows.

    First every id is paired with the smallest id of one of its bands, the one it shares most
    bands with; a band of any size gives one pair for each member at most.  Then bands that hold
    several of the components so found pair what lies outside their largest one with the rest.
    Pairs inside a component can't change the answer and are never made.

    Many documents may be rather alike without being linked, and so share bands in great number.
    With inside, ids that share family_votes bands or more with their partner form families; a
    family of several components goes to inside, and only pairs of different families are made.

    room(ids(id), scratch) returns columns for each id, and fits(a, b) tells from those with the prefixes
    a and b whether two ids can be alike; it may be true for others, too.  The join of a band's members
    applies it, so that pairs which can't be alike are never rows.

    While more than at_once pairs wait, each id's pair with most bands in common goes first: what these
    connect needs no further pair.  A round that leaves more than half of the pairs is the last one, and the
    rest is confirmed as it is.
    """
    shared = bands.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1")
    members = scratch.write(bands.join(shared.select("key", "first"), "key"))
    votes = members.where("id <> first").groupBy("id", "first").agg(F.count("*").alias("votes"), F.max("n").alias("n"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", F.col("first").alias("u"), "n")).alias("best"))
    pairs = scratch.write(best.select("best.u", F.col("id").alias("v"), "best.n", "best.votes"))
    first, held = pairs.select("u", "v", "n"), []
    if room:
        held = [scratch.write_result(lambda own: room(own.write(members.select("id").distinct()), own))]
        first = fitting(first, held[0], fits)
    links = scratch.write_result(lambda own: confirm(own.write(first) if room else first, own))

    found = components(links, scratch)
    ids = members.select("id", "n").distinct().join(found, "id", "left")
    if inside:
        near = pairs.where(F.col("votes") >= family_votes).select("u", "v").unionByName(links)
        families = components(near, scratch).withColumnRenamed("component", "family")
        ids = ids.join(families, "id", "left")
    else:
        ids = ids.withColumn("family", F.col("component"))
    ids = scratch.write(ids.select("id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("family", "id").alias("family")))
    if inside:
        several = ids.groupBy("family").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
        rows = scratch.write(ids.join(several.select("family"), "family").select("family", "id", "n"))
        if not rows.isEmpty():
            links = scratch.write_result(lambda own, links=links: links.unionByName(inside(rows, own)))
        scratch.drop(rows)

    placed = scratch.write(members.select("key", "id", "n").join(ids.select("id", "family"), "id"))
    scratch.drop(members)
    kinds = placed.groupBy("key", "family").agg(F.count("*").alias("m"))
    several = kinds.groupBy("key").agg(F.max(F.struct("m", "family")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = scratch.write(placed.join(several.select("key", F.col("most.family").alias("major")), "key"))
    sides = rows.join(held[0], "id") if room else rows

    def with_room(prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for read in held for c in read.columns if c != "id"]

    few = sides.where("family <> major").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("family").alias("fx"), *with_room("x_"))
    rest = sides.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("family").alias("fy"), (F.col("family") == F.col("major")).alias("in_major"), *with_room("y_"))
    once = F.col("in_major") | (F.col("x") < F.col("y"))  # two ids outside the largest family would meet twice
    sized = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    more = (
        few.join(rest, "key")
        .where((F.col("fx") != F.col("fy")) & sized & once & (fits("x_", "y_") if room else F.lit(True)))
        .groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.greatest("nx", "ny").alias("n"))
        .agg(F.count("*").alias("votes"))
    )
    more = scratch.write(more.join(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"))
    for read in (placed, rows, ids, pairs, *held):
        scratch.drop(read)
    waiting = more.count()
    while waiting > at_once:
        ends = more.select(F.explode(F.array("u", "v")).alias("id"), F.struct("votes", "u", "v", "n").alias("pair"))
        best = scratch.write(ends.groupBy("id").agg(F.max("pair").alias("pair")).select("pair.u", "pair.v", "pair.n").distinct())
        links = scratch.write_result(lambda own, links=links, best=best: links.unionByName(confirm(likely(best), own)))
        found = scratch.write_result(lambda own, links=links: components(links, own))
        more = scratch.write(_between(more.join(best.select("u", "v"), ["u", "v"], "left_anti"), found))
        before, waiting = waiting, more.count()
        if 2 * waiting > before:
            break
    if waiting:
        links = scratch.write_result(lambda own: links.unionByName(confirm(likely(more.drop("votes")), own)))
    return components(links, scratch)
