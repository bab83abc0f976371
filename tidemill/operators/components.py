"""Strongly connected components of many graphs at once, in few rounds whatever their depth.

A node whose incoming edges times outgoing edges are no more than their sum is taken
out: what leads to it is joined to what it leads to. That keeps all paths between
other nodes and never adds edges, and of the nodes that qualify all that have
no neighbour of a smaller hash go in one round, so that chains and ladders of any depth shrink
by a share of their nodes. What is left when no node qualifies is dense, and
taken apart by colours: every node gets the largest node that reaches it, and of
the nodes of one colour those that reach its namesake are its component. Afterwards the nodes taken out come
back, latest first: such a node belongs to the component that leads to it and is led to by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.session import Materialized, materialize

_EDGE = ["graph", "src", "dst"]
_NODE = ["graph", "node"]


@dataclass(frozen=True)
class Components:
    """``rows`` (graph, node, component): nodes on a circle, with the smallest node of their component."""

    rows: DataFrame
    rounds: int


def shuffled(rows: DataFrame) -> DataFrame:
    """One side of a join that both sides are shuffled for. Every round has a dozen joins: small sides
    sent out through the driver would add up in it, round after round."""
    return rows.hint("merge")


def _ends(edges: DataFrame, end: str) -> DataFrame:
    return edges.select("graph", F.col(end).alias("node"))


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with no end among the nodes."""
    for end in ("src", "dst"):
        edges = edges.join(shuffled(nodes.select("graph", F.col("node").alias(end))), ["graph", end], "left_anti")
    return edges.select(_EDGE)


def _degrees(edges: DataFrame) -> DataFrame:
    ins = _ends(edges, "dst").withColumns({"ins": F.lit(1), "outs": F.lit(0)})
    outs = _ends(edges, "src").withColumns({"ins": F.lit(0), "outs": F.lit(1)})
    return ins.unionByName(outs).groupBy(_NODE).agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))


def _priority(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64("graph", node, F.lit(turn)), F.col(node))


def _picked(edges: DataFrame, few: DataFrame, turn: int) -> DataFrame:
    """Of the nodes with few edges those without a neighbour among them that comes first."""
    both = edges
    for end in ("src", "dst"):
        both = both.join(shuffled(few.select("graph", F.col("node").alias(end))), ["graph", end], "left_semi")
    later = F.when(_priority("src", turn) < _priority("dst", turn), F.col("dst")).otherwise(F.col("src"))
    return few.select(_NODE).join(shuffled(both.select("graph", later.alias("node")).distinct()), _NODE, "left_anti")


@dataclass(frozen=True)
class _Round:
    edges: Materialized
    gone: DataFrame  # graph, node, other, inbound: the edges of the nodes taken out
    circles: DataFrame  # graph, node: nodes that lead to themselves through one of these


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges whose start is led to and whose end leads on."""
    reached = edges.select("graph", F.col("dst").alias("src")).distinct()
    leaving = edges.select("graph", F.col("src").alias("dst")).distinct()
    return edges.join(shuffled(reached), ["graph", "src"], "left_semi").join(shuffled(leaving), ["graph", "dst"], "left_semi").select(_EDGE)


def _contract(edges: DataFrame, turn: int) -> _Round:
    degrees = materialize(_degrees(edges), "degrees").rows
    product, total = F.col("ins") * F.col("outs"), F.col("ins") + F.col("outs")
    kept = _without(edges, degrees.where(product == 0))
    picked = materialize(_picked(edges, degrees.where((product > 0) & (product <= total)), turn), "picked").rows
    inbound = kept.join(shuffled(picked.withColumnRenamed("node", "dst")), ["graph", "dst"]).select("graph", F.col("dst").alias("node"), F.col("src").alias("other"))
    outbound = kept.join(shuffled(picked.withColumnRenamed("node", "src")), ["graph", "src"]).select("graph", F.col("src").alias("node"), F.col("dst").alias("other"))
    gone = inbound.withColumn("inbound", F.lit(True)).unionByName(outbound.withColumn("inbound", F.lit(False)))
    gone = materialize(gone, "gone").rows
    sides = {side: gone.where(F.col("inbound") == side).select("graph", "node", F.col("other").alias(name)) for side, name in ((True, "src"), (False, "dst"))}
    through = materialize(sides[True].join(shuffled(sides[False]), _NODE).select(_EDGE).distinct(), "through").rows
    rest = _without(kept, picked).unionByName(through.where("src <> dst")).distinct()
    return _Round(materialize(rest, "edges"), gone, through.where("src = dst").select("graph", F.col("src").alias("node")))


def _colours(edges: DataFrame) -> tuple[Materialized, int]:
    """Components of the nodes that give a colour its name: (graph, node, component)."""
    nodes = _ends(edges, "src").unionByName(_ends(edges, "dst")).distinct()
    colour, rounds = materialize(nodes.withColumns({"colour": F.col("node"), "changed": F.lit(True)}), "colour"), 0
    while True:
        rounds += 1
        sent = colour.rows.where("changed").select("graph", F.col("node").alias("src"), F.col("colour").alias("sent"))
        largest = edges.join(shuffled(sent), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.max("sent").alias("sent"))
        moved = colour.rows.join(shuffled(largest), _NODE, "left").select(
            *_NODE, F.greatest("colour", "sent").alias("colour"), F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("changed")
        )
        following = materialize(moved, "colour")
        colour.drop()
        colour = following
        if not colour.rows.where("changed").take(1):
            break
    paint = colour.rows.select("graph", "node", "colour")
    same = edges.join(shuffled(paint.select("graph", F.col("node").alias("src"), F.col("colour").alias("src_colour"))), ["graph", "src"])
    same = same.join(shuffled(paint.select("graph", F.col("node").alias("dst"), F.col("colour").alias("dst_colour"))), ["graph", "dst"])
    same = materialize(same.where("src_colour = dst_colour").select(*_EDGE, F.col("src_colour").alias("colour")), "one_colour").rows
    found = materialize(paint.where("node = colour").select(*_NODE, F.lit(0).alias("round")), "members")
    while True:
        rounds += 1
        newest = found.rows.where(F.col("round") == found.rows.agg(F.max("round")).first()[0]).select("graph", F.col("node").alias("dst"))
        reached = same.join(shuffled(newest), ["graph", "dst"]).select("graph", F.col("src").alias("node")).distinct()
        fresh = materialize(reached.join(shuffled(found.rows), _NODE, "left_anti").withColumn("round", F.lit(rounds)), "reached")
        if not fresh.count:
            break
        following = materialize(found.rows.unionByName(fresh.rows.select(*_NODE, "round")), "members")
        found.drop()
        found = following
    members = found.rows.join(shuffled(paint), _NODE).select(*_NODE, F.col("colour").alias("component"))
    return materialize(members, "components"), rounds


def _come_back(gone: DataFrame, known: DataFrame) -> DataFrame:
    """Components of the nodes of a round: the one on both sides of a node."""
    held = known.select("graph", F.col("node").alias("other"), "component")
    sided = gone.join(shuffled(held), ["graph", "other"], "left").select(*_NODE, "inbound", F.coalesce("component", "other").alias("component"))
    both = sided.groupBy(*_NODE, "component").agg(F.count_distinct("inbound").alias("sides")).where("sides = 2")
    return both.groupBy(_NODE).agg(F.min("component").alias("component"))


def strong_components(edges: DataFrame, graph: str = "dag_id", src: str = "src", dst: str = "dst", members: bool = True) -> Components:
    """Nodes that lie on a circle, and the components they form.

    Edges with a null end or graph are none; repeated edges count once. A node on no circle has no row. With
    ``members`` false, only some nodes of every graph that has circles are given, each with itself as its component, which
    saves bringing nodes back. Rounds are counted as the steps that read all edges left; each is written
    below the scratch folder, and only the number of its edges comes to the driver.
    """
    named = edges.select(F.col(graph).alias("graph"), F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct()
    loops = named.where("src = dst").select("graph", F.col("src").alias("node"))
    left = materialize(named.where("src <> dst"), "edges")
    gone, circles, dense, rounds = [], [loops], [], 0
    while left.count:
        # most graphs are shallow and have no circle: while ends that lie on none are many, they are taken off first
        while left.count:
            rounds += 1
            less = materialize(_peeled(_peeled(left.rows)), "edges")
            few = less.count * 4 > left.count * 3
            left.drop()
            left = less
            if few:
                break
        if not left.count:
            break
        done = _contract(left.rows, rounds)
        gone.append(done.gone)
        circles.append(done.circles)
        if done.edges.count and done.edges.count == left.count and not done.gone.take(1):
            found, more = _colours(done.edges.rows)
            rounds += more
            dense.append(found.rows)
            rest = materialize(_without(done.edges.rows, found.rows), "edges")
        else:
            rest = done.edges
        if not members:  # a graph with a circle is done
            rest = materialize(rest.rows.join(shuffled(done.circles.select("graph").distinct()), "graph", "left_anti"), "edges")
        left.drop()
        left = rest
    one = circles[0]
    for more in circles[1:]:
        one = one.unionByName(more)
    known = loops.select(*_NODE, F.col("node").alias("component")).limit(0)
    for found in dense:
        known = known.unionByName(found)
    if not members:
        several = known.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("graph", F.col("component").alias("node"))
        rows = one.unionByName(several).distinct().select(*_NODE, F.col("node").alias("component"))
        return Components(rows, rounds)
    known = materialize(known, "components").rows
    for taken in reversed(gone):
        known = materialize(known.unionByName(_come_back(taken, known)), "components").rows
    named_after = known.select("graph", F.col("component").alias("node"), "component").unionByName(known.select(*_NODE, "component"))
    named_after = named_after.unionByName(loops.select(*_NODE, F.col("node").alias("component")).join(shuffled(known), _NODE, "left_anti")).distinct()
    sizes = named_after.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    cyclic = named_after.join(shuffled(sizes), ["graph", "component"]).join(shuffled(loops.withColumn("loop", F.lit(True))), _NODE, "left")
    rows = cyclic.where("n > 1 OR loop").select(*_NODE, F.col("least").alias("component")).distinct()
    return Components(rows, rounds)
