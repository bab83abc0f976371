"""A manifest of a dataset: a tree of hashes per source, a tree of the sources' hashes, and proofs of rows.

Nodes of a level stand in runs of ``FANOUT``. Columns at fixed offsets before and
after a node, by window functions inside its run, are its siblings; the first node of
a run hashes them into the parent. A run is the largest group any window sees,
so a source may hold any share of the rows. Positions come from one range partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemill.llm.common import stored

#: Children of a node.
FANOUT = 16
#: Type of the pairs of siblings on the way up.
WAY = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value for hashing: its length in bytes and its text, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def positions(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``position`` in their tree, from 0, and ``many``, the size of the tree.

    Rows are sorted by ranges; a row's position is its place in its partition, less where its
    tree begins there, plus what partitions before hold of the tree. The sum over
    partitions has one row per tree and partition.
    """
    # the place among all rows breaks ties, so that equal rows can lie in several ranges
    placed = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(tree), *(F.col(name).asc_nulls_first() for name in order), F.col("tie")]
    ranged = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ranged = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("place", 33)
    begins = ranged.groupBy(F.col(tree).alias("of_tree"), part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    all_parts = Window.partitionBy("of_tree")
    before = F.sum("n").over(all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = begins.select(
        "of_tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(all_parts).alias("many")
    )
    placed = ranged.join(begins, (F.col(tree) == F.col("of_tree")) & (part == F.col("part")))
    return placed.select(*rows.columns, (F.col("place") + F.col("shift")).alias("position"), "many")


def with_siblings(nodes: DataFrame, by: str = "run") -> DataFrame:
    """Adds ``run``, ``slot``, and the concatenated hashes ``left`` and ``right`` of a node in its run.

    ``by`` tells the runs of a tree apart.
    """
    nodes = nodes.withColumns({"run": F.floor(F.col("position") / FANOUT), "slot": F.col("position") % FANOUT})
    in_run = Window.partitionBy("tree", by).orderBy("slot")
    length = F.least(F.lit(FANOUT), F.col("many") - F.col("run") * FANOUT)
    none = F.lit("")
    before = [F.when(F.col("slot") >= back, F.lag("node", back).over(in_run)).otherwise(none) for back in range(FANOUT - 1, 0, -1)]
    after = [F.when(F.col("slot") + on < length, F.lead("node", on).over(in_run)).otherwise(none) for on in range(1, FANOUT)]
    return nodes.withColumns({"left": F.concat(*before), "right": F.concat(*after)})


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``leaves`` (``tree``, ``position``, ``many``, ``node``), and the tops: ``tree``, ``node``.

    A level has the nodes that have siblings, with these, and a sixteenth of the rows of the one below; each is written.
    """
    levels, tops = [], leaves.where("many = 1").select("tree", "node")
    level = with_siblings(leaves.select("tree", "position", "many", "node").where("many > 1"))
    while True:
        parents = level.where("slot = 0").select(
            "tree", F.col("run").alias("position"), F.ceil(F.col("many") / FANOUT).alias("many"), digest(F.col("node"), F.col("right")).alias("node")
        )
        parents = stored(parents, "parents")
        if parents.isEmpty():
            return levels, stored(tops, "tops")
        tops = tops.unionByName(parents.where("many = 1").select("tree", "node"))
        level = stored(with_siblings(parents.where("many > 1")), "level")
        levels.append(level)


def parent(many: Column, run: Column) -> Column:
    """Position of a node's parent, -1 if that is the top of the tree."""
    return F.when(many <= FANOUT, F.lit(-1).cast("long")).otherwise(run)


def ways_of_parents(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``of_tree``, ``at``, ``way``: the pairs (left, right) from a parent of leaves up to the top of its tree.

    Built from the top down, so that every level is joined with one a sixteenth of its size.
    """
    nothing = F.array().cast(WAY)
    ends = tops.select(F.col("tree").alias("of_tree"), F.lit(-1).cast("long").alias("at"), nothing.alias("way"))
    above = ends
    for level in reversed(levels):
        here = level.withColumn("above", parent(F.col("many"), F.col("run")))
        here = here.join(above, (F.col("tree") == F.col("of_tree")) & (F.col("above") == F.col("at")))
        here = here.select(F.col("tree").alias("of_tree"), F.col("position").alias("at"), F.concat(F.array(F.struct("left", "right")), "way").alias("way"))
        above = stored(here.unionByName(ends), "ways")
    return above


def climb(node: Column, way: Column) -> Column:
    """The hash at the end of a way of siblings."""
    return F.aggregate(way, node, lambda held, step: digest(step["left"], held, step["right"]))


def with_ways(leaves: DataFrame, ways: DataFrame) -> DataFrame:
    """``leaves`` with ``way``, the siblings of every level. A leaf that is all of its tree has no siblings and no step.

    The windows and the join share their partitioning, so that leaves move once.
    """
    run = F.floor(F.col("position") / FANOUT)
    marked = leaves.withColumn("above", parent(F.col("many"), run))
    own = F.when(F.col("many") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast(WAY))
    joined = with_siblings(marked, "above").join(ways, (F.col("tree") == F.col("of_tree")) & (F.col("above") == F.col("at")))
    return joined.withColumn("way", F.concat(own, "way"))


def manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    A leaf hashes the row's ``fields``. Leaves of a source ascend by ``key``, null first, and by hash where keys are the
    same; a null source is a tree of its own, the first one. A lone leaf is its own subroot, a lone subroot the root. The proof is the
    hash of all siblings on the way to the root; ``folded_root`` climbs that way again from the leaf, or, where the condition
    ``tampered`` on ``docs`` holds (null: does not), from the leaf of the row with the A-Z of its text in lower case.
    Repeated rows have leaves of their own. An empty table gives no rows. Columns other than the fields are ignored, whatever
    their names, but for those the condition names.
    """
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = digest(*(field(lowered if name == text else F.col(name)) for name in fields))
    tampers = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        F.col(key).alias("key"),
        field(F.col(source)).alias("tree"),
        digest(*(field(F.col(name)) for name in fields)).alias("node"),
        F.when(tampers, changed).alias("changed"),
    )
    leaves = stored(positions(stored(leaves, "leaves"), "tree", "key", "node"), "positions")
    levels, subroots = grow(leaves)
    named = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "node", named.alias("name"))
    forest = stored(positions(forest, "tree", "name"), "forest")
    upper, top = grow(forest)
    root = top.select("node").first()
    roots = with_ways(forest, ways_of_parents(upper, top)).select("member", F.col("node").alias("subroot"), F.col("way").alias("upper"))
    ways = ways_of_parents(levels, subroots).join(stored(roots, "roots"), F.col("of_tree") == F.col("member"))
    ways = ways.select("of_tree", "at", "subroot", F.concat("way", "upper").alias("way"))
    found = with_ways(leaves, ways)
    proof = F.array_join(F.flatten(F.transform("way", lambda step: F.array(step["left"], step["right"]))), "")
    found = found.select(
        F.col("key").alias(key),
        F.col("node").alias("leaf"),
        "subroot",
        F.lit(root["node"] if root else None).cast("string").alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        climb(F.coalesce("changed", "node"), F.col("way")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
