"""Full hierarchies from parent links: paths, depths, roots, descendants, circles.

List ranking over splitters. A node is a splitter if its hash falls into one of ``k``
residues, which every executor decides alone. All nodes walk to the next splitter (or to
a root), extending their pointers by those of the node they point to, so the number of
rounds follows the logarithm of the longest gap between splitters. The splitters alone
then form a reduced pointer graph of about n/k nodes, which is solved the same way, and
each node's exact path is its own walk followed by its splitter's. A pointer never
passes a splitter in the first phase, so hot nodes near a root are joined by few rows.

Nodes that never reach a root lead into a circle. Circles without a splitter show in the
first phase (a walk meets itself), all others in the reduced graph. Nodes below a circle
are solved by a second pass in which the nodes on circles are the roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typegraph.plans.scratch import Scratch

#: One node in so many is a splitter.
SPLITTER_GAP = 8
_ROUNDS = 60  # pointers double in each round


def is_splitter(node: Column, gap: int = SPLITTER_GAP) -> Column:
    """Deterministic choice of splitters by hash."""
    return F.pmod(F.xxhash64(node), F.lit(gap)) == 0


def _follow(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Extend open pointers until each ends at a stop or is known to run round.

    rows: (node, cur, path, state, rooted); state is open, done or loop.
    """
    rows = scratch.save(rows)
    for _ in range(_ROUNDS):
        if rows.filter("state = 'open'").isEmpty():
            return rows
        by = rows.select(
            F.col("node").alias("__n"), F.col("cur").alias("__c"), F.col("path").alias("__p"),
            F.col("state").alias("__s"), F.col("rooted").alias("__r"),
        )
        moved = rows.filter("state = 'open'").join(by, F.col("cur") == F.col("__n")).select(
            "node",
            F.col("__c").alias("cur"),
            F.concat("path", "__p").alias("path"),
            F.col("__s").alias("state"),
            F.col("__r").alias("rooted"),
        )
        met = F.array_contains("path", F.col("node")) | (F.size(F.array_distinct("path")) < F.size("path"))
        moved = moved.withColumn("state", F.when(met, F.lit("loop")).otherwise(F.col("state")))
        rows = scratch.save(rows.filter("state <> 'open'").unionByName(moved))
    raise RuntimeError("a hierarchy deeper than 2^60 links")


def _solve(links: DataFrame, scratch: Scratch, gap: int) -> tuple[DataFrame, DataFrame]:
    """links: (node, parent), one row per node, parent <> node.

    Returns (node, path from parent to root) of all nodes that reach a root, and the rows
    (node, path, on_circle, least) of all others; least is set where on_circle is.
    """
    known = links.select(F.col("node").alias("__k"))
    first = links.join(known, F.col("parent") == F.col("__k"), "left").select(
        "node",
        F.col("parent").alias("cur"),
        F.array("parent").alias("path"),
        F.col("__k").isNull().alias("rooted"),
    )
    stop = F.col("rooted") | is_splitter(F.col("cur"), gap)
    first = first.withColumn("state", F.when(stop, F.lit("done")).otherwise(F.lit("open")))
    walks = _follow(first.select("node", "cur", "path", "state", "rooted"), scratch)

    ends = F.when(F.col("state") == "loop", F.lit("loop")).when(F.col("rooted"), F.lit("done")).otherwise(F.lit("open"))
    loop_at_once = F.when((F.col("state") != "loop") & F.array_contains("path", F.col("node")), F.lit("loop")).otherwise(ends)
    reduced = walks.filter(is_splitter(F.col("node"), gap)).withColumn("state", loop_at_once)
    reduced = _follow(reduced, scratch)

    onward = reduced.select(F.col("node").alias("__n"), F.col("path").alias("__p"), F.col("state").alias("__s"))
    out = walks.join(onward, (F.col("cur") == F.col("__n")) & ~F.col("rooted") & (F.col("state") == "done"), "left")
    full = out.select(
        "node",
        F.when(F.col("__p").isNull(), F.col("path")).otherwise(F.concat("path", "__p")).alias("path"),
        F.when((F.col("state") == "loop") | (F.col("__s") == "loop"), F.lit("loop")).otherwise(F.lit("done")).alias("state"),
    )
    full = scratch.save(full)

    def circle(rows: DataFrame) -> DataFrame:
        met = rows.filter("state = 'loop'").filter(F.array_contains("path", F.col("node")))
        return met.select("node", F.expr("slice(path, 1, cast(array_position(path, node) as int))").alias("ring"))

    ring_split = circle(reduced).filter(F.array_min(F.filter("ring", lambda x: is_splitter(x, gap))) == F.col("node"))
    on = ring_split.select(F.explode("ring").alias("node"), F.array_min("ring").alias("least"))
    on = on.unionByName(circle(walks).select("node", F.array_min("ring").alias("least"))).distinct()
    return full.filter("state = 'done'").select("node", "path"), on.unionByName(
        full.filter("state = 'loop'").select("node", F.lit(None).cast("string").alias("least"))
    ).groupBy("node").agg(F.max("least").alias("least"))


def hierarchy(links: DataFrame, spark: SparkSession, gap: int = SPLITTER_GAP) -> DataFrame:
    """(node, root, depth, path, state) for each node of ``links`` (node, parent).

    path is the array from the root down to the node for ``tree`` rows and null
    otherwise. On a circle: state ``cycle``, depth -1; below one: ``below_cycle`` with
    the steps to the first node on it; root is then the smallest node on the circle.
    Links with a null end and links of a node to itself are void. If a node has several
    parents, the smallest holds. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "hierarchy")
    links = (
        links.select(F.col("node").alias("node"), F.col("parent").alias("parent"))
        .filter("node is not null and parent is not null and node <> parent")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"))
    )
    links = scratch.save(links)
    tree, stuck = _solve(links, scratch, gap)
    out = tree.select(
        "node",
        F.element_at("path", -1).alias("root"),
        F.size("path").alias("depth"),
        F.concat(F.reverse("path"), F.array("node")).alias("path"),
        F.lit("tree").alias("state"),
    )
    stuck = scratch.save(stuck)
    if stuck.isEmpty():
        return out
    none = F.lit(None).cast("array<string>")
    rings = stuck.filter("least is not null")
    on = rings.select("node", F.col("least").alias("root"), F.lit(-1).alias("depth"), none.alias("path"), F.lit("cycle").alias("state"))
    out = out.unionByName(on)
    below = links.join(stuck.filter("least is null").select("node"), "node", "left_semi")
    if below.isEmpty():
        return out
    lower, _ = _solve(scratch.save(below), scratch, gap)
    ring = rings.select(F.col("node").alias("__c"), F.col("least").alias("root"))
    under = lower.join(ring, F.element_at("path", -1) == F.col("__c")).select(
        "node", "root", F.size("path").alias("depth"), none.alias("path"), F.lit("below_cycle").alias("state")
    )
    return out.unionByName(under)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all tree rows of :func:`hierarchy`."""
    at = tree.filter("state = 'tree'").select("node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return at.filter("pos < depth").select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("pos")).alias("distance"))
