"""Parent/child hierarchies and recursive queries.

Chains, in which every node has one edge from above, are followed by doubling pointers: a chain of any length takes a
number of rounds logarithmic in it. Only nodes with several edges from above are then walked one by one. Every round is
written, so plan and lineage stay short and a lost executor does not replay earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querydelta.functions.logic import as_column, tally, with_flag
from querydelta.session import durable

WIDE = "decimal(38,0)"


def hierarchy_paths(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Root rows, rows whose parent exists and orphans.

    Rows are counted per parent first: a parent with very many children is one
    row of the join.
    """
    counted = df.groupBy(F.col(parent).alias("parent__")).agg(F.count(F.lit(1)).alias("n__"))
    known = df.select(F.col(node).alias("known__")).where("known__ is not null").distinct()
    joined = counted.join(known, F.col("parent__") == F.col("known__"), "left")
    path = (
        F.when(F.col("parent__").isNull(), "root")
        .when(F.col("known__").isNotNull(), "child").otherwise("orphan")
    )
    labels = df.sparkSession.createDataFrame([("root",), ("child",), ("orphan",)], "path string")
    sums = joined.groupBy(path.alias("path")).agg(F.sum("n__").alias("n"))
    return with_flag(
        labels.join(sums, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def _chains(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, at, steps, factor``: the nearest node above that is a start or has several edges from above.

    ``arcs``: above, node, copies; one row per edge. ``starts``: node. Such a node stands at itself; one that hangs on
    nothing, or on a cycle of single edges, has no row. ``factor`` is the product of the copies on the way.
    """
    several = F.col("n__") > 1
    counted = arcs.groupBy("node").agg(F.count(F.lit(1)).alias("n__"), F.min("above").alias("above"), F.min("copies").alias("copies"))
    joined = counted.join(starts.select(F.col("node").alias("start__")), F.col("node") == F.col("start__"), "full").select(
        F.coalesce("node", "start__").alias("node"), "above", "copies", (F.col("start__").isNotNull() | several).alias("stands"),
    )
    first = durable(joined.select(
        "node", F.when(F.col("stands"), F.col("node")).otherwise(F.col("above")).alias("at"),
        F.when(F.col("stands"), 0).otherwise(1).cast("bigint").alias("steps"),
        F.when(F.col("stands"), 1).otherwise(F.col("copies")).cast(WIDE).alias("factor"), "stands",
    ))
    done, open_ = first.where("stands").drop("stands"), first.where("not stands").drop("stands")
    longest, reach = first.count(), 1
    while reach <= longest and not open_.isEmpty():
        upper = done.withColumn("ended", F.lit(True)).unionAll(open_.withColumn("ended", F.lit(False))).select(
            F.col("node").alias("of__"), F.col("at").alias("next__"), F.col("steps").alias("more__"), F.col("factor").alias("times__"), "ended"
        )
        moved = durable(open_.join(upper, F.col("at") == F.col("of__")).select(
            "node", F.col("next__").alias("at"), (F.col("steps") + F.col("more__")).alias("steps"),
            (F.col("factor") * F.col("times__")).cast(WIDE).alias("factor"), "ended",
        ))
        done = done.unionAll(moved.where("ended").drop("ended"))
        open_, reach = moved.where("not ended").drop("ended"), reach * 2
    return durable(done)


def _contracted(arcs: DataFrame, chains: DataFrame) -> DataFrame:
    """``above, node, steps, copies``: ways between the nodes that stand at themselves, each over one chain and its last edge."""
    last = arcs.join(chains.where("node = at").select("node"), "node", "left_semi")
    upper = chains.select(F.col("node").alias("of__"), "at", "steps", "factor")
    return durable(
        last.join(upper, F.col("above") == F.col("of__")).select(
            F.col("at").alias("above"), "node", (F.col("steps") + 1).alias("steps"),
            (F.col("factor") * F.col("copies")).cast(WIDE).alias("copies"),
        ).groupBy("above", "node", "steps").agg(F.sum("copies").cast(WIDE).alias("copies"))
    )


def _least_depths(ways: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, depth`` along shortest ways; rounds go on until no depth changes."""
    ways = ways.select("above", F.col("node").alias("to__"), "steps")
    reached = newest = durable(starts.select("node", F.lit(0).cast("bigint").alias("depth")))
    while not newest.isEmpty():
        further = ways.join(newest, F.col("above") == F.col("node")).groupBy(F.col("to__").alias("node")).agg(
            F.min(F.col("depth") + F.col("steps")).alias("found")
        )
        newest = durable(
            further.join(reached, "node", "left").where("depth is null or found < depth").select("node", F.col("found").alias("depth"))
        )
        reached = durable(reached.unionAll(newest).groupBy("node").agg(F.min("depth").alias("depth")))
    return reached


def hierarchy_reach(
    df: DataFrame, node: str, parent: str, roots: Column | str, max_depth: int | None = None
) -> DataFrame:
    """Every node with its least depth below the root rows; NULL where none is reached.

    Chains are followed by doubling; nodes with several parents are reached along shortest ways between such nodes
    until no depth changes, so cycles end. With ``max_depth`` a deeper hierarchy raises an error
    rather than return a part of the answer.
    """
    arcs = durable(
        df.select(F.col(parent).alias("above"), F.col(node).alias("node")).where("above is not null and node is not null")
        .distinct().withColumn("copies", F.lit(1).cast(WIDE))
    )
    starts = durable(df.where(as_column(roots)).select(F.col(node).alias("node")).where("node is not null").distinct())
    chains = _chains(arcs, starts)
    reached = _least_depths(_contracted(arcs, chains), starts)
    top = reached.select(F.col("node").alias("at"), "depth")
    depths = chains.join(top, "at").select(F.col("node").alias(node), (F.col("depth") + F.col("steps")).cast("int").alias("depth"))
    if max_depth is not None:
        depths = durable(depths)
        if not depths.where(F.col("depth") > max_depth).isEmpty():
            raise ValueError(f"the hierarchy is deeper than max_depth={max_depth}")
    return df.select(node).distinct().join(depths, node, "left").select(node, "depth")


def recursion_effect(reach: DataFrame) -> DataFrame:
    """What a recursive query finds beyond its one-level form, from ``hierarchy_reach``."""
    depth = F.col("depth")
    return with_flag(
        tally(
            reach,
            {
                "root": F.coalesce(depth == 0, F.lit(False)),
                "one_level": F.coalesce(depth == 1, F.lit(False)),
                "recursive_only": F.coalesce(depth > 1, F.lit(False)),
                "unreached": depth.isNull(),
            },
        )
    )


def _endless(ways: DataFrame) -> DataFrame:
    """The nodes on or behind a cycle of ``ways``: an edge goes once nothing leads to its start any more."""
    rest = durable(ways.select("above", "node").distinct())
    left, before = rest.count(), -1
    while left != before:
        rest = durable(rest.join(rest.select(F.col("node").alias("above")).distinct(), "above", "left_semi"))
        left, before = rest.count(), left
    return durable(rest.select("node").distinct())


def path_multiplicity(
    edges: DataFrame, source: str, target: str, roots: DataFrame, max_depth: int | None = None
) -> DataFrame:
    """Paths from the roots to each node, of any length or up to a given ``max_depth`` edges.

    A node on several paths is where UNION and UNION ALL recursion differ:
    UNION ALL returns it ``n_paths`` times. Paths are summed, never listed: along chains by doubling, between nodes with
    several edges from above round by round, until a round is empty. Without ``max_depth`` a node on or behind a
    cycle has no last path: its ``n_paths`` and ``last_depth`` are NULL and
    ``union_all_differs`` is true. ``roots`` has the column ``source``.
    """
    arcs = durable(
        edges.where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(source).alias("above"), F.col(target).alias("node")).agg(F.count(F.lit(1)).cast(WIDE).alias("copies"))
    )
    starts = durable(roots.groupBy(F.col(source).alias("node")).agg(F.count(F.lit(1)).cast(WIDE).alias("paths")))
    if max_depth is not None:
        found = _counted(arcs.withColumn("steps", F.lit(1).cast("bigint")), starts, max_depth)
        return found.withColumn("union_all_differs", F.col("n_paths") > 1)
    chains = _chains(arcs, starts.select("node"))
    ways = _contracted(arcs, chains)
    reached = _least_depths(ways, starts)
    ways = durable(ways.join(reached.select(F.col("node").alias("above")), "above", "left_semi"))
    endless = _endless(ways)
    finite = _counted(
        ways.join(endless, "node", "left_anti"), starts.join(endless, "node", "left_anti"), None
    ).withColumnRenamed("node", "at")
    steps = F.col("steps").cast("int")
    counted = chains.join(finite, "at").select(
        "node", (F.col("n_paths") * F.col("factor")).cast(WIDE).alias("n_paths"), (F.col("first_depth") + steps).alias("first_depth"),
        (F.col("last_depth") + steps).alias("last_depth"),
    ).withColumn("union_all_differs", F.col("n_paths") > 1)
    behind = reached.join(endless, "node", "left_semi").select(F.col("node").alias("at"), "depth")
    return counted.unionAll(chains.join(behind, "at").select(
        "node", F.lit(None).cast(WIDE).alias("n_paths"), (F.col("depth").cast("int") + steps).alias("first_depth"),
        F.lit(None).cast("int").alias("last_depth"), F.lit(True).alias("union_all_differs"),
    ))


def _counted(ways: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """``node, n_paths, first_depth, last_depth`` over ``ways`` without cycles, or with at most ``max_depth`` steps."""
    level = levels = durable(starts.select("node", "paths", F.lit(0).cast("bigint").alias("depth")))
    arcs, rounds = ways.select("above", F.col("node").alias("next__"), "steps", "copies"), 0
    while max_depth is None or rounds < max_depth:
        rounds += 1
        step = level.join(arcs, F.col("node") == F.col("above")).groupBy(
            F.col("next__").alias("node"), (F.col("depth") + F.col("steps")).alias("depth")
        ).agg(F.sum((F.col("paths") * F.col("copies")).cast(WIDE)).cast(WIDE).alias("paths"))
        level = durable(step.select("node", "paths", "depth"))
        if level.isEmpty():
            break
        levels = levels.unionAll(level)
        if rounds % 32 == 0:
            levels = durable(levels)
    return levels.groupBy("node").agg(
        F.sum("paths").cast(WIDE).alias("n_paths"), F.min("depth").cast("int").alias("first_depth"),
        F.max("depth").cast("int").alias("last_depth"),
    )
