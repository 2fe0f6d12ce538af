"""Parent chains in a table of (id, parent): depth and cycles.

Pointer doubling: after round r a node knows its ancestor 2^r steps up, so a
chain of length d needs log2(d) joins instead of d. Nodes that have reached
their root leave the join. Ids with several parents are a general graph and
take a way of their own. The joins of a loop are sort-merge joins: what a round leaves is
a share of the table, nothing to send through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored


def parent_edges(df: DataFrame, node: Column, parent: Column) -> DataFrame:
    """(id, jump, depth): one step up; parents outside the table are roots. For ids with one parent."""
    edges = df.select(node.alias("id"), parent.alias("up")).filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("up").alias("up"))
    known = edges.select(F.col("id").alias("up")).withColumn("known", F.lit(True))
    return (edges.join(known, "up", "left")
            .select("id", F.when(F.col("known"), F.col("up")).alias("jump"))
            .withColumn("depth", F.when(F.col("jump").isNotNull(), 1).otherwise(0).cast("long")))


def doubled(state: DataFrame, steps: int) -> DataFrame:
    """Follow chains until they end or at least ``steps`` steps were taken."""
    state, reach = stored(state), 1
    while reach < steps and not state.filter(F.col("jump").isNotNull()).isEmpty():
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        moved = (state.filter(F.col("jump").isNotNull()).join(ahead.hint("merge"), "jump")
                 .select("id", F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth")))
        state = stored(state.filter(F.col("jump").isNull()).unionByName(moved))
        reach *= 2
    return state


def all_edges(df: DataFrame, node: Column, parent: Column) -> tuple[DataFrame, DataFrame, bool]:
    """(id) of all nodes, (id, up) of all edges within the table, and whether a node has several parents."""
    pairs = df.select(node.alias("id"), parent.alias("up")).filter(F.col("id").isNotNull())
    ids = pairs.select("id").distinct()
    edges = stored(pairs.filter(F.col("up").isNotNull()).distinct().join(ids.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
    return ids, edges, not edges.groupBy("id").count().filter("count > 1").isEmpty()


def levels(ids: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth, root_reached) by the longest way up, for nodes of several parents: one round per level, down from the
    roots. Nodes below or on a cycle count as deeper than ``max_depth``."""
    frontier = stored(ids.join(edges.select("id").distinct(), "id", "left_anti"))
    found = frontier.withColumn("depth", F.lit(0).cast("long"))
    for depth in range(1, max_depth + 2):
        frontier = stored(edges.join(frontier.select(F.col("id").alias("up")), "up").select("id").distinct())
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth).cast("long")))
    deepest = found.groupBy("id").agg(F.max("depth").alias("depth"))
    return (ids.join(deepest, "id", "left").select("id", F.coalesce("depth", F.lit(max_depth + 1)).cast("long").alias("depth"))
            .withColumn("root_reached", F.col("depth") <= max_depth))


def cycle_members(edges: DataFrame) -> DataFrame:
    """(id): nodes on a cycle, for nodes of several parents, ``edges`` (id, up) being distinct.

    The graph is shrunk first: in turns, nodes without a way in or out are peeled off, and stretches of nodes with one way in and one way
    out become one edge, found by pointer doubling, so a tree or a ring of n nodes is gone after some log2(n) joins. What is
    left are the nodes where ways part or meet; its strongly connected parts tell which edges, and so which stretches, lie on
    a cycle. Rows stay in proportion to the edges throughout.
    """
    left, belongs, rings, turn = edges.select("id", "up", F.lit(None).cast("string").alias("stretch")), [], [], 0
    n = -1
    while (m := left.count()) != n:
        n = m
        left = stored(left.join(left.select(F.col("id").alias("up")).distinct(), "up", "left_semi"))
        left = stored(left.join(left.select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", "up", "stretch"))
        left, held, ring = contracted(left, turn)
        belongs, rings, turn = belongs + held, rings + ring, turn + 1
    part = strong_parts(left.select("id", "up").distinct())
    ends = left.join(part.select("id", F.col("part").alias("a")), "id").join(part.select(F.col("id").alias("up"), F.col("part").alias("b")), "up").filter("a = b")
    members = ends.select("id")
    # Stretches of later turns hold nodes and stretches of earlier ones.
    live = stored(ends.filter("stretch is not null").select("stretch").distinct())
    for held in reversed(belongs):
        inside = stored(held.join(live, "stretch", "left_semi"))
        members = members.unionByName(inside.filter("id is not null").select("id"))
        live = stored(live.unionByName(inside.filter("inner is not null").select(F.col("inner").alias("stretch"))).distinct())
    for ring in rings:
        members = members.unionByName(ring)
    return members.distinct()


def contracted(edges: DataFrame, turn: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Edges (id, up, stretch) with each stretch of nodes of one way in and one way out as one edge; what the new stretches hold, as
    (id, inner, stretch): nodes and former stretches; and the nodes of rings that nothing leads into or out of."""
    ways = edges.select(F.col("id").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("in"), (F.col("id") == F.col("up")).cast("int").alias("loop")).unionByName(
        edges.select(F.col("up").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("in"), F.lit(0).alias("loop")))
    inner = stored(ways.groupBy("v").agg(F.sum("out").alias("out"), F.sum("in").alias("in"), F.sum("loop").alias("loop"))
                         .filter("out = 1 and `in` = 1 and loop = 0").select("v"))
    n = inner.count()
    if not n:
        return edges, [], []
    on = edges.join(inner, F.col("id") == F.col("v")).select("id", "up", F.col("stretch").alias("inner"))
    marked = inner.select(F.col("v").alias("jump"), F.lit(True).alias("more"))
    # Whoever has reached the end of its stretch leaves the join; ``tail`` is the stretch's last node.
    state = stored(on.select("id", F.col("up").alias("jump"), F.col("id").alias("tail")).join(marked, "jump", "left"))
    reach = 1
    while reach < 2 * n and not state.filter("more").isEmpty():
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("tail").alias("last"), F.col("more").alias("on"))
        moved = state.filter("more").join(ahead.hint("merge"), "jump").select("id", F.col("next").alias("jump"), F.col("last").alias("tail"), F.col("on").alias("more"))
        state = stored(state.filter("more is null").select("id", "jump", "tail", "more").unionByName(moved))
        reach *= 2
    ended = state.filter("more is null").select("id", "jump", F.concat(F.lit(f"{turn}:"), F.col("tail").cast("string")).alias("name"))
    ring = state.filter("more").select("id")
    outside = edges.join(inner, F.col("id") == F.col("v"), "left_anti")
    into = stored(outside.join(ended.select(F.col("id").alias("up"), "jump", "name"), "up", "left"))
    held = (on.join(ended, "id").select("id", "inner", F.col("name").alias("stretch"))
            .unionByName(into.filter("name is not null and stretch is not null").select(F.lit(None).cast(edges.schema["id"].dataType).alias("id"), F.col("stretch").alias("inner"), F.col("name").alias("stretch"))))
    fewer = into.select("id", F.coalesce("jump", F.col("up")).alias("up"), F.coalesce("name", F.col("stretch")).alias("stretch"))
    return stored(fewer), [stored(held)], [stored(ring)]


def strong_parts(edges: DataFrame) -> DataFrame:
    """(id, part): strongly connected parts of the graph of distinct ``edges`` (id, up), for nodes on a cycle only.

    Rounds of forward colouring and backward reach: every node takes the greatest id that leads to it; the nodes of a colour that lead
    back to the colour's own node are one part. Ways between colours can be on no cycle and go.
    """
    edges, parts = stored(edges), []
    while not edges.isEmpty():
        colour = stored(edges.select("id").union(edges.select("up")).distinct().withColumn("c", F.col("id")))
        fresh = colour
        while not fresh.isEmpty():  # only nodes whose colour has changed tell it on
            told = edges.join(fresh, "id").groupBy("up").agg(F.max("c").alias("n")).withColumnRenamed("up", "id")
            fresh = stored(told.join(colour, "id").filter("n > c").select("id", F.col("n").alias("c")))
            colour = stored(colour.join(fresh.select("id", F.col("c").alias("n")), "id", "left").select("id", F.coalesce("n", "c").alias("c")))
        inside = stored(edges.join(colour, "id").join(colour.select(F.col("id").alias("up"), F.col("c").alias("d")), "up").filter("c = d").select("id", "up", "c"))
        back = stored(colour.filter("id = c"))
        front = back
        while not front.isEmpty():
            came = inside.join(front.select(F.col("id").alias("up"), F.col("c").alias("d")), "up").filter("c = d").select("id", "c").distinct()
            front = stored(came.join(back.select("id"), "id", "left_anti"))
            back = stored(back.unionByName(front))
        rest = inside.join(back.select("id"), "id", "left_anti").join(back.select(F.col("id").alias("up")), "up", "left_anti")
        # A colour's node alone is on a cycle only if it leads to itself.
        mine = inside.join(back.select("id"), "id", "left_semi").join(back.select(F.col("id").alias("up")), "up", "left_semi")
        parts.append(stored(mine.select("id", F.col("c").alias("part")).distinct()))
        edges = stored(rest.select("id", "up"))
    if not parts:
        return edges.select("id", F.col("up").alias("part"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def climb(df: DataFrame, node: Column, parent: Column, max_depth: int) -> DataFrame:
    """(id, depth, root_reached): steps to the root (the most, where ids have
    several parents), followed for more than ``max_depth`` steps;
    ``root_reached`` is false when the chain goes on."""
    ids, edges, several = all_edges(df, node, parent)
    if several:
        return levels(ids, edges, max_depth)
    state = doubled(parent_edges(df, node, parent), max_depth + 1)
    return state.select("id", "depth", F.col("jump").isNull().alias("root_reached"))


def on_cycle(df: DataFrame, node: Column, parent: Column, max_depth: int = 100) -> DataFrame:
    """(id): nodes on a cycle of parents, however long, so ``max_depth`` is no bound.

    Steps are doubled as in ``doubled``, but after each round only nodes that
    some other one has reached stay: trees shrink to the cycles they lead to.
    When every node is reached, the steps permute the nodes, which are then
    those of the cycles. Where ids have several parents, all their edges count.
    """
    _, edges, several = all_edges(df, node, parent)
    if several:
        return cycle_members(edges)
    state = stored(parent_edges(df, node, parent).filter("jump is not null").select("id", "jump"))
    while True:
        reached = state.select(F.col("jump").alias("id")).distinct()
        left = stored(state.join(reached.hint("merge"), "id", "left_semi"))
        if left.count() == state.count():
            return left.select("id")
        ahead = left.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        state = stored(left.join(ahead.hint("merge"), "jump").select("id", F.col("next").alias("jump")))
