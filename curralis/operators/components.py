"""Connected and strongly connected components as DataFrame loops."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curralis.plans.lineage import counted, settled


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the least node reachable over undirected edges (a, b); nodes (node) adds isolated ones.

    Labels spread to neighbours and, by pointer jumping, to the label's own label, so rounds grow with the logarithm of a chain.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settled(both)
    labels = both.select(F.col("a").alias("node")).distinct() if nodes is None else nodes.select("node").union(both.select("a")).distinct()
    labels = settled(labels.withColumn("component", F.col("node")))
    while True:
        near = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        spread = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("other", "component")).alias("component"), F.col("component").alias("old"))
        jump = labels.toDF("component", "further")
        step, moved = counted(spread.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old"), F.expr("component <> old"))
        if not moved:
            return step.select("node", "component")
        labels = step.select("node", "component")


def _spread(df: DataFrame) -> DataFrame:
    """df for a join that deals out both sides: a table of keys packs so well in files that it would be sent to the driver and every executor instead."""
    return df.hint("merge")


def _trimmed(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """n edges without those that can't be on a cycle, and their number: their source has no way in, or their target none out. To a fixpoint, or till one task can take them."""
    before = None
    while n > ONE_TASK and n != before:
        before = n
        into, out = edges.select(F.col("target").alias("source")).distinct(), edges.select(F.col("source").alias("target")).distinct()
        edges, n = counted(edges.join(_spread(into), "source", "left_semi").join(_spread(out), "target", "left_semi").select("source", "target"))
    return edges, n


#: Graphs up to so many edges (a few dozen MB) are cheaper to settle in one task than by a job per round.
ONE_TASK = 500_000
#: Types of node that one task takes.
ARROW = {"bigint": pa.int64(), "string": pa.string()}


def _cycles_of(pairs: list[tuple]) -> list[tuple]:
    """(node, greatest node of its component) of the nodes on cycles, in linear time: finishing order forward, then sweeps backward."""
    ahead, back = {}, {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in ahead:
        if start in seen:
            continue
        seen.add(start)
        open_ = [(start, iter(ahead[start]))]
        while open_:
            node, rest = open_[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    open_.append((other, iter(ahead.get(other, ()))))
                    break
            else:
                order.append(node)
                open_.pop()
    out, taken = [], set()
    for start in reversed(order):
        if start in taken:
            continue
        taken.add(start)
        members = [start]
        for node in members:  # grows while it is read
            for other in back.get(node, ()):
                if other not in taken:
                    taken.add(other)
                    members.append(other)
        if len(members) > 1 or start in ahead.get(start, ()):
            head = max(members)
            out += [(m, head) for m in members]
    return out


def _in_one_task(edges: DataFrame) -> DataFrame:
    def task(batches):
        found = _cycles_of([pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], names=["node", "component"])

    named = edges.schema["source"].dataType.simpleString()
    kind = ARROW[named]
    return settled(edges.coalesce(1).mapInArrow(task, f"node {named}, component {named}"))


def _colored(rest: DataFrame) -> DataFrame:
    """(node, color): the greatest node from which a node can be reached, itself included. After the first round only nodes whose color rose pass it on."""
    nodes = rest.select(F.col("source").alias("node")).union(rest.select(F.col("target").alias("node"))).distinct()
    color = settled(nodes.withColumn("color", F.col("node")))
    risen = color
    while True:
        into = rest.join(_spread(risen.toDF("source", "from")), "source").groupBy(F.col("target").alias("node")).agg(F.max("from").alias("from"))
        step, moved = counted(color.join(_spread(into), "node", "left").select("node", F.greatest("color", F.coalesce("from", "color")).alias("color"), F.col("color").alias("old")), F.expr("color <> old"))
        color = step.select("node", "color")
        if not moved:
            return color
        risen = step.filter("color <> old").select("node", "color")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles of edges (source, target); a self-loop is a cycle. component: the greatest node.

    Trim, spread the greatest label forward, and take from each label's own node everything backward with the same
    label: that is one whole component. Removed and repeated till no edge is left; nothing is quadratic in the graph.
    Up to ONE_TASK distinct edges, a counted size, of the graph or of what is left of it, one task does the same in linear time.
    """
    edges, n = counted(edges.select("source", "target").distinct())
    one, rest, out = edges.schema["source"].dataType.simpleString() in ARROW, edges, None
    while n:
        rest, n = _trimmed(rest, n)
        if not n:
            break
        if one and n <= ONE_TASK:
            last = _in_one_task(rest)
            return last if out is None else out.union(last)
        color = _colored(rest)
        inner = settled(rest.join(_spread(color.toDF("source", "cs")), "source").join(_spread(color.toDF("target", "ct")), "target").filter("cs = ct").select("source", "target", F.col("cs").alias("color")))
        found = level = color.filter("node = color")
        while True:
            back = inner.join(_spread(level.select(F.col("node").alias("target"))), "target").select(F.col("source").alias("node"), "color").distinct()
            level, new = counted(back.join(_spread(found), ["node", "color"], "left_anti"))
            if not new:
                break
            found = found.union(level)
        found = settled(found)
        # both ends: a label's own node that is on no cycle has ways out to nodes of its label, but none back
        cyclic = inner.join(_spread(found.select(F.col("node").alias("source"))), "source", "left_semi").join(_spread(found.select(F.col("node").alias("target"))), "target", "left_semi")
        cyclic = settled(cyclic.select(F.col("source").alias("node"), F.col("color").alias("component")).distinct())
        out = cyclic if out is None else out.union(cyclic)
        gone = found.select("node")
        rest, n = counted(rest.join(_spread(gone.toDF("source")), "source", "left_anti").join(_spread(gone.toDF("target")), "target", "left_anti").select("source", "target"))
    return out if out is not None else edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)


def longest_path_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, node, step) in DAGs: step is 1 for a node with no target, else 1 + the greatest step of its targets.

    nodes (group, node), edges (group, source, target). On a cycle steps stop growing at the number of nodes.
    """
    edges = settled(edges.select("group", "source", "target").distinct())
    steps = settled(nodes.select("group", "node").distinct().withColumn("step", F.lit(1)))
    for _ in range(steps.count()):
        over = edges.join(steps.toDF("group", "target", "below"), ["group", "target"]).groupBy("group", F.col("source").alias("node")).agg((F.max("below") + 1).alias("up"))
        step = settled(steps.join(over, ["group", "node"], "left").select("group", "node", F.greatest("step", F.coalesce("up", "step")).alias("step"), F.col("step").alias("old")))
        if step.filter("step <> old").isEmpty():
            return step.select("group", "node", "step")
        steps = step.select("group", "node", "step")
    return steps
