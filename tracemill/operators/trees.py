"""Span trees by pointer doubling: depth, root, top ancestor, subtree sizes and depth-first numbers, spans without a root.

Every node points to an ancestor. Each round it takes its ancestor's pointer instead, so that pointers reach twice as far;
a tree of depth d is done after about log2(d) rounds, whatever d is, and what no round brings nearer to a root hangs on a
cycle. Sums are carried along: a node that points 2^k up gives its pointer's node what lies in the 2^k levels below itself,
so that after the last round each knows its subtree's size; and a node's depth-first number is the sum, over its ancestors
and itself, of one and the sizes of earlier siblings. A node's state has a fixed width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.stats import less_than
from tracemill.staging import drop_staged, staged


def _far(state: DataFrame, *columns: str) -> DataFrame:
    return state.select(F.col("key").alias("k"), F.col("node").alias("n"), *[F.col(c).alias(f"a_{c}") for c in columns])


#: A node and that which it points to.
POINTS = "key = k AND up = n"


def resolved(parents: DataFrame, sizes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(done, stuck) of nodes (key, node, up): done has key, node, depth, root, top, and with ``sizes`` the number of nodes of
    the subtree; stuck are the nodes on cycles and below them. ``up`` is null for roots; nodes whose parent isn't there, and
    those below them, have no root.

    root is null below a missing parent; top is the ancestor right below the root, null for the root. (key, node) must be
    unique.
    """
    there = parents.select(F.col("key").alias("k"), F.col("node").alias("n"))
    known = parents.join(there, F.expr(POINTS), "left")
    kind = dict(parents.dtypes)["node"]
    lost, is_root = F.col("up").isNotNull() & F.col("n").isNull(), F.col("up").isNull()
    state = staged(known.select("key", "node", F.when(~lost, F.col("up")).alias("up"), F.col("node").alias("low"), F.when(is_root | lost, 0).otherwise(1).cast("long").alias("depth"), F.when(is_root, F.col("node")).alias("root"), F.lit(None).cast(kind).alias("top"), F.lit(1).cast("long").alias("size")), "tree")
    left = state.where("up is not null").count()
    while left:
        moving = state.where("up is not null").join(_far(state, "up", "low", "depth", "root", "top"), F.expr(POINTS))
        arrived = F.col("a_up").isNull()
        below = F.when(F.col("a_root") == F.col("n"), F.col("low")).otherwise(F.col("a_top"))
        moved = moving.select("key", "node", F.col("a_up").alias("up"), F.col("a_low").alias("low"), (F.col("depth") + F.col("a_depth")).alias("depth"), F.when(arrived, F.col("a_root")).alias("root"), F.when(arrived, below).alias("top"), "size")
        nxt = state.where("up is null").union(moved)
        if sizes:
            given = state.where("up is not null").groupBy(F.col("key").alias("k"), F.col("up").alias("n")).agg(F.sum("size").alias("more"))
            nxt = nxt.join(given, F.expr("key = k AND node = n"), "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("k", "n", "more")
        before, state = state, staged(nxt, "tree")
        drop_staged(before)
        had, left = left, state.where("up is not null").count()
        if left == had:  # a span at the least depth that is left would have arrived
            break
    return state.where("up is null").drop("up", "low", *([] if sizes else ["size"])), state.where("up is not null").select("key", "node")


def summed_up(nodes: DataFrame) -> DataFrame:
    """(key, node, total) of nodes (key, node, up, weight): the sum of the weights from a root down to each node. Every
    ``up`` that isn't null must be there, and no node may be on a cycle."""
    state = staged(nodes.select("key", "node", "up", F.col("weight").alias("total")), "sums")
    while not state.where("up is not null").isEmpty():
        moved = state.where("up is not null").join(_far(state, "up", "total"), F.expr(POINTS)).select("key", "node", F.col("a_up").alias("up"), (F.col("total") + F.col("a_total")).alias("total"))
        before, state = state, staged(state.where("up is null").union(moved), "sums")
        drop_staged(before)
    return state.drop("up")


def walked(spark: SparkSession, spans: DataFrame, numbers: bool = False) -> DataFrame:
    """Every span reachable from a root: (trace_id, span_id, depth, root, top).

    top is the ancestor right below the root (null for the root itself). With ``numbers`` also number and size: spans are
    numbered from 1 depth first in their trace, siblings by (start, end, type, id); a span's subtree has the numbers from its
    own on, ``size`` of them. A parent may have any number of children: their order comes from sums over ranges.
    """
    nodes = spans.dropDuplicates(["trace_id", "span_id"]).select(F.col("trace_id").alias("key"), F.col("span_id").alias("node"), F.col("parent_id").alias("up"), F.struct("start_us", "end_us", "span_type", "span_id").alias("at"))
    nodes = staged(nodes if numbers else nodes.drop("at"), "nodes")  # read by nodes, by parents and by siblings
    done, _ = resolved(nodes.select("key", "node", "up"), numbers)
    found = done.where("root is not null")
    head = [F.col("key").alias("trace_id"), F.col("node").alias("span_id"), F.col("depth").cast("int").alias("depth"), "root", "top"]
    if not numbers:
        return found.select(*head)
    children = found.select("key", "node", "size").join(nodes, ["key", "node"]).select("key", "up", "node", "at", "size")
    earlier = less_than(children, ["key", "up"], "at", "size")
    totals = summed_up(earlier.select("key", "node", "up", (F.col("less") + 1).alias("weight")))
    return found.join(totals, ["key", "node"]).select(*head, F.col("total").alias("number"), "size")


def cycles(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of the spans on cycles of parents and below these, each once.

    A span whose parent is missing counts as a root here; that is a rule of its own. Of rows that share an id, one without
    a parent counts, else that of the least parent.
    """
    up = F.when(F.count_if(F.col("parent_id").isNull()) == 0, F.min("parent_id")).alias("up")
    _, stuck = resolved(spans.groupBy(F.col("trace_id").alias("key"), F.col("span_id").alias("node")).agg(up))
    return stuck.select(F.col("key").alias("trace_id"), F.col("node").alias("span_id"))
