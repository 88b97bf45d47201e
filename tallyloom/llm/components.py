"""Distributed union-find: connected components of an edge table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import outlive, stage, staging

SMALL = 1 << 16  # edges; the choices of so few (two nodes an edge at most) are broadcast


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, component), component being the smallest node reachable.

    In each round every node joins the smallest node of its closed neighbourhood, and the
    graph is contracted along these choices. The first round orders nodes by id, so stars around
    their smallest node end at once; later ones order them by a fresh hash (a bijection of longs),
    so no order of ids is bad: each leaves an expected two thirds of the nodes of a path and fewer of
    other graphs. There is no cap on rounds, since every round with an edge left loses a node.
    At last the choices are followed back, and each class takes its smallest node.

    Choices are minima that are combined before they move, and joins have a unique key on one
    side, so Spark may split a hub's rows; no list of neighbours is ever held. Most rounds are of few edges: once at most
    SMALL are left, their choices are broadcast, so a round takes two exchanges and not six. Nodes without an
    edge to another are not returned. The result is a staged table.
    """
    with staging(edges.sparkSession):
        graph = stage(_edges(edges.select("a", "b")), "graph")
        choices: list[DataFrame] = []
        sent: list[DataFrame] = []  # the choices again, marked to be broadcast where they are few
        while n := graph.count():
            choices.append(stage(_nearest(graph, len(choices)), "choices"))
            sent.append(F.broadcast(choices[-1]) if n <= SMALL else choices[-1])
            one = sent[-1].select(F.col("node").alias("a"), F.col("to").alias("x"))
            two = sent[-1].select(F.col("node").alias("b"), F.col("to").alias("y"))
            moved = graph.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            graph = stage(_edges(moved), "graph")
        if not choices:
            return outlive(stage(graph.select(F.col("a").alias("node"), F.col("b").alias("component")), "components"))
        classes = choices[0].withColumnRenamed("to", "class")
        for later in sent[1:]:
            further = later.select(F.col("node").alias("class"), F.col("to").alias("further"))
            classes = classes.join(further, "class", "left").select("node", F.coalesce("further", "class").alias("class"))
        if len(choices) == 1:  # by id: a class is named by its smallest node
            return outlive(stage(classes.withColumnRenamed("class", "component"), "components"))
        classes = stage(classes, "classes")
        least = classes.groupBy("class").agg(F.min("node").alias("component"))
        return outlive(stage(classes.join(least, "class").select("node", "component"), "components"))


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nearest(graph: DataFrame, salt: int) -> DataFrame:
    """(node, to): the first of each node and its neighbours, in the order of this round."""
    rank = lambda c: F.col(c) if salt == 0 else F.xxhash64(c, F.lit(salt))
    ways = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))
    both = graph.select(F.inline(ways)).select("node", "next", rank("next").alias("rank"))
    found = both.groupBy("node").agg(F.min_by("next", "rank").alias("next"), F.min("rank").alias("rank"))
    return found.select("node", F.when(rank("node") < F.col("rank"), F.col("node")).otherwise(F.col("next")).alias("to"))


def named(rows: DataFrame, joined: DataFrame, node: str) -> DataFrame:
    """``rows`` with the component of ``node``, which is the node itself if it has no link."""
    found = rows.join(joined.select(F.col("node").alias(node), "component"), node, "left")
    return found.withColumn("component", F.coalesce("component", node))


def spanning(rows: DataFrame, bucket: str, node: str, *carried: str, hint: str | None = None) -> DataFrame:
    """Rows of the buckets that hold more than one ``component``, with the ends ``lo`` and ``hi`` of each bucket.

    An end is a struct of a node, its component and the columns ``carried``: the first of the
    smallest and of the largest component. Buckets are aggregated before they move and joined back, so one that holds
    a large part of all rows is split. ``hint`` is how the aggregated side (one row a bucket) is joined.
    """
    fields = [node, "component", *carried]
    ends = [F.min(F.col("component")).alias("__lo"), F.max(F.col("component")).alias("__hi"), F.count("*").alias("size")]
    for name, pick in (("lo", F.min_by), ("hi", F.max_by)):
        ends += [pick(F.col(f), F.col("component")).alias(f"__{name}_{f}") for f in fields]
    found = rows.groupBy(bucket).agg(*ends).where("__lo < __hi")
    as_struct = lambda name: F.struct(*(F.col(f"__{name}_{f}").alias(f) for f in fields)).alias(name)
    ends = found.select(bucket, "size", as_struct("lo"), as_struct("hi"))
    return rows.join(ends.hint(hint) if hint else ends, bucket)


def far_end(node: str, field: str) -> Column:
    """``field`` of a row's end of another component: the low one, or the high one for rows of the low one's."""
    return F.when(F.col("component") == F.col("lo.component"), F.col(f"hi.{field}")).otherwise(F.col(f"lo.{field}"))
