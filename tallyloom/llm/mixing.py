"""Mixing sources to target weights by hierarchical budgeting.

A tree (for example domain, language, source) has a weight at each node. The token target
flows down by the weights of siblings. A node can give what its leaves hold, times the
number of epochs allowed; what it falls short of goes to its siblings by their weights,
and only what a whole subtree cannot give goes to the siblings of its ancestor.

Each leaf then gives whole epochs and a token-prefix of one more: documents in the order
of a hash of seed, epoch and id, as long as their tokens fit. The prefix is found without
sorting a leaf: token sums of hash ranges give the range in which the budget ends, and only
that range is sorted. So a leaf with a third of all rows is no bottleneck, and texts are
never shuffled. The leaf table is checked against ``max_leaves`` before it is broadcast.

Defined results: tokens are runs of non-space characters, so null and empty texts have none
and go with their place in the order; null level values form a leaf of their own; rows of
one id in a leaf go together (null counts as an id); an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

RANGE_BITS = 12
Path = tuple[str | None, ...]


@dataclass
class Mix:
    """Weights by path prefix, among siblings; a node that is not listed has ``default``."""

    levels: list[str]
    weights: dict[Path, float] = field(default_factory=dict)
    default: float = 1.0
    max_epochs: int = 4
    seed: int = 0
    max_leaves: int = 100_000

    def weight(self, path: Path) -> float:
        return self.weights.get(path, self.default)


def budgets(mix: Mix, available: dict[Path, int], target: float) -> dict[Path, float]:
    """Tokens of each leaf. Their sum is ``target``, or all there is if that is less."""
    room: dict[Path, float] = {}
    children: dict[Path, set[Path]] = {}
    for leaf, tokens in available.items():
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] = room.get(leaf[:depth], 0) + tokens * mix.max_epochs
            if depth:
                children.setdefault(leaf[: depth - 1], set()).add(leaf[:depth])
    out: dict[Path, float] = {}

    def give(node: Path, amount: float) -> None:
        if node not in children:
            out[node] = amount
            return
        open_ = {c: mix.weight(c) for c in children[node]}
        share = dict.fromkeys(open_, 0.0)
        while open_ and amount > 0:
            total = sum(open_.values())
            if total <= 0:  # only siblings of weight 0 are left: they take the rest by their room
                open_ = {c: room[c] for c in open_ if room[c] > 0}
                if not (total := sum(open_.values())):
                    break
            full = {c for c, w in open_.items() if amount * w / total >= room[c]}
            if not full:
                for c, w in open_.items():
                    share[c] = amount * w / total
                break
            for c in full:
                share[c] = room[c]
                del open_[c]
            amount -= sum(room[c] for c in full)
        for c, tokens in share.items():
            give(c, tokens)

    if available:
        give((), min(float(target), room[()]))
    return out


def n_tokens(text: Column) -> Column:
    found = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(F.length(found), F.lit(0)) == 0, 0).otherwise(F.size(F.split(found, r"\s+"))).cast("long")


def _order(mix: Mix, epoch: Column, id: str) -> Column:
    return F.xxhash64(F.lit(mix.seed), epoch.cast("int"), F.col(id))


def plan(docs: DataFrame, mix: Mix, target: float | None = None, share: float | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each leaf: its levels, tokens, budget, whole epochs, and the last place
    (order, id) of the next epoch's prefix. The target is ``target`` tokens, or ``share`` of all."""
    spark, levels = docs.sparkSession, mix.levels
    slim = stage(docs.select(*levels, F.col(id).alias("id"), n_tokens(F.col(text)).alias("tokens")), "tokens")
    rows = slim.groupBy(*levels).agg(F.sum("tokens").alias("tokens")).limit(mix.max_leaves + 1).collect()
    if len(rows) > mix.max_leaves:
        raise ValueError(f"more than {mix.max_leaves} leaves")
    available = {tuple(r[c] for c in levels): r.tokens for r in rows}
    total = sum(available.values())
    wanted = budgets(mix, available, target if target is not None else (1.0 if share is None else share) * total)
    leaves = []
    for leaf, tokens in available.items():
        budget = int(wanted[leaf] + 1e-6)
        epochs = budget // tokens if tokens else 0
        leaves.append((*leaf, tokens, budget, epochs, budget - epochs * tokens))
    kinds = [docs.schema[c].dataType for c in levels] + [T.LongType()] * 4
    names = [*levels, "leaf_tokens", "budget", "epochs", "rest"]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    table = F.broadcast(spark.createDataFrame(leaves, schema))  # max_leaves rows at most

    placed = _with_leaf(slim, table, levels).where("rest > 0").withColumn("at", _order(mix, F.col("epochs"), "id"))
    placed = placed.withColumn("range", F.shiftright("at", 64 - RANGE_BITS)).select(*levels, "rest", "range", "at", "id", "tokens")
    before = Window.partitionBy(*levels).orderBy("range")
    sums = placed.groupBy(*levels, "rest", "range").agg(F.sum("tokens").alias("tokens"))
    sums = sums.withColumn("end", F.sum("tokens").over(before)).where("end >= rest")
    last = sums.groupBy(*levels).agg(F.min_by(F.struct("range", (F.col("end") - F.col("tokens")).alias("before")), "range").alias("s"))
    last = last.select(*levels, "s.range", "s.before")
    ranges = F.broadcast(stage(last, "ranges"))  # one row for each leaf at most
    inside = _with_leaf(placed, ranges, [*levels, "range"])
    run = Window.partitionBy(*levels).orderBy("at", "id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("end", F.col("before") + F.sum("tokens").over(run)).where("end <= rest")
    places = fits.groupBy(*levels).agg(F.max(F.struct("at", F.col("id").alias("upto"))).alias("p"))
    out = _with_leaf(spark.createDataFrame(leaves, schema), last, levels, "left")
    out = _with_leaf(out, places.select(*levels, "p.at", "p.upto"), levels, "left")
    return stage(out.select(*names, "range", "at", "upto"), "mix")


def _with_leaf(rows: DataFrame, leaves: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys are kept once."""
    other = leaves
    for k in keys:
        other = other.withColumnRenamed(k, f"__{k}")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = rows.join(F.broadcast(other), on, how)
    return joined.drop(*(f"__{k}" for k in keys))


def select(docs: DataFrame, mix: Mix, copies: str = "copies", repeat: bool = False, id: str = "doc_id", text: str = "text", **goal) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with how often; or each as often (``repeat``)."""
    leaves = plan(docs, mix, id=id, text=text, **goal)
    marks = [F.col(c).alias(f"__{c}") for c in ("epochs", "rest", "range", "at", "upto")]
    taken = _with_leaf(docs, leaves.select(*mix.levels, *marks), mix.levels)
    place, at = _order(mix, F.col("__epochs"), id), F.col("__at")
    own = F.shiftright(place, 64 - RANGE_BITS)
    # Ranges before the last are in the prefix as a whole; in the last, all up to a place.
    inside = (place < at) | ((place == at) & (F.col(id).isNull() | F.coalesce(F.col(id) <= F.col("__upto"), F.lit(False))))
    prefix = F.col("__rest").cast("boolean") & ((own < F.col("__range")) | ((own == F.col("__range")) & F.coalesce(inside, F.lit(False))))
    times = (F.col("__epochs") + F.coalesce(prefix, F.lit(False)).cast("long")).cast("int")
    if repeat:
        return taken.withColumn("__n", F.explode(F.sequence(F.lit(0), times))).where("__n > 0").select(*docs.columns)
    kept = [c for c in docs.columns if c != copies]  # an older count gives way
    return taken.withColumn(copies, times).where(F.col(copies) > 0).select(*kept, copies)
