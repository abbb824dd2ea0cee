"""Sums and paths over forests by pointer doubling: as many rounds as the depth has binary digits.

A forest is a table of edges (node, parent); a null parent, or one that is no node, ends a chain. In round k each node points at the
ancestor 2**k steps up and holds what lies between; so a chain of a million edges takes 20 rounds of one join over its
rows, where a closure would hold 500 billion. What is no forest is told apart, never followed round and round: of several parents
of a node the least counts (`double_parents` names the node), and nodes whose chain never ends are `cyclic`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwise.session import cut_lineage

#: Pointers at one node beyond which what they look for goes to every executor, and the most rows that may.
HOT, MOST_SENT = 100_000, 1 << 20


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint of at most as many parts as a shuffle has, so that unions of rounds do not pile up parts."""
    return cut_lineage(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def look_up(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left, which has `rows` rows, with the columns of right, which has one row for each key; null where there is none.

    Rows of left with one frequent key are not gathered: what right has for keys of more than HOT rows is broadcast. left is read
    three times then and should be stored.
    """
    if rows <= HOT:
        return left.join(right, key, "left")
    names = [c for c in right.columns if c != key]
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(key)
    if not 0 < hot.limit(MOST_SENT + 1).count() <= MOST_SENT:
        return left.join(right, key, "left")
    found = F.broadcast(hot.join(right, key, "left").select(key, F.struct(*names).alias("_hot"), F.lit(True).alias("_many")))
    marked = left.join(found, key, "left")
    many = marked.where("_many").select(*left.columns, *[F.col("_hot")[c].alias(c) for c in names])
    return many.unionByName(marked.where("_many is null").select(left.columns).join(right, key, "left").select(many.columns))


def double_parents(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, parents) of every node with more than one parent."""
    found = tree.where(F.col(parent).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.count_distinct(parent).alias("parents"))
    return found.where("parents > 1")


def _forest(tree: DataFrame, node: str, parent: str, values: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """One row for each node (node, up, *values) with the least of its parents, null if that is no node; and how many rows."""
    least = [F.min_by(v, F.struct(F.col(parent).isNull(), F.col(parent), F.col(v))).alias(v) for v in values]
    rows = _kept(tree.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"), *least))
    n = rows.count()
    there = rows.select(F.col("node").alias("up"), F.lit(True).alias("_there"))
    return _kept(look_up(rows, there, "up", n).select("node", F.when(F.col("_there"), F.col("up")).alias("up"), *values)), n


def _climb(flat: DataFrame, n: int, lengths: Sequence[str]) -> DataFrame:
    own = [F.when(F.col("up").isNotNull(), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("double").alias(c) for c in lengths]
    top = F.col("up").isNull()
    state = _kept(flat.select("node", F.coalesce("up", "node").alias("at"), top.alias("done"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), *own))
    for _ in range(n.bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        ahead = state.select(F.col("node").alias("at"), F.struct("at", "done", "depth", *lengths).alias("_a"))
        summed = [(F.col(c) + F.col(f"_a.{c}")).alias(c) for c in ("depth", *lengths)]
        moved = look_up(state.where("not done"), ahead, "at", n).select("node", F.col("_a.at").alias("at"), F.col("_a.done").alias("done"), *summed)
        state = _kept(state.where("done").unionByName(moved))
    return state


def climb(tree: DataFrame, lengths: Sequence[str] = (), node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, top, depth, cyclic, *lengths): the last node of the chain upwards, the steps to it, and each length summed over the edges from the node to it.

    A length belongs to the edge above its row's node; at a top it does not count, and null counts as nothing. Where the
    chain never ends, cyclic is true and the rest null.
    """
    state = _climb(*_forest(tree, node, parent, lengths), lengths)
    keep = lambda c: F.when(F.col("done"), F.col(c)).alias(c)
    return state.select("node", F.when(F.col("done"), F.col("at")).alias("top"), keep("depth"), (~F.col("done")).alias("cyclic"), *[keep(c) for c in lengths])


def gather(tree: DataFrame, sums: Sequence[str] = (), maxes: Sequence[str] = (), node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, depth, below, *sums, *maxes) of every node whose chain ends: the steps to its top, how many nodes its subtree has, itself included, and sums and greatest values of columns over that subtree.

    Null counts as nothing, and a sum of nothing is 0. In round k a node holds what lies less than 2**k steps below it, and adds what
    the nodes 2**k below it hold. Nodes on a cycle, or that lead into one, have no row.
    """
    flat, n = _forest(tree, node, parent, [*sums, *maxes])
    start = [*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums], *[F.col(c) for c in maxes]]
    state = flat.select("node", F.col("up").alias("jump"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("below"), *start)
    added, cut = ["below", *sums], _kept if n > HOT else lambda df: df
    for _ in range(n.bit_length() + 1):
        if state.where("jump is not null").isEmpty():
            break
        wide = [*[F.try_sum(c).alias(f"_{c}") for c in added], *[F.max(c).alias(f"_{c}") for c in maxes]]  # round a cycle sums may grow too large
        under = state.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(*wide)
        total = [*[F.try_add(F.col(c), F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in added], *[F.greatest(c, f"_{c}").alias(c) for c in maxes]]
        ahead = state.select(F.col("node").alias("jump"), F.struct("jump", "depth").alias("_a"))
        grown = cut(state.join(under, "node", "left").select("node", "jump", "depth", *total))
        steps = F.col("depth") + F.coalesce(F.col("_a.depth"), F.lit(0))
        state = _kept(look_up(grown, ahead, "jump", n).select("node", F.col("_a.jump").alias("jump"), steps.alias("depth"), "below", *sums, *maxes))
    return state.where("jump is null").drop("jump")


def _equal_above(flat: DataFrame, n: int, value: str, more: Sequence[str]) -> DataFrame:
    """(node, up, *more) with the way up cut where `value` changes."""
    above = flat.select(F.col("node").alias("up"), F.struct(value).alias("_v"))
    same = F.col("_v").isNotNull() & F.col(value).eqNullSafe(F.col("_v")[value])
    return _kept(look_up(flat, above, "up", n).select("node", F.when(same, F.col("up")).alias("up"), *more))


def runs_up(tree: DataFrame, value: str, lengths: Sequence[str] = (), node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, last, edges, longest_<length>..., *lengths) of every node: the stretch of equal `value` that begins with it and goes up.

    `last` is its topmost node, `edges` how many nodes it holds, each length is summed over them all; longest_<length> is the largest such sum of
    any stretch of that value that begins at or below the node and holds it. Null equals null. A stretch that is a whole cycle has no rows.
    """
    flat, n = _forest(tree, node, parent, [value, *lengths])
    cut = _equal_above(flat, n, value, lengths)
    state = _climb(cut, n, lengths).where("done").select("node", F.col("at").alias("last"), (F.col("depth") + 1).alias("edges"), *lengths)
    end = cut.select(F.col("node").alias("last"), F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in lengths], F.lit(0).alias("_")).alias("_e"))
    found = look_up(state, end, "last", n).select("node", "last", "edges", *[(F.col(c) + F.col(f"_e.{c}")).alias(c) for c in lengths])
    if not lengths:
        return found
    found = _kept(found)
    ways = cut.select("node", "up").join(found.select("node", *[F.col(c).alias(f"longest_{c}") for c in lengths]), "node")
    return found.join(gather(ways, maxes=[f"longest_{c}" for c in lengths], parent="up").drop("depth", "below"), "node")


def path_runs(tree: DataFrame, value: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, runs, longest) of every node whose chain ends: how many stretches of one value the way from it up has, and the most nodes in one of them.

    The first stretch begins with the node itself, the next above the last node of that; the starts are a forest of their own.
    """
    flat, n = _forest(tree, node, parent, [value])
    ends = flat.select(F.col("node").alias("last"), F.col("up").alias("next"))
    stretch = _climb(_equal_above(flat, n, value, ()), n, ()).where("done").select("node", F.col("at").alias("last"), (F.col("depth") + 1).alias("longest"))
    state = _kept(look_up(stretch, ends, "last", n).select("node", F.col("next").alias("jump"), F.lit(1).cast("long").alias("runs"), "longest"))
    for _ in range(n.bit_length() + 1):
        if state.where("jump is not null").isEmpty():
            break
        ahead = state.select(F.col("node").alias("jump"), F.struct("jump", "runs", "longest").alias("_a"))
        more = (F.col("runs") + F.coalesce(F.col("_a.runs"), F.lit(0))).alias("runs"), F.greatest("longest", F.col("_a.longest")).alias("longest")
        state = _kept(look_up(state, ahead, "jump", n).select("node", F.col("_a.jump").alias("jump"), *more))
    # a stretch that leads into a cycle of stretches, or of one stretch, never gets here
    return state.where("jump is null").join(_climb(flat, n, ()).where("done").select("node"), "node", "left_semi").drop("jump")
