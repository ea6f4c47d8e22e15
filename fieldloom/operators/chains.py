"""List ranking: the chain that each node stands in and its place there, by pointer doubling.

Every round each node's pointer jumps as far again, so a chain of n nodes takes log2(n) rounds of one join on the node;
no node's chain is ever gathered in a task, and a hot chain is as cheap as many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.tables import Scratch


def ranked(links: DataFrame, node: str = "node", before: str = "before") -> DataFrame:
    """(node, head, place, closed) for rows (node, before): each node once, with the one before it or null.

    A chain's head is its node without one before, at place 0. A closed chain (a ring) has its least node as head. A node whose
    `before` is no row begins a chain.
    """
    tables = Scratch(links.sparkSession)
    rows = tables.saved(links.select(F.col(node).alias("node"), F.col(before).alias("before")))
    known = rows.select(F.col("node").alias("_k"))
    first = rows.join(known, F.expr("before = _k"), "left").select("node", F.col("_k").alias("before"))
    open_, rings = _jumped(first, tables)
    out = open_.withColumn("closed", F.lit(False))
    if rings is not None:
        cut = first.join(rings, "node").select("node", F.when(F.col("node") != F.col("head"), F.col("before")).alias("before"))
        out = out.unionByName(_jumped(cut, tables)[0].withColumn("closed", F.lit(True)))
    out = tables.saved(out)
    tables.discard(but=out)
    return out


def _jumped(links: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(node, head, place) of the nodes of open chains, and (node, head) of those in rings, if any."""
    start = F.col("before").isNull()
    state = links.select("node", F.coalesce("before", "node").alias("to"), F.when(start, 0).otherwise(1).cast("long").alias("place"), F.least("node", F.coalesce("before", "node")).alias("least"), start.alias("done"))
    state = tables.saved(state)
    open_, least = (int(x or 0) for x in state.agg(F.count_if(~F.col("done")), F.sum(F.xxhash64("least").cast("decimal(38,0)"))).first())
    while open_:
        far = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("place").alias("_place"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        moved = state.filter("not done").join(far, "to").select("node", F.col("_to").alias("to"), (F.col("place") + F.col("_place")).alias("place"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        new = tables.saved(state.filter("done").unionByName(moved))
        tables.discard(state)
        state = new
        # chains finish nodes in every round; when none was finished, the rest are rings, whose least nodes still spread
        now = tuple(int(x or 0) for x in state.agg(F.count_if(~F.col("done")), F.sum(F.xxhash64("least").cast("decimal(38,0)"))).first())
        if now == (open_, least):
            break
        open_, least = now
    chains = state.filter("done").select("node", F.col("to").alias("head"), "place")
    return chains, state.filter("not done").select("node", F.col("least").alias("head")) if open_ else None


def followed(rows: DataFrame, key: Column, place: Column, value: Column) -> DataFrame:
    """(key, values): the values of each chain in the order of their place. A chain's row is as long as the chain."""
    each = rows.select(key.alias("key"), F.struct(place.alias("place"), value.alias("value")).alias("at"))
    return each.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("at")).select("key", F.col("at.value").alias("values"))
