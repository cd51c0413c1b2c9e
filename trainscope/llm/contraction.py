"""Totals over every subtree of a forest of any size and shape, by parallel tree contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trainscope.session import stored


def _kept(df: DataFrame, name: str, condition: str) -> tuple[DataFrame, int]:
    """The written rows, and how many of them meet the condition, counted as they are written."""
    seen = Observation()
    kept = stored(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
    return kept, seen.get["n"]


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """``(id, values)`` with each value summed over the node and all below it.

    ``tree`` has ``id`` (not null, once each), ``parent`` (an id, null for roots), ``kids`` (how many rows have
    it as parent) and the long ``values``.  Rounds alternate a rake, which adds all leaves to their parents, and
    a compress, which takes out every chain of nodes with one child.  Each round leaves at most half of the
    nodes, so a forest of n nodes takes log n rounds whatever its depth.  The chains that were taken out
    are then put back, last round first, each node from the total at the end of its chain.
    """
    up = [f"up_{v}" for v in values]
    alive = tree.select("id", "parent", "kids", *values, *(F.lit(0).cast("long").alias(u) for u in up))
    raked, chains = [], []
    while True:
        leaves = alive.where("kids = 0")
        raked.append(leaves.select("id", *values))
        gain = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count("*").alias("gone"), *(F.sum(F.col(v) + F.col(u)).alias(f"gain_{v}") for v, u in zip(values, up)))
        rest = alive.where("kids > 0").join(gain, "id", "left").select(
            "id", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
            *((F.col(v) + F.coalesce(f"gain_{v}", F.lit(0))).alias(v) for v in values), *up)
        rest, left = _kept(rest, "contraction-raked", "true")
        if not left:
            break
        chain, alive = _compressed(rest, values, up)
        chains.append(chain)
    return _expanded(raked, chains, values)


def _compressed(rest: DataFrame, values: list[str], up: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(id, next, values)`` for every node with one child: where its chain ends, and what lies between; and the other nodes.

    The end of a chain takes the place of its first node under that one's parent; what the chain held
    goes into ``up``, which the end brings its parent besides its own total.
    """
    single = rest.where("kids = 1").select(F.col("id").alias("parent"), *(F.col(v).alias(f"own_{v}") for v in values))
    links = rest.join(single, "parent").select(F.col("parent").alias("id"), F.col("id").alias("next"),
                                               *((F.col(f"own_{v}") + F.col(u)).alias(v) for v, u in zip(values, up)))
    chain = _chain_ends(links, values)
    first = rest.where("kids = 1").join(single.select("parent"), "parent", "left_anti").select(
        "id", F.col("parent").alias("above"), *(F.col(u).alias(f"over_{u}") for u in up))
    moved = chain.join(first, "id").select(F.col("next").alias("id"), "above", F.lit(True).alias("moved"),
                                           *((F.col(v) + F.col(f"over_{u}")).alias(f"new_{u}") for v, u in zip(values, up)))
    alive = rest.where("kids <> 1").join(moved, "id", "left").select(
        "id", F.when(F.col("moved"), F.col("above")).otherwise(F.col("parent")).alias("parent"), "kids", *values,
        *(F.when(F.col("moved"), F.col(f"new_{u}")).otherwise(F.col(u)).alias(u) for u in up))
    return chain, stored(alive, "contraction-compressed")


def _chain_ends(links: DataFrame, values: list[str]) -> DataFrame:
    """The links followed to the first node without a link, with the values on the way added up.

    Every round doubles the steps that each open link has taken.  Links that are done stay for a round
    only if an open one points to them, so the work shrinks with the chains that are left.
    """
    columns = ["id", "next", *values]
    table = links.join(links.select(F.col("id").alias("next"), F.lit(True).alias("open")), "next", "left").select(
        *columns, F.coalesce("open", F.lit(False)).alias("open"))
    table, n_open = _kept(table, "contraction-links", "open")
    done, left = [table.where("not open").select(columns)], table.where("open")
    while n_open:
        far = table.select(F.col("id").alias("next"), F.col("next").alias("far"), *(F.col(v).alias(f"far_{v}") for v in values),
                           F.col("open").alias("far_open"))
        new, n_open = _kept(left.join(far, "next").select(
            "id", F.col("far").alias("next"), *((F.col(v) + F.col(f"far_{v}")).alias(v) for v in values), F.col("far_open").alias("open")),
            "contraction-jumped", "open")
        done.append(new.where("not open").select(columns))
        left = new.where("open")
        if n_open:
            asked = left.select(F.col("next").alias("id"))
            passed = table.where("not open").join(asked, "id", "left_semi").select(new.columns)
            table = new.unionByName(stored(passed, "contraction-passed"))
    return reduce(DataFrame.unionByName, done)


def _expanded(raked: list[DataFrame], chains: list[DataFrame], values: list[str]) -> DataFrame:
    """Totals of all nodes.  A chain's end is raked or taken out in a later round, so those alone are looked up."""
    known = raked[len(chains):]
    for place in reversed(range(len(chains))):
        ends = reduce(DataFrame.unionByName, known).select(F.col("id").alias("next"), *(F.col(v).alias(f"end_{v}") for v in values))
        back = chains[place].join(ends, "next").select("id", *((F.col(v) + F.col(f"end_{v}")).alias(v) for v in values))
        known += [stored(back, "contraction-expanded"), raked[place]]
    return reduce(DataFrame.unionByName, known)
