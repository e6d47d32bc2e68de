"""Links between the members of inverted lists, without forming all pairs of a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsmith.llm.common import components
from volsmith.session import stage

#: Most rounds in which a member is held against two members of its lists, before all pairs of
#: members that are still apart; a round without a link ends them.
STAR_ROUNDS = 4


def list_components(lists: DataFrame, carried: list[str], verified: Callable[[DataFrame], DataFrame],
                    may_link: Callable[[str, str], Column], first: Column | None = None,
                    rounds: int = STAR_ROUNDS, last: DataFrame | None = None) -> DataFrame:
    """Components (node, component) of nodes that share a list and pass the check.

    ``lists`` has (value, node) and the ``carried`` columns, which ``may_link(prefix, other
    prefix)`` reads to tell pairs that need no check. ``verified`` gives the linked ones of pairs (a, b). In
    each star round every list names a hub (least ``first`` in the first round, by hash later) and
    each node is held against two: the hub with which it shares most lists and that of its smallest list. Pairs within a component are
    never checked again. Finally all pairs of a list whose components differ are formed and
    checked, so every pair of linked nodes ends up in one component. ``last`` gives other lists of
    the same form for those final pairs.
    """
    columns = ["node", *carried]
    links = roots = None
    turn, final = 0, rounds == 0
    while True:
        if final and last is not None:
            lists = last
        now = lists.withColumn("root", F.col("node")) if roots is None else lists.join(
            roots.select("node", F.col("component").alias("known")), "node", "left").select(
                "value", *columns, F.coalesce("known", "node").alias("root"))
        choice = first if first is not None and not turn else F.lit(0)
        hub = F.min(F.struct(choice.alias("choice"), F.xxhash64("node", F.lit(turn)).alias("by_hash"), *columns, "root"))
        mixed = stage(now.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), hub.alias("hub"))
                      .where("low <> high").select("value", "size", "hub"), "hubs")
        if mixed.isEmpty():
            if final or last is None:
                break
            final = True
            continue
        if not final:
            met = now.join(mixed, "value").select(
                *columns, "root", "size", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in (*columns, "root")])
            met = met.where((F.col("root") != F.col("hub_root")) & may_link("", "hub_"))
            best = met.groupBy("node", "hub_node").agg(F.count("*").alias("met"), F.min("size").alias("size")).groupBy(
                "node").agg(F.max(F.struct("met", "hub_node")).alias("most"), F.min(F.struct("size", "hub_node")).alias("rarest"))
            pairs = best.select(F.col("node").alias("a"), F.explode(F.array_distinct(
                F.array("most.hub_node", "rarest.hub_node"))).alias("b"))
        else:
            apart = now.join(mixed.select("value"), "value", "left_semi")
            other = apart.select("value", *[F.col(c).alias(f"hub_{c}") for c in (*columns, "root")])
            pairs = apart.join(other, "value").where(
                (F.col("node") < F.col("hub_node")) & (F.col("root") != F.col("hub_root")) & may_link("", "hub_")).select(
                    F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct()
        found = stage(verified(pairs), "links")
        fruitless = found.isEmpty()
        if not fruitless:
            links = found if links is None else links.unionByName(found)
            roots = stage(components(links), "roots")
        if final:
            break
        turn += 1
        final = turn >= rounds or fruitless
    if roots is None:
        roots = lists.limit(0).select("node", F.col("node").alias("component"))
    return roots


def shared_values(values: DataFrame, name: str = "lo") -> DataFrame:
    """Values that occur with more than one ``name``, by the two extremes of the names."""
    return values.groupBy("value").agg(F.min(name).alias("least"), F.max(name).alias("most")).where(
        "least <> most").select("value")
