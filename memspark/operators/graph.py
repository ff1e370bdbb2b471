"""The graph of rooms that wings share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.plans.shared import materialize, release


def room_nodes(drawers: DataFrame, last_dates: int = 5) -> DataFrame:
    """(room, wings, halls, count, dates): sorted distinct values, the last five dates. Rows without a wing or in no room
    or ``general`` don't count. Values are made distinct per room before any are collected."""
    rows = drawers.where((F.coalesce("room", F.lit("")) != "") & (F.col("room") != "general") & (F.coalesce("wing", F.lit("")) != ""))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.nullif(F.col(k).cast("string"), F.lit("")).alias("value")) for k in ("wing", "hall", "date")))
    counted = rows.groupBy("room", "wing", "hall", "date").agg(F.count("*").alias("n"))
    values = counted.select("room", F.explode(kinds).alias("v")).select("room", "v.kind", "v.value").where("value is not null").distinct()
    late = F.row_number().over(Window.partitionBy("room", "kind").orderBy(F.desc("value")))
    values = values.withColumn("late", late).where((F.col("kind") != "date") | (F.col("late") <= last_dates))
    sets = values.groupBy("room").agg(*(F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(f"{k}s") for k in ("wing", "hall", "date")))
    totals = counted.groupBy("room").agg(F.sum("n").alias("count"))
    return sets.join(totals, "room").select("room", "wings", "halls", "count", "dates")


def room_edges(nodes: DataFrame) -> DataFrame:
    """(room, wing_a, wing_b, hall, count): each pair of a room's wings for each of its halls."""
    pairs = nodes.select("room", "count", "halls", F.col("wings"), F.explode("wings").alias("wing_a"))
    pairs = pairs.select("room", "count", "halls", "wing_a", F.explode(F.filter("wings", lambda w: w > F.col("wing_a"))).alias("wing_b"))
    return pairs.select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "count")


def tunnels(nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None, limit: int = 50) -> DataFrame:
    """Rooms of at least two wings, the fullest first, with their last date."""
    rows = nodes.where(F.size("wings") >= 2)
    for wing in (wing_a, wing_b):
        if wing:
            rows = rows.where(F.array_contains("wings", wing))
    return rows.orderBy(F.desc("count"), "room").limit(limit).select("room", "wings", "halls", "count", F.coalesce(F.try_element_at("dates", F.lit(-1)), F.lit("")).alias("recent"))


def graph_stats(nodes: DataFrame) -> DataFrame:
    """One row: rooms, rooms of several wings, edges (by formula, none are made)."""
    n = F.size("wings")
    edges = F.when(n >= 2, n * (n - 1) / 2 * F.size("halls")).otherwise(0)
    return nodes.agg(F.count("*").alias("total_rooms"), F.count_if(n >= 2).alias("tunnel_rooms"), F.coalesce(F.sum(edges), F.lit(0)).cast("long").alias("total_edges"))


def rooms_per_wing(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wing")


def top_tunnels(nodes: DataFrame, n: int = 10) -> DataFrame:
    return nodes.where(F.size("wings") >= 2).orderBy(F.desc(F.size("wings")), "room").limit(n).select("room", "wings", "count")


def traverse(nodes: DataFrame, start_room: str, max_hops: int = 2, limit: int = 50) -> DataFrame:
    """(room, wings, halls, count, hop, connected_via): rooms within so many hops over shared wings. A room's parent is the
    first, by the order in which rooms were found, that shares a wing; that order is the order of the rooms' trails (the
    names from the start), so nothing has to be numbered. Each hop goes from the frontier's wings, each of which is expanded
    once, to rooms not seen yet; its result is a table in the shared folder. An unknown start is an error that names rooms
    like it."""
    member = nodes.select("room", F.explode("wings").alias("wing"))
    seen = materialize(nodes.where(F.col("room") == start_room).select("room", F.lit(0).alias("hop"), F.array("room").alias("trail"), F.lit(None).cast("string").alias("parent")), "seen")
    if not seen.limit(1).count():
        raise LookupError(f"no room {start_room!r}; rooms like it: {', '.join(r['room'] for r in suggest_rooms(nodes, start_room).collect()) or 'none'}")
    for hop in range(1, max_hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select("room", "trail")
        by_wing = frontier.join(member, "room").groupBy("wing").agg(F.min("trail").alias("trail"))
        found = member.join(by_wing, "wing").join(seen.select("room"), "room", "left_anti").groupBy("room").agg(F.min("trail").alias("trail"))
        found = found.select("room", F.lit(hop).alias("hop"), F.concat("trail", F.array("room")).alias("trail"), F.element_at("trail", -1).alias("parent"))
        new = materialize(seen.unionByName(found), "seen")
        release(seen)
        seen = new
    parents = nodes.select(F.col("room").alias("parent"), F.col("wings").alias("parent_wings"))
    rows = seen.join(nodes, "room").join(parents, "parent", "left")
    via = F.array_sort(F.coalesce(F.array_intersect("wings", "parent_wings"), F.lit([]).cast("array<string>")))
    return rows.select("room", "wings", "halls", "count", "hop", via.alias("connected_via")).orderBy("hop", F.desc("count"), "room").limit(limit)


def suggest_rooms(nodes: DataFrame, query: str, n: int = 5) -> DataFrame:
    """Rooms whose name has the query, then those with one of its parts."""
    lowered = query.lower()
    part = F.lit(False)
    for word in lowered.split("-"):
        if word:
            part = part | F.col("room").contains(word)
    score = F.when(F.col("room").contains(lowered), 1.0).when(part, 0.5).otherwise(0.0)
    return nodes.select("room", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "room").limit(n)
