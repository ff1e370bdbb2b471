"""Shards by a consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions only.

The ring has `CELLS` cells; each shard holds `VNODES` virtual nodes at hashed cells, and a cell belongs to the next virtual
node clockwise. A row's cell is a hash of its id, its text's checksum and size, so that rows of one id, or without one, are
spread like others. Shards have a capacity; what comes to a full shard goes on clockwise to
the next node of a shard with room. With capacities that add up to the rows exactly (`law` rows) every shard ends full, so
counts are at most one apart; with `law` bytes a shard's capacity is its share of the bytes and `slack`, and a shard
overruns it by part of one text per cell at most.

Which part of a cell goes where follows from the cells' loads alone. Those are one row a cell, so at most `CELLS` rows
reach the driver, and the table of parts that comes back (at most `CELLS` + shards x virtual nodes rows) is broadcast.
Rows are put in order within their own cell only.

How much moves when a shard is added depends on the slack. With none (law `rows`) the shards' ends push each other on: of
the rows about a tenth move, a third of those between old shards. With a slack of a quarter half as many move, nearly all to
the new shard. The tests hold both.

A null text has no bytes (size 1). Equal rows are interchangeable; each gets a slot of its own. An empty table gives an empty
result. The input's other columns are not returned.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 16384
VNODES = 64


def virtual_nodes(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) clockwise."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()) % cells, s) for s in range(shards) for v in range(vnodes))


def allocate(loads: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, shard, from, to): which part of each cell's load a shard takes. Cells come in clockwise order; what a full
    shard doesn't take waits for its next turn at the next node of a shard with room."""
    room = list(capacity)
    if sum(loads.values()) > sum(room):
        raise ValueError("the capacities are less than the load")
    out: list[tuple[int, int, int, int]] = []
    at, waiting = 0, []
    for cell in sorted(loads):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        waiting.append((at % len(nodes), cell, 0, loads[cell]))
    while waiting:
        over = []
        for node, cell, start, end in waiting:
            shard = nodes[node][1]
            take = min(room[shard], end - start)
            if take:
                room[shard] -= take
                out.append((cell, shard, start, start + take))
            if start + take < end:
                following = (node + 1) % len(nodes)
                while not room[nodes[following][1]]:
                    following = (following + 1) % len(nodes)
                    if following == node:
                        break
                over.append((following, cell, start + take, end))
        waiting = over
    return out


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [int(total * (1 + slack) / shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def parts_table(spark, parts: list[tuple]) -> DataFrame:
    rows = json.dumps([{"cell": c, "shard": s, "lo": a, "hi": b, "slot0": n} for c, s, a, b, n in parts])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<cell:int,shard:int,lo:bigint,hi:bigint,slot0:bigint>>")))


def shard(df: DataFrame, shards: int = 16, law: str = "rows", doc_id: str = "doc_id", text: str = "text", slack: float = 0.0, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot): a row per row of ``df``; slots are gapless from 0 in each shard."""
    if law not in ("rows", "bytes"):
        raise ValueError("bounded loads keep the law rows or bytes")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    load = F.lit(1).cast("long") if law == "rows" else size
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32")
    spot = F.xxhash64(F.col(doc_id), crc, size)
    cell = F.pmod(spot, F.lit(cells)).cast("int").alias("cell")
    loads = {r["cell"]: r["load"] for r in df.select(cell, load.alias("load")).groupBy("cell").agg(F.sum("load").alias("load")).collect()}
    parts = allocate(loads, virtual_nodes(shards, vnodes, cells), capacities(sum(loads.values()), shards, slack))
    slots: dict[int, int] = defaultdict(int)
    placed = []
    for c, s, lo, hi in sorted(parts, key=lambda p: (p[1], p[0], p[2])):
        placed.append((c, s, lo, hi, slots[s]))
        slots[s] += hi - lo
    rows = df.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc, load.alias("load"), spot.alias("spot"), cell)
    order = Window.partitionBy("cell").orderBy("spot", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("start", F.sum("load").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("load"))
    # Bounded by the cells and the virtual nodes, whatever the rows.
    taken = F.broadcast(parts_table(df.sparkSession, placed).withColumnRenamed("cell", "of_cell"))
    rows = rows.join(taken, (F.col("cell") == F.col("of_cell")) & (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    if law == "rows":
        slot = F.col("slot0") + F.col("start") - F.col("lo")
        return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"))
    counted = rows.groupBy("shard", "cell", "lo").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "lo").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("shard", "cell", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("cell", "lo").orderBy("start")) - 1
    rows = rows.withColumn("within", within).join(F.broadcast(first), ["shard", "cell", "lo"])
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("first") + F.col("within")).alias("slot"))
