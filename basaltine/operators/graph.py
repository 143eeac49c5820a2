"""Shortest paths by rounds of relaxation, and paths on grids."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.sources.scratch import forget, new_folder


def shortest_distances(edges: DataFrame, source: int, rounds: int = 10_000) -> DataFrame:
    """edges (src, dst, weight >= 0) to node, distance, parent of every node that a source reaches.

    A round relaxes the edges of the nodes that got nearer in the last one, and its state is written to the shared
    folder, which cuts the plan and survives lost executors. The state before goes when a round has ended.
    """
    spark, last = edges.sparkSession, None
    known = spark.createDataFrame([(source, 0.0, None)], "node bigint, distance double, parent bigint")
    frontier = known
    for _ in range(rounds):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("node").alias("parent"))
        both = known.withColumn("old", F.lit(True)).unionByName(found.withColumn("old", F.lit(False)))
        best = both.groupBy("node").agg(F.min(F.struct("distance", (~F.col("old")).alias("new"), "parent")).alias("b"))
        state = best.select("node", "b.distance", "b.parent", "b.new")
        folder = new_folder(spark, "distances")
        state.write.parquet(folder)
        state = spark.read.schema(state.schema).parquet(folder)
        if last is not None:
            forget(spark, last)
        last = folder
        frontier = state.where("new").select("node", "distance", "parent")
        known = state.select("node", "distance", "parent")
        if frontier.isEmpty():
            break
    return known


def shortest_path(distances: DataFrame, target: int) -> list[int]:
    """The nodes from the source to a target; empty if it is not reached."""
    path, node = [], target
    while node is not None:
        row = distances.where(F.col("node") == node).select("parent").first()
        if row is None:
            return []
        path.append(node)
        node = row["parent"]
    return path[::-1]


def grid_paths(grids: DataFrame) -> DataFrame:
    """grids (grid, cells: lines of ``.``, ``#``, one S and one G) to grid, steps, path; grids are independent.

    A shortest way goes from S to G over four neighbours; steps are -1 and the path is empty if there is none. The
    search is nested here, so that it is sent by value: Python workers need not have this package.
    """

    def search(cells: list[str]) -> tuple[int, list[int]]:
        width, flat = len(cells[0]), "".join(cells)
        start, goal = flat.index("S"), flat.index("G")
        gy, gx = divmod(goal, width)
        queue, cost, parent = [(0, 0, start)], {start: 0}, {start: -1}
        while queue:
            _, g, at = heapq.heappop(queue)
            if at == goal:
                path = []
                while at >= 0:
                    path.append(at)
                    at = parent[at]
                return g, path[::-1]
            if g > cost[at]:
                continue
            y, x = divmod(at, width)
            for ny, nx in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
                n = ny * width + nx
                if 0 <= nx < width and 0 <= ny < len(cells) and flat[n] != "#" and g + 1 < cost.get(n, 1 << 60):
                    cost[n], parent[n] = g + 1, at
                    heapq.heappush(queue, (g + 1 + abs(ny - gy) + abs(nx - gx), g + 1, n))
        return -1, []

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [search(c.split("\n")) for c in b["cells"]]
            yield pd.DataFrame({"grid": b["grid"], "steps": [f[0] for f in found], "path": [f[1] for f in found]})

    return grids.select("grid", "cells").mapInPandas(each, "grid bigint, steps bigint, path array<bigint>")
