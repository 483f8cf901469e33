"""Weighted graphs over edges (src, dst, weight, ...): upkeep, neighbours and spreading."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The last write of (src, dst) wins; new rows are later than old ones."""
    rows = edges.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("_seq")))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_seq")


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def outgoing(edges: DataFrame, node: str, min_weight: float = 0.0) -> DataFrame:
    return edges.where((F.col("src") == node) & (F.col("weight") >= min_weight))


def incoming(edges: DataFrame, node: str, min_weight: float = 0.0) -> DataFrame:
    return edges.where((F.col("dst") == node) & (F.col("weight") >= min_weight))


def both(edges: DataFrame, node: str, min_weight: float = 0.0) -> DataFrame:
    return outgoing(edges, node, min_weight).unionByName(incoming(edges, node, min_weight))


def decayed(edges: DataFrame, factor: float, floor: float = 0.001) -> DataFrame:
    """weight * factor; edges below the floor go."""
    if not 0 < factor < 1:
        raise ValueError("factor must lie between 0 and 1")
    return edges.withColumn("weight", F.col("weight") * factor).where(F.col("weight") >= floor)


def stats(edges: DataFrame, nodes: DataFrame, term_stats: DataFrame) -> DataFrame:
    """One row: terms, edges, nodes."""
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(term_stats.select("field", "term").distinct(), "terms").join(one(edges, "edges")).join(one(nodes, "nodes"))  # three single rows


def node_features(edges: DataFrame) -> DataFrame:
    """degree, average, largest and smallest weight of every source node."""
    return edges.groupBy(F.col("src").alias("node")).agg(
        F.count("*").alias("degree"), F.avg("weight").alias("avg_weight"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight")
    )


def top_edges(edges: DataFrame, k: int, epsilon: float = 0.0, seed: int = 0) -> DataFrame:
    """The k heaviest edges of each source; epsilon > 0 gives a share of places to seeded random others."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    if not epsilon:
        return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    explore = max(1, int(k * epsilon))
    ranked = edges.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("src")))
    tail = Window.partitionBy("src", F.col("_n") > k - explore).orderBy(F.xxhash64("src", "dst", F.lit(seed)))
    keep = (F.col("_all") <= k) | (F.col("_n") <= k - explore) | (F.row_number().over(tail) <= explore)
    return ranked.withColumn("_keep", keep).where("_keep").drop("_n", "_all", "_keep")


def spread(edges: DataFrame, start: str, hops: int, decay: float = 0.7, fan_out: int = 0) -> DataFrame:
    """node, weight: best product of weights and decay per hop, then the best hop; no way back to the start."""
    decay = decay if 0 < decay <= 1 else 0.7
    # the start is left out before the cut, so its edges never use up a place
    usable = edges.select("src", "dst", "weight").where(F.col("dst") != start)
    usable = top_edges(usable, fan_out) if fan_out else usable
    frontier = edges.sparkSession.createDataFrame([(start, 1.0)], "node string, energy double")
    found = []
    for _ in range(max(0, hops)):
        step = usable.join(frontier, usable.src == frontier.node).select(F.col("dst").alias("node"), (F.col("energy") * F.col("weight") * decay).alias("energy"))
        frontier = step.groupBy("node").agg(F.max("energy").alias("energy"))
        found.append(frontier)
    if not found:
        return edges.sparkSession.createDataFrame([], "node string, weight double")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("node").agg(F.max("energy").alias("weight"))


def activate(adjacency: dict[str, list[tuple[str, float]]], start: str, energy: float, hops: int, decay: float, fan_out: int, threshold: float) -> dict[str, float]:
    """Best-first activation: a node is settled by its first, strongest arrival and spreads from there."""
    heap, settled = [(-energy, start, 0)], {}
    while heap:
        e, node, hop = heapq.heappop(heap)
        if node in settled:
            continue
        settled[node] = -e
        if hop >= hops:
            continue
        onward = [(d, w) for d, w in adjacency.get(node, ()) if d != start][:fan_out]
        for d, w in onward:
            if d not in settled and -e * w * decay >= threshold:
                heapq.heappush(heap, (e * w * decay, d, hop + 1))
    settled.pop(start, None)
    return settled


def spread_activation(
    edges: DataFrame, starts: DataFrame, energy: float = 1.0, hops: int = 3, decay: float = 0.7, fan_out: int = 15, threshold: float = 0.01,
    embeddings: DataFrame | None = None, alpha: float = 0.0,
) -> DataFrame:
    """start, node, energy for every row of starts.

    Each start's reachable part of the pruned graph (fan_out + 1 edges a node, as the start itself
    may take a place) is gathered by joins, hop by hop, and activated in one task per start; it holds
    at most fan_out ** hops nodes. Only the edges of the nodes reached are ranked, and a hop is written, so
    the next one reads the graph once, beside a small table. Embeddings blend alpha * cosine into edge
    weights after the cut.
    """
    decay = decay if 0 < decay <= 1 else 0.7
    fan_out = fan_out if fan_out > 0 else 50
    if energy <= 0:
        hops = 0

    def pruned(nodes: DataFrame) -> DataFrame:
        own = edges.select("src", "dst", "weight").join(nodes.select("src").distinct(), "src", "left_semi")
        out = top_edges(own, fan_out + 1).withColumn("rank", F.col("weight"))
        if embeddings is None or alpha <= 0:
            return out
        from ..functions.scoring import cosine

        e = embeddings.select("term", "embedding")
        out = out.join(e.select(F.col("term").alias("src"), F.col("embedding").alias("ea")), "src", "left").join(e.select(F.col("term").alias("dst"), F.col("embedding").alias("eb")), "dst", "left")
        blended = alpha * cosine(F.col("ea"), F.col("eb")) + (1 - alpha) * F.col("weight")
        return out.select("src", "dst", F.when(F.col("ea").isNotNull() & F.col("eb").isNotNull(), blended).otherwise(F.col("weight")).alias("weight"), "rank")

    frontier = starts.select("start", F.col("start").alias("src")).distinct()
    parts = []
    for _ in range(max(0, hops)):
        reached = materialize(pruned(frontier).join(frontier, "src").select("start", "src", "dst", "weight", "rank"), "hop")
        parts.append(reached)
        frontier = reached.select("start", F.col("dst").alias("src")).distinct()
    if not parts:
        return starts.sparkSession.createDataFrame([], "start string, node string, energy double")
    local = parts[0]
    for x in parts[1:]:
        local = local.unionByName(x)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        start, adjacency = g["start"].iloc[0], {}
        g = g.drop_duplicates(["src", "dst"]).sort_values(["src", "rank", "dst"], ascending=[True, False, True])
        for s, d, w in zip(g.src, g.dst, g.weight, strict=True):
            adjacency.setdefault(s, []).append((d, w))
        found = activate(adjacency, start, energy, hops, decay, fan_out, threshold)
        return pd.DataFrame([(start, n, e) for n, e in found.items()], columns=["start", "node", "energy"])

    return local.groupBy("start").applyInPandas(run, "start string, node string, energy double")


class Graphs:
    """Named graphs: edges and nodes (node_id, label, type, metadata) as DataFrames."""

    def __init__(self) -> None:
        self._graphs: dict[str, dict[str, DataFrame | None]] = {}

    def create(self, name: str, edges: DataFrame, nodes: DataFrame | None = None) -> None:
        if name in self._graphs:
            raise ValueError(f"graph {name!r} exists")
        self._graphs[name] = {"edges": edges, "nodes": nodes}

    def edges(self, name: str) -> DataFrame:
        return self._graphs[name]["edges"]

    def nodes(self, name: str, prefix: str = "", limit: int | None = None) -> DataFrame:
        out = self._graphs[name]["nodes"].where(F.col("node_id").startswith(prefix)).orderBy("node_id")
        return out.limit(limit) if limit else out

    def add_edges(self, name: str, new: DataFrame) -> None:
        self._graphs[name]["edges"] = upsert(self.edges(name), new)

    def set_nodes(self, name: str, new: DataFrame) -> None:
        old = self._graphs[name]["nodes"]
        keep = old.join(new.select("node_id"), "node_id", "left_anti") if old is not None else None
        self._graphs[name]["nodes"] = new if keep is None else keep.unionByName(new)

    def delete_node(self, name: str, node_id: str) -> None:
        g = self._graphs[name]
        g["nodes"] = g["nodes"].where(F.col("node_id") != node_id)
        g["edges"] = g["edges"].where((F.col("src") != node_id) & (F.col("dst") != node_id))

    def decay(self, name: str, factor: float) -> None:
        self._graphs[name]["edges"] = decayed(self.edges(name), factor)

    def delete(self, name: str) -> None:
        del self._graphs[name]

    def names(self) -> list[str]:
        return sorted(self._graphs)


