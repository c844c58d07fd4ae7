"""Connected components: of one table of edges, and of many graphs at once.

A table of edges is first contracted in blocks where it lies: each block becomes the
stars of its own components. What is left is settled by alternating large-star and
small-star rounds. Every step keeps at most as many edges as it got, so nothing grows
with the square of a component. State between rounds is a table in the shared folder.
Graphs that are small, each by itself, are finished by the task that holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.shared import drop_table, redeal, write_table

MAX_ROUNDS = 60
#: Edges that a task contracts at once.
BLOCK_EDGES = 1 << 18
#: A graph with up to this many edges is finished in one task; other graphs don't count.
GRAPH_EDGES = 1 << 18


def _with_smallest(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """Join each edge with its ``u``'s smallest neighbour.

    A hot ``u`` can be split, as the aggregate is dealt out once more.
    """
    return edges.join(redeal(smallest, "u"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("m"))
    return _with_smallest(both, smallest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger node ``u`` to the smaller ``v``."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = _with_smallest(edges, smallest).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(smallest.select("u", F.col("m").alias("v")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and marks that tell whether two such tables are alike, taken as it is written."""
    seen = Observation()
    marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x"))
    out = write_table(edges.observe(seen, *marks), "edges")
    got = seen.get
    return out, (got["n"], got["s"], got["x"])


def order_codes(values: pa.Array) -> np.ndarray:
    """Numbers that are equal and ordered like the values (nulls first), those of a struct by its fields."""
    if pa.types.is_struct(values.type):
        code = np.where(values.is_null().to_numpy(zero_copy_only=False), 0, 1)
        for field in values.flatten():
            own = order_codes(field)
            code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
        return code
    encoded = values.dictionary_encode()
    rank = np.empty(len(encoded.dictionary), np.int64)
    rank[pc.sort_indices(encoded.dictionary).to_numpy()] = np.arange(1, len(rank) + 1)
    return np.append(rank, 0)[encoded.indices.fill_null(len(rank)).to_numpy()]


def smallest_reachable(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest that edges x - y lead to.

    Roots hook on to smaller neighbours until no edge leads on; neighbours never stay
    roots both, so their number halves at least.
    """
    label = np.arange(n)
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(up := label[label], label):
            label = up


def _stars(columns: list[pa.Array], alone: bool = True) -> list[pa.Array]:
    """Columns that end in an edge's two nodes, to the same columns as stars: each node and its root; the graph is part of a node.

    Without ``alone`` roots aren't named as nodes of their own.
    """
    *graph, u, v = columns
    nodes = pa.concat_arrays([u, v])
    code = order_codes(nodes)
    for g in graph:
        code = np.tile(order_codes(g), 2) * (int(code.max(initial=0)) + 1) + code
    _, first, ids = np.unique(code, return_index=True, return_inverse=True)
    root = smallest_reachable(len(first), *np.split(ids, 2))
    at = np.arange(len(first)) if alone else np.flatnonzero(root != np.arange(len(first)))
    take = lambda x, i: x.take(pa.array(i))
    return [take(g, first[at] % len(u)) for g in graph] + [take(nodes, first[at]), take(nodes, first[root[at]])]


def _columns(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    whole = [c.combine_chunks() for c in pa.Table.from_batches(batches).columns]
    return [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in whole]


def _contract(batches):
    """(u, v) edges to the stars (u, v: the smaller node) of each block of them, without nodes on their own."""
    held, size = [], 0

    def done():
        return pa.RecordBatch.from_arrays(_stars(_columns(held), alone=False), names=["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= BLOCK_EDGES:
            yield done()
            held, size = [], 0
    if held:
        yield done()


def _finish_graphs(batches):
    """(g, u, v) sorted by g to (g, node, component): whole graphs, as many at a time as fill a block."""
    held: list = []
    size = 0
    for b in (b for b in batches if b.num_rows):
        held.append(b)
        size += b.num_rows
        if size < BLOCK_EDGES:
            continue
        g = order_codes(_columns([x.select([0]) for x in held])[0])
        cut = len(g) - int((g == g[-1]).sum())
        if cut:
            whole = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays(_stars(_columns(whole.slice(0, cut).to_batches())), names=["g", "node", "component"])
            held = whole.slice(cut).to_batches()
            size = sum(x.num_rows for x in held)
    if held:
        yield pa.RecordBatch.from_arrays(_stars(_columns(held)), names=["g", "node", "component"])


def connected_components(edges: DataFrame, a: str, b: str, contract: bool = True) -> DataFrame:
    """(node, component) for every node that an edge names; component = its smallest node.

    Edges with a null end are ignored; loops make a component of one. Works for any
    orderable type of node. An empty edge table gives an empty result. Without
    ``contract`` all is done by the rounds, in the JVM alone.
    """
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = named.where("u = v").select("u").distinct()
    apart = named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state, mark = _written((apart.mapInArrow(_contract, apart.schema) if contract else apart).distinct())
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        after, new = _written(_small_star(_large_star(state)).distinct())
        drop_table(state)
        state, before, mark = after, mark, new
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), "v")).unionByName(
        loops.select("u", F.col("u").alias("v"))
    )
    return nodes.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def graph_components(edges: DataFrame, g: str, a: str, b: str, graph_edges: int = GRAPH_EDGES) -> DataFrame:
    """(g, node, component) for the nodes that edges name, by graph; component = the smallest node of it in that graph.

    Each graph takes its own way: one of up to ``graph_edges`` edges is finished by one
    task, which holds about a block of edges, the others are settled together in
    rounds. Null ends and loops as in ``connected_components``; null is a graph as well.
    """
    named = edges.select(F.col(g).alias("g"), F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    large = write_table(named.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > graph_edges).select(F.col("g").alias("_g")), "large-graphs")
    some = not large.isEmpty()
    form = T.StructType([T.StructField(n, f.dataType) for n, f in zip(("g", "node", "component"), named.schema)])
    small = named.join(redeal(large, "_g"), named["g"].eqNullSafe(F.col("_g")), "left_anti") if some else named
    out = small.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g").mapInArrow(_finish_graphs, form)
    if some:
        rest = named.join(redeal(large, "_g"), named["g"].eqNullSafe(F.col("_g")), "left_semi")
        ends = rest.select(*(F.struct("g", F.col(c).alias("o")).alias(c) for c in ("u", "v")))
        out = out.unionByName(connected_components(ends, "u", "v").select(F.col("node.g").alias("g"), F.col("node.o").alias("node"), F.col("component.o").alias("component")))
    return out
