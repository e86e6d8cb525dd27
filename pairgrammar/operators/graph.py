"""Pair-graph jobs on edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrammar.operators.ordered import ranked
from pairgrammar.session import materialize, shared_dir


HUB_PARTS = 4096  # a node with a larger share of all edges than one of so many is a hub: there are fewer of these


def look_up(edges: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Edges with the values that ``table`` (``key``, ``_edges``, values) has for their ``key``.

    The values of hubs, fewer than ``HUB_PARTS``, go to the tasks in which their edges lie, so a hub's edges stay
    spread; all other nodes have too few edges to fill a task by themselves.
    """
    is_hub = F.col("_edges") * HUB_PARTS > total
    hubs = F.broadcast(table.filter(is_hub).drop("_edges"))
    rest = table.filter(~is_hub).drop("_edges")
    return edges.join(hubs, key).unionByName(edges.join(hubs.select(key), key, "left_anti").join(rest, key))


def with_lowest(edges: DataFrame, lowest: Column, total: int) -> DataFrame:
    """Edges (u, v) with ``m``, the lowest of all v of their u (``lowest``)."""
    return look_up(edges, edges.groupBy("u").agg(lowest.alias("m"), F.count("*").alias("_edges")), "u", total)


def _fingerprint(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


FOREST = 1 << 20  # edges that a task holds at once


def forest(u: np.ndarray, v: np.ndarray, odd: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least edges that tie the same nodes by walks of the same parities: one to the lowest node of each component, and a loop there if it has an odd cycle.

    ``odd``: whether an edge changes sides. Works on the double cover: the second copy of a node has its number and ``nodes`` more.
    """
    flip = np.where(odd, nodes, 0)
    a, b, root = np.concatenate([u, u + nodes]), np.concatenate([v + flip, v + nodes - flip]), np.arange(2 * nodes)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    low = np.minimum(root[:nodes], root[nodes:])
    tied, loops = np.flatnonzero(low != np.arange(nodes)), np.flatnonzero((low == np.arange(nodes)) & (root[:nodes] == root[nodes:]))
    return np.concatenate([tied, loops]), np.concatenate([low[tied], loops]), np.concatenate([root[tied] != low[tied], np.ones(len(loops), bool)])


def contracted(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Edges (u, v, odd) with the components and odd cycles of all edges, fewer for each task than the nodes it meets.

    Repeated edges and those that close even cycles end in the task that reads them, before anything is stored or shuffled. A
    task holds ``FOREST`` edges at most besides those it is given.
    """
    def run(batches):
        kept, held = [], 0

        def folded():
            columns = [pa.concat_arrays([k[i] for k in kept]) for i in range(3)]
            coded = pa.concat_arrays(columns[:2]).dictionary_encode()
            at = coded.indices.to_numpy().astype(np.int64)
            u, v, odd = forest(at[:len(at) // 2], at[len(at) // 2:], columns[2].to_numpy(zero_copy_only=False), len(coded.dictionary))
            return [coded.dictionary.take(pa.array(u)), coded.dictionary.take(pa.array(v)), pa.array(odd)]

        for b in batches:
            kept.append([b.column(0), b.column(1), pa.array(np.ones(b.num_rows, bool))])
            held += b.num_rows
            if held > FOREST:
                kept = [folded()]
                held = len(kept[0][0])
                if held > FOREST // 2:
                    yield pa.RecordBatch.from_arrays(kept[0], ["u", "v", "odd"])
                    kept, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(folded(), ["u", "v", "odd"])

    given = edges.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v")).filter("u is not null and v is not null")
    return given.mapInArrow(run, "u string, v string, odd boolean")


def _numbered(edges: DataFrame, left: str, right: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, more) by the numbers of their nodes, and the nodes (node, id): numbers from 1 in the order of the names.

    The rounds compare and group by numbers: the lowest name of a group would be found by sorting.
    """
    base = materialize(edges.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v"), *more).filter("u is not null and v is not null"))
    nodes = base.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("_edges"))
    ids = materialize(ranked(nodes, [], ["node"], "id"))
    total = 2 * base.count()
    for side in ("u", "v"):
        base = look_up(base, ids.select(F.col("node").alias(side), "_edges", F.col("id").alias(f"_{side}")), side, total).drop(side)
    return base.select(F.col("_u").alias("u"), F.col("_v").alias("v"), *more), ids.select("node", "id")


def _lower(pairs: DataFrame) -> DataFrame:
    """``(u, low)``: the smallest node of its component for every node but that smallest one.

    Alternates large-star and small-star steps (logarithmically many rounds). Each step is
    checkpointed to the shared folder, which cuts the lineage and survives a lost executor. A hub's
    edges are never gathered in one task (``look_up``).
    """
    links = pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_lowest(both, F.least(F.min("v"), F.col("u")), 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        small = with_lowest(large, F.min("v"), mark[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        links = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct().checkpoint()
        now = _fingerprint(links)
        if now == mark:
            break
        mark = now
    return links.groupBy("u").agg(F.min("v").alias("low"))


def connected_components(edges: DataFrame, left: str = "left_tf", right: str = "right_tf") -> DataFrame:
    """K1: ``(node, component)`` with the smallest node of the component as its name."""
    shared_dir(edges.sparkSession)
    pairs, ids = _numbered(edges, left, right)
    low = ids.join(_lower(pairs).withColumnRenamed("u", "id"), "id", "left").select("node", F.coalesce("low", "id").alias("id"))
    names = low.select("id").distinct().join(ids.withColumnRenamed("node", "component"), "id")
    sizes = low.groupBy("id").agg(F.count("*").alias("_edges"))
    return look_up(low, names.join(sizes, "id"), "id", ids.count()).select("node", "component")


def identifiability_components(edges: DataFrame) -> DataFrame:
    """K2: per component its size and whether it holds an odd cycle (self loops count).

    One run over the bipartite double cover answers both: a component is non-bipartite when both
    copies of a node meet, and the smaller name of the two copies' components is its own. It runs
    over the edges that the tasks which read them leave (``contracted``); edges may repeat.
    """
    shared_dir(edges.sparkSession)
    pairs, ids = _numbered(contracted(edges, "left_tf", "right_tf"), "u", "v", "odd")
    n = ids.count()  # a node's second copy has its number and n more
    flip = F.when(F.col("odd"), n).otherwise(0)
    cover = pairs.select(F.explode(F.array(F.struct("u", (F.col("v") + flip).alias("v")), F.struct((F.col("u") + n).alias("u"), (F.col("v") + n - flip).alias("v")))).alias("e")).select("e.*")
    copies = ids.select(F.explode(F.array("id", F.col("id") + n)).alias("u"))
    halves = copies.join(_lower(cover), "u", "left").select(((F.col("u") - 1) % n + 1).alias("id"), F.coalesce("low", "u").alias("half"))
    nodes = halves.groupBy("id").agg(F.min((F.col("half") - 1) % n + 1).alias("low"), (F.min("half") == F.max("half")).alias("odd"))
    found = nodes.groupBy("low").agg(F.count("*").alias("nodes"), F.bool_or("odd").alias("non_bipartite"))
    return found.join(ids.select(F.col("id").alias("low"), F.col("node").alias("component")), "low").select("component", "nodes", "non_bipartite")


def identifiability_audit(edges: DataFrame) -> DataFrame:
    """K2: counts and the gate that every component is non-bipartite."""
    return identifiability_components(edges).agg(
        F.count("*").alias("num_components"), F.count_if("non_bipartite").alias("num_non_bipartite_components"),
        (F.coalesce(F.bool_and("non_bipartite"), F.lit(False))).alias("joint_finetune_allowed"))


def reference_graph(inventory: DataFrame, motifs: DataFrame) -> DataFrame:
    """K3: distinct usable edges whose genes both have a motif."""
    genes = motifs.select("gene_symbol").distinct()
    edges = inventory.filter("pair_usable").select("left_tf", "right_tf").distinct()
    for side in ("left_tf", "right_tf"):
        edges = edges.join(genes.withColumnRenamed("gene_symbol", side), side, "left_semi")
    return edges.select("left_tf", "right_tf")
