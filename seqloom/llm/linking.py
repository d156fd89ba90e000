"""Links inside groups of any size, and the components they make, without a task that holds a whole group.

`linked` takes members of groups and a test of likeness. Small groups are packed many to a task. A large group is cut
into blocks by a hash: every block is compared with itself and with the group's first block, which connects nearly all
of a group that is really alike; what then stands outside the group's largest component is compared with every block.
So each pair of a group is tested or already connected, the work is near linear in groups of near copies, and nothing
but links leaves a task: at most one per member and comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import discard, staged

LINKS = "a binary, b binary"
EDGES_A_TASK = 200_000
FEW = 200_000  # edges that one task joins: their nodes are 16 bytes each
MINIMA = 250_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """`df` in as many tasks as `rows` need, and at least one for each core: links are few beside what they come from."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // EDGES_A_TASK)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges by union-find in one task: (node, root), the root being the smallest node."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    edges = pa.concat_tables(tables)
    both = pa.concat_arrays([c.combine_chunks() for c in (edges["a"], edges["b"])])
    nodes = pc.unique(both)
    nodes = nodes.take(pc.array_sort_indices(nodes))
    at = pc.index_in(both, nodes).to_numpy()
    up = np.arange(len(nodes))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(at[: len(edges)], at[len(edges) :], strict=True):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    while (up != up[up]).any():
        up = up[up]
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(up))], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it is connected to.

    Up to FEW edges are joined in one task. More alternate the large-star and small-star steps until nothing moves, or
    few enough are left; each round is written to the shared folder. Minima are aggregated before the shuffle, then
    joined back, so that a node with many neighbours can be split.
    """
    n = edges.count()
    edges = staged(fitted(edges.select("a", "b").where("a <> b").distinct(), n), "edges")
    n = edges.count()
    # A node has one minimum, so a table of minima has at most 2 * n rows: broadcast where that is little.
    beside = F.broadcast if n <= MINIMA else lambda df: df
    before = None
    while n > FEW:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(beside(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(beside(least), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b")
        last, edges = edges, staged(fitted(small.distinct(), n), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    if n <= FEW:
        roots = staged(edges.repartition(1).mapInArrow(_joined, "node binary, root binary"), "roots")
    else:
        tops = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        roots = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops), "roots")
    discard(edges)
    return roots


def spread(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect rows 0..n-1 as all links would: a walk that compares each reached row with those not yet
    reached only. alike(i, js) tells which rows of js link with i."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = alike(i, left)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue.extend(found)
                out.extend((i, j) for j in found)
    return out


def across(outside: np.ndarray, label: np.ndarray, alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between each row of `outside` and the rows of another component, one per component met."""
    out = []
    for i in outside:
        js = np.flatnonzero(label != label[i])
        found = js[alike(i, js)] if len(js) else js
        _, first = np.unique(label[found], return_index=True)
        out.extend((i, j) for j in found[first])
    return out


def _tasks(compare, residual: bool):
    """The function of one task: rows of one or more groups -> links."""

    def run(rows: pa.Table) -> pa.Table:
        codes = rows["grp"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        rows, codes = rows.take(pa.array(order)), codes[order]
        cuts = np.flatnonzero(np.diff(codes)) + 1
        left, right = [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(codes)], strict=True):
            if hi - lo < 2:
                continue
            part = rows.slice(lo, hi - lo)
            alike = compare(part)
            if residual:
                label = pd.factorize(np.array(part["root"].to_pylist(), object))[0]
                pairs = across(np.flatnonzero(part["outside"].to_numpy(zero_copy_only=False)), label, alike)
            else:
                pairs = spread(hi - lo, alike)
            left += [lo + a for a, _ in pairs]
            right += [lo + b for _, b in pairs]
        nodes = rows["node"].combine_chunks()
        return pa.table({"a": nodes.take(pa.array(left, pa.int64())), "b": nodes.take(pa.array(right, pa.int64()))}).cast(
            pa.schema([("a", pa.binary()), ("b", pa.binary())])
        )

    return run


def linked(members: DataFrame, compare: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]], block: int = 256, pack: int = 20_000) -> DataFrame:
    """(node, root) of the components that the links inside all groups make, for the nodes that have links.

    `members` has grp, node (binary), blocks (into how many its group is cut) and what `compare` reads; it should be a
    written table. compare(rows) of one group's rows gives alike(i, js).
    """
    n = members.count()
    packs = max(1, -(-n // pack))
    whole = members.where("blocks <= 1").withColumn("task", F.struct((F.xxhash64("grp") % packs).alias("x"), F.lit(-1).alias("y")))
    parts = members.where("blocks > 1").withColumn("at", F.pmod(F.xxhash64("node", "grp"), F.col("blocks")).cast("int"))
    reach = F.when(F.col("at") == 0, F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array("at"))
    cut = parts.withColumn("y", F.explode(reach)).withColumn("task", F.struct(F.xxhash64("grp").alias("x"), "y")).drop("at", "y")
    edges = staged(whole.unionByName(cut).groupBy("task").applyInArrow(_tasks(compare, False), LINKS), "links")
    roots = components(edges)
    discard(edges)
    if parts.isEmpty():
        return roots
    known = known_table = staged(
        parts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "known"
    )
    counts = known.groupBy("grp", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    known = known.join(main, "grp").withColumn("outside", F.col("root") != F.col("main")).drop("main")
    rest = known.where("outside")
    if rest.isEmpty():
        return roots
    held = rest.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("tiles"))
    known = known.join(held, "grp")
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    width = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    tile = F.pmod(F.xxhash64("grp", "node"), F.col("tiles")).cast("int")
    own = known.withColumn("i", F.explode(tiles)).withColumn("j", F.col("at")).withColumn("outside", F.lit(False))
    out = known.where("outside").withColumn("i", tile).withColumn("j", F.explode(width))
    both = own.unionByName(out).withColumn("task", F.struct(F.xxhash64("grp").alias("x"), "i", "j")).drop("at", "i", "j", "tiles")
    more = staged(both.groupBy("task").applyInArrow(_tasks(compare, True), LINKS), "links")
    discard(known_table)
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return roots if more.isEmpty() else components(stars.unionByName(more))
