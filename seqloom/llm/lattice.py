"""Near-duplicate embeddings by lattice hashing with E8.

In each of TABLES tables a unit vector is projected at random to two times eight dimensions, scaled, shifted, and each
half decoded to its nearest point of the E8 lattice; the pair of points is its cell. A vector is filed under its own
cell and under the cells next to it (each half moved to one of its nearest neighbouring points, and both moved
together), so vectors on either side of a border meet. Members of a cell with equal label and dimension are compared
by cosine in double precision; what links connect is a component. Two vectors of cosine 0.98 miss each other in one
table with a chance near a quarter, in all of them near 1e-6; nearer ones less.

Links are then counted over each whole component with blocked matrix products: every pair of a component is compared,
no pair leaves a task. Equal vectors are one class throughout and are counted by multiplicity.

Vectors that are null, empty, zero or hold a null or non-finite component, and vectors without label, link with
nothing and are their own component. Vectors of different length never link. Repeated rows are vectors of their own;
a component's id is its smallest vec_id. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bind, small_batches, staged
from seqloom.llm.linking import linked
from seqloom.llm.shingles import mix
from seqloom.operators.skew import spread_lookup

COSINE = 0.98
TABLES = 10
WIDTH = 0.6  # a lattice unit, as a distance between unit vectors
NEAR = 4  # neighbouring points tried for each half
BOTH = 2  # and for both halves together
SEED = 8
BLOCK = 512
COUNT_BLOCK = 1024


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = [v for v in itertools.product((-1.0, 0.0, 1.0), repeat=8) if np.count_nonzero(v) == 2]
    half = [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number point with an even sum: round, and if the sum is odd, round the worst entry the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: E8 is the even points and the even points moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _point_hash(p: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(p), salt, np.uint64)
    for c in (2 * p).astype(np.int64).view(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def cells(unit: np.ndarray, tables: int = TABLES, width: float = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per table: the hash of each vector's own cell, and the hashes (columns) of the cells next to it."""
    steps = minimal_vectors()
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, unit.shape[1]])
        halves = []
        for half in range(2):
            y = unit @ (rng.normal(size=(unit.shape[1], 8)) / (np.sqrt(8) * width)) + rng.uniform(0, 2, 8)
            p = nearest(y)
            order = np.argpartition(-((y - p) @ steps.T), NEAR, axis=1)[:, :NEAR]
            closeness = np.take_along_axis((y - p) @ steps.T, order, 1)
            order = np.take_along_axis(order, np.argsort(-closeness, 1, kind="stable"), 1)
            salt = 2 * t + half + 1
            halves.append([_point_hash(p, salt)] + [_point_hash(p + steps[order[:, k]], salt) for k in range(NEAR)])
        a, b = halves
        joint = lambda x, y: mix(x ^ (y * np.uint64(0xD6E8FEB86659FD93)))
        beside = [joint(a[k], b[0]) for k in range(1, NEAR + 1)] + [joint(a[0], b[k]) for k in range(1, NEAR + 1)]
        beside += [joint(a[i], b[j]) for i in range(1, BOTH + 1) for j in range(1, BOTH + 1)]
        yield joint(a[0], b[0]), np.stack(beside, 1)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.array(batch["size"].to_pylist(), np.int64)
        for n in np.unique(size):
            part = batch.take(pa.array(np.flatnonzero(size == n)))
            salt = mix(np.array(part["label_hash"].to_pylist(), np.int64).view(np.uint64) + np.uint64(n))
            for own, beside in cells(_vectors(part["unit"])):
                keys = np.column_stack((own, beside)) ^ salt[:, None]
                width = keys.shape[1]
                home = np.zeros(keys.shape, bool)
                home[:, 0] = True
                node = part["node"].take(pa.array(np.repeat(np.arange(len(part)), width)))
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), node, pa.array(home.ravel())], ["grp", "node", "home"])


def cosine_links(part: pa.Table):
    unit = _vectors(part["unit"])
    kind = np.array(list(zip(part["label_hash"].to_pylist(), part["size"].to_pylist(), strict=True)))

    def alike(i, js):
        return (unit[js] @ unit[i] >= COSINE) & (kind[js] == kind[i]).all(1)

    return alike


def _links_of_blocks(rows: pa.Table) -> pa.Table:
    """Per vector of two blocks of a component: how many vectors of the other block it links with."""
    at = rows["at"].to_numpy()
    low, high = rows["i"][0].as_py(), rows["j"][0].as_py()
    a, b = np.flatnonzero(at == low), np.flatnonzero(at == high)
    unit, times = _vectors(rows["unit"]), rows["times"].to_numpy().astype(np.int64)
    near = unit[a] @ unit[b].T >= COSINE
    if low == high:
        near &= ~np.eye(len(a), dtype=bool)
        counts, index = near @ times[b], a
    else:
        counts, index = np.concatenate((near @ times[b], times[a] @ near)), np.concatenate((a, b))
    return pa.table({"node": rows["node"].combine_chunks().take(pa.array(index)).cast(pa.binary()), "links": pa.array(counts, pa.int64())})


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """Per row of embeddings: vec_id, n_links, component_id, kept."""
    small_batches(embeddings.sparkSession, 4 << 20)
    v = F.transform("embedding", lambda x: x.cast("double"))
    # In units of the largest component, so that no square overflows or vanishes.
    largest = F.array_max(F.transform(v, F.abs))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "label", "embedding", largest.alias("largest"), finite.alias("finite"))
    valid = F.col("label").isNotNull() & F.coalesce(F.col("finite"), F.lit(False)) & (F.coalesce(F.col("largest"), F.lit(0.0)) > 0)
    scaled = F.transform(v, lambda x: x / F.col("largest"))
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
    unit = bind(scaled, lambda w: bind(norm(w), lambda n: F.transform(w, lambda x: x / n)))
    name = F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.concat_ws(",", v.cast("array<string>")))))
    rows = staged(rows.withColumn("node", F.when(valid, name)), "vectors")
    classes = (
        rows.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("vec_id").alias("first_id"),
            F.count("*").alias("times"),
            F.first(F.xxhash64(F.col("label").cast("string"))).alias("label_hash"),
            F.first(unit).alias("unit"),
        )
        .withColumn("size", F.size("unit"))
    )
    classes = staged(classes, "classes")
    filed = staged(classes.select("node", "label_hash", "size", "unit").mapInArrow(_filed, "grp long, node binary, home boolean"), "filed")
    shared = filed.groupBy("grp").agg(F.count("*").alias("c"), F.max("home").alias("met")).where("c > 1 and met")
    members = filed.join(shared, "grp").select("grp", "node", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    members = members.join(classes.select("node", "label_hash", "size", "unit"), "node")
    roots = linked(staged(members, "members"), cosine_links, BLOCK, pack=4000)

    grouped = staged(roots.join(classes, "node").select("root", "node", "first_id", "times", "unit"), "grouped")
    width = grouped.groupBy("root").agg(
        F.ceil(F.count("*") / COUNT_BLOCK).cast("int").alias("blocks"), F.min("first_id").alias("component_id"), F.count("*").alias("held")
    )
    placed = spread_lookup(grouped, staged(width, "width"), ["root"], "held", "node").withColumn("at", F.pmod(F.xxhash64("node", "root"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = placed.withColumn("other", F.explode(others)).select(
        "root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "node", "times", "unit"
    )
    links = dealt.groupBy("root", "i", "j").applyInArrow(_links_of_blocks, "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))
    found = placed.select("node", "component_id").join(links, "node", "left")
    known = classes.select("node", "first_id", "times").join(found, "node", "left").select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component_id", "first_id").alias("component_id"),
    )
    out = rows.select("vec_id", "node").join(staged(known, "known"), "node", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
