"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact verification.

A document is the set of its distinct word n-grams (A-Z in lower case): five words for stages, four for the report of
op9. Two documents link if 100 * |intersection|
>= 80 * |union|; a component is what links connect.

1. Each text becomes its set's size, digest and sketch (the K smallest hashes). Equal sets are one class from here on.
2. Every retained value has an inverted list of classes. Values held by one class only are of no use. Values held by
   more than CAP classes (passages that many documents share) are hot: a class enters its M smallest other lists, and,
   if over half of its sketch is hot, its M_HOT smallest hot lists too. Two classes with similarity 0.8 of which a
   share f is hot have (0.8 - f) / (1 - f) in common of the rest, 0.6 at one half, and so miss each other in all of
   their lists with a chance below 0.4**M there, 0.2**M without hot values, 0.2**M_HOT in the hot lists.
3. In each list, pairs of fitting sizes are kept if the union sketch estimates their similarity at ESTIMATE or more (at
   0.8 a sketch falls below it with a chance of 3e-8; sketches that hold the whole set are compared exactly). The
   components of these pairs are the candidate groups; only their texts are read again.
4. In each group, all pairs of fitting sizes are compared on the full sets. Lists and groups of any size are cut into
   blocks (`linking`).

Null and empty texts and texts without words have the empty set, are their own component and are kept. Of equal texts
the smallest doc_id stands for all (a text none of whose rows has a doc_id links with nothing but its copies); repeated
rows stay rows. Extra columns are ignored here and kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import shingles
from seqloom.llm.common import discard, small_batches, staged
from seqloom.llm.linking import linked

SIZE = 5  # words in a shingle
REPORT_SIZE = 4  # the contract of op9 alone
PERCENT = 80
K = 32
M = 12
M_HOT = 8
CAP = 256
ESTIMATE = 0.375
BLOCK = 256
BLOCK_BYTES = 6 << 20
FILTER_BITS = 1 << 24
_NONE = np.iinfo(np.int64).max


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signature(size: int):
    def signature(text: pa.Array) -> pa.Array:
        sizes, digests, sketches = [], [], []
        for s in shingles.shingle_sets(text, size):
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            sketches.append(s[:K])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(sketches)], ["n", "digest", "sketch"])

    return signature


def _full_set(size: int):
    def full_set(text: pa.Array, digest: pa.Array) -> pa.Array:
        """The set of each text that has the digest asked for; null for other texts of the same doc_id."""
        sets = list(shingles.shingle_sets(text, size))
        wrong = [_digest(s) != d for s, d in zip(sets, digest.to_pylist(), strict=True)]
        return pc.if_else(pa.array(wrong), pa.scalar(None, pa.list_(pa.int64())), _lists(sets))

    return full_set


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """The first K values of each list as a row, filled up with _NONE."""
    lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)
    take = np.minimum(np.diff(offsets), K)
    out = np.full((len(lists), K), _NONE, np.int64)
    row = np.repeat(np.arange(len(lists)), take)
    col = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    out[row, col] = values[np.repeat(offsets[:-1], take) + col]
    return out


class _Sketches:
    """Union-sketch estimates between rows."""

    def __init__(self, n: np.ndarray, s: np.ndarray):
        self.n, self.s = n, s
        self.whole = n <= K
        self.upto = np.where(self.whole, _NONE - 1, s[:, K - 1])
        values, ids = np.unique(s, return_inverse=True)
        self.ids, self.marked = ids.reshape(s.shape), np.zeros(len(values), bool)

    def __call__(self, i: int, js: np.ndarray) -> np.ndarray:
        n, a = self.n[js], self.s[i]
        hit = 100 * np.minimum(n, self.n[i]) >= PERCENT * np.maximum(n, self.n[i])
        js = js[hit]
        if len(js):
            b = self.s[js]
            upto = np.minimum(self.upto[js], self.upto[i])
            inside = b <= upto[:, None]
            self.marked[self.ids[i]] = True
            both = (self.marked[self.ids[js]] & inside).sum(1)
            self.marked[self.ids[i]] = False
            union = np.searchsorted(a, upto, "right") + inside.sum(1) - both
            exact = self.whole[js] & self.whole[i]
            hit[hit] = np.where(exact, 100 * both >= PERCENT * union, both >= ESTIMATE * union)
        return hit


def estimates(part: pa.Table) -> _Sketches:
    return _Sketches(part["n"].to_numpy(), _matrix(part["sketch"]))


def exact(part: pa.Table):
    """Links on the full sets of all rows whose sizes fit."""
    lists = part["members"].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets).astype(np.int64)
    distinct, ids = np.unique(values[offsets[0] : offsets[-1]], return_inverse=True)
    marked, begin = np.zeros(len(distinct), bool), offsets[:-1] - offsets[0]

    def common(i, js):
        own = ids[begin[i] : begin[i] + n[i]]
        marked[own] = True
        start = np.concatenate(([0], np.cumsum(n[js])[:-1]))
        there = np.arange(n[js].sum()) + np.repeat(begin[js] - start, n[js])
        out = np.add.reduceat(marked[ids[there]].astype(np.int64), start)
        marked[own] = False
        return out

    def alike(i, js):
        hit = 100 * np.minimum(n[js], n[i]) >= PERCENT * np.maximum(n[js], n[i])
        js = js[hit]
        if len(js):
            both = common(i, js)
            hit[hit] = 100 * both >= PERCENT * (n[js] + n[i] - both)
        return hit

    return alike


def candidates(classes: DataFrame) -> DataFrame:
    """(node, root) of classes that may be linked; classes not listed link with nothing."""
    postings = classes.select("digest", "n", F.explode("sketch").alias("v"))
    held = postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    per_class = (
        postings.join(held, "v")
        .groupBy("digest", "n")
        .agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("vs"))  # at most K of them
        .withColumn("cold", F.filter("vs", lambda x: x.c <= CAP))
        .withColumn("hot", F.filter("vs", lambda x: x.c > CAP))
    )
    dense = 2 * F.size("hot") > F.least(F.lit(K), F.col("n"))
    chosen = F.concat(F.slice("cold", 1, M), F.when(dense, F.slice("hot", 1, M_HOT)).otherwise(F.slice("hot", 1, 0)))
    entries = staged(per_class.select("digest", F.explode(chosen).alias("x")).select(F.col("x.v").alias("grp"), "x.c", "digest"), "entries")
    large = entries.where(F.col("c") > BLOCK).groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sized = entries.join(large, "grp", "left").select("grp", F.coalesce("blocks", F.lit(1)).alias("blocks"), "digest")
    rows = sized.join(classes.select("digest", "n", "sketch"), "digest").withColumnRenamed("digest", "node")
    rows = staged(rows, "lists")
    roots = linked(rows, estimates, BLOCK)
    discard(entries, rows)
    return roots


def possible(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones, so that few others are shuffled: a bitmap of FILTER_BITS key
    hashes, broadcast as words of 64 bits. Its size is fixed; where very many keys are wanted it lets more rows through."""
    place = F.xxhash64(key).bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(place, 6)
    words = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = rows.withColumn("_word", word).join(F.broadcast(words), "_word")  # at most FILTER_BITS / 64 rows
    return held.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def component_of(classes: DataFrame, documents: DataFrame, size: int = SIZE) -> DataFrame:
    """(digest, root, component_id) of every class; root names the component. `classes` has digest, first_id, n and sketch of `size`-word shingles."""
    groups = staged(candidates(classes).join(classes.select(F.col("digest").alias("node"), "first_id", "n"), "node"), "groups")
    extent = groups.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(8 * F.col("s") / BLOCK_BYTES)).cast("int")
    wanted = staged(groups.join(extent, "root").select("root", F.col("node").alias("digest"), "first_id", blocks.alias("blocks")), "wanted")
    texts = possible(documents.select(F.col("doc_id").alias("first_id"), F.col("text").cast("binary").alias("text")), wanted, "first_id")
    full = (
        texts.join(wanted, "first_id")
        .withColumn("members", F.arrow_udf(_full_set(size), "array<long>").asNondeterministic()("text", "digest"))  # once per row
        .where("members is not null")
        .select(F.col("root").alias("grp"), F.col("digest").alias("node"), "blocks", "members")
        .dropDuplicates(["node"])
    )
    full = staged(full, "sets")
    roots = linked(full, exact, BLOCK, pack=1000).select(F.col("node").alias("digest"), "root")
    discard(groups, wanted, full)
    named = classes.select("digest", "first_id").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "root").select("digest", "root", "component_id")


def _classed(documents: DataFrame, size: int) -> DataFrame:
    """Per row of documents: doc_id, whole (a hash of the text), n, digest, component_id."""
    small_batches(documents.sparkSession, 4 << 20)
    signature = F.arrow_udf(_signature(size), "struct<n long, digest binary, sketch array<long>>")
    read = documents.select("doc_id", F.xxhash64("text").alias("whole"), signature(F.col("text").cast("binary")).alias("s"))
    rows = staged(read.select("doc_id", "whole", "s.*"), "signatures")
    classes = staged(
        rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    found = staged(component_of(classes, documents, size), "components")
    discard(classes)
    return rows.select("doc_id", "whole", "n", "digest").join(found, "digest", "left")


def near_duplicates(documents: DataFrame, size: int = REPORT_SIZE) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        _classed(documents, size)
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of each component, with the columns it came with: that with the smallest doc_id (rows without one come
    last), of several texts of this id that with the smallest digest. What counts is the text, not the id: texts that
    share an id and nothing else all stay, copies without an id are one. Rows without words all stay."""
    rows = _classed(documents, size)
    group = F.coalesce("root", "digest")
    named = rows.where("n > 0").select("doc_id", "whole", "digest", "root")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "whole")
    kept = named.groupBy(group.alias("group")).agg(F.min(first).alias("k")).select("k.doc_id", "k.whole")
    marks = kept.select(F.col("doc_id").alias("_doc"), F.col("whole").alias("_whole"))
    times = named.groupBy("doc_id", "whole").agg(F.count("*").alias("_times"))
    marks = times.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("whole") == F.col("_whole"))).select("_doc", "_whole", "_times")
    held = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    found = held.join(staged(marks, "marks"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_whole")))
    # Only rows that occur several times are gathered; each task first keeps one of its own.
    again = found.where("_times > 1").groupBy("_id", "_text").agg(F.first("row").alias("row"))
    one = found.where("_times = 1").select("row.*").unionByName(again.select("row.*"))
    empty = documents.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t-\r]"))
    return one.unionByName(empty)
