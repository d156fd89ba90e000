"""Training sequences of bounded length, packed from whole documents by a linear grouping scheme.

1. Each text is encoded and gets an end id. Documents longer than the capacity are cut into pieces of exactly the
   capacity, the first of which may be shorter; no other document is cut. A piece is numbered within its length by the
   task that made it, and written.
2. The lengths are counted: at most `capacity` counts go to the driver, whatever the corpus. `configurations` plans the
   bins for them (linear grouping, few-size configurations, substitution, best fit).
3. The numbers of a length run on over the tasks, so that each piece has a place among those of its length; the plan
   says for each range of places which bins they go to and at what offset. A piece of any length, however common, is
   looked up on its own: no task gathers the pieces of a length or of a sequence.

Null and empty texts are their end id alone. Repeated rows are documents of their own. Very long texts are encoded in
parts, cut before a single space between two words, where the tokenizer always begins anew. An empty table gives no
rows. Other columns are ignored by `packed`.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex as re
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.common import small_batches, staged
from seqloom.llm.configurations import Run, planned

CAPACITY = 1024
END_ID = 2
PART = 1 << 18  # characters encoded at once
KNOWN = 1 << 19  # pre-tokens that a worker remembers
# How a byte-level BPE tokenizer cuts text, and characters that texts are not cut around here.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OTHER_CHARACTERS = r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ͯΆ-ϿЀ-ԧ‐-‧₠-€←-⇿]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def parts(text: str, size: int = PART) -> list[str]:
    """The text cut before spaces between two words, each part `size` characters or as few more as that allows.

    A byte-level pre-tokenizer always ends a token before a space that follows a visible character, and takes that space
    and the visible character behind it into one token: encoding part by part gives the ids of the whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (text[at - 1].isspace() or text[at + 1 : at + 2].isspace() or at + 1 == len(text)):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


class Encoder:
    """The ids of texts. The tokenizer encodes each distinct pre-token once; those met before are looked up.

    Pre-tokens are cut here only in texts of characters whose kind all Unicode versions agree on, and that hold no special
    token; other texts the tokenizer takes whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        self.model = Tokenizer.from_file(path)
        kept = json.loads(self.model.to_str())
        shape = kept["pre_tokenizer"] or {}
        plain = shape.get("type") == "ByteLevel" and shape.get("use_regex") and not shape.get("add_prefix_space") and not kept["normalizer"]
        special = [re.escape(t["content"]) for t in kept["added_tokens"]]
        self.other = re.compile("|".join([OTHER_CHARACTERS, *special]) if plain else "")
        self.known: dict[str, bytes] = {}

    def whole(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(strings, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Encode pre-tokens not met before. Those that begin with a space go as one text: it is cut there again."""
        spaced = [w for w in words if w[0] == " " and w[1:2].strip()]
        for at in range(0, len(spaced), 5000):
            some = spaced[at : at + 5000]
            found = self.model.encode("".join(some), add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(some) + 1))).tolist()
            self.known.update((w, raw[i:j]) for w, i, j in zip(some, ends[:-1], ends[1:], strict=True))
        rest = [w for w in words if w not in self.known]
        self.known.update(zip(rest, self.whole(rest), strict=True))

    def part(self, text: str) -> bytes:
        if self.other.search(text):
            return self.whole([text])[0]
        words = PRE_TOKEN.findall(text)
        distinct = set(words)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = distinct
        if new:
            self.learn(new)
        return b"".join([*map(self.known.__getitem__, words)])

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([self.part(p) for p in parts(text)]), "<u4")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(max(0, stop - capacity), stop) for stop in range(first, n + 1, capacity)]


def pieces(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and (task, number): its number among those of its length that
    the task made. With `with_ids` also the ids themselves."""
    path = tokenizer or default_tokenizer()
    small_batches(documents.sparkSession, 4 << 20)
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = encoder(path)
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            origin, rows, ids = [], [], []
            for k, text in enumerate(batch["text"]):
                found = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for number, (start, stop) in enumerate(cuts(len(found), capacity)):
                    part = found[start:stop]
                    origin.append(k)
                    rows.append((number, start, stop - start, zlib.crc32(part.tobytes()), task, made[stop - start]))
                    made[stop - start] += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = np.array(rows, np.int64).reshape(len(rows), 6).T
            arrays = [batch["doc_id"].take(pa.array(origin, pa.int64())), *map(pa.array, columns)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), np.concatenate([np.empty(0, np.int32), *ids])))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([a.cast(pa.int32()) if n == "piece" else a for a, n in zip(arrays, names, strict=True)], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, number long"
    return source.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


class Places:
    """For each place among the pieces of a length: the sequence and the offset there. As many ranges as the plan has."""

    def __init__(self, runs: list[Run], capacity: int):
        used = np.zeros(capacity + 1, np.int64)
        ranges, sequence = [], 0
        for run in runs:
            offset = 0
            for length in run.lengths:
                ranges.append((length, used[length], sequence, offset))
                used[length] += run.times
                offset += length
            sequence += run.times
        table = np.array(sorted(ranges), np.int64).reshape(len(ranges), 4)
        self.sequences, self.length, self.begin, self.sequence, self.offset = sequence, *table.T
        self.first = np.searchsorted(self.length, np.arange(capacity + 2))

    def __call__(self, length: pa.Array, place: pa.Array) -> pa.Array:
        n, at = length.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
        row = np.empty(len(n), np.int64)
        for k in np.unique(n):
            lo, hi = self.first[k], self.first[k + 1]
            mine = n == k
            row[mine] = lo + np.searchsorted(self.begin[lo:hi], at[mine], "right") - 1
        found = self.sequence[row] + at - self.begin[row]
        return pa.StructArray.from_arrays([pa.array(found), pa.array(self.offset[row])], ["sequence_id", "offset"])


def placed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A written table of pieces (length, task, number, ...) with sequence_id and offset instead of task and number."""
    held = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Places(planned(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    look_up = F.arrow_udf(lambda length, place: places(length, place), "struct<sequence_id long, offset long>")
    rows = made.join(held, ["length", "task"]).withColumn("_at", look_up("length", F.col("number") + F.col("_before")))
    kept = [c for c in made.columns if c not in ("task", "number")]
    return rows.select(*kept, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def packed(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for."""
    return placed(staged(pieces(documents, capacity, end_id, tokenizer, with_ids), "pieces"), capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token sequences that `packed(..., with_ids=True)` describes, at most the capacity each."""
    part = F.struct("offset", "ids", "doc_id")
    return (
        rows.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
    )
