"""Language identification with a blended-spectrum string kernel.

A text is the set of its character 1-, 2- and 3-grams (lower-cased letters; anything else is a space, runs of spaces
one). The kernel of two texts is the mean over n of |common n-grams| / sqrt(|n-grams of one| * |n-grams of the other|).
LANDMARKS labelled texts span the feature space (Nystrom: k(x, landmarks) K_mm^-1/2); on it, one ridge regression per
language with targets 1 and -1 is solved. A batch of texts is scored by three matrix products: grams x landmarks,
landmarks x features, features x languages.

Only the fit is bounded: it sees SAMPLE labelled rows, spread evenly over the languages by a hash of doc_id, and the
dictionary has at most MAX_GRAMS n-grams of the landmarks (of those whose slots in the hashed table collide, the more
frequent). Prediction reads every whole text and nothing but the text.

A score is relative to the other languages, so it cannot tell that a text is in none of them. The filter of the stage
therefore asks how many of the text's 3-grams the dictionary has: a text in a learned language has at least SLACK times
the share that all but QUANTILE of the labelled rows fitted on have (`LanguageModel.least`), whatever the number of languages.

Null texts and texts without a letter are 'und' with score 0; so is everything if no labelled row exists. Ties go to
the first language in sorted order. Repeated rows get equal answers; other columns are carried along untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches

SIZES = (1, 2, 3)
SAMPLE = 1600
LANDMARKS = 120
MAX_GRAMS = 1 << 13
TABLE_BITS = 20
RIDGE = 1e-3
UNDETERMINED = "und"
QUANTILE, SLACK = 0.05, 0.5


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a space."""
    codes = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, codes, np.uint32(32))


def code_points(text: bytes) -> np.ndarray:
    """The text's letters as lower-case code points between single spaces; empty if it has no letter."""
    raw = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    codes = _letters()[raw]
    space = codes == 32
    if space.all():
        return codes[:0]
    return codes[~(space & np.concatenate(([False], space[:-1])))]


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Every n-gram of the code points as one number of 21 bits per character; repeats are kept."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[: len(wide) - n + 1].copy()
    for j in range(1, n):
        out <<= np.uint64(21)
        out |= wide[j : len(wide) - n + 1 + j]
    return out


def _slots(keys: np.ndarray, n: int) -> np.ndarray:
    odd = np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    return (keys * odd) >> np.uint64(64 - TABLE_BITS)


class LanguageModel:
    """The dictionary, the landmarks' gram sets and the weights; small, and the same size for any corpus."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], landmarks: np.ndarray, project: np.ndarray, weights: np.ndarray, least: float = 0.0):
        self.least = least
        self.languages, self.grams, self.landmarks, self.project, self.weights = languages, grams, landmarks, project, weights
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def tables(self):
        if self._tables is None:
            self._tables, start = [], 0
            for n, keys in zip(SIZES, self.grams, strict=True):
                held, place = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
                at = _slots(keys, n)
                held[at], place[at] = keys, np.arange(start, start + len(keys))
                self._tables.append((held, place))
                start += len(keys)
        return self._tables

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows of 0 and 1 over the dictionary, scaled per n so that a matrix product gives the kernel."""
        width = sum(map(len, self.grams))
        x = np.zeros((len(texts), width), np.float32)
        for row, codes in zip(x, texts, strict=True):
            for (held, place), n in zip(self.tables(), SIZES, strict=True):
                keys = gram_keys(codes, n)
                at = _slots(keys, n)
                row[place[at[held[at] == keys]]] = 1
        return scaled(x, self.grams)

    def known(self, codes: np.ndarray) -> float:
        """The share of the text's 3-grams, repeats included, that the dictionary has; 0 if there is none."""
        held, _ = self.tables()[-1]
        keys = gram_keys(codes, SIZES[-1])
        return float((held[_slots(keys, SIZES[-1])] == keys).mean()) if len(keys) else 0.0

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        kernel = self.presence(texts) @ self.landmarks.T
        features = kernel @ self.project
        return features @ self.weights[:-1] + self.weights[-1]


def scaled(x: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    start = 0
    for keys in grams:
        part = x[:, start : start + len(keys)]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(SIZES))
        start += len(keys)
    return x


def _dictionary(sets: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Per n, the n-grams of two or more landmarks, most frequent first, at most a third of MAX_GRAMS each."""
    out = []
    for k, n in enumerate(SIZES):
        keys, counts = np.unique(np.concatenate([s[k] for s in sets]), return_counts=True)
        if (counts > 1).any():
            keys, counts = keys[counts > 1], counts[counts > 1]
        keys = keys[np.lexsort((keys, -counts))]
        _, first = np.unique(_slots(keys, n), return_index=True)
        out.append(keys[np.sort(first)][: MAX_GRAMS // len(SIZES)])
    return out


def solve(languages: list[str], sets: list[list[np.ndarray]]) -> LanguageModel:
    """Fit from the gram sets (one array per n) of labelled texts; the first LANDMARKS of them are the landmarks."""
    names = sorted(set(languages))
    grams = _dictionary(sets[:LANDMARKS])
    x = np.zeros((len(sets), sum(map(len, grams))), np.float32)
    for row, one in zip(x, sets, strict=True):
        row[:] = np.concatenate([np.isin(g, s) for g, s in zip(grams, one, strict=True)])
    x = scaled(x, grams)
    landmarks = x[:LANDMARKS].copy()
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    kept = values > 1e-6 * values[-1]
    project = vectors[:, kept] / np.sqrt(values[kept])
    z = np.hstack([(x @ landmarks.T) @ project, np.ones((len(x), 1))])
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    return LanguageModel(names, grams, landmarks, project.astype(np.float32), weights.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(labelled: DataFrame, size: int) -> DataFrame:
    """At most `size` ids. The r-th smallest hash of a language with c rows is near r / c, so hash times c takes
    about the same number from each language, and all of a rare one."""
    share = F.xxhash64("doc_id", F.lit("sample")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    rank = (share * F.col("rows")).alias("rank")
    return labelled.join(counts, "lang").select("doc_id", "lang", rank).orderBy("rank", "doc_id").limit(size)


def _grams(text: bytes) -> list[np.ndarray]:
    """The text's distinct n-grams for each n, and how often each of the longest ones occurs."""
    codes = code_points(text)
    sets = [np.unique(gram_keys(codes, n), return_counts=True) for n in SIZES]
    return [keys for keys, _ in sets] + [sets[-1][1]]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) of the labelled rows in their order -> the model, pickled; no row if no text has a letter."""
    known = []
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            grams = _grams(text.as_py() or b"")
            if len(grams[0]):
                known.append((lang.as_py(), grams))
    if known:
        model = solve([lang for lang, _ in known], [g[: len(SIZES)] for _, g in known])
        shares = [g[-1][np.isin(g[-2], model.grams[-1])].sum() / g[-1].sum() for _, g in known if len(g[-1])]
        model.least = SLACK * float(np.quantile(shares, QUANTILE)) if shares else 0.0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def fit(documents: DataFrame, size: int = SAMPLE) -> LanguageModel | None:
    """A model from the labelled documents that are not held out; None if there are none.

    One task reads the texts of the sample, one by one, and hands back the model alone, which has the same size for any
    corpus. Of several texts of one id and language that with the smallest hash counts.
    """
    small_batches(documents.sparkSession, 4 << 20)
    labelled = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    picked = _sample(labelled.select("doc_id", "lang"), size)
    texts = (
        labelled.select("doc_id", "lang", F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(picked.distinct()), ["doc_id", "lang"])  # at most `size` ids
        .groupBy("rank", "doc_id", "lang")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    ordered = texts.repartition(1).sortWithinPartitions("rank", "doc_id", "lang").select("lang", "text")
    made = ordered.mapInArrow(_solved, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


def predictor(model: LanguageModel | None):
    """A column function: text as binary -> struct(lang, score, known); `known` is whether the text is in a learned language."""

    def predict(text: pa.Array) -> pa.Array:
        langs, scores, known, step = [], [], [], 128
        for start in range(0, len(text), step):
            texts = [code_points(t or b"") for t in text[start : start + step].to_pylist()]
            if model is None:
                langs += [UNDETERMINED] * len(texts)
                scores += [0.0] * len(texts)
                known += [False] * len(texts)
                continue
            found = model.scores(texts)
            best = found.argmax(1)
            for codes, b, f in zip(texts, best, found, strict=True):
                langs.append(model.languages[b] if len(codes) else UNDETERMINED)
                scores.append(float(np.clip((f[b] + 1) / 2, 0, 1)) if len(codes) else 0.0)
                share = model.known(codes)
                known.append(share > 0 and share >= model.least)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], ["lang", "score", "known"])

    # Not deterministic, so that a filter on the answer does not make Spark ask twice.
    return F.arrow_udf(predict, "struct<lang string, score double, known boolean>").asNondeterministic()


def identified(documents: DataFrame, model: LanguageModel | None = None, out: str = "language") -> DataFrame:
    """`documents` with a struct of the predicted language and its score; fits on the documents if no model is given."""
    model = model or fit(documents)
    return documents.withColumn(out, predictor(model)(F.col("text").cast("binary")))


def language_report(documents: DataFrame) -> DataFrame:
    rows = identified(documents.select("doc_id", "text", "lang"))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents in a language that was learned, with the columns they came with."""
    model = fit(documents)
    rows = documents.select(F.struct("*").alias("row"), predictor(model)(F.col("text").cast("binary")).alias("found"))
    return rows.where((F.col("found.lang") != UNDETERMINED) & F.col("found.known")).select("row.*")
