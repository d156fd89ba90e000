"""Collocations: phrases of two to five words that stand together more often than their parts would by chance.

Everything is counted per language. Only the longest windows are counted from the text: each word of a piece with the
four that follow it, padded with nulls at the piece's end. The counts of shorter phrases are the sums of the windows that
begin with them, which Spark's ROLLUP makes of the counted windows.

1. Words are counted. A word's code is its rank if it is one of the CODES most frequent, else a hash; the hashes are
   checked to differ for all words, and drawn anew if they do not, so codes stand for words exactly.
2. A phrase is no more frequent than its words or its beginnings. Windows therefore end before a word that is rarer than
   MIN (a bitmap of fixed size tells; where very many words are frequent it lets rare ones pass, which costs time and
   changes nothing), and, once counted, before a word with which the beginning is rarer than MIN.
3. Windows are dealt by their first two words, so that beginnings are summed where the windows are. Pairs of words that
   each make more than 1/HOT of the corpus are dealt by the task they come from as well and left to the ROLLUP whole.
4. Each candidate is cut in all ways; its parts are at least as frequent as it is and so are in the same table. The cut
   with the lowest score counts. A candidate inside a longer one that is (nearly) as frequent is dropped; as frequencies
   only fall with length, it is enough to look one word further.

Null texts have no words, a null language is 'und'. Repeated rows count again. Pieces of any length are cut into rows of
CHUNK windows. No row, text or phrase is sampled or capped; `top` is the length of the report. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import bounded, discard, small_batches, staged
from seqloom.operators.skew import spread_lookup

LONGEST = 5
MIN = 100
TOP = 2000
RANK_BITS = 19
CODES = (1 << RANK_BITS) - 1
FILTER_BITS = 1 << 24
HOT = 256
SALTS = 32
CHUNK = 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
W = [f"w{k}" for k in range(1, LONGEST + 1)]
_SIGN = -(1 << 63)


def word_lists(documents: DataFrame) -> DataFrame:
    """(lang, ws): the words of each piece of each text, A-Z in lower case."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    piece = F.explode(F.split(text, r"[.,;:!?\n-\r]")).alias("piece")
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), piece)
    return rows.select("lang", F.array_remove(F.split("piece", r"[ \t]+"), "").alias("ws")).where(F.size("ws") > 0)


def _hash(lang: str, word: Column, seed: int) -> Column:
    """A negative long, so that it is never a rank."""
    return F.xxhash64(lang, word, F.lit(seed)).bitwiseOR(F.lit(_SIGN))


def vocabulary(lists: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, f, h) of all words, and the seed with which all h differ."""
    words = staged(lists.select("lang", F.explode("ws").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("f")), "words")
    seed = 0
    while True:
        coded = words.withColumn("h", _hash("lang", F.col("word"), seed))
        if coded.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return coded, seed
        seed += 1


class Coder:
    """Arrays of hashes -> arrays of codes; 0 for words that are surely too rare. Of fixed size for any corpus."""

    def __init__(self, top: np.ndarray, slots: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(top)
        self.top = top[self.order]
        self.bitmap = np.zeros(FILTER_BITS >> 6, np.int64)
        self.bitmap[slots] = bits

    def __call__(self, hashes: pa.Array) -> pa.Array:
        h = hashes.flatten().to_numpy(zero_copy_only=False)
        place = h & (64 * len(self.bitmap) - 1)
        held = (self.bitmap[place >> 6] >> (place & 63)) & 1 != 0
        codes = np.where(held, h, 0)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
            codes = np.where(self.top[at] == h, self.order[at] + 1, codes)
        offsets = hashes.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(codes))


def _coder(frequent: DataFrame, top: pa.Table) -> Coder:
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = frequent.groupBy(F.shiftright(place, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    return Coder(top["h"].to_numpy(), words["slot"].to_numpy(), words["bits"].to_numpy())


def windows(lists: DataFrame, coder: Coder, seed: int) -> DataFrame:
    """(w1..w5) of each word that may begin a phrase: its code and those that follow, null from the first rare word on."""
    code = F.arrow_udf(lambda h: coder(h), "array<long>")
    ids = lists.where(F.size("ws") > 1).select(code(F.transform("ws", lambda x: _hash("lang", x, seed))).alias("ids"))
    n = F.size("ids")
    begins = F.sequence(F.lit(0), n - 1, F.lit(CHUNK))
    cut = F.transform(begins, lambda s: F.struct(F.slice("ids", s + 1, F.lit(CHUNK + LONGEST - 1)).alias("c"), F.least(F.lit(CHUNK), n - s).alias("own")))
    chunks = ids.select(F.explode(cut).alias("x")).select("x.c", "x.own")
    rows = chunks.select("c", "own", F.posexplode("c").alias("i", "w1")).where("i < own and w1 <> 0")
    rows = rows.select("w1", *[F.nullif(F.get("c", F.col("i") + k), F.lit(0).cast("long")).alias(W[k]) for k in range(1, LONGEST)])
    for k in range(2, LONGEST):
        rows = rows.withColumn(W[k], F.when(F.col(W[k - 1]).isNotNull(), F.col(W[k])))
    return rows.where("w2 is not null")


def _packed(rows: DataFrame) -> DataFrame:
    """(head, tail, wide) of each window: two numbers where all its words are ranks, which is most of a shuffle's bytes;
    the codes as they are (`wide`) elsewhere. Equal first words have equal heads."""
    small = lambda w: F.coalesce(F.col(w).between(1, (1 << RANK_BITS) - 1), F.lit(True))
    place = lambda w, k: F.call_function("shiftleft", F.coalesce(w, F.lit(0).cast("long")), F.lit(k * RANK_BITS))
    first = small("w1") & small("w2")
    head = F.when(first, place("w1", 1) + F.col("w2")).otherwise(F.xxhash64("w1", "w2").bitwiseOR(F.lit(_SIGN)))
    fits = first & small("w3") & small("w4") & small("w5")
    tail = F.when(fits, place("w3", 2) + place("w4", 1) + place("w5", 0)).otherwise(F.lit(0).cast("long"))
    return rows.select(head.alias("head"), tail.alias("tail"), F.when(~fits, F.array(*W)).alias("wide"), *[c for c in rows.columns if c not in W])


def _unpacked(rows: DataFrame) -> DataFrame:
    part = lambda c, k: F.nullif(F.shiftright(c, k * RANK_BITS).bitwiseAND(F.lit((1 << RANK_BITS) - 1).cast("long")), F.lit(0).cast("long"))
    packed = [part("head", 1), part("head", 0), part("tail", 2), part("tail", 1), part("tail", 0)]
    codes = [F.when(F.col("wide").isNull(), c).otherwise(F.get("wide", k)).alias(W[k]) for k, c in enumerate(packed)]
    return rows.select(*[c for c in rows.columns if c not in ("tail", "wide")], *codes)


def grams(rows: DataFrame, hot: int, least: int = MIN) -> DataFrame:
    """(key, f) of all phrases of two words and more that occur `least` times or more; key is the array of their codes.

    `hot` is the number of the most frequent words whose pairs may be too many for one task.
    """
    is_hot = F.col("w1").between(1, hot) & F.col("w2").between(1, hot)
    salt = F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    dealt = _unpacked(_packed(rows.withColumn("salt", salt)).repartition("salt", "head"))
    counted = dealt.groupBy("salt", "head", *W).agg(F.count("*").alias("n"))
    for k in range(LONGEST - 1, 1, -1):
        counted = counted.withColumn(f"c{k}", F.sum("n").over(Window.partitionBy("salt", "head", *W[:k])))
    kept = counted.where((F.col("salt") > 0) | (F.col("c2") >= least))
    for k in range(3, LONGEST + 1):
        times = F.col(f"c{k}" if k < LONGEST else "n")
        kept = kept.withColumn(W[k - 1], F.when((F.col("salt") > 0) | (times >= least), F.col(W[k - 1])))
    sums = kept.rollup(*W).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")).where(F.col("f") >= least)
    whole = F.lit(False)
    for k in range(2, LONGEST + 1):  # the last LONGEST - k columns are rolled up, and the phrase is not padded
        whole = whole | ((F.col("level") == (1 << (LONGEST - k)) - 1) & F.col(W[k - 1]).isNotNull())
    return sums.where(whole).select(F.array_compact(F.array(*W)).alias("key"), "f")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(key, a, and per cut k: l_k, r_k) of each phrase; `phrases` and `words` (code, f) are written tables."""
    size = F.size("key")
    sides = F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("key", F.lit(1), k).alias("part")),
            F.struct(k.alias("k"), F.lit(1).alias("side"), F.slice("key", k + 1, size - k).alias("part")),
        ),
    )
    needs = phrases.select("key", F.col("f").alias("a"), F.explode(F.flatten(sides)).alias("x")).select("key", "a", "x.*")
    every = phrases.unionByName(words.select(F.array("code").alias("key"), "f")).withColumnRenamed("key", "part")
    facts = staged(every.join(needs.groupBy("part").agg(F.count("*").alias("uses")), "part"), "parts")
    found = spread_lookup(needs, facts, ["part"], "uses", "key")
    sums = []
    for k in range(1, LONGEST):
        for side, name in ((0, "l"), (1, "r")):
            sums.append(F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{name}{k}"))
    return found.groupBy("key", "a").agg(*sums)


def _weakest(n: Column) -> Column:
    """struct(score, k, l, r) of the cut with the lowest score, the first of equals. Products stay below 38 digits."""
    big = "decimal(38,0)"
    cuts = []
    for k in range(1, LONGEST):
        left, right = F.col(f"l{k}"), F.col(f"r{k}")
        top = (F.lit(1000) * F.col("a")).cast(big) * n.cast(big)
        score = F.call_function("div", top.cast(big), (left.cast(big) * right.cast(big)).cast(big))
        cuts.append(F.when(left.isNotNull(), F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def uncovered(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """The phrases that are in no longer one with at least `percent` of their frequency."""
    size = F.size("key")
    inner = F.array(F.slice("key", F.lit(1), size - 1), F.slice("key", F.lit(2), size - 1))
    longer = phrases.where(size > 2).select(F.explode(inner).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    return phrases.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f"))).drop("longer")


def collocations(documents: DataFrame, least: int = MIN, top: int = TOP, percent: int = 100) -> DataFrame:
    """Per language its first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = documents.sparkSession
    small_batches(spark, 4 << 20)
    lists = word_lists(documents)
    vocab, seed = vocabulary(lists)
    totals = vocab.groupBy("lang").agg(F.sum("f").alias("n"))
    total = vocab.agg(F.sum("f")).first()[0] or 0
    frequent = vocab.where(F.col("f") >= least)
    first = frequent.orderBy(F.desc("f"), "lang", "word").limit(CODES).select("h", "f").toArrow()
    hot = int((first["f"].to_numpy() > total / HOT).sum())
    ranks = spark.createDataFrame(first.select(["h"]).append_column("rank", pa.array(np.arange(1, len(first) + 1))), "h long, rank long")
    words = staged(
        frequent.join(F.broadcast(ranks), "h", "left").select(F.coalesce("rank", "h").alias("code"), "lang", "word", "f"),  # at most CODES rows
        "codes",
    )
    phrases = staged(grams(windows(lists, _coder(frequent, first), seed), hot, least), "phrases")
    cuts = scored(phrases, words)
    kept = uncovered(phrases, percent).select("key").join(cuts, "key")
    spelled = kept.select("key", F.posexplode("key").alias("i", "code")).join(bounded(words).drop("f"), "code")
    spelled = spelled.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("ws"), F.first("lang").alias("lang"))
    spelled = spelled.select("key", "lang", F.array_join("ws.word", " ").alias("phrase"))
    full = kept.join(spelled, "key").join(totals, "lang").withColumn("x", _weakest(F.col("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    full = full.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return full.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
found as (
    select lang, ws[i:i + k - 1] as g, count(*) as f
    from places, (values (1), (2), (3), (4), (5)) as t(k) where i + k - 1 <= len(ws) group by all having count(*) >= {MIN}
),
totals as (select lang, sum(len(ws))::bigint as n from lists group by lang),
candidates as (select lang, g, f as a from found where len(g) > 1),
cuts as (
    select lang, g, a, unnest(range(1, len(g))) as k from candidates
),
scores as (
    select c.lang, c.g, c.a, c.k, x.f as l, y.f as r, t.n,
           ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join totals t using (lang)
    join found x on x.lang = c.lang and x.g = c.g[1:c.k] join found y on y.lang = c.lang and y.g = c.g[c.k + 1:len(c.g)]
),
weakest as (
    select * from scores qualify row_number() over (partition by lang, g order by score, k) = 1
),
inside as (
    select lang, longer, g[i:i + k - 1] as g
    from (select lang, a as longer, g, k, unnest(range(1, len(g) - k + 2)) as i from candidates, (values (2), (3), (4)) as t(k) where k < len(g))
),
kept as (
    select w.*, array_to_string(w.g, ' ') as phrase from weakest w
    where not exists (select 1 from inside i where i.lang = w.lang and i.g = w.g and 100 * i.longer >= 100 * w.a)
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept qualify rank <= {TOP}
"""
