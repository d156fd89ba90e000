"""Quality rules as a ledger: measure each text once, keep one failure bit per rule, decide by policy afterwards.

The ledger row of a text holds the measurements and `failures`, a long whose bit b is set if the rule at place b of
RULES failed. A policy is a version and a mask of rules that reject, so a new policy or an ablation reads the ledger
and never a text. Everything is DataFrame functions; nothing is shuffled.

A null or empty text has no words: it measures zero everywhere and fails `few_words`. Lines without a word count
for nothing. Repeated rows are judged alike and all kept; columns of the input are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import GAP, bind, words

#: Rule name, and whether a text with measurements m (a struct) fails it. The place in the list is the bit.
RULES = [
    ("few_words", lambda m: m.n_words < 50),
    ("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    ("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    ("capitals", lambda m: 2 * m.n_upper > m.word_chars),
    ("duplicate_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
    ("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)),
]
BIT = {name: 1 << b for b, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Version of a policy, and the rules that reject under it.
POLICIES = {
    "1": BASE,
    "2": BASE | mask("symbols", "capitals"),
    "3": BASE | mask("symbols", "capitals", "duplicate_lines", "word_length"),
}
CURRENT = "3"


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text.

    Each window becomes one long: as many bits of its hash as the text's length leaves free, then its place. Sorted,
    windows that may be equal are neighbours; the words of neighbours are compared, so different windows never count.
    Equal windows whose hash is shared by a third one may stand one further apart; two steps are looked at.
    """
    windows = F.size(w) - 2
    bits = F.length(F.bin(windows))

    def packed(i):
        h = F.xxhash64(w[i], w[i + 1], w[i + 2])
        return F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))

    def key(x):
        return F.call_function("shiftright", x, bits)

    def place(x):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        return x.bitwiseAND(low).cast("int")

    def same(x, y):
        words = [F.get(w, place(x) + k) == F.get(w, place(y) + k) for k in range(3)]
        return F.coalesce((key(x) == key(y)) & words[0] & words[1] & words[2], F.lit(False))

    def places(p):
        twice = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)) | same(x, F.get(p, i - 2)) | same(x, F.get(p, i + 2)))
        return F.sort_array(F.transform(twice, place))

    def covered(at):
        steps = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = bind(bind(F.sort_array(F.transform(F.sequence(F.lit(0), windows - 1), packed)), places), covered)
    return F.when(windows < 2, F.lit(0).cast("long")).otherwise(found)


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def rest(pattern):
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def measured(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            rest(GAP).alias("word_chars"),
            rest(r"[^#*$%&|<>]+").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            rest(r"\P{Lu}+").alias("n_upper"),
        )

    return bind(words(text), measured)


def failures(m: Column) -> Column:
    bits = [F.when(rule(m), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, (_, rule) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(df: DataFrame, text: str = "text", measures: str = "measures", bits: str = "failures") -> DataFrame:
    """`df` with the struct of measurements and the failure bits of each row."""
    return df.withColumn(measures, measurements(F.col(text))).withColumn(bits, failures(F.col(measures)))


def passes(bits: Column, version: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0


def ablation(df: DataFrame, bits: str = "failures") -> DataFrame:
    """Per policy and rule of it: rows the policy rejects, rows this rule fails, rows only this rule rejects.

    Rows are first counted by their failure bits (at most 2**len(RULES) groups), then read bitwise.
    """
    groups = df.groupBy(F.col(bits).alias("bits")).agg(F.count("*").alias("n"))
    cases = F.array(
        *[
            F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
            for v, m in POLICIES.items()
            for r in BIT
            if m & BIT[r]
        ]
    )
    hit = F.col("bits").bitwiseAND(F.col("c.mask"))
    return (
        groups.select("bits", "n", F.explode(cases).alias("c"))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(hit == F.col("c.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        )
    )


def quality_report(documents: DataFrame) -> DataFrame:
    """One row per document: the measurements, the base verdict and the current policy's verdict."""
    row = ledger(documents.select("doc_id", "text"))
    m = F.col("measures")
    return row.select(
        "doc_id",
        m.n_words.alias("n_words"),
        m.word_chars.alias("word_chars"),
        m.n_symbols.alias("n_symbols"),
        m.n_dup_lines.alias("n_dup_lines"),
        m.n_repeat_words.alias("n_repeat_words"),
        (F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed"),
        passes(F.col("failures")).alias("kept"),
        F.col("failures").alias("failure_bits"),
    )


def keep_good(documents: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents the policy passes, with the columns they came with."""
    rows = documents.select(F.struct("*").alias("row"), measurements(F.col("text")).alias("m"))
    return rows.where(passes(failures(F.col("m")), version)).select("row.*")


QUALITY_SQL = """
with words as (
    select doc_id, coalesce(text, '') as text, row_number() over () as row_id,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws
    from documents
),
places as (
    select row_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from words
),
windows as (
    select row_id, i, count(*) over (partition by row_id, ws[i], ws[i + 1], ws[i + 2]) as times from places
),
covered as (
    select row_id, count(distinct i + k) as n_repeat_words
    from windows, (values (0), (1), (2)) as t(k)
    where times > 1 group by row_id
),
lines as (
    select row_id, unnest(string_split(text, chr(10))) as line from words
),
line_counts as (
    select row_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row_id
),
measured as (
    select doc_id, len(ws)::bigint as n_words,
           length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
           length(regexp_replace(text, '\\P{Lu}+', '', 'g'))::bigint as n_upper,
           coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
           coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from words left join covered using (row_id) left join line_counts using (row_id)
),
judged as (
    select *, (case when n_words < 50 then 1 else 0 end
             + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
             + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
             + case when 2 * n_upper > word_chars then 8 else 0 end
             + case when 2 * n_dup_lines > n_lines then 16 else 0 end
             + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 32 else 0 end)::bigint as failure_bits
    from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failure_bits % 4 <> 0 as base_failed, failure_bits = 0 as kept, failure_bits
from judged
"""
