"""Conversations put into the form (system? (user assistant)+)? by the cheapest edits; the edits are found in `edits`.

Keep costs 0, rerole 3, delete 4, insert 3; a kept or reroled turn whose text is cut off costs 3 more. Turns without a
visible character and turns whose role and text occurred earlier in the conversation must be deleted.

1. Equal turns (conversation, turn, role, text) become one row with their number; which of them is the first of its role
   and text is told by a minimum per (conversation, role and text), looked up through copies where many turns are equal.
2. Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any size is spread over tasks in
   order. A task repairs the conversations that lie inside it, one at a time. Of those that begin or end it, or hold more
   than OPEN_BYTES of text, it writes the rows and, per task, the symbols with their effect on every cost vector.
3. The effects of a conversation's parts are composed from the last to the first (one small row per part), then states
   from the first to the last; then every part's edits are known on their own.
4. The digest of a repaired conversation is one hash over its lines in order, which cannot be split: the lines of an open
   conversation pass through one task, streamed in order, of which only the current row is held.

Nulls are one space, in texts, roles and for naming a conversation; a null turn comes first and counts for no gap. Rows of
one turn are in the order of role and text. A role's initial is its first character; an empty role has none, and stands
nowhere. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, staged
from seqloom.llm.edits import GONE, NEXT_ROLE, NEXT_STATE, START, symbol, tables
from seqloom.operators.skew import spread_lookup

OPEN_BYTES = 4 << 20
VISIBLE = r"[^ \t-\r]"
LEGAL = ("su", "ua", "au")
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with faults put into them by crc32(conv_id:turn) % 20."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.coalesce("role", space))
    rows = conversations.select("conv_id", "turn", "role", "text", fault.alias("_fault")).where("_fault <> 0")
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def judged(turns: DataFrame) -> DataFrame:
    """Distinct turns: conv (the conversation's name), conv_id, turn, role, text, m (how many), blank, first, cut_off."""
    space = F.lit(" ")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), space).alias("conv"), "conv_id", "turn",
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    rows = rows.groupBy("conv", "conv_id", "turn", "role", "text").agg(F.count("*").alias("m"))
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    facts = rows.groupBy("conv", "said").agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_uses"))
    found = spread_lookup(rows, facts, ["conv", "said"], "_uses", "turn")
    return found.select(
        "conv", "conv_id", "turn", "role", "text", "m",
        (~F.col("text").rlike(VISIBLE)).alias("blank"),
        F.struct("turn").eqNullSafe(F.col("_first")).alias("first"),
        (~F.col("text").rlike(r"[.!?][ \t-\r]*\z")).alias("cut_off"),
    )


class _Part:
    """What one task has seen of one conversation: counts, symbols, and what its neighbours in order need to know."""

    def __init__(self, conv, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.counts = dict.fromkeys(COUNTS, 0)
        self.runs: list[tuple[int, int]] = []
        self.head = self.tail = None  # initials
        self.low = self.high = self.last_turn = self.first_turn = None
        self.turns = 0
        self.rows: list[tuple[str, str, int]] | None = []
        self.size = self.n = 0

    def add(self, turn, role, text, m, blank, first, cut_off) -> None:
        own = first and not blank
        self.counts["blank"] += m * blank
        self.counts["duplicate"] += (m - first) * (not blank)
        self.counts["truncated"] += own and cut_off
        if own:
            self.runs.append((symbol(role[:1], cut_off), 1))
        if m > own:
            self.runs.append((GONE, m - own))
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += m - 1
        self.tail = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn

    def symbols(self) -> np.ndarray:
        if not self.runs:
            return np.empty(0, np.uint8)
        values, times = np.array(self.runs, np.int64).T
        return np.repeat(values.astype(np.uint8), times)


class Lines:
    """The repaired turns of a conversation, row by row, from the letters of its edits."""

    def __init__(self, state: int = START):
        self.state, self.at, self.letters = state, 0, ""

    def more(self, letters: str) -> None:
        self.letters, self.at = self.letters[self.at :] + letters, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            yield NEXT_ROLE[self.state], ""
            self.state = NEXT_STATE[self.state]

    def row(self, role: str, text: str, m: int) -> Iterator[tuple[str, str]]:
        for _ in range(m):
            yield from self.inserted()
            letter = self.letters[self.at]
            self.at += 1
            if letter == "K":
                self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
                yield role, text
            elif letter == "R":
                yield NEXT_ROLE[self.state], text
                self.state = NEXT_STATE[self.state]


class _Digest:
    def __init__(self):
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        if self.begun:
            self.hash.update(b"\n")
        self.begun = True
        self.hash.update(f"{role}:{text}".encode())


_STAT = "gap_low long, gap_high long, gap_turns long, blank long, duplicate long, truncated long, illegal long"
_RESULT = "cost long, audit string, repaired_sha256 string"
_PART = "part int, head string, tail string, symbols binary, left_of array<int>, added array<long>"
_ROW = "seq long, role string, text string, m long"


def _schema(kind: str) -> str:
    return f"kind string, conv string, conv_id {kind}, {_STAT}, {_RESULT}, {_PART}, {_ROW}"


_NAMES = [c.split()[0] for c in _schema("long").split(", ")]


def _segments(schema: pa.Schema, open_bytes: int):
    """The function of one task over its range: closed conversations as results, the others as parts and rows."""

    def stats(p: _Part) -> dict:
        return {"conv": p.conv, "conv_id": p.conv_id, "gap_low": p.low, "gap_high": p.high, "gap_turns": p.turns} | p.counts

    def closed(p: _Part) -> list[dict]:
        cost, audit = tables().repaired(p.symbols())
        lines, digest = Lines(), _Digest()
        lines.more(audit)
        for role, text, m in p.rows:
            for line in lines.row(role, text, m):
                digest.add(*line)
        for line in lines.inserted():
            digest.add(*line)
        return [stats(p) | {"kind": "done", "cost": cost, "audit": audit, "repaired_sha256": digest.hash.hexdigest()}]

    def opened(p: _Part, task: int) -> list[dict]:
        symbols = p.symbols()
        left, added = tables().effect(symbols)
        part = {"kind": "part", "part": task, "head": p.head, "tail": p.tail, "symbols": symbols.tobytes()}
        return [stats(p) | part | {"left_of": left.tolist(), "added": added.tolist()}]

    def flush(p: _Part, task: int) -> list[dict]:
        """The rows held so far, as rows of an open conversation; further ones are not held."""
        rows = [
            {"kind": "row", "conv": p.conv, "part": task, "seq": p.n - len(p.rows) + k, "role": role, "text": text, "m": m}
            for k, (role, text, m) in enumerate(p.rows)
        ]
        p.rows, p.size = [], 0
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: list[dict] = []
        held = 0
        p, border = None, True  # the first conversation of the range may have begun before it

        def ready() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            held = 0
            return batch

        for batch in batches:
            columns = [batch[c] for c in ("conv", "conv_id", "turn", "role", "text", "m", "blank", "first", "cut_off")]
            for i in range(len(batch)):
                conv, conv_id, turn, role, text, m, blank, first, cut_off = (c[i].as_py() for c in columns)
                if p is None or conv != p.conv:
                    if p is not None:
                        out += [*flush(p, task), *opened(p, task)] if border else closed(p)
                        border = False
                    p = _Part(conv, conv_id)
                p.add(turn, role, text, m, blank, first, cut_off)
                p.rows.append((role, text, m))
                p.n += 1
                p.size += len(text)
                held += len(text) + 200
                if border or p.size > open_bytes:
                    border = border or p.size > open_bytes
                    out += flush(p, task)
                if held > open_bytes:
                    yield ready()
        if p is not None:  # the last conversation of the range may go on behind it
            out += [*flush(p, task), *opened(p, task)]
        yield ready()

    return run


def _arrow(df: DataFrame) -> pa.Schema:
    return df.limit(0).toArrow().schema


def _composed(parts: pa.Array) -> pa.Array:
    """Per conversation, its parts' (part, left_of, added) in order -> (cost without edits at its ends, vector to the right of each part)."""
    costs, rights = [], []
    for row in parts.to_pylist():
        v, cost, right = 0, 0, []
        for p in reversed(row):
            right.append(v)
            cost += p["added"][v]
            v = p["left_of"][v]
        costs.append(cost + tables().vectors[v][START])
        rights.append([{"part": p["part"], "right": r} for p, r in zip(row, reversed(right), strict=True)])
    return pa.array([{"cost": c, "rights": r} for c, r in zip(costs, rights, strict=True)], pa.struct([("cost", pa.int64()), ("rights", pa.list_(pa.struct([("part", pa.int32()), ("right", pa.int32())])))]))


def _walks(symbols: pa.Array, right: pa.Array) -> pa.Array:
    """A part's edits and the state after them, for each state it may begin in."""
    out = []
    for s, r in zip(symbols.to_pylist(), right.to_pylist(), strict=True):
        walked = [tables().walk(np.frombuffer(s, np.uint8), r, state) for state in range(4)]
        out.append({"letters": [w[0] for w in walked], "states": [w[1] for w in walked]})
    return pa.array(out, pa.struct([("letters", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))]))


def _entries(parts: pa.Array) -> pa.Array:
    """Per conversation, its parts' (part, states) in order -> (part, state at its begin, edits behind it: none but at the end)."""
    out = []
    for row in parts.to_pylist():
        state, entries = START, []
        for p in row:
            entries.append({"part": p["part"], "state": state, "ending": ""})
            state = p["states"][state]
        entries[-1]["ending"] = tables().ending(state)
        out.append(entries)
    return pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("state", pa.int32()), ("ending", pa.string())])))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, seq, letters or role, text, m) in order -> (conv, repaired_sha256); a part's letters come before its rows."""
    conv, lines, digest, out = None, None, None, []

    def finish():
        for line in lines.inserted():
            digest.add(*line)
        out.append({"conv": conv, "repaired_sha256": digest.hash.hexdigest()})

    for batch in batches:
        columns = [batch[c] for c in ("conv", "letters", "role", "text", "m")]
        for i in range(len(batch)):
            name, letters, role, text, m = (c[i].as_py() for c in columns)
            if name != conv:
                if conv is not None:
                    finish()
                conv, lines, digest = name, Lines(), _Digest()
            if letters is not None:
                lines.more(letters)
                continue
            for line in lines.row(role, text, m):
                digest.add(*line)
    if conv is not None:
        finish()
    yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))


def _gap(low: Column, high: Column, turns: Column) -> Column:
    wide = "decimal(38,0)"
    return F.coalesce((high.cast(wide) - low.cast(wide) + 1 - turns).try_cast("long"), F.lit(0).cast("long"))


def repaired(turns: DataFrame, open_bytes: int = OPEN_BYTES) -> DataFrame:
    """Per conversation that has turns: conv (its name), conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = turns.sparkSession
    small_batches(spark, 4 << 20)
    rows = judged(turns)
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = _arrow(spark.createDataFrame([], _schema(kind)))
    # Ranges by bounded prefixes of role and text: they are sampled to the driver.
    dealt = rows.repartitionByRange("conv", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64))
    ordered = dealt.sortWithinPartitions("conv", "turn", "role", "text")
    table = staged(ordered.mapInArrow(_segments(schema, open_bytes), _schema(kind)), "repairs")

    done = table.where("kind = 'done'").select("conv", "conv_id", _gap(F.col("gap_low"), F.col("gap_high"), F.col("gap_turns")).alias("gaps"), *COUNTS, "cost", "audit", "repaired_sha256")
    parts = table.where("kind = 'part'")
    composed = F.arrow_udf(_composed, "struct<cost long, rights array<struct<part int, right int>>>")
    sides = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "left_of", "added"))).alias("ps"))  # one per task
    sides = staged(sides.select("conv", composed("ps").alias("x")).select("conv", "x.cost", "x.rights"), "composed")
    rights = sides.select("conv", F.explode("rights").alias("x")).select("conv", "x.part", "x.right")
    walks = F.arrow_udf(_walks, "struct<letters array<string>, states array<int>>")
    walked = staged(parts.join(rights, ["conv", "part"]).select("conv", "part", walks("symbols", "right").alias("w")).select("conv", "part", "w.*"), "walked")
    entries = F.arrow_udf(_entries, "array<struct<part int, state int, ending string>>")
    begun = walked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "states"))).alias("ps"))
    begun = begun.select("conv", F.explode(entries("ps")).alias("x")).select("conv", "x.*")
    letters = walked.join(begun, ["conv", "part"]).select("conv", "part", F.concat(F.get("letters", "state"), F.col("ending")).alias("letters"))
    letters = staged(letters, "letters")

    empty = {"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "m": F.lit(None).cast("long")}
    heads = letters.select("conv", "part", F.lit(-1).cast("long").alias("seq"), "letters", *[c.alias(n) for n, c in empty.items()])
    lines = table.where("kind = 'row'").select("conv", "part", "seq", F.lit(None).cast("string").alias("letters"), "role", "text", "m")
    stream = heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    hashes = stream.mapInArrow(_hashed, "conv string, repaired_sha256 string")

    # Neighbouring parts share a border: the initials on both sides of it, and a turn that may lie on both.
    border = F.struct("part", "head", "tail", "gap_low", "gap_high")
    whole = parts.groupBy("conv").agg(
        F.max("conv_id").alias("conv_id"), F.min("gap_low").alias("low"), F.max("gap_high").alias("high"),
        F.sum("gap_turns").alias("turns"), *[F.sum(c).alias(c) for c in COUNTS], F.sort_array(F.collect_list(border)).alias("bs"),
    )
    pairs = F.sequence(F.lit(1), F.size("bs"))
    unlike = F.size(F.filter(pairs, lambda i: ~F.concat(F.get("bs", i - 1).tail, F.get("bs", i).head).isin(*LEGAL)))
    same = F.size(F.filter(pairs, lambda i: F.get("bs", i - 1).gap_high == F.get("bs", i).gap_low))
    audits = letters.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "letters"))).alias("ls")).select("conv", F.array_join("ls.letters", "").alias("audit"))
    opened = (
        whole.join(sides.select("conv", "cost"), "conv")
        .join(audits, "conv")
        .join(hashes, "conv")
        .select(
            "conv", "conv_id", _gap(F.col("low"), F.col("high"), F.col("turns") - same).alias("gaps"), "blank", "duplicate", "truncated",
            (F.col("illegal") + unlike).alias("illegal"), "cost", "audit", "repaired_sha256",
        )
    )
    return done.unionByName(opened)


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and reports on every one, also those left without turns."""
    found = repaired(damaged(conversations)).drop("conv_id")
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    both = ids.join(found, "conv", "left")
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))


def _sql() -> str:
    """The same as a recursion over turns from the last to the first: for each state the cheapest cost, the least edits
    and the lines they give."""

    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def edit(letter: str, cost: str, state: int, line: str | None, source: str = "t") -> str:
        lines = f"list_prepend({line}, {source}.s{state}.o)" if line else f"{source}.s{state}.o"
        return f"{{'c': {cost} + {source}.s{state}.c, 'a': '{letter}' || {source}.s{state}.a, 'o': {lines}}}"

    never = "{'c': 1000000000::bigint, 'a': '', 'o': []::varchar[]}"

    def turn(q: int) -> str:
        after = NEXT_STATE[q]
        delete = edit("D", "4", q, None)
        rerole = f"case when r.gone then {never} else " + edit("R", "3 + r.extra", after, f"'{NEXT_ROLE[q]}:' || r.text") + " end"
        kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        keeps = [f"case when r.gone or r.initial <> '{k}' then {never} else " + edit("K", "r.extra", to, "r.role || ':' || r.text") + " end" for k, to in kept.items()]
        return best(delete, rerole, *keeps)

    def inserted(state: int, q: int, source: str) -> str:
        return best(f"{source}.s{q}", edit("I", "3", state, f"'{NEXT_ROLE[q]}:'", source))

    return rf"""
with recursive crc as (
    select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
               lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
),
named as (
    select conv_id, coalesce(conv_id::varchar, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes
    from conversations
),
faults as (
    select conv, turn, role, text,
           xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as fault
    from named, crc
),
turns as (
    select conv, turn, case when fault = 4 then 'user' else role end as role,
           case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(case when fault = 3 then [0, 1] else [0] end) as copy
    from faults where fault <> 0
),
placed as (
    select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as i,
           row_number() over (partition by conv, role, text order by turn nulls first, copy) > 1 as again,
           not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut_off
    from turns
),
judged as (
    select conv, i, turn, role, text, left(role, 1) as initial, blank or again as gone, blank, again and not blank as duplicate,
           cut_off and not blank and not again as truncated, case when cut_off then 3 else 0 end as extra,
           lag(left(role, 1)) over (partition by conv order by i) || left(role, 1) as pair
    from placed
),
counted as (
    select conv, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count_if(blank) as blank,
           count_if(duplicate) as duplicate, count_if(truncated) as truncated, count_if(pair not in ('su', 'ua', 'au')) as illegal
    from judged group by conv
),
paths as (
    select conv, n + 1 as i, {{'c': 0::bigint, 'a': '', 'o': []::varchar[]}} as s0, {{'c': 6::bigint, 'a': 'II', 'o': ['user:', 'assistant:']}} as s1,
           {{'c': 3::bigint, 'a': 'I', 'o': ['assistant:']}} as s2, {{'c': 0::bigint, 'a': '', 'o': []::varchar[]}} as s3
    from counted
    union all
    select conv, i, {inserted(2, 0, "y")}, {inserted(2, 1, "y")}, y.s2, y.s3
    from (
        select conv, i, x.s0, x.s1, {inserted(3, 2, "x")} as s2, {inserted(2, 3, "x")} as s3
        from (
            select r.conv, r.i, {turn(0)} as s0, {turn(1)} as s1, {turn(2)} as s2, {turn(3)} as s3
            from paths t join judged r on r.conv = t.conv and r.i = t.i - 1
        ) x
    ) y
),
ids as (select distinct conv_id, coalesce(conv_id::varchar, ' ') as conv from conversations)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(s0.c, 0)::bigint as cost,
       coalesce(s0.a, '') as audit, sha256(coalesce(array_to_string(s0.o, chr(10)), '')) as repaired_sha256
from ids left join counted using (conv) left join paths on paths.conv = ids.conv and paths.i = 1
"""


REPAIR_SQL = _sql()
