"""Preference pairs as training text: one prompt, two completions, and what of them to train on.

The prompt is the longest common prefix of turns (equal role and text) of the chosen and the rejected conversation,
rendered once; each completion is the rest of its side, rendered in the same way. Spans are the character ranges of a
completion that count for the loss: what the assistant says with its end mark, never role headers or other turns.

All DataFrame functions. A pair is one training example and so one row; both sides of it are gathered in one shuffle by
pair. Turns are ordered by turn, then role and text, so repeated turns keep a fixed order (null turns first); a null or
blank role is 'user', roles are lower case, a null text is empty. If one side is a prefix of the other (or equal, or
empty), its completion is empty. Marks inside a text are spaced out so that they cannot pass for marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bind, words

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _role(role: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(name == "", F.lit("user")).otherwise(name)


def _header(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn.role, F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn.text, F.lit("<|"), F.lit("< |")), F.lit(END))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def spans(turns: Column) -> Column:
    """Character ranges [start, stop) of what the assistant says in render(turns)."""
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))

    def step(state, t):
        start = state.at + F.length(_header(t))
        stop = start + F.length(_body(t))
        span = F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        found = F.when(t.role == "assistant", F.array_append(state.found, span)).otherwise(state.found)
        return F.struct((stop + 1).cast("long").alias("at"), found.alias("found"))

    return F.aggregate(turns, begin, step, lambda s: s.found)


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two arrays have in common from the start."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    apart = F.filter(places, lambda i: (F.get(a, i).role != F.get(b, i).role) | (F.get(a, i).text != F.get(b, i).text))
    return F.coalesce(F.get(apart, 0), n)


def gathered(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): the turns (turn, role, text) of each key in order, as structs of role and text."""
    turn = F.struct("turn", _role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    return turns.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`pairs` with arrays of turns in two columns -> those columns replaced by the completions' texts, with prompt,
    n_prefix_turns, chosen_spans and rejected_spans."""
    a, b = F.col(chosen), F.col(rejected)
    n = F.col("n_prefix_turns")
    rest = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    return pairs.withColumn("n_prefix_turns", common_turns(a, b)).withColumns(
        {
            "prompt": render(F.slice(a, F.lit(1), n)),
            "chosen_spans": spans(rest(a)),
            "rejected_spans": spans(rest(b)),
            chosen: render(rest(a)),
            rejected: render(rest(b)),
        }
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs from two tables of turns (key, turn, role, text); a side without turns is empty."""
    a = gathered(chosen, key).withColumnRenamed("turns", "chosen")
    b = gathered(rejected, key).withColumnRenamed("turns", "rejected")
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = a.join(b, key, "full").withColumn("chosen", F.coalesce("chosen", none)).withColumn("rejected", F.coalesce("rejected", none))
    return formatted(both)


def worsened(turns: Column) -> Column:
    """A rejected variant of a conversation: its last answer becomes the answer before it, said again, or, if there is
    none or it is the same, the first half of its own words. Without an answer nothing changes."""
    places = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.get(turns, i - 1).role == "assistant")

    def replaced(at):
        last = F.get(at, F.size(at) - 1)
        text = F.get(turns, last - 1).text
        before = F.get(turns, F.get(at, F.size(at) - 2) - 1).text
        half = bind(words(text), lambda w: F.array_join(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), " "))
        worse = F.when(before.isNull() | (before == text), half).otherwise(before)
        return F.transform(turns, lambda t, i: F.struct(t.role.alias("role"), F.when(i + 1 == last, worse).otherwise(t.text).alias("text")))

    return bind(places, replaced)


def _shown(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat(x.start.cast("string"), F.lit("-"), x.stop.cast("string"))), " ")


def chat_report(conversations: DataFrame) -> DataFrame:
    """One row per conversation: it is the chosen side, its worsened variant the rejected one."""
    pairs = gathered(conversations.select("conv_id", "turn", "role", "text"), "conv_id").withColumn("rejected", worsened(F.col("turns")))
    return formatted(pairs.withColumnRenamed("turns", "chosen")).select(
        "conv_id",
        F.col("n_prefix_turns").cast("long").alias("n_prefix_turns"),
        "prompt",
        "chosen",
        "rejected",
        _shown(F.col("chosen_spans")).alias("chosen_spans"),
        _shown(F.col("rejected_spans")).alias("rejected_spans"),
    )


CHAT_SQL = f"""
with turns as (
    select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, role, text
    from (select conv_id, turn, coalesce(nullif(lower(trim(role)), ''), 'user') as role, coalesce(text, '') as text from conversations)
),
answers as (
    select conv_id, i, text, lag(text) over (partition by conv_id order by i) as earlier,
           row_number() over (partition by conv_id order by i desc) as back
    from turns where role = 'assistant'
),
worse as (
    select conv_id, i,
           case when earlier is null or earlier = text
                then coalesce(array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) // 2], ' '), '')
                else earlier end as text
    from answers where back = 1
),
both_sides as (
    select t.conv_id, t.i, t.role, t.text as a, coalesce(w.text, t.text) as b from turns t left join worse w using (conv_id, i)
),
marked as (
    select *, coalesce(min(case when a <> b then i end) over (partition by conv_id), count(*) over (partition by conv_id) + 1) - 1 as n,
           '{BEGIN}' || role || chr(10) as head, replace(a, '<|', '< |') || '{END}' as ta, replace(b, '<|', '< |') || '{END}' as tb
    from both_sides
),
placed as (
    select *, coalesce(sum(case when i > n then length(head) + length(ta) + 1 else 0 end) over before, 0) as at_a,
           coalesce(sum(case when i > n then length(head) + length(tb) + 1 else 0 end) over before, 0) as at_b
    from marked window before as (partition by conv_id order by i rows between unbounded preceding and 1 preceding)
)
select conv_id, max(n)::bigint as n_prefix_turns,
       coalesce(string_agg(case when i <= n then head || ta || chr(10) end, '' order by i), '') as prompt,
       coalesce(string_agg(case when i > n then head || ta || chr(10) end, '' order by i), '') as chosen,
       coalesce(string_agg(case when i > n then head || tb || chr(10) end, '' order by i), '') as rejected,
       coalesce(string_agg(case when i > n and role = 'assistant' then (at_a + length(head)) || '-' || (at_a + length(head) + length(ta)) end, ' ' order by i), '') as chosen_spans,
       coalesce(string_agg(case when i > n and role = 'assistant' then (at_b + length(head)) || '-' || (at_b + length(head) + length(tb)) end, ' ' order by i), '') as rejected_spans
from placed group by conv_id
"""
