"""Mixing sources to target weights: a token budget flows down a tree, leaves are filled from seeded epochs.

The tree's levels are columns (domain, language, source). A node's capacity is what its leaves hold times the largest
number of epochs. A budget is split among siblings by weight, no node above its capacity; what one cannot take is
shared by its siblings in proportion to their weights, and because capacities are summed up the tree, only what a whole
family cannot take reaches its parent's siblings. The split is closed: sorted by capacity over weight, the full nodes
are a prefix, so running sums give the level without iteration. Whole numbers throughout.

A leaf with a allotted of b available tokens is taken a // b times in full, then a prefix of the next epoch: documents
in the order of md5(seed:epoch:doc_id), while their running sum of tokens stays within the rest. Running sums are two
deep (4,096 hash ranges per leaf, then one range), so no leaf is gathered in one task.

Everything is DataFrame functions. Null level values count as 'unknown'; null texts have 0 tokens; equal ids are
ordered as one (all in or all out); an empty table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import bounded, staged, words

DOMAIN_WEIGHTS = {"group0": 4, "group1": 3, "group2": 2, "group3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 1}
SEED, MAX_EPOCHS, BUDGET_PERCENT = 17, 2, 60
BUCKET_DIGITS = 3  # hex digits of the order key that name a hash range


def domain_of(source: Column) -> Column:
    """Sources are numbered; their number modulo 4 names the domain."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("group"), (number.cast("int") % 4).cast("string")))


def weight_of(level: Column, weights: dict[str, int]) -> Column:
    """A node's weight; 1 where none is given."""
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(level == name, F.lit(w).cast("long")).otherwise(out)
    return out


def split(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Give each child (capacity, weight) its share of `budget`, which all children of a parent carry alike."""
    family = Window.partitionBy(*parent)
    order = family.orderBy(F.col("capacity") / F.col("weight"), F.col(node))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = children.withColumn("full", F.col("capacity") * F.sum("weight").over(onward) <= left * F.col("weight"))
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family)
    weights = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family)
    shared = full.withColumn("taken", taken).withColumn("weights", weights)
    return shared.withColumn(
        "budget", F.expr("CASE WHEN full THEN capacity ELSE ((budget - taken) * weight) DIV weights END")
    ).drop("full", "taken", "weights")


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """Per leaf: its available tokens and its budget. `leaves` has the levels and `available`."""
    nodes = leaves.withColumn("capacity", F.col("available") * max_epochs)
    parents = nodes.agg((F.coalesce(F.sum("available"), F.lit(0)) * percent / 100).cast("long").alias("budget"))
    for depth, node in enumerate(levels):
        path = levels[: depth + 1]
        level = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
        level = level.withColumn("weight", weight_of(F.col(node), weights[depth]))
        level = level.join(parents, path[:-1]) if depth else level.crossJoin(F.broadcast(parents))  # one row
        parents = split(level, path[:-1], node).select(*path, "budget", "available")
        if depth + 1 < len(levels):
            parents = parents.drop("available")
    return parents


def order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(tokens: DataFrame, levels: list[str], weights: list[dict[str, int]], percent: int, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: whole epochs, and the order key up to which the next epoch is taken (null: nothing of it).

    `tokens` has doc_id, the levels and n_tokens; it is read several times, so it should be a written table.
    """
    leaves = tokens.groupBy(*levels).agg(F.sum("n_tokens").alias("available"))
    shares = staged(
        budgets(leaves, levels, weights, percent, max_epochs)
        .withColumn("epochs", F.expr("CASE WHEN available = 0 THEN 0 ELSE budget DIV available END"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available")),
        "shares",
    )
    keyed = (
        tokens.join(bounded(shares.select(*levels, "epochs", "rest")), levels)
        .where("rest > 0")
        .withColumn("order_key", order_key(F.col("epochs"), seed))
        .withColumn("range", F.substring("order_key", 1, BUCKET_DIGITS))
    )
    ranges = keyed.groupBy(*levels, "rest", "range").agg(F.sum("n_tokens").alias("n"), F.max("order_key").alias("last"))
    upto = F.sum("n").over(Window.partitionBy(*levels).orderBy("range"))
    ranges = ranges.withColumn("upto", upto)
    whole = ranges.where("upto <= rest").groupBy(*levels).agg(F.max("last").alias("last"))
    edge = (
        ranges.where("upto > rest and upto - n <= rest")
        .groupBy(*levels)
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("edge"))
    )
    within = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("order_key"))  # equal keys are one step
    inside = (
        keyed.join(edge, levels)
        .where("range = edge.range")
        .withColumn("running", F.col("edge.before") + within)
        .where("running <= rest")
        .groupBy(*levels)
        .agg(F.max("order_key").alias("last"))
    )
    cuts = whole.unionByName(inside).groupBy(*levels).agg(F.max("last").alias("cut"))
    return staged(shares.join(cuts, levels, "left"), "plan")


def _levels(source: Column, lang: Column) -> list[Column]:
    return [
        domain_of(source).alias("_domain"),
        F.coalesce(lang, F.lit("unknown")).alias("_lang"),
        F.coalesce(source, F.lit("unknown")).alias("_source"),
    ]


LEVELS = ["_domain", "_lang", "_source"]


def mixed(
    documents: DataFrame,
    percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    weights: tuple[dict[str, int], ...] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS),
    whole_rows: bool = False,
) -> DataFrame:
    """The chosen documents, one row per epoch they are taken in.

    `percent` is the budget as a share of all tokens (words). With `whole_rows` the rows have the input's columns;
    otherwise doc_id, the levels, n_tokens, epoch and the order key within the epoch.
    """
    tokens = staged(
        documents.select("doc_id", *_levels(F.col("source"), F.col("lang")), F.size(words(F.col("text"))).cast("long").alias("n_tokens")),
        "tokens",
    )
    shares = bounded(plan(tokens, LEVELS, list(weights), percent, max_epochs, seed).select(*LEVELS, "epochs", "cut"))
    if whole_rows:
        names = documents.columns
        rows = documents.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *_levels(F.col("source"), F.col("lang")))
    else:
        rows = tokens
    taken = F.col("epochs") + F.when(order_key(F.col("epochs"), seed) <= F.col("cut"), 1).otherwise(0)
    rows = (
        rows.join(shares, LEVELS)
        .withColumn("_times", taken)
        .where("_times > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    )
    if whole_rows:
        return rows.select("_row.*")
    return rows.select(
        "doc_id",
        F.col("_domain").alias("domain"),
        F.col("_lang").alias("lang"),
        F.col("_source").alias("source"),
        "n_tokens",
        F.col("_epoch").alias("epoch"),
        order_key(F.col("_epoch"), seed).alias("order_key"),
    )


def _cases(column: str, weights: dict[str, int]) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _split_sql(level: str, path: list[str], weights: dict[str, int], parent: str) -> str:
    up, node, keys = path[:-1], path[-1], ", ".join(path)
    part = f"partition by {', '.join(up)}" if up else ""
    joined = f"join {parent} using ({', '.join(up)})" if up else f"cross join {parent}"
    return f"""
{level}_nodes as (
    select *, {_cases(node, weights)} as weight from (select {keys}, sum(capacity) as capacity from leaves group by {keys}) {joined}
),
{level}_level as (
    select *, capacity * sum(weight) over (w rows between current row and unbounded following)
              <= (budget - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0)) * weight as is_full
    from {level}_nodes window w as ({part} order by capacity::double / weight, {node})
),
{level} as (
    select {keys}, (case when is_full then capacity else ((budget - taken) * weight) // weights end)::hugeint as budget
    from (select *, sum(case when is_full then capacity else 0 end) over ({part}) as taken,
                 sum(case when is_full then 0 else weight end) over ({part}) as weights from {level}_level)
)"""


MIXING_SQL = f"""
with tokens as (
    select doc_id,
           case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
                else 'group' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4) end as domain,
           coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens
    from documents
),
leaves as (
    select domain, lang, source, sum(n_tokens)::hugeint as available, (sum(n_tokens) * {MAX_EPOCHS})::hugeint as capacity
    from tokens group by all
),
total as (select (sum(available) * {BUDGET_PERCENT}) // 100 as budget from leaves),
{_split_sql('a', ['domain'], DOMAIN_WEIGHTS, 'total')},
{_split_sql('b', ['domain', 'lang'], LANG_WEIGHTS, 'a')},
{_split_sql('c', ['domain', 'lang', 'source'], SOURCE_WEIGHTS, 'b')},
shares as (
    select domain, lang, source, case when available = 0 then 0 else budget // available end as epochs,
           budget - (case when available = 0 then 0 else budget // available end) * available as rest
    from c join leaves using (domain, lang, source)
),
running as (
    select *, sum(n_tokens) over (partition by domain, lang, source order by k) as upto
    from (select *, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::varchar, '')) as k from tokens join shares using (domain, lang, source))
),
taken as (
    select *, epochs + (case when rest > 0 and upto <= rest then 1 else 0 end) as times from running
)
select doc_id, domain, lang, source, n_tokens, epoch::bigint as epoch,
       md5('{SEED}:' || epoch || ':' || coalesce(doc_id::varchar, '')) as order_key
from (select *, unnest(range(0, times::bigint)) as epoch from taken where times > 0)
"""
