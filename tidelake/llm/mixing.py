"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Weights go down a tree of domain, language and source.  Each level shares its
parent's budget by weight, none getting more than it can give in ``max_epochs``
passes over its tokens; what a short child leaves goes to its siblings by
weight.  A subtree gets its own budget only once its parent's children are
settled, so shortages move to siblings first and to ancestors' siblings only
where a whole subtree is short.

A leaf then gives its documents in a seeded order, a new one for each epoch:
whole epochs, and of the last one the shortest prefix that reaches the budget.
Its end is found without ordering a leaf in one task: tokens are added up in ranges
of the order key, then again in ranges of the one in which the budget runs out, and
so on; each step sees 16 to the power of ``range_digits`` numbers of a leaf, and what
is ordered at last are the rows of one range of the last step.

Defined results: a null domain, language or source is a branch ``(none)``; a
null or empty text has no tokens and comes along where it precedes the end of a
prefix; rows of equal id have equal keys and come or go together; children
without a weight have weight 1, those of weight 0 or less give nothing; an empty
table gives an empty result; columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.runtime import cut, free_name, joinable

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by level and child, the tokens wanted (a share of all, or a number), and passes allowed."""

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    share: float = 0.5
    tokens: int | None = None
    max_epochs: int = 2
    seed: int = 17
    range_digits: int = 2
    range_steps: int = 5


def word_tokens(text: Column) -> Column:
    """Words between white space, as the unit of budgets."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered_domain(source: Column, domains: int = 4) -> Column:
    """A domain for sources named with a number at the end: its remainder by ``domains``; null without one."""
    return F.concat(F.lit("domain"), (F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint") % domains).cast("string"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The seeded order of a leaf's documents in an epoch: a text of hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, mix: Mix) -> Column:
    weight: Column = F.lit(1.0)
    for name, w in sorted(mix.weights.get(level, {}).items()):
        weight = F.when(F.col(level) == name, F.lit(float(w))).otherwise(weight)
    return F.greatest(weight, F.lit(0.0))


def share_out(children: DataFrame, parents: list[str], level: str, mix: Mix) -> DataFrame:
    """Adds ``budget``: each parent's ``given`` among its children by weight, none above its ``room``.

    The children come in the order of room for their weight.  Were all before
    one short, the rest would share what they left at some rate per weight.  That
    rate rises while children are short of it and falls from the first that is
    not, so the highest is the one at which the parent's budget comes out."""
    each = children.withColumn("weight", _weight(level, mix))
    order = Window.partitionBy(*parents).orderBy(F.when(F.col("weight") > 0, F.col("room") / F.col("weight")).asc_nulls_first(), level)
    left = F.col("given") - F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumn("left", left).withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    each = each.withColumn("rate", F.when(F.col("open") > 0, F.col("left") / F.col("open")))
    highest = F.coalesce(F.max("rate").over(Window.partitionBy(*parents)), F.lit(0.0))
    return each.withColumn("budget", F.floor(F.least("room", F.col("weight") * highest)).cast("double")).drop("left", "open", "rate", "weight")


def fill(children: DataFrame, given: float, level: str, mix: Mix) -> DataFrame:
    """As ``share_out`` for the top level, whose children have no parent to be grouped by, so that no task sees
    all of them: the rate is raised while children are short of it, by two sums over all children each time."""
    each = children.withColumn("weight", _weight(level, mix))
    rate = 0.0
    while True:
        short = F.col("room") <= F.col("weight") * rate
        full, open_ = each.where("weight > 0").agg(F.sum(F.when(short, F.col("room"))), F.sum(F.when(~short, F.col("weight")))).first()
        raised = (given - (full or 0.0)) / open_ if open_ else rate
        if raised <= rate:
            break
        rate = raised
    return each.withColumn("budget", F.floor(F.least("room", F.col("weight") * rate)).cast("double")).drop("weight")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Adds to ``leaves(domain, lang, source, tokens)`` what each may give (``room``) and its ``budget``."""
    usable = F.lit(True)
    for level in LEVELS:
        usable = usable & (_weight(level, mix) > 0)
    rooms = cut(leaves.withColumn("room", F.when(usable, F.col("tokens") * mix.max_epochs).otherwise(0).cast("double")))
    total, most = rooms.agg(F.sum("tokens"), F.sum("room")).first()
    wanted = float(mix.tokens) if mix.tokens is not None else float(math.floor(mix.share * (total or 0)))
    part = rooms.groupBy("domain").agg(F.sum("room").alias("room"))
    part = fill(cut(part), min(wanted, most or 0.0), LEVELS[0], mix)
    above = part.select(LEVELS[0], F.col("budget").alias("given"))
    part = rooms.groupBy(*LEVELS[:2]).agg(F.sum("room").alias("room"), F.max("tokens").alias("tokens")).join(above, [LEVELS[0]])
    for depth in range(2, len(LEVELS) + 1):
        part = share_out(part, list(LEVELS[: depth - 1]), LEVELS[depth - 1], mix)
        if depth < len(LEVELS):
            above = part.select(*LEVELS[:depth], F.col("budget").alias("given"))
            part = rooms.groupBy(*LEVELS[: depth + 1]).agg(F.sum("room").alias("room"), F.max("tokens").alias("tokens")).join(above, list(LEVELS[:depth]))
    return part.select(*LEVELS, "tokens", "room", "budget")


def limits(rows: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf of ``rows(doc_id, domain, lang, source, tokens)``: its ``budget``,
    whole epochs (``whole``), and the last key of the epoch after them (``last_key``, null for none)."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, mix).where("tokens > 0 and budget > 0")
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget").cast("long") - F.col("whole") * F.col("tokens"))
    plan = joinable(plan)
    part = rows.join(plan.where("rest > 0").drop("tokens"), list(LEVELS)).withColumn("key", order_key(mix.seed, F.col("whole"), F.col("doc_id")))
    leaf = list(LEVELS)
    leaf_order = Window.partitionBy(*leaf)
    part = cut(part.select(*leaf, "key", "tokens", F.col("rest").alias("need"), F.lit("").alias("begin")))
    for step in range(1, mix.range_steps + 1):
        span = F.substring("key", 1, step * mix.range_digits)
        spans = part.groupBy(*leaf, "need", span.alias("span")).agg(F.sum("tokens").alias("tokens"))
        spans = spans.withColumn("upto", F.sum("tokens").over(leaf_order.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)))
        last = joinable(spans.where("upto >= need and upto - tokens < need").select(*leaf, F.col("span").alias("begin"), (F.col("need") - F.col("upto") + F.col("tokens")).alias("need")))
        part = part.drop("need", "begin").withColumn("begin", span).join(last, [*leaf, "begin"])
    # Rows of equal keys count together, as a range frame has them.
    ends = part.withColumn("upto", F.sum("tokens").over(leaf_order.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    keys = ends.where("upto >= need").groupBy(*leaf).agg(F.min("key").alias("last_key"))
    return plan.drop("room", "rest").join(keys, list(LEVELS), "left").withColumnRenamed("tokens", "leaf_tokens")


def mix_documents(docs: DataFrame, domain: Column, mix: Mix = Mix(), tokens: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The chosen documents with all their columns, once for each epoch that takes them, and
    the struct column ``mixed`` (underscores in front if taken): domain, lang,
    source, tokens, epoch, leaf_tokens and leaf_budget."""
    name = free_name(docs, "mixed")
    none = F.lit("(none)")
    branch = {"domain": F.coalesce(domain, none), "lang": F.coalesce(F.col(lang).cast("string"), none), "source": F.coalesce(F.col(source).cast("string"), none)}
    counted = word_tokens(F.col(text)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), counted.alias("tokens"), *(c.alias(k) for k, c in branch.items())))
    found = joinable(limits(rows, mix))
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), *(c.alias(k) for k, c in branch.items()), *([] if tokens is None else [counted.alias("tokens")]))
    chosen = marked.join(found, list(LEVELS)).withColumn("also", F.coalesce(order_key(mix.seed, F.col("whole"), F.col("doc_id")) <= F.col("last_key"), F.lit(False)))
    chosen = chosen.where((F.col("whole") > 0) | F.col("also"))
    if tokens is None:  # the words of chosen texts only
        chosen = chosen.withColumn("tokens", word_tokens(F.col("row").getField(text)))
    epochs = F.filter(F.sequence(F.lit(0), F.col("whole")), lambda e: (e < F.col("whole")) | F.col("also"))
    chosen = chosen.select("row", *LEVELS, "tokens", F.explode(epochs).alias("epoch"), "leaf_tokens", F.col("budget").cast("long").alias("leaf_budget"))
    return chosen.select("row.*", F.struct(*LEVELS, "tokens", "epoch", "leaf_tokens", "leaf_budget").alias(name))


def oracle(mix: Mix, domain: str, table: str = "documents") -> str:
    """The same choice as SQL for DuckDB: whole leaves ordered, no ranges."""

    def weight(level: str) -> str:
        cases = "".join(f" when {level} = '{k}' then {float(w)!r}" for k, w in sorted(mix.weights.get(level, {}).items()))
        return f"(case{cases} else 1.0 end)" if cases else "1.0"

    def share(source: str, parents: str, level: str) -> str:
        by = f"partition by {parents}" if parents else ""
        order = f"{by} order by case when w > 0 then room / w end asc nulls first, {level}"
        return f"""select *, cast(floor(least(room, w * max(rate) over ({by}))) as double) as budget from (
          select *, (given - coalesce(sum(room) over ({order} rows between unbounded preceding and 1 preceding), 0)) / nullif(sum(w) over ({order} rows between current row and unbounded following), 0) as rate
          from (select *, cast({weight(level)} as double) as w from {source}))"""

    wanted = str(mix.tokens) if mix.tokens is not None else f"floor({mix.share} * sum(tokens))"
    usable = " and ".join(f"{weight(x)} > 0" for x in LEVELS)
    key = f"md5(concat('{mix.seed}:', cast(whole as varchar), ':', coalesce(cast(doc_id as varchar), '')))"
    return f"""with rows_ as (
      select doc_id, coalesce({domain}, '(none)') as domain, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
        cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as tokens from {table}),
    leaves as (select *, cast(case when {usable} then tokens * {mix.max_epochs} else 0 end as double) as room
      from (select domain, lang, source, cast(sum(tokens) as bigint) as tokens from rows_ group by all)),
    root as (select coalesce(least(cast({wanted} as double), sum(room)), 0) as given from leaves),
    d as ({share("(select domain, sum(room) as room, (select given from root) as given from leaves group by domain)", "", "domain")}),
    l as ({share("(select domain, lang, sum(leaves.room) as room, any_value(d.budget) as given from leaves join d using (domain) group by domain, lang)", "domain", "lang")}),
    s as ({share("(select domain, lang, source, tokens, leaves.room, l.budget as given from leaves join l using (domain, lang))", "domain, lang", "source")}),
    plan as (select domain, lang, source, tokens as leaf_tokens, cast(budget as bigint) as leaf_budget, cast(floor(budget / tokens) as integer) as whole from s where tokens > 0 and budget > 0),
    keyed as (select r.*, leaf_tokens, leaf_budget, whole, {key} as key, leaf_budget - whole * leaf_tokens as rest from rows_ r join plan using (domain, lang, source)),
    summed as (select *, sum(tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) as upto,
      sum(tokens) over (partition by domain, lang, source, key) as own from keyed),
    marked as (select *, case when rest > 0 and key <= min(case when upto >= rest then key end) over (partition by domain, lang, source) then whole else whole - 1 end as last_epoch from summed)
    select doc_id, domain, lang, source, tokens as n_tokens, cast(e.epoch as integer) as epoch, leaf_tokens, leaf_budget
    from marked, (select unnest(range(0, {mix.max_epochs + 1})) as epoch) e where e.epoch <= last_epoch"""
