"""Mixing sources to target weights: budgets down a domain-language-source tree, prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versetime.llm.common import staged

LEVELS = ("domain", "language", "origin")
#: Rows of a leaf in one bucket of its seeded order, on average, and leaves that are broadcast at most.
BUCKET_ROWS, BROADCAST_LEAVES = 256, 50_000
#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixtureWeights:
    """Whole-number weights of the children of each node, by name; others have the default."""

    domain: Mapping[str, int] = field(default_factory=dict)
    language: Mapping[str, int] = field(default_factory=dict)
    origin: Mapping[str, int] = field(default_factory=dict)
    default: int = 1

    def of(self, level: str) -> Column:
        named = [F.when(F.col(level) == k, F.lit(v)) for k, v in getattr(self, level).items()]
        return F.coalesce(*named, F.lit(self.default)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, none above its ``capacity``.

    What a child cannot take goes to its siblings by their weights.  Children in order of capacity for their
    weight fill up first; the first that does not fill shares the rest with all after it.  The sums are whole
    numbers, so shares are rounded down.  Adds ``given``.
    """
    n = "decimal(38,0)"
    capacity, weight, budget = (F.col(c).cast(n) for c in ("capacity", "weight", "budget"))
    ordered = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name)
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
    rows = children.where("weight > 0").withColumns({
        "rest": budget - F.coalesce(F.sum(capacity).over(before), F.lit(0)).cast(n),
        "rest_weight": F.sum(weight).over(whole).cast(n) - F.coalesce(F.sum(weight).over(before), F.lit(0)).cast(n),
    })
    rows = rows.withColumn("full", capacity.cast("decimal(20,0)") * F.col("rest_weight").cast("decimal(18,0)") <= weight.cast("decimal(18,0)") * F.col("rest").cast("decimal(20,0)"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0))
    left_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    exact = F.expr("cast(cast(left_tokens as decimal(20,0)) * cast(weight as decimal(18,0)) div cast(left_weight as decimal(18,0)) as bigint)")
    return rows.withColumns({"left_tokens": left, "left_weight": left_weight}).withColumn(
        "given", F.when(F.col("full"), F.col("capacity")).otherwise(exact)
    ).drop("rest", "rest_weight", "full", "left_tokens", "left_weight")


def leaf_budgets(leaves: DataFrame, weights: MixtureWeights, budget: int, max_epochs: int) -> DataFrame:
    """Budgets ``given`` of the leaves ``(domain, language, origin, tokens, docs)``, from the root down.

    A node's capacity is that of its leaves, ``max_epochs`` times their tokens, and none is given more.  So a
    shortage is made up by the siblings of the node where it arises, and reaches an ancestor's siblings only
    if they have nothing left.
    """
    given = None
    for i, level in enumerate(LEVELS):
        above, own = list(LEVELS[:i]), list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).alias("capacity"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        if above:
            nodes = nodes.join(given.select(*above, F.col("given").alias("budget")), above)
        else:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        given = shared_out(nodes.withColumn("weight", weights.of(level)), above or [F.lit(0)], level)
    return given.select(*LEVELS, "tokens", "docs", "given")


def mix(
    docs: DataFrame, domain: Column, weights: MixtureWeights, *, budget_percent: int = 80, max_epochs: int = 2, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang", origin_col: str = "source", keep: list[str] | None = None, stage_rows: bool = True,
) -> DataFrame:
    """The rows of ``docs`` that make up the mixture, once an epoch, with ``domain, language, origin, n_tokens, epoch``.

    Of the columns of ``docs`` those in ``keep`` stay, or all.  They are written to the shared folder with each row's
    words counted, so texts are read once; without ``stage_rows`` the counts are written alone and the words of rows
    that stay are counted again, which spares the disk a copy of them.

    ``budget_percent`` of all tokens (words) are given out; see :func:`leaf_budgets`.  A leaf's budget is whole
    epochs of its rows and a token-prefix of one more, whose order is that of a hash of seed, epoch and id.
    To find where the prefix ends, a leaf's rows are counted in buckets of that order: those before the cut
    are in, those after it out, and only the bucket of the cut is sorted, so that no task sorts a leaf.

    Null languages and sources are ``und`` and ``unknown``; null texts have no tokens; null ids are ordered by
    their text; rows that repeat are each counted; ties go by id and tokens; an empty table gives no rows.
    Columns of ``docs`` named as an output are replaced.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c not in (*LEVELS, "n_tokens", "epoch")]
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.encode(text_col, "UTF-8")), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(c) for c in columns)).alias("_row") if columns else F.lit(None).cast("int").alias("_row"), F.col(id_col).alias("_id"), name.alias("_name"), domain.alias("domain"),
        F.coalesce(F.col(language_col), F.lit("und")).alias("language"), F.coalesce(F.col(origin_col), F.lit("unknown")).alias("origin"), word_count(F.col(text_col)).alias("n_tokens"),
    )
    counted = staged(rows if stage_rows else rows.drop("_row"), "counted")
    rows = counted if stage_rows else rows
    leaves = staged(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    budget = int(leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) * budget_percent // 100
    given = leaf_budgets(leaves, weights, budget, max_epochs)
    positive = F.greatest(F.col("tokens"), F.lit(1))
    plan = staged(
        given.select(*LEVELS, F.expr("given div greatest(tokens, 1)").alias("full"), (F.col("given") % positive).alias("rest"), F.expr(f"greatest(1, docs div {BUCKET_ROWS})").alias("buckets")),
        "plan",
    )
    small = plan.count() <= BROADCAST_LEAVES
    with_plan = lambda own, table: own.join(F.broadcast(table) if small else table, list(LEVELS))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("full").cast("string"), F.lit(":"), "_name").cast("binary"))
    bucket = F.expr("(cast(conv(substr(seeded, 1, 8), 16, 10) as bigint) * buckets) div 4294967296")
    ranked = lambda own, table: with_plan(own, table).withColumn("seeded", order).withColumn("bucket", bucket)
    sums = ranked(counted, plan).groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("own"))
    until = F.sum("own").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    cut = sums.withColumn("until", until).where("until > rest").groupBy(*LEVELS).agg(F.min("bucket").alias("cut"), F.min(F.col("until") - F.col("own")).alias("before"))
    plan = staged(plan.join(cut, list(LEVELS), "left"), "plan")
    kept = [*(F.col(f"_row.`{c}`") for c in columns), *LEVELS, "n_tokens"]
    now = ranked(rows, plan)
    epochs = F.expr("if(bucket < coalesce(cut, buckets), sequence(0L, full), if(full > 0, sequence(0L, full - 1), array()))")
    whole = now.select(*kept, F.explode(epochs).alias("epoch"))
    running = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("seeded", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = now.where("bucket = cut").withColumn("until", F.col("before") + running).where("until <= rest")
    return whole.unionByName(edge.select(*kept, F.col("full").alias("epoch")))
