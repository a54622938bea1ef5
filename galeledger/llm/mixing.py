"""Mixing sources to target weights by hierarchical budgets.

The sources form a tree, by default domain, language and source. A token budget goes
down the tree: the children of a node share its budget by their weights, but none
gets more than its documents hold in ``epochs`` passes; what a child cannot use goes
to its siblings by their weights, and only what all of them cannot use has been
kept by the parent's siblings, because a node's limit is the sum of its leaves'. With
children in order of limit per weight this is one running sum per level.

Each leaf then takes its budget in tokens from a seeded order of its documents: whole
epochs first, and of the next epoch the documents that begin before the budget is
used up. The order of an epoch is the hash of seed, epoch and id. Positions come from
sums per slice of the hash space, so a source with a third of all documents is not
sorted in one task, and the decision is a cut-off hash per leaf: texts don't move.

Only DataFrame operations are used.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeledger.llm.tables import materialise, packed

EPOCHS = 2
SEED = "mix"
#: Rows of a slice of the largest leaf's order, at most about; a leaf with a third of all
#: rows is so dealt over many tasks.
SLICE_ROWS = 5_000

Level = tuple[str, Column]


def count_words(text: Column) -> Column:
    """Words of a text, as its number of tokens; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    levels: Sequence[Level],
    weights: Mapping[tuple[str, str], int] | None = None,
    total: int | None = None,
    share: float = 1.0,
    epochs: int = EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Rows of ``docs`` with all their columns, and ``mix_epoch`` (in place of a column of
    that name), once per epoch from 1 in which they were chosen.

    ``levels`` are names and expressions from the root down; null names are one child
    called ``''``. ``weights`` maps (level, child) to a whole number, 1 if not listed;
    a child of weight 0 gets nothing. The budget is ``total`` tokens, or ``share`` of the
    tokens of ``docs``; if the tree holds less, all of it is taken. Documents without
    tokens come along if they stand before the cut. Equal rows go together. An empty
    table gives none; a null id hashes as empty text.
    """
    names = [f"__{name}" for name, _ in levels]
    size = count_words(F.col("text")) if tokens is None else tokens
    light = materialise(
        docs.select(
            *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, (_, c) in zip(names, levels)],
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
            size.alias("__tokens"),
        ),
        "mix",
    )
    leaves = materialise(
        light.groupBy(*names).agg(
            F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
        ),
        "leaves",
    )
    whole = leaves.agg(F.sum("tokens").alias("tokens"), F.max("rows").alias("rows")).first()
    budget = float(math.floor((whole["tokens"] or 0) * share) if total is None else total)
    planned = materialise(
        _epochs(_budgets(leaves, names, [n for n, _ in levels], weights or {}, budget, epochs)), "plan"
    )
    digits = max(0, math.ceil(math.log((whole["rows"] or 1) / SLICE_ROWS, 16)))
    cuts = planned.join(_cuts(light, planned, names, digits, seed), names, "left")
    # One row per leaf; written, its size is known to the join with the texts.
    plan = materialise(cuts.select(*names, "full", "cut"), "plan")
    keyed = docs.select(
        packed(docs),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, (_, c) in zip(names, levels)],
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
    )
    joined = keyed.join(plan, names)
    place = _place(seed, F.col("full"), F.col("__id"))
    taken = F.col("full") + F.when(place <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn("__taken", taken).filter("__taken > 0").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "mix_epoch"],
        F.explode(F.sequence(F.lit(1), F.col("__taken").cast("int"))).alias("mix_epoch"),
    )


def _place(seed: str, full: Column, doc_id: Column) -> Column:
    """Where a document stands in the epoch after the ``full`` ones."""
    return F.md5(F.concat_ws(":", F.lit(seed), (full + 1).cast("string"), doc_id))


def _budgets(
    leaves: DataFrame,
    names: list[str],
    labels: list[str],
    weights: Mapping[tuple[str, str], int],
    budget: float,
    epochs: int,
) -> DataFrame:
    """Leaves with their ``budget``, top-down."""
    table = leaves.withColumn("limit", F.col("tokens") * F.lit(epochs))
    above = None
    for depth in range(1, len(names) + 1):
        own, parent = names[:depth], names[: depth - 1]
        level = table.groupBy(*own).agg(F.sum("limit").alias("limit"))
        weight = F.lit(1)
        for (label, child), value in weights.items():
            if label == labels[depth - 1]:
                weight = F.when(F.col(names[depth - 1]) == child, int(value)).otherwise(weight)
        level = level.withColumn("weight", weight.cast("long")).filter("weight > 0")
        level = level.withColumn("share", F.lit(budget)) if above is None else level.join(above, parent)
        above = _fill(level, parent, own[-1]).select(*own, F.col("budget").alias("share"))
    return table.join(above.withColumnRenamed("share", "budget"), names)


def _fill(level: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of children from ``share``, their parent's: by weight, up to the limit."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = group.orderBy(F.col("limit") / F.col("weight"), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    onward = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("share") - F.coalesce(F.sum("limit").over(before), F.lit(0))
    full = F.col("limit") * F.sum("weight").over(onward) <= F.col("weight") * left
    marked = level.withColumn("full", full)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(group), F.lit(0))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    part = (F.col("share") - used) * F.col("weight") / rest
    return marked.withColumn("budget", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(part))


def _epochs(leaves: DataFrame) -> DataFrame:
    """Whole epochs and the tokens left for the next one."""
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    return leaves.withColumn("full", full).withColumn(
        "rest", F.floor(F.col("budget") - F.col("full") * F.col("tokens"))
    )


def _cuts(light: DataFrame, planned: DataFrame, names: list[str], digits: int, seed: str) -> DataFrame:
    """The last place of each leaf that its rest reaches."""
    wanted = planned.filter("rest > 0").select(*names, "full", "rest")
    placed = light.join(wanted, names).withColumn("place", _place(seed, F.col("full"), F.col("__id")))
    # Rows of one place go together.
    rows = placed.groupBy(*names, "rest", "place").agg(F.sum("__tokens").alias("n"))
    sliced = rows.withColumn("slice", F.substring("place", 1, digits) if digits else F.lit(""))
    sums = sliced.groupBy(*names, "slice").agg(F.sum("n").alias("n"))
    leaf = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("begun", F.coalesce(F.sum("n").over(leaf), F.lit(0))).drop("n")
    inner = (
        Window.partitionBy(*names, "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("begun") + F.coalesce(F.sum("n").over(inner), F.lit(0))
    return (
        sliced.join(begun, [*names, "slice"])
        .withColumn("start", start)
        .filter("start < rest")
        .groupBy(*names)
        .agg(F.max("place").alias("cut"))
    )


def default_levels() -> list[Level]:
    """Domain (the source's number modulo 4), language and source of ``documents``."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return [
        ("domain", F.concat(F.lit("domain"), (number % 4).cast("string"))),
        ("lang", F.col("lang")),
        ("source", F.col("source")),
    ]


#: Weights of the registered query; children that are not listed weigh 1.
DEFAULT_WEIGHTS = {("lang", "en"): 3, ("domain", "domain0"): 2}
