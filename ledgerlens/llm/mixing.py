"""Operator 4: mixing sources to target weights, by hierarchical budgets.

The leaves of a tree (domain, language, source) hold token counts.  The
budget runs down the tree: a node's children share it by weight, but none
gets more than its subtree can give (tokens times the allowed epochs); what
one child can't take goes to its siblings by their weights, and only what a
whole subtree can't take was never given to it, so its parent's other
children have it.  A leaf then takes whole epochs and, of the next one, the
prefix of a seeded order of its documents.

Order: the MD5 digest of "seed:epoch:doc_id".  The cut is found in two steps,
so no leaf is sorted in one task: token sums per leading 12 bits of the
digest find the part in which the budget ends, and only that part (1/4096 of
the leaf) is ordered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEVELS = ("domain", "lang", "source")
PART_DIGITS = 3                  # hex digits: 4096 parts of a leaf

# Production parameters: domains of the sources, weights, seed.
DOMAINS = (("web", 0, 4), ("news", 5, 9), ("books", 10, 14), ("forum", 15, 19))
WEIGHTS = {
    "domain": {"web": 0.4, "news": 0.25, "books": 0.2, "forum": 0.1, "other": 0.05},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {},
}
DEFAULT_WEIGHT = {"domain": 0.05, "lang": 0.05, "source": 1.0}
SEED = 20

#: Words stand for tokens (runs of anything but space and 0x09-0x0D).
TOKENS = r"cast(coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0) as long)"


def domain_of(source: str = "source") -> Column:
    """The domain a source belongs to by its number; ``other`` without one."""
    number = F.try_element_at(F.regexp_extract_all(F.col(source), F.lit(r"^src([0-9]{1,9})$"), F.lit(1)), F.lit(1)).cast("long")
    out = F.lit("other")
    for name, lo, hi in DOMAINS:
        out = F.when(number.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """Weights are looked up by value; a null value takes the default."""
    out = F.lit(float(DEFAULT_WEIGHT.get(level, 1.0)))
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
    return out


def _same(left: str, right: str, columns) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def budgets(leaves: DataFrame, budget: float, weights: Mapping[str, Mapping[str, float]], epochs: int,
            levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (the levels, tokens) with the tokens each is to give (alloc).

    Siblings fill up like vessels: with x = capacity / weight in ascending
    order, the common level is the largest of (budget - capacities before) /
    (weights from here on), and a child gets min(capacity, weight * level).
    """
    nodes = None
    for k in range(1, len(levels) + 1):
        path = list(levels[:k])
        capacity = (leaves.groupBy(*path).agg((F.sum("tokens") * F.lit(epochs)).cast("double").alias("capacity"))
                    .withColumn("weight", _weight(levels[k - 1], weights)))
        if nodes is None:
            given = capacity.withColumn("given", F.lit(float(budget)))
        else:
            given = (capacity.alias("c").join(nodes.alias("p"), _same("c", "p", path[:-1]))
                     .select("c.*", F.col("p.alloc").alias("given")))
        group = Window.partitionBy(*path[:-1]) if k > 1 else Window.partitionBy(F.lit(0))
        order = group.orderBy(F.try_divide("capacity", "weight").asc_nulls_last(), levels[k - 1])
        before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = (given.withColumn("reach", F.try_divide(F.col("given") - before, onward))
                 .withColumn("level", F.max("reach").over(group))
                 .withColumn("alloc", F.greatest(F.lit(0.0), F.least("capacity", F.col("weight") * F.coalesce("level", F.lit(0.0)))))
                 .select(*path, "alloc"))
    return leaves.alias("l").join(nodes.alias("n"), _same("l", "n", levels)).select("l.*", "n.alloc")


def _digest(seed: int, epoch: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(docs: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
         seed: int = SEED, tokens: str = TOKENS) -> DataFrame:
    """One row per leaf: tokens, alloc, whole (full epochs), cut (last digest
    taken of the next epoch, null: none), cut_take (tokens taken at the cut).

    ``docs`` has doc_id, text, lang, source; the budget is ``share`` of all
    its tokens.
    """
    light = materialize(docs.select("doc_id", domain_of().alias("domain"), "lang", "source", F.expr(tokens).alias("tokens")), "tokens")
    leaves = materialize(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves, share * total, weights, epochs).withColumn("alloc", F.floor(F.col("alloc") + 1e-6).cast("long"))
    given = materialize(given.withColumn("whole", F.coalesce(F.expr("try_divide(alloc, tokens)").cast("long"), F.lit(0)))
                        .withColumn("rest", F.col("alloc") - F.col("whole") * F.col("tokens")), "budgets")
    ordered = (light.alias("d").join(given.where("rest > 0").alias("g"), _same("d", "g", LEVELS))
               .select(*[F.col(f"g.{c}") for c in LEVELS], "doc_id", F.col("d.tokens").alias("size"), "whole", "rest")
               .where("size > 0").withColumn("digest", _digest(seed, "whole"))
               .withColumn("part", F.substring("digest", 1, PART_DIGITS)))
    upto = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (ordered.groupBy(*LEVELS, "part", "rest").agg(F.sum("size").alias("held"))
             .withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
             .where("before < rest and before + held >= rest").select(*LEVELS, "part", "before"))
    inside = Window.partitionBy(*LEVELS).orderBy("digest")
    rows = (ordered.alias("o").join(parts.alias("p"), _same("o", "p", (*LEVELS, "part")))
            .select("o.*", "p.before").groupBy(*LEVELS, "digest", "rest", "before")
            .agg(F.sum("size").alias("size"), F.max("size").alias("one"))          # repeated rows go together
            .withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
            .where("start < rest and start + size >= rest")
            .select(*LEVELS, F.col("digest").alias("cut"), F.least("one", F.col("rest") - F.col("start")).alias("cut_take")))
    return materialize(given.alias("g").join(rows.alias("r"), _same("g", "r", LEVELS), "left")
                       .select("g.*", "r.cut", "r.cut_take"), "plan")


def mix(docs: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
        seed: int = SEED, tokens: str = TOKENS) -> DataFrame:
    """The documents of the mixture, once per epoch they are taken in.

    Returns the rows of ``docs`` (with all their columns) that the mixture
    holds, and mix_domain, mix_epoch, mix_tokens, mix_take (tokens that
    belong to the leaf's prefix: fewer than mix_tokens only at the cut).
    Whole documents are returned; those without tokens never are.  A null
    language or source is a branch of its own with the default weight.
    Repeated rows of a doc_id are taken or left together.  A leaf of weight 0
    gives nothing; an empty table gives an empty mixture.  Columns of ``docs``
    named mix_domain, mix_epoch, mix_tokens or mix_take are overwritten, names
    that start with ``__mix_`` are reserved; any other column is kept.
    """
    leaf = plan(docs, share, epochs, weights, seed, tokens)
    # reserved names: the documents may have columns called like the plan's
    leaf = leaf.select(*[F.col(c).alias(f"__mix_{c}") for c in (*LEVELS, "whole", "cut", "cut_take")])
    same = (F.col("mix_domain") == F.col("__mix_domain")) & F.col("lang").eqNullSafe(F.col("__mix_lang")) & F.col("source").eqNullSafe(F.col("__mix_source"))
    rows = (docs.withColumns({"mix_domain": domain_of(), "mix_tokens": F.expr(tokens)}).join(leaf, same).where("mix_tokens > 0")
            .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), "__mix_whole")))
            .withColumn("__mix_digest", _digest(seed, "mix_epoch")))
    full = F.col("mix_epoch") < F.col("__mix_whole")
    return (rows.where(full | (F.col("__mix_digest") <= F.col("__mix_cut")))
            .withColumn("mix_take", F.when(full | (F.col("__mix_digest") < F.col("__mix_cut")), F.col("mix_tokens")).otherwise(F.col("__mix_cut_take")))
            .drop(*leaf.columns, "__mix_digest"))
