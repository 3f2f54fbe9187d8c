"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed once into cells, one for each combination of source,
language and topic.  The cells' token weights are raked to the target shares
of each margin in turn until every margin is met, and every document is then
kept with the calibrated probability of its cell.  Only cells are shuffled; no
document moves, and no task sees the cells of more than one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.tables import stored

DIMENSIONS = ("source", "lang", "topic")
MAX_ROUNDS = 64
ROUNDS_PER_STEP = 4
TOLERANCE = 1e-6
BILLION = 1_000_000_000


def tokens(text: Column) -> Column:
    """Words between white space plus one end mark, so that no document weighs nothing."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long") + 1


def topic(text: Column) -> Column:
    """A coarse register, told by layout marks and then by length in characters."""
    size = F.coalesce(F.length(text), F.lit(0))
    return (F.when(text.contains(" | "), "table").when(text.contains("!! "), "shout").when(text.contains("%%% "), "symbols")
            .when(size < 500, "short").when(size < 4000, "medium").otherwise("long"))


def tempered(cells: DataFrame, dimension: str, exponent: float = 0.5) -> DataFrame:
    """``value, share``: the margin's own shares raised to ``exponent``, which lifts small categories."""
    margin = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("weight").alias("w"))
    return margin.select("value", F.pow(F.col("w").cast("double"), F.lit(exponent)).alias("share"))


def residual(held: DataFrame, names: Sequence[str]) -> float:
    """How far the worst margin is from its goal, as a share of the goal."""
    off = [F.abs(F.sum("fitted").over(Window.partitionBy(name)) / F.col(f"_goal_{name}") - 1) for name in names]
    far = F.greatest(F.lit(0.0), *(F.coalesce(x, F.lit(0.0)) for x in off))
    return held.select(far.alias("far")).agg(F.max("far")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``fitted``: weights whose margins are the target shares.

    ``targets`` holds ``value, share`` for each dimension; shares are scaled
    to one over the values that occur.  A value without a positive target
    keeps its weight.  The total weight is kept.  No cells give no rows.
    Rounds end when no margin is further than ``tolerance`` of its goal away,
    looked at after every fourth; empty cells can make targets contradict each
    other, and then the weights after ``rounds`` rounds are given.
    """
    held = cells.withColumn("fitted", F.col("weight").cast("double"))
    for name, target in targets.items():
        own = target.groupBy(F.col("value").alias(name)).agg(F.max("share").alias("_share")).filter("_share > 0")
        margin = cells.groupBy(name).agg(F.sum("weight").alias("_w")).join(own, name)
        shares, weight = margin.agg(F.sum("_share"), F.sum("_w")).first()
        if shares is not None:
            goal = margin.select(name, (F.col("_share") / F.lit(float(shares)) * F.lit(weight)).alias(f"_goal_{name}"))
            held = held.join(goal, name, "left")
        else:
            held = held.withColumn(f"_goal_{name}", F.lit(None).cast("double"))
    held = stored(held, "cells")
    for turn in range(rounds):
        for name in targets:
            now = F.sum("fitted").over(Window.partitionBy(name))
            held = held.withColumn("fitted", F.coalesce(F.col("fitted") * F.col(f"_goal_{name}") / now, F.col("fitted")))
        if (turn + 1) % ROUNDS_PER_STEP == 0 and turn + 1 < rounds:
            held = stored(held, "cells")
            if residual(held, list(targets)) <= tolerance:
                break
    return held.drop(*(f"_goal_{name}" for name in targets))


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone, so that a document is always decided alike."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))


def cells_of(docs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The token weight of each combination; a null value is a category of its own."""
    return docs.groupBy(*dimensions).agg(F.sum("tokens").alias("weight"))


def with_dimensions(docs: DataFrame) -> DataFrame:
    """The named columns of ``docs`` that mixing looks at, under private names."""
    unknown = F.lit("unknown")
    return docs.withColumns({
        "_tokens": tokens(F.col("text")), "_source": F.coalesce(F.col("source").cast("string"), unknown),
        "_lang": F.coalesce(F.col("lang").cast("string"), unknown), "_topic": topic(F.col("text"))})


def calibration(fitted: DataFrame, keep: float) -> float:
    """The scale at which ``min(1, scale * fitted / weight)`` keeps the share ``keep`` of all tokens.

    Cells that the scale pushes above one are kept whole and the others share
    what is left, which raises the scale; this ends when no further cell is
    pushed, after at most one pass for each cell and mostly after very few.
    Each pass is one aggregation.  A ``keep`` of one or more keeps everything.
    """
    rows = fitted.select("weight", "fitted", (F.col("fitted") / F.col("weight")).alias("factor"))
    scale, pushed = 0.0, -1
    while True:
        whole = F.col("factor") * F.lit(scale) > 1
        total, above, rest, n = rows.agg(
            F.sum("weight"), F.coalesce(F.sum(F.when(whole, F.col("weight"))), F.lit(0)),
            F.sum(F.when(~whole, F.col("fitted"))), F.count_if(whole)).first()
        if n == pushed or not rest:
            return scale if scale and rest else float("inf") if total else 1.0
        scale, pushed = max(scale, (keep * total - above) / rest), n


def mixed(docs: DataFrame, exponent: float = 0.5, rounds: int = MAX_ROUNDS, keep: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with ``_tokens, _topic, _per_billion`` (its probability) and ``_kept``.

    Targets are the tempered margins of the documents themselves.  About the
    share ``keep`` of all tokens is sampled; cells that would need more than
    all their documents are kept whole.  Null texts count as empty, null
    sources and languages as ``unknown``, rows may repeat, a row with a null
    id is decided like any other, and other columns pass through; one that is
    named like a column added here gives way to it.
    """
    marked = with_dimensions(docs.drop("_per_billion", "_kept"))
    flat = marked.select(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS), F.col("_tokens").alias("tokens"))
    cells = stored(cells_of(flat, DIMENSIONS), "weights")
    fitted = stored(rake(cells, {d: tempered(cells, d, exponent) for d in DIMENSIONS}, rounds), "fitted")
    chance = F.round(F.least(F.lit(calibration(fitted, keep)) * F.col("fitted") / F.col("weight"), F.lit(1.0)) * BILLION).cast("long")
    chances = fitted.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), chance.alias("_per_billion"))
    judged = marked.join(chances, [f"_{d}" for d in DIMENSIONS], "left")
    return judged.withColumn("_kept", uniform(F.col("doc_id")) < F.col("_per_billion") / F.lit(float(BILLION)))
