"""Plan helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HEAVY_KEYS = 64
HEAVY_SHARE = 0.005


def _is_small(held: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether kept rows are within both bounds, told in one pass."""
    size = F.lit(0)
    for name, kind in held.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        else:
            size = size + 8
    found = held.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def broadcast_checked(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast ``df`` only after measuring its rows and bytes; otherwise leave the join to shuffle.

    The rows are cached while they are measured, so the check costs no second
    evaluation.  Past a bound the kept rows (on disk where memory is short)
    meet the other side in the ordinary shuffle join, with AQE splitting
    skewed partitions, and give the same result.
    """
    held = df.persist()
    return F.broadcast(held) if _is_small(held, max_rows, max_bytes) else held


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], limit: int | str, rank: str = "rank", most: int | None = None
) -> DataFrame:
    """The first ``limit`` rows of each group, ranked from 1.

    With a literal limit Spark cuts each task's rows to the limit before the
    shuffle, so a hot group never travels whole.  When the limit is a column,
    ``most``, a number that no limit exceeds, has the same effect; without it
    groups are first cut within salted sub-groups.
    """
    final = Window.partitionBy(*group).orderBy(*order)
    if isinstance(limit, int) or most is not None:
        ranked = df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= (limit if most is None else most))
        return ranked if isinstance(limit, int) else ranked.filter(F.col(rank) <= F.col(limit))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(64)))
    local = Window.partitionBy(*group, "_salt").orderBy(*order)
    cut = salted.withColumn("_local", F.row_number().over(local)).filter(F.col("_local") <= F.col(limit))
    return (cut.drop("_salt", "_local")
            .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= F.col(limit)))


def heavy_hashes(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of all rows, by a sketch of bounded size.

    The sketch can only err for keys near the share.  A wrong guess costs
    balance or a few copies of a row, never a result.
    """
    sketch = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(HEAVY_KEYS), F.lit(4096))
    found = df.agg(F.count("*").alias("n"), sketch.alias("top")).first()
    return [item["item"] for item in found["top"] or [] if item["count"] >= max(2, share * found["n"])]


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], salts: int, spread_on: str,
    max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner equi-join that no hot key can stall.

    A ``small`` side within both bounds is broadcast, so ``big`` is not
    shuffled at all.  Beyond it, a sketch names the heavy keys of ``big``:
    those are split over ``salts`` tasks and their rows of ``small`` repeated
    once per salt; all other keys are shuffled as they are.  Every pair meets
    once.
    """
    held = small.persist()
    if _is_small(held, max_rows, max_bytes):
        return big.join(F.broadcast(held), keys)
    heavy = heavy_hashes(big, keys)
    hot = F.xxhash64(*keys).isin(heavy) if heavy else F.lit(False)
    left = big.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = held.withColumn("_salt", F.explode(copies))
    return left.join(right, [*keys, "_salt"]).drop("_salt")
