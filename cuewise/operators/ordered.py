"""Row-to-row results over ordered groups of any length.

A plain window puts a whole group into one task. Here a group is cut into
blocks that follow the order; each block is one window partition, each block
leaves one summary row, and the summaries (rows / block size of them) carry
totals and neighbour values from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_b"
#: Rows of one group above which the group is cut into blocks.
TARGET_ROWS = 1 << 20
#: Blocks of one group at most, and rows drawn per block to find its cuts.
MOST_BLOCKS, SAMPLES = 1 << 12, 64


def fixed_blocks(df: DataFrame, position: str, width: int = 1 << 16) -> DataFrame:
    """Blocks of `width` consecutive positions; for a dense integer order column."""
    return df.withColumn(BLOCK, F.floor(F.col(position) / width))


def density_blocks(df: DataFrame, keys: list[str], order: str, target: int = TARGET_ROWS, tie: str | None = None) -> DataFrame:
    """Blocks of about `target` rows each, by rank on `order` and, among equal values, on `tie`.

    Groups above `target` rows are cut at ranks of a sample drawn by a hash of the row's own order, about `SAMPLES` rows a
    block, so a rerun cuts alike; without `tie`, equal values stay in one block. A group has at most `MOST_BLOCKS`
    blocks, and its cuts travel in a broadcast table of at most rows / target entries in all. Other groups are one block.
    """
    by = [order] if tie is None else [order, tie]
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(by)])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target)
    rows = F.greatest(F.lit(target), F.ceil(F.col("_n") / MOST_BLOCKS))
    rate = F.greatest(F.lit(1).cast("long"), F.floor(rows / SAMPLES))
    sizes = sizes.select(*keys, rate.alias("_rate"), F.floor(rows / rate).alias("_every"))
    drawn = df.select(*dict.fromkeys([*keys, *by])).join(F.broadcast(sizes), keys).where(F.pmod(F.xxhash64(*by), F.col("_rate")) == 0)
    cuts = drawn.groupBy(*keys, "_every").agg(F.array_sort(F.collect_list(at)).alias("_all"))
    cuts = cuts.select(*keys, F.array_distinct(F.filter("_all", lambda x, i: (i > 0) & (i % F.col("_every") == 0))).alias("_cuts"))
    # number of cuts up to the row, by halving
    steps = F.array(*[F.lit(MOST_BLOCKS >> k) for k in range(MOST_BLOCKS.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col("_cuts"), n + step - 1) <= at, n + step).otherwise(n))
    return df.join(F.broadcast(cuts), keys, "left").withColumn(BLOCK, F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(found)).drop("_cuts")


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    number: str | None = None,
    lag: dict[str, str | Column] | None = None,
    lead: dict[str, str | Column] | None = None,
    total: dict[str, str | Column] | None = None,
    peak_before: dict[str, str | Column] | None = None,
    last_known: dict[str, str | Column] | None = None,
    next_known: dict[str, str | Column] | None = None,
) -> DataFrame:
    """Window results over blocked rows (`df` carries the block column).

    number: 1-based row number. lag / lead: neighbour row's value. total:
    running sum up to this row. peak_before: maximum over all earlier rows.
    last_known / next_known: nearest non-null value at or before / after the row.
    `order` lists ascending columns that identify a row within its group.
    """
    part = [*keys, BLOCK]
    rows = df.repartition(*part)
    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*order)

    def col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    local: list[tuple[str, Column]] = []
    summary: list[Column] = []
    carry: list[Column] = []
    final: list[tuple[str, Column]] = []

    def plan(name, in_block, block_value, carried, combine):
        local.append((f"_l_{name}", in_block))
        summary.append(block_value.alias(f"_s_{name}"))
        carry.append(carried.alias(f"_c_{name}"))
        final.append((name, combine))

    if number:
        plan(number, F.row_number().over(w), F.count(F.lit(1)), F.sum(f"_s_{number}").over(earlier),
             F.col(f"_l_{number}") + F.coalesce(F.col(f"_c_{number}"), F.lit(0)))
    for name, c in (lag or {}).items():
        plan(name, F.lag(F.struct(col(c).alias("v"))).over(w), F.max_by(F.struct(col(c).alias("v")), at),
             F.lag(f"_s_{name}").over(blocks), F.coalesce(f"_l_{name}", f"_c_{name}")["v"])
    for name, c in (lead or {}).items():
        plan(name, F.lead(F.struct(col(c).alias("v"))).over(w), F.min_by(F.struct(col(c).alias("v")), at),
             F.lead(f"_s_{name}").over(blocks), F.coalesce(f"_l_{name}", f"_c_{name}")["v"])
    for name, c in (total or {}).items():
        plan(name, F.sum(col(c)).over(upto), F.sum(col(c)), F.sum(f"_s_{name}").over(earlier),
             F.when(F.col(f"_c_{name}").isNull(), F.col(f"_l_{name}"))
             .otherwise(F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.col(f"_c_{name}")))
    for name, c in (peak_before or {}).items():
        plan(name, F.max(col(c)).over(before), F.max(col(c)), F.max(f"_s_{name}").over(earlier),
             F.greatest(f"_l_{name}", f"_c_{name}"))
    for name, c in (last_known or {}).items():
        plan(name, F.last(col(c), True).over(upto), F.max_by(col(c), F.when(col(c).isNotNull(), at)),
             F.last(f"_s_{name}", True).over(earlier), F.coalesce(f"_l_{name}", f"_c_{name}"))
    for name, c in (next_known or {}).items():
        plan(name, F.first(col(c), True).over(onward), F.min_by(col(c), F.when(col(c).isNotNull(), at)),
             F.first(f"_s_{name}", True).over(later), F.coalesce(f"_l_{name}", f"_c_{name}"))

    carried = rows.groupBy(*part).agg(*summary).select(*part, *carry)
    out = rows.select("*", *[c.alias(n) for n, c in local]).join(carried, part, "left")
    kept = [c for c in df.columns if c != BLOCK]
    return out.select(*part, *[c for c in kept if c not in keys], *[c.alias(n) for n, c in final])
