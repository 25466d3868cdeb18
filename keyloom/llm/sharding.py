"""Proportional stratified interleaving of rows into shards.

Rows of a stratum are shuffled by a seeded hash and ranked; a row's fractional rank is its place in
the shuffled stratum as a share of the stratum's size. Sorted by fractional rank, every stretch of
the sequence holds each stratum in proportion, so cutting the sequence into equal runs gives shards
that match the mixture. Both sorts are range-partitioned over all tasks: a stratum with a third of
the rows is spread like any other.

Law ``rows``: row counts of shards differ by one at most, whatever the sizes of rows. Rows are dealt one
by one, so groups of equal texts are not kept together: like any rows they spread over the shards.

Defined results: a null stratum is a stratum of its own; rows with null or equal keys are told apart
by their place only. An empty table gives no rows. All columns are carried; ``shard`` or ``slot`` among
them raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, fresh, global_rank

LAW = "rows"


def shard_rows(df: DataFrame, shards: int = 16, stratum_col: str = "source", key_cols: tuple[str, ...] = ("doc_id",), seed: int = 11) -> DataFrame:
    """Append ``shard`` (int) and ``slot`` (gapless from 0 in a shard) to ``df``; all its columns are carried through two sorts."""
    if {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError("shard and slot are columns already")
    scratch = Scratch(df.sparkSession, "sharding")
    mix, place, own, fraction, first, size, salt = fresh(df, "mix", "place", "own", "fraction", "first", "size", "salt")
    keys = [F.col(f"`{c}`") for c in key_cols]
    named = df.withColumn(own, F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum_col}`").cast("string")), F.lit("")))
    # the salt parts rows with one key (a null id, say), which would otherwise all lie in one range
    mixed = named.withColumn(mix, F.xxhash64(F.lit(seed), *keys)).withColumn(salt, F.monotonically_increasing_id())
    ranked, raw = global_rank(scratch, mixed, [F.col(own), F.col(mix), *keys, F.col(salt)], place)
    ranked = ranked.drop(salt)
    strata = scratch.save(ranked.groupBy(own).agg(F.min(place).alias(first), F.count("*").alias(size)))
    total = int(strata.agg(F.sum(size)).first()[0] or 0)
    # the joined rows are ordered by (fraction, stratum): a fraction is the middle of the row's share
    joined = ranked.join(strata, own).withColumn(fraction, (F.col(place) - F.col(first) + 0.5) / F.col(size))
    spread, _ = global_rank(scratch, joined.drop(first, size, place), [F.col(fraction), F.xxhash64(F.lit(seed), F.col(own)), F.col(mix), *keys], place)
    scratch.drop(raw)
    out = spread.withColumn("shard", F.expr(f"cast((cast({place} as decimal(30,0)) * {shards}) div {max(1, total)} as int)"))
    starts = F.expr(f"cast((cast(shard as decimal(30,0)) * {total} + {shards - 1}) div {shards} as bigint)")
    return out.withColumn("slot", F.col(place) - starts).drop(mix, place, own, fraction)
