"""Joins of tables that grow with the products."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(side: DataFrame) -> DataFrame:
    """A side of a join that is never sent whole to the driver and to every task.

    Sizes are guessed from the files below: rows that were exploded, or texts that were put together, since
    then are many times what the guess says, and so is what would be sent.
    """
    return side.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over four tasks a core, or as many as shuffles have.

    A file of a few MB is read by one or two tasks; where a short row is long to compute, they would do the whole work.
    The number is stated, so small partitions are not put together again.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
