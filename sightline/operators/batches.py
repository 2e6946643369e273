"""Slices, chunks and orders of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_index(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``index``: their place, from 0, in the given order (which must be total).

    Rows are dealt by ranges and numbered inside each range; only the ranges' sizes, a row for
    each partition, are added up in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    inside = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    sizes = inside.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    return inside.join(starts, "_range").withColumn("index", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def source_slice(pairs: DataFrame, *, start: int = 0, limit: int | None = None) -> DataFrame:
    """The pairs of ``limit`` sources from the ``start``-th on, in the order of their ids."""
    sources = pairs.select("source_h3").distinct().orderBy("source_h3").offset(start)
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be positive")
        sources = sources.limit(limit)
    return pairs.join(sources, "source_h3", "left_semi")


def limit_per_source(pairs: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` pairs of every source in the given order."""
    rank = F.row_number().over(Window.partitionBy("source_h3").orderBy(*order))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def chunk_ids(sources: DataFrame, size: int, strategy: str = "sequential", *, cost: Column | None = None, parent: Column | None = None) -> DataFrame:
    """``sources`` (``source_h3, lat, lon``) with ``index`` and ``chunk`` of ``size`` sources, by one of the orders

    ``sequential`` (id), ``spatial_sort`` (longitude, latitude, id), ``parent`` (coarse cell, id) or
    ``costly_first`` (largest cost, id).
    """
    orders = {
        "sequential": ["source_h3"], "spatial_sort": ["lon", "lat", "source_h3"],
        "parent": ["_parent", "source_h3"], "costly_first": [F.col("_cost").desc(), "source_h3"],
    }
    if strategy not in orders:
        raise ValueError(f"unknown strategy {strategy!r}")
    none = F.lit(None).cast("string")
    keyed = sources.withColumns({"_cost": none if cost is None else cost, "_parent": none if parent is None else parent})
    indexed = ordered_index(keyed, [F.col(c) if isinstance(c, str) else c for c in orders[strategy]])
    return indexed.withColumn("chunk", F.floor(F.col("index") / F.lit(size))).drop("_cost", "_parent")
