"""Composition of pair factors: coverage-checked joins on the pair key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import scalars as S
from sightline.operators.checks import assert_one_to_one

PAIR = ["source_h3", "target_h3"]


def densify(lookup: DataFrame, sparse: DataFrame, weight: str, completed: DataFrame | None = None) -> DataFrame:
    """All pairs of ``lookup`` with the sparse weight; 0 only where the source is completed, else null."""
    out = lookup.join(sparse.select(*PAIR, weight), PAIR, "left")
    if completed is None:
        return out.withColumn(weight, F.coalesce(weight, F.lit(0.0)))
    done = completed.select("source_h3", F.lit(True).alias("done_")).distinct()
    out = out.join(done, "source_h3", "left")
    return out.withColumn(weight, F.when(F.col(weight).isNull() & F.col("done_"), F.lit(0.0)).otherwise(F.col(weight))).drop("done_")


def compose_static(lookup: DataFrame, terrain: DataFrame, vegetation: DataFrame, *, check: bool = True) -> DataFrame:
    """Static weight of every pair: terrain times vegetation; fails on duplicate or missing factor rows."""
    if check:
        assert_one_to_one({"lookup": lookup, "terrain": terrain, "vegetation": vegetation}, PAIR)
    joined = lookup.join(terrain.select(*PAIR, "weight_terrain"), PAIR, "left").join(vegetation.select(*PAIR, "weight_vegetation"), PAIR, "left")
    return joined.withColumn("weight_static_viewability", S.static_weight(F.col("weight_terrain"), F.col("weight_vegetation")))


def dual_surface(lookup: DataFrame, bare: DataFrame, canopy: DataFrame) -> DataFrame:
    """Bare and canopy sparse supports densified over the land pairs, with the conditional canopy factor."""
    land = lookup.where("source_type = 'land'").select(*PAIR)
    joined = land.join(bare.select(*PAIR, "weight_terrain"), PAIR, "left").join(canopy.select(*PAIR, F.col("weight_terrain").alias("weight_canopy_los_raw")), PAIR, "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("weight_terrain", "weight_canopy_los_raw")})
    los = F.least("weight_canopy_los_raw", "weight_terrain")
    status = F.when(F.col("weight_terrain") == 0, "no_baseline_support_neutral").otherwise("computed_canopy_los")
    return joined.withColumns({"weight_canopy_los": los, "weight_vegetation": S.conditional_canopy(F.col("weight_terrain"), los), "vegetation_status": status})


def observation_geometry(lookup: DataFrame, static: DataFrame, joint: DataFrame) -> DataFrame:
    """Pairs with their weights and a state for each factor; absent rows are unavailable, not zero."""
    out = lookup.join(joint.select(*PAIR, "joint_fraction"), PAIR, "left").join(static.select(*PAIR, "weight_terrain", "weight_vegetation", "weight_static_viewability"), PAIR, "left")
    t, v, s = (F.col(c) for c in ("weight_terrain", "weight_vegetation", "weight_static_viewability"))
    return out.withColumns({
        "terrain_state": S.weight_state(t, t.isNotNull()), "joint_state": S.weight_state(F.col("joint_fraction"), F.col("joint_fraction").isNotNull()),
        "vegetation_state": S.vegetation_state(F.col("source_type"), t, v), "static_state": S.weight_state(s, s.isNotNull()),
    })


def max_merge(partitions: DataFrame, weight: str) -> DataFrame:
    """Repeated pairs merged: largest weight, all flags true, first method by name."""
    return partitions.groupBy(*PAIR).agg(F.max(weight).alias(weight), F.bool_and("visible").alias("visible"), F.min("method").alias("method"))
